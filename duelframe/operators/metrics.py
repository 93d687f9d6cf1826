"""Model evaluation as aggregation. Input columns: ``y`` (0/1) and ``p`` (probability of 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import order_stats

EPS = 1e-15
# Which metrics count as better when higher, and the named targets.
HIGHER, LOWER = ("accuracy", "roc_auc"), ("log_loss", "brier", "mce")
TARGETS = {"accuracy": 0.62, "log_loss": 0.60, "roc_auc": 0.68, "brier": 0.25}
# Half-life in years, days per year of the daily variant, and the market's accuracy.
HALF_LIFE_YEARS, MARKET_ACCURACY = 8.0, 0.65


def predicted(p: Column) -> Column:
    return (p > 0.5).cast("int")


def row_log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def _hit() -> Column:
    return (predicted(F.col("p")) == F.col("y")).cast("double")


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve with half credit for ties, from counts per distinct score."""
    counts = df.groupBy("p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    placed = order_stats.running_before(counts, "p", order_stats.unit_bucket(F.col("p")), ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return placed.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def binary_metrics(df: DataFrame) -> DataFrame:
    """One row: accuracy, log loss, Brier score, ROC AUC and mean calibration error."""
    y, p = F.col("y"), F.col("p")
    basic = df.agg(F.count(F.lit(1)).alias("n"), F.avg(_hit()).alias("accuracy"), F.avg(row_log_loss(y, p)).alias("log_loss"),
                   F.avg((p - y) * (p - y)).alias("brier"))
    return basic.join(F.broadcast(roc_auc(df))).join(F.broadcast(calibration_error(df).select(F.col("mce_mean").alias("mce"))))


def confusion_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy("y", predicted(F.col("p")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Uniform bins, right edge included, empty ones absent."""
    number = F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0))
    return df.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"),
                                               F.avg(F.col("y").cast("double")).alias("rate"))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean and maximum over bins of |mean prediction - observed rate|; both are called MCE in practice."""
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return calibration_bins(df, bins).agg(F.avg(gap).alias("mce_mean"), F.max(gap).alias("mce_max"))


def accuracy_ceiling(df: DataFrame, bins: int = 10) -> DataFrame:
    """Accuracy when every score is replaced by its bin's outcome rate, against the current one and the market's."""
    number = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    per_bin = df.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.sum(_hit()).alias("hits"))
    best = F.when(F.col("ones") / F.col("n") > 0.5, F.col("ones")).otherwise(F.col("n") - F.col("ones"))
    rates = per_bin.agg((F.sum(best) / F.sum("n")).alias("ceiling"), (F.sum("hits") / F.sum("n")).alias("current"))
    return rates.select("ceiling", "current", (F.col("ceiling") - F.col("current")).alias("headroom"),
                        (F.lit(MARKET_ACCURACY) - F.col("ceiling")).alias("market_gap"))


# Confidence buckets of the two-model comparison.
BUCKETS = ((0.50, 0.55, "50-55%"), (0.55, 0.60, "55-60%"), (0.60, 0.65, "60-65%"), (0.65, 0.70, "65-70%"), (0.70, 1.00, "70%+"))


def bucket_comparison(df: DataFrame) -> DataFrame:
    """Accuracy of scores ``p`` (baseline) and ``p2`` in the baseline's confidence buckets."""
    sure = F.greatest(F.col("p"), 1 - F.col("p"))
    label = F.lit(None).cast("string")
    for low, high, name in reversed(BUCKETS):
        label = F.when((sure >= low) & (sure < high), F.lit(name)).otherwise(label)
    second = (predicted(F.col("p2")) == F.col("y")).cast("double")
    out = df.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(_hit()).alias("base_accuracy"), F.avg(second).alias("other_accuracy"))
    return out.filter("bucket IS NOT NULL").withColumn("improvement", F.col("other_accuracy") - F.col("base_accuracy"))


def recency_weight_year(df: DataFrame, half_life: float = HALF_LIFE_YEARS) -> DataFrame:
    """Halves every ``half_life`` calendar years before the latest year."""
    year = F.year("contest_date")
    latest = df.agg(F.max(year).alias("_latest"))
    return df.join(F.broadcast(latest)).withColumn("weight", F.pow(F.lit(0.5), (F.col("_latest") - year) / half_life)).drop("_latest")


def recency_weight_day(df: DataFrame, half_life: float = HALF_LIFE_YEARS) -> DataFrame:
    latest = df.agg(F.max("contest_date").alias("_latest"))
    ago = F.date_diff("_latest", "contest_date")
    return df.join(F.broadcast(latest)).withColumn("weight", F.exp(-F.log(F.lit(2.0)) / (half_life * 365) * ago)).drop("_latest")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: rows of each label dealt out in hash order, so fold sizes differ by at most one."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    numbered = order_stats.number_rows(df, [label], order, "_i")
    return numbered.withColumn("fold", (F.col("_i") % folds).cast("int")).drop("_i")


def _gram(columns: list[str]):
    """Sums over the rows of a task that have both columns of a pair, by pair."""
    def run(batches):
        d = len(columns)
        sums = np.zeros((4, d, d))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1).reshape(-1, d)
            told = ~np.isnan(x)
            x, there = np.where(told, x, 0.0), told.astype(np.float64)
            sums += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        i, j = np.triu_indices(d, 1)
        n, x, xx, xy = sums
        yield pa.record_batch({"i": pa.array(i), "j": pa.array(j), "n": n[i, j], "x": x[i, j], "y": x[j, i], "xx": xx[i, j], "yy": xx[j, i], "xy": xy[i, j]})
    return run


def correlated_pairs(df: DataFrame, columns: list[str], threshold: float = 0.85) -> DataFrame:
    """Column pairs with absolute Pearson correlation above the threshold, from one pass of Gram matrices.

    Tasks emit one row per pair of columns, which are added up by pair; values are taken from each column's mean on. A row in
    which one of the two is null or NaN does not count for that pair; a pair with a column that does not vary there is left out.
    """
    number = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    means = df.agg(*[F.avg(x).alias(f"_{i}") for i, x in enumerate(number)]).head()
    moved = df.select(*[(x - F.lit(m or 0.0)).alias(f"_{i}") for i, (x, m) in enumerate(zip(number, means))])
    sums = ["n", "x", "y", "xx", "yy", "xy"]
    parts = moved.mapInArrow(_gram(moved.columns), "i long, j long, " + ", ".join(f"{c} double" for c in sums))
    whole = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    spread = lambda a, aa: F.col("n") * F.col(aa) - F.col(a) * F.col(a)
    # A constant column's spread is what rounding leaves.
    varies = (spread("x", "xx") > F.lit(1e-12) * F.col("n") * F.col("xx")) & (spread("y", "yy") > F.lit(1e-12) * F.col("n") * F.col("yy"))
    corr = F.when(varies, F.abs((F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread("x", "xx")) / F.sqrt(spread("y", "yy"))))
    names = F.array(*[F.lit(c) for c in columns])
    return whole.select(names[F.col("i")].alias("left"), names[F.col("j")].alias("right"), corr.alias("corr")).filter(F.col("corr") > threshold)


def prune_features(importance: DataFrame, pairs: DataFrame, limit: int = 5) -> DataFrame:
    """Features kept: positive importance, and not the weaker of one of the first ``limit`` correlated pairs.

    All tables here have one row per feature or pair of features.
    """
    alive = importance.filter("importance > 0").select("feature", "importance")
    left, right = (alive.select(F.col("feature").alias(s), F.col("importance").alias("_" + s)) for s in ("left", "right"))
    first = pairs.join(left, "left").join(right, "right").orderBy(F.desc("corr"), "left", "right").limit(limit)
    weaker = first.select(F.when(F.col("_left") > F.col("_right"), F.col("right")).otherwise(F.col("left")).alias("feature"))
    return alive.join(weaker, "feature", "left_anti")


def interaction_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Product, guarded ratio and absolute difference of every pair of columns."""
    new = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            x, y = F.col(a), F.col(b)
            new |= {f"{a}_x_{b}": x * y, f"{a}_div_{b}": x / (F.abs(y) + 1e-10), f"abs_{a}_minus_{b}": F.abs(x - y)}
    return df.select("*", *[c.alias(n) for n, c in new.items()])


def long_metrics(wide: DataFrame, key: str) -> DataFrame:
    names = [m for m in (*HIGHER, *LOWER) if m in wide.columns]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    return wide.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def compare_candidates(long: DataFrame, baseline: str, min_wins: int = 3,
                       max_drop: dict[str, float] | None = None) -> DataFrame:
    """Wins over the baseline, catastrophic flag and the chosen candidate; ties go to the lower log loss.

    ``long`` has model, metric and value. ``max_drop`` gives the tolerated worsening per metric.
    """
    max_drop = {"accuracy": 0.03, "log_loss": 0.03} if max_drop is None else max_drop
    base = long.filter(F.col("model") == baseline).select("metric", F.col("value").alias("_base"))
    gain = F.when(F.col("metric").isin(*HIGHER), F.col("value") - F.col("_base")).otherwise(F.col("_base") - F.col("value"))
    limit = F.lit(None).cast("double")
    for m, d in max_drop.items():
        limit = F.when(F.col("metric") == m, F.lit(d)).otherwise(limit)
    judged = long.filter(F.col("model") != baseline).join(F.broadcast(base), "metric").groupBy("model").agg(
        F.sum((gain > 0).cast("long")).alias("wins"), F.coalesce(F.max((-gain > limit).cast("int")), F.lit(0)).alias("catastrophic"),
        F.max(F.when(F.col("metric") == "log_loss", F.col("value"))).alias("log_loss"))
    judged = judged.withColumn("beats", (F.col("wins") >= min_wins) & (F.col("catastrophic") == 0))
    best = judged.filter("beats").agg(F.min(F.struct("log_loss", "model"))["model"].alias("_best"))
    return judged.join(F.broadcast(best)).withColumn(
        "chosen", F.coalesce(F.col("model") == F.col("_best"), F.lit(False))).drop("_best")


def target_check(wide: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    targets = targets or TARGETS
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target"),
                     (F.col(m) >= t if m in HIGHER else F.col(m) < t).alias("met")) for m, t in targets.items()]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
