"""Spark ML fits: boosted trees, logistic models, stacking, calibration, importance, routing.

Every fit runs on a frame with columns ``features`` (vector), ``y``, ``weight`` and ``fold``.
Out-of-fold scores are produced by fitting on the other folds and scoring one, so no step
collects rows. Features are prepared once and staged by the caller when reused.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import metrics, order_stats
from ..session import stage
from . import isotonic

SEED = 42
# Settings tried by the random search.
SPACE = {"maxDepth": (2, 3, 4), "stepSize": (0.05, 0.1, 0.2), "maxIter": (10, 20), "subsamplingRate": (0.7, 0.85, 1.0),
         "minInstancesPerNode": (5, 20, 50)}


def prepare(df: DataFrame, columns: list[str], label: str = "f1_won", key: str = "contest_id", folds: int | None = 5) -> DataFrame:
    """Null features to zero, assembled; recency weight and balanced folds attached. Dealing folds shuffles all rows, so a fit
    that reads none asks for none."""
    kept = df.select(key, "contest_date", F.col(label).cast("int").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    weighted = metrics.recency_weight_day(kept)
    dealt = weighted if folds is None else metrics.stratified_folds(weighted, "y", key, folds)
    return VectorAssembler(inputCols=columns, outputCol="features").transform(dealt)


def gbt(**settings) -> GBTClassifier:
    options = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "seed": SEED, "subsamplingRate": 0.8, **settings}
    return GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", **options)


def gbt_early_stop(**settings) -> GBTClassifier:
    """Stops when the rows flagged ``held_out`` no longer improve."""
    return gbt(validationIndicatorCol="held_out", validationTol=0.001, **settings)


def logistic(features: str = "features", **settings) -> LogisticRegression:
    options = {"maxIter": 50, "regParam": 0.01, **settings}
    return LogisticRegression(featuresCol=features, labelCol="y", weightCol="weight", **options)


def score(model, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def out_of_fold(make, df: DataFrame, folds: int = 5, name: str = "p") -> DataFrame:
    """Scores of every row by a model that has not seen its fold."""
    parts = [score(make().fit(df.filter(F.col("fold") != k)), df.filter(F.col("fold") == k), name) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- stacking
class Stack:
    """Base models with a logistic model over their scores."""

    def __init__(self, bases: list, meta):
        self.bases, self.meta = bases, meta

    def transform_scores(self, df: DataFrame, name: str = "p") -> DataFrame:
        out = df
        for i, b in enumerate(self.bases):
            out = score(b, out, f"s{i}")
        out = _meta_features(out, len(self.bases))
        return score(self.meta, out, name).drop("meta", *[f"s{i}" for i in range(len(self.bases))])


def _meta_features(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("meta", array_to_vector(F.array(*[F.col(f"s{i}") for i in range(n)])))


def stacking(df: DataFrame, makers: list, key: str = "contest_id", folds: int = 5) -> Stack:
    """Out-of-fold scores of each base, joined by key, feed the meta model; bases are refitted on everything."""
    scored = df
    for i, make in enumerate(makers):
        oof = out_of_fold(make, df, folds, f"s{i}").select(key, f"s{i}")
        scored = scored.join(oof, key)
    meta = logistic("meta", regParam=0.0).fit(_meta_features(scored, len(makers)))
    return Stack([make().fit(df) for make in makers], meta)


# ---------------------------------------------------------------- calibration
def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


class Platt:
    def __init__(self, model):
        self.model = model

    def apply(self, df: DataFrame, source: str = "p", name: str = "p_cal") -> DataFrame:
        one = df.withColumn("cal", array_to_vector(F.array(_logit(F.col(source)))))
        return score(self.model, one, name).drop("cal")


class TwoStage:
    def __init__(self, first: Platt, second: isotonic.Isotonic):
        self.first, self.second = first, second

    def apply(self, df: DataFrame, source: str = "p", name: str = "p_cal") -> DataFrame:
        return self.second.apply(self.first.apply(df, source, "_p1"), "_p1", name).drop("_p1")


def calibrate_platt(oof: DataFrame, source: str = "p") -> Platt:
    one = oof.withColumn("cal", array_to_vector(F.array(_logit(F.col(source)))))
    return Platt(logistic("cal", regParam=0.0).fit(one))


def calibrate_isotonic(oof: DataFrame, source: str = "p") -> isotonic.Isotonic:
    return isotonic.fit(oof, source, "y", "weight")


def calibrate_two_stage(oof: DataFrame, source: str = "p") -> TwoStage:
    first = calibrate_platt(oof, source)
    return TwoStage(first, calibrate_isotonic(first.apply(oof, source, "_p1"), "_p1"))


# ---------------------------------------------------------------- search and selection
def random_search(df: DataFrame, tries: int = 50, folds: int = 5, space: dict | None = None, seed: int = SEED, parallelism: int = 8) -> list[tuple[float, dict]]:
    """Random settings by log loss on held-out folds (mean of the folds), best first.

    ``parallelism`` settings are fitted at once. One number per setting reaches the driver.
    """
    draw = random.Random(seed)
    picks = [{k: draw.choice(v) for k, v in (space or SPACE).items()} for _ in range(tries)]
    model = gbt()
    grid = [{model.getParam(k): v for k, v in pick.items()} for pick in picks]
    loss = MulticlassClassificationEvaluator(metricName="logLoss", labelCol="y", probabilityCol="probability")
    dealt = df.withColumn("fold", (F.col("fold") % folds).cast("int"))
    search = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=loss, numFolds=folds, foldCol="fold", parallelism=parallelism)
    return sorted(zip(search.fit(dealt).avgMetrics, picks), key=lambda found: found[0])


def permutation_importance(model, df: DataFrame, columns: list[str], key: str = "contest_id", repeats: int = 10, seed: int = SEED,
                           scoring: str = "log_loss") -> DataFrame:
    """Rise in log loss, or with ``scoring`` "accuracy" fall in the share of right picks, when a column is shuffled.

    A shuffle gives row n the value held by the row numbered n in another hash order. All
    (feature, repeat) variants are exploded and scored in one pass and reduced by one aggregate.
    """
    order = lambda salt: F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(f"{seed}:{salt}")))
    base = df.select(key, "y", *[F.col(c).cast("double").alias(c) for c in columns])
    # Numbered once for all rounds, and scored unshuffled once.
    placed = stage(order_stats.number_rows(base, [], order("place"), "_at"), "placed")
    bad = F.lit(0.0)
    loss = {"log_loss": metrics.row_log_loss(F.col("y"), F.col("p")), "accuracy": (metrics.predicted(F.col("p")) != F.col("y")).cast("double")}[scoring]
    vector = lambda c: array_to_vector(F.array(*[F.col("_d_" + x if x == c else x) for x in columns]))
    total = None
    for r in range(repeats):
        donor = order_stats.number_rows(base, [], order(r), "_at").select("_at", *[F.col(c).alias("_d_" + c) for c in columns])
        both = placed.join(donor, "_at")
        variants = F.array(*[F.struct(F.lit(c).alias("feature"), vector(c).alias("features")) for c in columns])
        rows = both.select("y", F.explode(variants).alias("v")).select("y", "v.*", F.lit(r).alias("round"))
        losses = score(model, rows).groupBy("round", "feature").agg(F.avg(loss).alias("loss"))
        total = losses if total is None else total.unionByName(losses)
    start = score(model, placed.select("y", vector(None).alias("features"))).agg(F.avg(loss).alias("_base"))
    drop = total.join(F.broadcast(start)).withColumn("drop", F.col("loss") - F.col("_base"))
    return drop.groupBy("feature").agg(F.avg("drop").alias("importance"), F.coalesce(F.stddev_pop("drop"), bad).alias("std"))


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def debut_routing(main, debut, df: DataFrame, is_debut: Column, name: str = "p") -> DataFrame:
    """Contests with a debut are scored by the small model, the rest by the main one."""
    both = score(debut, score(main, df, "_pm"), "_pd")
    return both.withColumn(name, F.when(is_debut, F.col("_pd")).otherwise(F.col("_pm"))).drop("_pm", "_pd")


def single_feature_baselines(train: DataFrame, test: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Accuracy and log loss of a logistic model on each small feature list."""
    out = []
    for name, columns in sets.items():
        shape = lambda d: VectorAssembler(inputCols=columns, outputCol="features").transform(d.fillna(0, columns).withColumn("weight", F.lit(1.0)))
        scored = score(logistic(regParam=0.0).fit(shape(train)), shape(test))
        out.append(scored.agg(F.avg((metrics.predicted(F.col("p")) == F.col("y")).cast("double")).alias("accuracy"),
                              F.avg(metrics.row_log_loss(F.col("y"), F.col("p"))).alias("log_loss")).withColumn("baseline", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def tune_k(games_with_elo: DataFrame, cutoff: str) -> DataFrame:
    """Test accuracy and log loss of rating difference alone, per K value; the best by accuracy is marked."""
    ks = [r[0] for r in games_with_elo.select("k").distinct().orderBy("k").collect()]
    rows = []
    for k in ks:
        one = games_with_elo.filter(F.col("k") == k).select("contest_date", (F.col("score") == 1).cast("int").alias("y"), "diff_elo").filter("y IS NOT NULL")
        at = F.lit(cutoff).cast("date")
        rows.append(single_feature_baselines(one.filter(F.col("contest_date") < at), one.filter(F.col("contest_date") >= at), {"elo": ["diff_elo"]})
                    .select(F.lit(k).alias("k"), "accuracy", "log_loss"))
    table = reduce(DataFrame.unionByName, rows)
    best = table.agg(F.max_by("k", F.struct("accuracy", -F.col("k"))).alias("_best"))
    return table.join(F.broadcast(best)).withColumn("best", F.col("k") == F.col("_best")).drop("_best")


def validate_elo(rated: DataFrame, matchups: DataFrame) -> DataFrame:
    """Accuracy of the rating difference alone and its correlation with the win-rate difference, with pass bands."""
    joined = rated.select("contest_id", "diff_elo").join(matchups.select("contest_id", F.col("f1_won").alias("y"), "diff_win_rate"), "contest_id")
    acc = single_feature_baselines(joined, joined, {"elo": ["diff_elo"]}).select("accuracy")
    row = joined.agg(F.corr("diff_elo", "diff_win_rate").alias("correlation")).join(F.broadcast(acc))
    return row.withColumns({"accuracy_ok": F.col("accuracy").between(0.54, 0.70), "correlation_ok": F.abs("correlation").between(0.3, 0.9)})


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
