"""Snapshots, serving rows, card places and event documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import asof_join

# Contest numbers to a cell, and contests to a part of an event document.
CELL, PART = 4_096, 500


def card_places(contests: DataFrame, cell: int = CELL) -> DataFrame:
    """Zero-based place on the card and card size, per event date.

    Places are counted within cells of contest numbers and shifted by the sizes of earlier cells, so a date with very
    many contests spreads over many tasks.
    """
    keys = ["contest_date", "_cell"]
    tagged = contests.withColumn("_cell", F.floor(F.col("contest_id") / cell))
    day = Window.partitionBy("contest_date")
    before = day.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("contest_date").alias("_day"), F.col("_cell").alias("_spot"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(day).alias("card_size"))
    inside = tagged.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("contest_id")) - 1)
    met = inside.join(cells, F.col("contest_date").eqNullSafe(F.col("_day")) & (F.col("_cell") == F.col("_spot")))
    return met.select(*contests.columns, (F.col("_start") + F.col("_i")).cast("int").alias("position"), "card_size")


def latest_snapshot(matchups: DataFrame, features: list[str], before: str | None = None) -> DataFrame:
    """Latest feature row of every competitor over both roles, and its number of contests.

    An aggregate per competitor: each task keeps one row per key before the shuffle.
    ``before`` leaves out contests on or after a date, for honest backtests.
    """
    rows = matchups if before is None else matchups.filter(F.col("contest_date") < F.lit(before).cast("date"))
    side = lambda s, first: F.struct(F.col(f"{s}_id").alias("side_id"), F.lit(first).alias("role"), F.col("contest_date"),
                                     F.col("contest_id"), *[F.col(f"{s}_{f}").alias(f) for f in features])
    both = rows.select(F.explode(F.array(side("f1", 1), side("f2", 0))).alias("s"))
    latest = both.groupBy("s.side_id").agg(
        F.max_by("s", F.struct("s.contest_date", "s.contest_id", "s.role")).alias("l"), F.count(F.lit(1)).alias("contests"))
    return latest.select("side_id", F.col("l.contest_date").alias("last_date"), "contests", *[F.col(f"l.{f}") for f in features])


# Features of a competitor without history.
DEBUT_FEATURES = {"win_rate": 0.52, "ko_rate": 0.25, "sub_rate": 0.15, "dec_rate": 0.60, "finish_rate": 0.40,
                  "days_since_last": 365.0, "contests_per_year": 2.0}


def serving_features(upcoming: DataFrame, snapshot: DataFrame, features: list[str]) -> DataFrame:
    """Features of each named side of upcoming contests: its snapshot, else debut defaults, else zero.

    ``upcoming`` has contest_id, contest_date, side_id. The gap since the last contest is
    recomputed only when the date is later than that contest.
    """
    return _served(upcoming.join(snapshot, "side_id", "left"), upcoming.columns, features)


def serving_features_asof(upcoming: DataFrame, history: DataFrame, features: list[str], cell_days: int | None = 730) -> DataFrame:
    """As ``serving_features``, but each contest sees the state of its sides strictly before its own date.

    ``history`` has a row per side and contest: side_id, contest_date, contest_id and the features.
    """
    joined = asof_join(upcoming, history, ["side_id"], "contest_date", features, ["contest_id"], cell_days=cell_days)
    return _served(joined.withColumnRenamed("contest_date_asof", "last_date"), upcoming.columns, features)


def _served(joined: DataFrame, columns: list[str], features: list[str]) -> DataFrame:
    days = F.date_diff("contest_date", "last_date")
    out = {f: F.coalesce(F.col(f).cast("double"), F.lit(float(DEBUT_FEATURES.get(f, 0.0)))) for f in features}
    if "days_since_last" in out:
        out["days_since_last"] = F.when(days > 0, days.cast("double")).otherwise(out["days_since_last"])
    return joined.select(*columns, F.col("last_date").isNotNull().alias("known"), *[c.alias(f) for f, c in out.items()])


def resolve_names(announced: DataFrame, competitors: DataFrame, metric: str = "edit") -> DataFrame:
    """Announced contests (contest_id, contest_date, name_1, name_2) to one row per side with its competitor.

    A name is looked up exactly, then by the best similar name, and otherwise stays unknown: ``how`` is ``exact``,
    ``similar`` or ``debut``, and ``side_id`` null for a debut. Of competitors with one name the smallest id counts.
    """
    from . import matching
    side = lambda r: F.struct(F.lit(r).alias("role"), F.col(f"name_{r}").alias("name"))
    rows = announced.select("contest_id", "contest_date", F.explode(F.array(side(1), side(2))).alias("s")).select("contest_id", "contest_date", "s.*")
    known = competitors.groupBy("name").agg(F.min("side_id").alias("side_id"))
    best = matching.fuzzy_best_match(rows.select("name"), known.select("name"), metric=metric)
    found = best.join(known.withColumnRenamed("name", "match"), "match", "left")
    how = F.when(F.col("score") >= 1, "exact").when(F.col("score").isNotNull(), "similar").otherwise("debut")
    return rows.join(found.select("name", "side_id", how.alias("how")), "name", "left").withColumn("how", F.coalesce("how", F.lit("debut")))


def serving_matchup(sides: DataFrame, features: list[str], model_columns: list[str] | None = None) -> DataFrame:
    """One row per upcoming contest with f1, f2 and diff columns; missing model columns are zero.

    ``sides`` has role 1 and 2 for the two names as announced.
    """
    pick = lambda r, f: F.coalesce(F.max(F.when(F.col("role") == r, F.col(f))), F.lit(0.0))
    wide = sides.groupBy("contest_id", "contest_date").agg(
        *[F.max(F.when(F.col("role") == r, F.col("side_id"))).alias(f"f{r}_id") for r in (1, 2)],
        *[pick(r, f).alias(f"f{r}_{f}") for f in features for r in (1, 2)])
    new = {f"diff_{f}": F.col(f"f1_{f}") - F.col(f"f2_{f}") for f in features}
    if "n_prior" in features:
        total = F.col("f1_n_prior") + F.col("f2_n_prior") + 1
        new |= {f"f{r}_experience_ratio": F.col(f"f{r}_n_prior") / total for r in (1, 2)}
    if {"win_streak", "loss_streak"} <= set(features):
        new["diff_momentum"] = F.col("f1_win_streak") - F.col("f1_loss_streak") - F.col("f2_win_streak") + F.col("f2_loss_streak")
    out = wide.withColumns(new)
    for c in model_columns or []:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0.0))
    return out


def top_factors(df: DataFrame, columns: list[str], k: int = 5, name: str = "factors") -> DataFrame:
    """Add the ``k`` largest non-zero columns by magnitude as an array of (feature, value)."""
    pairs = F.array(*[F.struct((-F.abs(F.col(c).cast("double"))).alias("rank"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    kept = F.filter(pairs, lambda x: x["value"].isNotNull() & (x["value"] != 0))
    best = F.slice(F.array_sort(kept), 1, k)
    return df.withColumn(name, F.transform(best, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"))))


# Bar widths by rank.
WIDTHS = (85, 68, 52, 36, 22)


def factor_rank_widths(df: DataFrame, factors: str = "factors") -> DataFrame:
    """Explode factors into rank, favoured side (positive favours side one) and bar width by rank."""
    widths = F.array(*[F.lit(w) for w in WIDTHS])
    rows = df.select("contest_id", F.posexplode(factors).alias("i", "f"))
    return rows.select("contest_id", (F.col("i") + 1).alias("rank"), "f.feature",
                       F.when(F.col("f.value") > 0, 1).otherwise(2).alias("favours"),
                       F.element_at(widths, F.least(F.col("i") + 1, F.lit(len(WIDTHS)))).alias("width"))


def score_contests(scored: DataFrame, p: Column) -> DataFrame:
    """Probabilities, pick and confidence from a model score of side one."""
    from ..functions import market
    return scored.withColumn("p1", p).withColumns({
        "p2": 1 - F.col("p1"), "predicted": F.when(F.col("p1") > 0.5, F.col("f1_id")).otherwise(F.col("f2_id")),
        "win_probability": F.greatest("p1", 1 - F.col("p1")), "confidence": market.confidence(F.col("p1"))})


def event_documents(contests: DataFrame, part: int = PART) -> DataFrame:
    """One row per event and ``part`` contests, numbered from 0, with the contests in card order."""
    item = F.struct("position", "contest_id", F.round("p1", 3).alias("p1"), F.round(1 - F.col("p1"), 3).alias("p2"), "predicted_winner", "confidence")
    number = F.floor(F.col("position") / part).alias("part")
    return contests.groupBy("event_id", F.col("contest_date").alias("event_date"), number).agg(F.array_sort(F.collect_list(item)).alias("contests"))


def backfill_factors(predictions: DataFrame, matchups: DataFrame, columns: list[str], force: bool = False, k: int = 5) -> DataFrame:
    """Compute factors for predictions that lack them (or all with ``force``); the rest pass unchanged."""
    missing = F.lit(True) if force else (F.coalesce(F.size("factors"), F.lit(0)) <= 0)
    todo = predictions.filter(missing).drop("factors")
    done = predictions.filter(~missing)
    filled = top_factors(todo.join(matchups.select("contest_id", *columns), "contest_id"), columns, k).drop(*columns)
    return done.unionByName(filled)
