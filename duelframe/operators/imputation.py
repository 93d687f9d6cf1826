"""Tiered filling of early careers and of missing physical data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import spec
from ..functions import labels, parsing

MEASURES = {"sig_landed": "sig_landed", "sig_absorbed": "sig_absorbed", "td_landed": "td_landed", "duration": "duration_s"}


def division_medians(career: DataFrame) -> DataFrame:
    """Exact medians over rows with six or more earlier contests; all divisions together where one has none.

    The medians are of small integers, so the partial aggregates hold value counts, not rows.
    """
    seasoned = F.col("n_prior") >= spec.RELIABLE_CONTESTS
    value = lambda c: F.when(seasoned, F.col(c))
    # One pass: the rollup adds the all-divisions row, which a window over the few result rows hands out.
    levels = career.rollup("division").agg(F.grouping_id().alias("_all"), *[F.median(value(c)).alias(m) for m, c in MEASURES.items()])
    everywhere = Window.partitionBy()
    filled = levels.select("division", "_all", *[
        F.coalesce(m, F.max(F.when(F.col("_all") == 1, F.col(m))).over(everywhere)).alias("med_" + m) for m in MEASURES])
    return filled.filter("_all = 0").drop("_all")


def impute_early_career(career: DataFrame, medians: DataFrame) -> DataFrame:
    """Debuts get priors and medians; one or two earlier contests blend strikes with the median.

    ``medians`` has one row per division, so Spark joins it by broadcast when it is small.
    """
    n = F.col("n_prior")
    joined = career.join(medians, "division", "left")
    debut, novice = n == 0, n.isin(1, 2)
    new: dict[str, Column] = {k: F.when(debut, F.lit(v)).otherwise(F.col(k)) for k, v in spec.DEBUT.items()}
    for w in spec.WINDOWS:
        for m in MEASURES:
            column, median = f"{m}_last_{w}", F.coalesce("med_" + m, F.lit(0.0))
            value = F.when(debut, median)
            if m in ("sig_landed", "sig_absorbed"):
                share = n / F.lit(float(w))
                blend = share * F.coalesce(column, F.lit(0.0)) + (1 - share) * median
                value = value.when(novice & (n < w), blend)
            new[column] = value.otherwise(F.col(column))
    new["is_debut"] = debut.cast("int")
    new["completeness"] = completeness(n)
    new["tier"] = labels.experience_tier(n)
    return joined.withColumns(new).drop(*["med_" + m for m in MEASURES])


def completeness(n: Column) -> Column:
    return F.least(n / F.lit(float(spec.RELIABLE_CONTESTS)), F.lit(1.0))


def physical_medians(sides: DataFrame, competitors: DataFrame) -> DataFrame:
    """Median height and reach over the distinct competitors of each division, plus row ``_global``."""
    medians = [F.coalesce(F.median(c), F.lit(spec.PHYSICAL_DEFAULTS[c])).alias(c) for c in ("height", "reach")]
    members = sides.select("division", "side_id").distinct()
    per_division = members.join(competitors, "side_id", "left").groupBy("division").agg(*medians)
    overall = competitors.agg(*medians).select(F.lit("_global").alias("division"), "height", "reach")
    return per_division.unionByName(overall).withColumn("age", F.lit(spec.PHYSICAL_DEFAULTS["age"]))


def impute_physical(sides: DataFrame, competitors: DataFrame, medians: DataFrame) -> DataFrame:
    """Height, reach, age and stance of each side at its contest.

    Own value, else the division's median, else the overall one, else the fixed default.
    The competitor table joins by key; Spark broadcasts it only below its size limit.
    """
    overall = medians.filter("division = '_global'").select(F.col("height").alias("_gh"), F.col("reach").alias("_gr"))
    local = medians.filter("division <> '_global'").select("division", F.col("height").alias("_mh"), F.col("reach").alias("_mr"))
    facts = competitors.select("side_id", F.col("height").alias("_h"), F.col("reach").alias("_r"), "stance", "born")
    rows = (sides.join(facts, "side_id", "left").join(local, "division", "left").join(F.broadcast(overall)))
    fallback = spec.PHYSICAL_DEFAULTS
    stance = F.coalesce("stance", F.lit("Orthodox"))
    age = F.coalesce(parsing.age_at(F.col("contest_date"), F.col("born"), F.lit(fallback["age"])), F.lit(fallback["age"]))
    return rows.select(
        *sides.columns,
        F.coalesce(F.col("_h").cast("double"), "_mh", "_gh", F.lit(fallback["height"])).alias("height"),
        F.coalesce(F.col("_r").cast("double"), "_mr", "_gr", F.lit(fallback["reach"])).alias("reach"),
        age.alias("age"),
        *[(stance == s).cast("int").alias("stance_" + s.lower()) for s in ("Orthodox", "Southpaw", "Switch")])


PHYSICAL = ("height", "reach", "age", "stance_orthodox", "stance_southpaw", "stance_switch")


def physical_diffs(pairs: DataFrame) -> DataFrame:
    """Differences, reach relative to height, and the orthodox-against-southpaw flag."""
    c = F.col
    advantage = lambda s: c(f"{s}_reach") - c(f"{s}_height")
    mixed = lambda a, b: (c(f"{a}_stance_orthodox") == 1) & (c(f"{b}_stance_southpaw") == 1)
    return pairs.withColumns({
        **{f"diff_{x}": c(f"f1_{x}") - c(f"f2_{x}") for x in ("height", "reach", "age")},
        "f1_reach_advantage": advantage("f1"), "f2_reach_advantage": advantage("f2"),
        "diff_reach_advantage": advantage("f1") - advantage("f2"),
        "stance_mismatch": (mixed("f1", "f2") | mixed("f2", "f1")).cast("int")})
