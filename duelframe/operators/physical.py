"""Competitor dimension, records outside the loaded contests, and debut features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import imputation, reshape


def competitor_lookup(sides: DataFrame, competitors: DataFrame) -> DataFrame:
    """Left join to the dimension with the default stance; Spark broadcasts it only below its size limit."""
    facts = competitors.select("side_id", "name", "stance", "height", "reach", "born")
    return sides.join(facts, "side_id", "left").withColumn("stance", F.coalesce("stance", F.lit("Orthodox")))


def _two(pairs: DataFrame, columns: list[str]) -> DataFrame:
    both = [c for n in columns for c in (F.col(n).alias("f1_" + n), F.col("f2")[n].alias("f2_" + n))]
    return pairs.select("contest_id", "contest_date", F.col("side_id").alias("f1_id"), F.col("f2")["side_id"].alias("f2_id"), *both)


def physical_matchups(physical: DataFrame) -> DataFrame:
    columns = list(imputation.PHYSICAL)
    return imputation.physical_diffs(_two(reshape.pair_sides(physical, ["side_id", *columns]), columns))


def running_record(career: DataFrame) -> DataFrame:
    rows = career.select("contest_id", "contest_date", "side_id", F.col("wins_prior").alias("wins"), F.col("losses_prior").alias("losses"))
    return _two(reshape.pair_sides(rows, ["side_id", "wins", "losses"]), ["wins", "losses"]).drop("contest_date", "f1_id", "f2_id")


def prior_career_features(career: DataFrame, competitors: DataFrame) -> DataFrame:
    """Record outside the loaded contests. Uses today's totals, so it knows the future: report only, never a default input."""
    totals = competitors.select("side_id", "total_wins", "total_losses")
    zero = F.lit(0)
    rows = career.join(totals, "side_id").select(
        "contest_id", "contest_date", "side_id", F.greatest(F.col("total_wins") - F.col("wins_prior"), zero).alias("pre_wins"),
        F.greatest(F.col("total_losses") - F.col("losses_prior"), zero).alias("pre_losses"))
    n = F.col("pre_wins") + F.col("pre_losses")
    rows = rows.withColumns({"pre_contests": n, "pre_rate": F.col("pre_wins") / (n + 1)})
    columns = ["pre_wins", "pre_losses", "pre_contests", "pre_rate"]
    two = _two(reshape.pair_sides(rows, ["side_id", *columns]), columns)
    return two.select("contest_id", "f1_pre_wins", "f1_pre_losses", "f2_pre_wins", "f2_pre_losses", "f1_pre_rate", "f2_pre_rate",
                      (F.col("f1_pre_contests") - F.col("f2_pre_contests")).alias("diff_pre_contests"),
                      (F.col("f1_pre_rate") - F.col("f2_pre_rate")).alias("diff_pre_rate"))


def prior_career_at_debut(sides: DataFrame, competitors: DataFrame) -> DataFrame:
    """Total record minus everything in the loaded contests; rate 0.5 when nothing is left."""
    here = sides.groupBy("side_id").agg(F.sum("won").alias("w"), F.sum(1 - F.col("won")).alias("l"))
    left = lambda total, c: F.greatest(F.col(total) - F.coalesce(c, F.lit(0)), F.lit(0))
    wins, losses = left("total_wins", "w"), left("total_losses", "l")
    return competitors.join(here, "side_id", "left").select(
        "side_id", wins.alias("pre_wins"), losses.alias("pre_losses"),
        F.coalesce(F.try_divide(wins.cast("double"), (wins + losses).cast("double")), F.lit(0.5)).alias("pre_win_rate"))


def debut_features(matchups: DataFrame) -> DataFrame:
    n1, n2 = F.col("f1_n_prior"), F.col("f2_n_prior")
    flag = lambda c: c.cast("int")
    first1, first2 = (n1 == 0) & (n2 > 0), (n2 == 0) & (n1 > 0)

    def facing(column: str) -> Column:
        """The number of the experienced side a single debutant meets."""
        return (F.when(first1, F.col("f2_" + column)).when(first2, F.col("f1_" + column)).otherwise(F.lit(0))).cast("double")

    new = {"f1_debut": flag(n1 == 0), "f2_debut": flag(n2 == 0), "any_debut": flag((n1 == 0) | (n2 == 0)),
           "both_debut": flag((n1 == 0) & (n2 == 0)), "f1_early": flag(n1 < 3), "f2_early": flag(n2 < 3),
           "any_early": flag((n1 < 3) | (n2 < 3)), "experience_gap": F.abs(n1 - n2),
           "debut_opp_win_rate": facing("win_rate"), "debut_opp_contests": facing("n_prior")}
    if "f1_elo" in matchups.columns:
        new["debut_opp_elo"] = F.when(first1, F.col("f2_elo")).when(first2, F.col("f1_elo")).otherwise(F.lit(0.0))
    return matchups.withColumns(new)
