"""Book prices, consensus and comparison with a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import market

VALUE_POINTS = 5.0


def book_fair(odds: DataFrame) -> DataFrame:
    """Implied and fair probabilities per contest and book, rounded to four places."""
    p1, p2 = market.implied(F.col("f1_line")), market.implied(F.col("f2_line"))
    fair = market.fair_pair(p1, p2)
    return odds.withColumns({"f1_implied": F.round(p1, 4), "f2_implied": F.round(p2, 4),
                             "f1_fair": F.round(fair["f1"], 4), "f2_fair": F.round(fair["f2"], 4)})


def fair_consensus(fair: DataFrame, by: list[str]) -> DataFrame:
    """Average of the books' four-place probabilities, to four places, and the number of books.

    Averaged as whole ten-thousandths, so that halves round up whatever the order of the books.
    """
    mean = lambda c: (F.round(F.avg(F.round(F.col(c) * 10000))) / 10000).alias(c)
    return fair.groupBy(*by).agg(mean("f1_fair"), mean("f2_fair"), F.count(F.lit(1)).alias("sources"))


def odds_board(odds: DataFrame, books: list[str]) -> DataFrame:
    """Contests of each event with every book's prices side by side, ordered by date and event."""
    return odds.groupBy("contest_date", "event_name", "contest_id").pivot("book", books).agg(
        F.first("f1_line").alias("f1"), F.first("f2_line").alias("f2")).orderBy("contest_date", "event_name", "contest_id")


def orient(df: DataFrame, pairs: list[tuple[str, str]], flipped: str = "flipped") -> DataFrame:
    """Swap each (f1, f2) column pair where the contest was matched with its sides reversed."""
    turned = {}
    for a, b in pairs:
        turned[a] = F.when(F.col(flipped), F.col(b)).otherwise(F.col(a))
        turned[b] = F.when(F.col(flipped), F.col(a)).otherwise(F.col(b))
    return df.withColumns(turned)


def edge(p1: Column, fair1: Column, fair2: Column) -> Column:
    """The favoured side's model probability minus its consensus fair probability, to four places."""
    return F.round(F.when(p1 > 0.5, p1 - fair1).otherwise((1 - p1) - fair2), 4)


def model_vs_market(df: DataFrame) -> DataFrame:
    """Edge on side one in percentage points and the flag at five points either way."""
    points = F.round((F.col("p1") - F.col("f1_fair")) * 100, 6)
    flag = (F.when(points >= VALUE_POINTS, "VALUE").when(points <= -VALUE_POINTS, "MODEL DISAGREES").otherwise(""))
    return df.withColumns({"edge_points": points, "flag": flag})


def value_picks(compared: DataFrame) -> DataFrame:
    picks = compared.filter(F.abs("edge_points") >= VALUE_POINTS)
    return picks.withColumn("direction", F.when(F.col("edge_points") > 0, "OVER").otherwise("UNDER")).orderBy(
        F.desc(F.abs("edge_points")), "contest_id")
