"""Odds arithmetic and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Distance from even odds for HIGH and MEDIUM confidence.
HIGH_MARGIN, MEDIUM_MARGIN = 0.15, 0.05


def implied(line: Column) -> Column:
    line = line.cast("double")
    return F.when(line < 0, -line / (100 - line)).otherwise(F.lit(100.0) / (line + 100))


def fair_pair(p1: Column, p2: Column) -> Column:
    """Two implied probabilities scaled to one; even when both are zero."""
    total = p1 + p2
    even = F.lit(0.5)
    return F.struct(F.coalesce(F.try_divide(p1, total), even).alias("f1"),
                    F.coalesce(F.try_divide(p2, total), even).alias("f2"))


def line_text(line: Column) -> Column:
    return (F.when(line.isNull(), F.lit("N/A"))
            .when(line > 0, F.format_string("+%d", line))
            .otherwise(F.format_string("%d", line)))


def confidence(p: Column) -> Column:
    margin = F.abs(p - 0.5)
    return (F.when(margin >= HIGH_MARGIN, F.lit("HIGH"))
            .when(margin >= MEDIUM_MARGIN, F.lit("MEDIUM")).otherwise(F.lit("LOW")))
