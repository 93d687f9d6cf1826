"""Outcome, experience and card labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def is_knockout(method: Column) -> Column:
    return _has(method, "KO|TKO")


def is_submission(method: Column) -> Column:
    return _has(method, "Submission")


def is_decision(method: Column) -> Column:
    return _has(method, "Decision")


def is_draw(method: Column) -> Column:
    return _has(method, "draw")


def is_no_contest(method: Column) -> Column:
    return _has(method, "no contest|nc")


def method_category(method: Column, short_forms: bool = False) -> Column:
    """KO/TKO, Submission, Decision or Other, tested in that order; ``short_forms`` also reads SUB and U-DEC."""
    submission, decision = ("SUB", "DEC") if short_forms else ("Submission", "Decision")
    return (F.when(is_knockout(method), F.lit("KO/TKO"))
            .when(_has(method, submission), F.lit("Submission"))
            .when(_has(method, decision), F.lit("Decision"))
            .otherwise(F.lit("Other")))


def experience_tier(n: Column) -> Column:
    return (F.when(n <= 0, F.lit("debut")).when(n <= 2, F.lit("novice"))
            .when(n <= 5, F.lit("developing")).otherwise(F.lit("established")))


def elo_expected(own: Column, other: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (other - own) / 400.0))


def card_slot(position: Column, size: Column) -> Column:
    """Label of a zero-based place on the card and its section."""
    return F.struct(
        F.when(position == 0, F.lit("Main Event")).when(position == 1, F.lit("Co-Main")).otherwise(F.lit("")).alias("label"),
        F.when(position < F.least(F.lit(5), size), F.lit("main")).otherwise(F.lit("prelim")).alias("section"))
