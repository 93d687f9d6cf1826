"""Career measures of a side before each contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import spec
from ..functions import labels
from . import history
from .history import Lagged, Prefix, RecentDays, Trailing

KEY = ["side_id"]


def _rate(top: Column, bottom: Column) -> Column:
    return top / F.greatest(bottom, F.lit(1))


def _finish(win: Column) -> Column:
    method = F.col("method")
    return (win & (labels.is_knockout(method) | labels.is_submission(method))).cast("int")


def career_features(sides: DataFrame, chunks: DataFrame | None = None,
                    division_chunks: DataFrame | None = None) -> DataFrame:
    """All counters, rates, streaks, gaps and rolling means in one pass over each competitor's rows."""
    win, method = F.col("won") == 1, F.col("method")
    measures = [
        Prefix("_n", "sum", F.lit(1)),
        Prefix("_wins", "sum", F.col("won")),
        Prefix("_kos", "sum", (win & labels.is_knockout(method)).cast("int")),
        Prefix("_subs", "sum", (win & labels.is_submission(method)).cast("int")),
        Prefix("_decs", "sum", (win & labels.is_decision(method)).cast("int")),
        Prefix("_first_day", "min", F.col("contest_date")),
        Lagged("_last_day", F.col("contest_date")),
        RecentDays("_recent", 364),
    ]
    rolling = {"win_rate": F.col("won"), "finish_rate": _finish(win), "sig_landed": F.col("sig_landed"),
               "sig_absorbed": F.col("sig_absorbed"), "td_landed": F.col("td_landed"), "duration": F.col("duration_s")}
    measures += [Trailing(f"{name}_last_{n}", expr, n) for n in spec.WINDOWS for name, expr in rolling.items()]
    out = history.with_history(sides, KEY, measures, chunks)

    # Streaks: distance to the latest earlier contest with the opposite result.
    zero = F.lit(0)
    out = out.withColumns({"_n": F.coalesce("_n", zero), **{c: F.coalesce(c, zero) for c in ("_wins", "_kos", "_subs", "_decs")}})
    out = history.with_history(out, KEY, [
        Prefix("_last_loss", "max", F.when(~win, F.col("_n"))),
        Prefix("_last_win", "max", F.when(win, F.col("_n")))], chunks)
    out = history.at_day_start(out, KEY, ["_n"], "_before_today")
    out = history.with_history(out, ["side_id", "division"], [Prefix("_division", "sum", F.lit(1))], division_chunks)

    n, wins = F.col("_n"), F.col("_wins")
    days = F.date_diff("contest_date", "_first_day")
    earlier = F.col("_before_today_n")
    names = [c for c in sides.columns]
    return out.select(
        *names,
        n.cast("long").alias("n_prior"), wins.cast("long").alias("wins_prior"), (n - wins).cast("long").alias("losses_prior"),
        _rate(wins, n).alias("win_rate"), _rate(F.col("_kos"), wins).alias("ko_rate"),
        _rate(F.col("_subs"), wins).alias("sub_rate"), _rate(F.col("_decs"), wins).alias("dec_rate"),
        _rate(F.col("_kos") + F.col("_subs"), wins).alias("finish_rate"),
        (n - 1 - F.coalesce("_last_loss", F.lit(-1))).cast("long").alias("win_streak"),
        (n - 1 - F.coalesce("_last_win", F.lit(-1))).cast("long").alias("loss_streak"),
        F.coalesce(F.date_diff("contest_date", "_last_day"), F.lit(spec.DEBUT_GAP_DAYS)).cast("long").alias("days_since_last"),
        F.when(n > 0, F.coalesce(F.try_divide(n.cast("double"), days / F.lit(spec.DAYS_PER_YEAR)), F.lit(0.0))).alias("contests_per_year"),
        F.coalesce("_division", zero).cast("long").alias("division_prior"),
        # The current row counts, the competitor's very first one never does.
        (F.col("_recent") + n - earlier + 1 - (F.col("_recent") == earlier).cast("int")).cast("long").alias("contests_last_365d"),
        (F.col("_recent") + n - earlier).cast("long").alias("prior_contests_365d"),
        *[f"{m}_last_{w}" for w in spec.WINDOWS for m in spec.ROLLING])
