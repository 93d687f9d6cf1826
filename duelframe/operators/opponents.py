"""Opponent strength before each contest, and measures adjusted by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import spec
from ..functions import labels
from . import history
from .history import Prefix, Trailing

KEY = ["side_id"]

#: Skills and adjusted numbers are multiples of one over this power of two. Doubles hold sums of such numbers
#: exactly up to 2 ** 23, in any order, so windows and means do not depend on how rows are dealt to tasks.
UNITS = 1 << 30


def fixed(value: Column) -> Column:
    """``value`` at the nearest multiple of 1 / UNITS."""
    return F.floor(value * F.lit(float(UNITS)) + F.lit(0.5)).cast("double") / F.lit(float(UNITS))


def exact_moments(value: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of fixed-point values from exact integer sums, the same for every order of rows."""
    units = (value * F.lit(float(UNITS))).cast("long")
    n = F.count(value)
    first, second = (F.sum(c.cast("decimal(20,0)")).cast("double") for c in (units, units * units))
    spread = F.when(n > 1, F.greatest(F.lit(0.0), (second - F.try_divide(first * first, n)) / (n - 1)))
    return F.try_divide(first, n) / F.lit(float(UNITS)), F.sqrt(spread) / F.lit(float(UNITS))


def _cap(value: Column, scale: float) -> Column:
    return F.least(value / F.lit(scale), F.lit(1.0))


def own_profiles(sides: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Raw skill scores of each side from contests on strictly earlier dates, and the number of its earlier rows."""
    seen = lambda c: F.when(F.col("detailed"), F.col(c))
    sums = {"_all": F.lit(1), "_won": F.col("won"), "_time": F.col("duration_s"),
            "_dec": labels.is_decision(F.col("method")).cast("int"),
            "_ko_lost": (labels.is_knockout(F.col("method")) & (F.col("won") == 0)).cast("int"),
            "_seen": F.col("detailed").cast("int")}
    sums |= {"_" + c: seen(c) for c in ("sig_landed", "sig_attempted", "sig_absorbed", "kd", "td_landed",
                                        "td_attempted", "control_s", "sub_attempts")}
    measures = [Prefix(k, "sum", e) for k, e in sums.items()] + [Trailing("_form", F.col("won"), 5)]
    rows = history.with_history(sides, KEY, measures, chunks)
    rows = history.at_day_start(rows, KEY, [m.name for m in measures], "d")

    total = lambda c: F.coalesce(F.col("d_" + c), F.lit(0)).cast("double")
    n, seen_n = total("all"), total("seen")
    mean = lambda c: F.try_divide(total(c), seen_n)
    half = F.lit(0.5)
    striking = (0.40 * _cap(mean("sig_landed"), 100.0)
                + 0.30 * F.coalesce(F.try_divide(total("sig_landed"), total("sig_attempted")), half)
                + 0.20 * F.greatest(F.lit(0.0), 1 - mean("sig_absorbed") / 100)
                + 0.10 * _cap(mean("kd"), 3.0))
    grappling = (0.35 * F.coalesce(F.try_divide(total("td_landed"), total("td_attempted")), half)
                 + 0.30 * _cap(mean("td_landed"), 5.0) + 0.25 * _cap(mean("control_s"), 300.0)
                 + 0.10 * _cap(mean("sub_attempts"), 3.0))
    damage = F.when(seen_n > 0, F.greatest(F.lit(0.0), 1 - mean("sig_absorbed") / 100)).otherwise(half)
    durability = (0.40 * F.try_divide(total("dec"), n) + 0.30 * (1 - F.try_divide(total("ko_lost"), n))
                  + 0.20 * damage + 0.10 * _cap(F.try_divide(total("time"), n), 900.0))
    quality = 0.50 * F.try_divide(total("won"), n) + 0.25 * _cap(n, 10.0) + 0.25 * F.col("d_form")
    enough = n >= spec.SKILL_MIN_CONTESTS
    return rows.select(
        *sides.columns,
        F.when(enough & (seen_n > 0), fixed(striking)).alias("own_striking"),
        F.when(enough & (seen_n > 0), fixed(grappling)).alias("own_grappling"),
        F.when(enough, fixed(durability)).alias("own_durability"),
        F.when(n > 0, fixed(quality)).alias("own_quality"), n.cast("long").alias("own_earlier"),
        F.coalesce("_all", F.lit(0)).alias("n_before"))


def opponent_profiles(sides: DataFrame, chunks: DataFrame | None = None, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Attach the opponent's profile: both sides of a contest swap theirs in one pass by contest, ``dealt`` by it if given."""
    scored = own_profiles(sides, chunks)
    if dealt is not None:
        scored = dealt(scored)
    w = Window.partitionBy("contest_id").orderBy("side_id")
    # Column by column, so that only skills which are read are shipped.
    other = lambda c: F.when(F.lead(F.lit(True)).over(w), F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    return scored.select(*sides.columns, "n_before", *[other("own_" + s).alias("raw_opp_" + s) for s in spec.SKILLS],
                         F.coalesce(other("own_earlier"), F.lit(0)).alias("opp_earlier"))


def zscore_skills(profiled: DataFrame, fit_before: str | None = None) -> DataFrame:
    """``opp_*``: 1 + clipped z / 4, neutral 1.0 when unknown; mean and deviation from one aggregate row.

    ``fit_before`` limits the rows behind mean and deviation to dates before a cutoff.
    """
    fitted = profiled.filter(F.col("contest_date") < F.lit(fit_before).cast("date")) if fit_before else profiled
    stats = fitted.agg(*[c.alias(f"_{k}_{s}") for s in spec.SKILLS for k, c in zip(("mean", "std"), exact_moments(F.col("raw_opp_" + s)))])

    def scaled(s: str) -> Column:
        std = F.col(f"_std_{s}")
        std = F.when(std > 0, std).otherwise(F.lit(0.1))
        z = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("raw_opp_" + s) - F.col(f"_mean_{s}")) / std))
        # least and greatest skip nulls, so an unknown score needs its own branch.
        return F.when(F.col("raw_opp_" + s).isNull(), F.lit(1.0)).otherwise(fixed(1 + z * 0.25)).alias("opp_" + s)

    # One row, so joining it to every side is a broadcast of fixed size.
    return profiled.join(F.broadcast(stats)).select(*profiled.columns, *[scaled(s) for s in spec.SKILLS])


def adjust_by_opponent(df: DataFrame) -> DataFrame:
    striking, grappling = F.col("opp_striking"), F.col("opp_grappling")
    by = {**{c: striking for c in ("sig_landed", "sig_attempted", "tot_landed", "tot_attempted")},
          **{c: grappling for c in ("td_landed", "td_attempted", "sub_attempts", "control_s")}}
    return df.withColumns({
        **{c + "_adj": F.col(c) * k for c, k in by.items()},
        "kd_adj": fixed(F.col("kd") * F.sqrt(striking * F.col("opp_durability"))),
        "won_adj": F.col("won") * F.col("opp_quality")})


def adjusted_features(adjusted: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Career and rolling means of the adjusted numbers and of the opponents' skills."""
    measures = [Prefix("_n", "sum", F.lit(1)), Prefix("_won_adj", "sum", F.col("won_adj"))]
    measures += [Prefix("_sum_" + s, "sum", F.col("opp_" + s)) for s in spec.SKILLS]
    rolling = {"adj_win_rate": "won_adj", "opp_striking": "opp_striking", "opp_grappling": "opp_grappling",
               "opp_quality": "opp_quality", "adj_sig_landed": "sig_landed_adj", "adj_td_landed": "td_landed_adj",
               "adj_control": "control_s_adj", "adj_kd": "kd_adj"}
    measures += [Trailing(f"{name}_last_{n}", F.col(c), n) for n in spec.WINDOWS for name, c in rolling.items()]
    out = history.with_history(adjusted, KEY, measures, chunks)
    n = F.coalesce("_n", F.lit(0))
    return fill_adjusted_defaults(out.select(
        *adjusted.columns,
        (F.coalesce("_won_adj", F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("adj_win_rate"),
        *[F.try_divide(F.col("_sum_" + s), F.col("_n")).alias("avg_opp_" + s) for s in spec.SKILLS],
        *[m.name for m in measures if isinstance(m, Trailing)]))


def adjusted_defaults() -> dict[str, float]:
    """Fill values: the debut prior for the career rate, neutral 1 for opponent skills, 0 for the rest."""
    neutral = {f"avg_opp_{s}": 1.0 for s in spec.SKILLS}
    for n in spec.WINDOWS:
        neutral |= {f"{m}_last_{n}": 1.0 if m.startswith("opp_") else 0.0 for m in spec.ADJUSTED_ROLLING}
    return {"adj_win_rate": spec.DEBUT["win_rate"], **neutral}


def fill_adjusted_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({c: v for c, v in adjusted_defaults().items() if c in df.columns})
