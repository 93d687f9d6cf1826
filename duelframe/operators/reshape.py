"""Contest rows to side rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import spec
from ..functions import labels, parsing

# One-hot columns are a schema decision: beyond this many values the column is no category.
# Outcome words that name no winner.
NO_WINNER = ("draw", "no contest", "nc", "unknown")


def explode_sides(contests: DataFrame) -> DataFrame:
    """Two rows per contest with own and opposing numbers; absent numbers count as zero.

    ``detailed`` says whether the record carries per-strike numbers at all. Texts are parsed
    once per contest in a projection below the explode, which only rearranges the results.
    """
    round_no = F.col("round_text").try_cast("int")
    parsed = contests.select(
        "contest_id", "contest_date", "event_name", "division", "method", round_no.alias("round"),
        parsing.elapsed_seconds(round_no, parsing.mmss_seconds(F.col("time_text"))).alias("duration_s"),
        F.col("red_sig_str").isNotNull().alias("detailed"), "winner", "red_id", "blue_id",
        *[e for s in ("red", "blue") for e in (
            parsing.landed_attempted(F.col(f"{s}_sig_str")).alias(f"{s}_sig"),
            parsing.landed_attempted(F.col(f"{s}_total_str")).alias(f"{s}_tot"),
            parsing.landed_attempted(F.col(f"{s}_td")).alias(f"{s}_tds"),
            parsing.first_int(F.col(f"{s}_kd")).alias(f"{s}_kds"),
            parsing.first_int(F.col(f"{s}_sub_att")).alias(f"{s}_subs"),
            parsing.mmss_seconds(F.col(f"{s}_ctrl")).alias(f"{s}_control"))])
    shared = ["contest_id", "contest_date", "event_name", "division", "method", "round", "duration_s", "detailed"]
    # Only a number is exploded: columns that a query does not read are then not parsed for it.
    dealt = parsed.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("_red"))
    side = lambda red, blue: F.when(F.col("_red"), F.col(red)).otherwise(F.col(blue))
    own, other = (lambda f: side("red_" + f, "blue_" + f)), (lambda f: side("blue_" + f, "red_" + f))
    return dealt.select(
        *shared, own("id").alias("side_id"), other("id").alias("opp_id"),
        F.coalesce(F.col("winner") == own("id").cast("string"), F.lit(False)).cast("int").alias("won"), own("kds").alias("kd"),
        *[own(f"{s}.{n}").alias(f"{t}_{n}") for s, t in (("sig", "sig"), ("tot", "tot"), ("tds", "td")) for n in ("landed", "attempted")],
        own("subs").alias("sub_attempts"), own("control").alias("control_s"),
        other("sig.landed").alias("sig_absorbed"), other("sig.attempted").alias("opp_sig_attempted"))


def outcome(winner: Column, f1: Column, f2: Column) -> Column:
    return (F.when(winner == f1.cast("string"), F.lit("f1")).when(winner == f2.cast("string"), F.lit("f2"))
            .when(F.lower(winner) == "draw", F.lit("draw")).otherwise(F.lit("nc")))


def pair_sides(sides: DataFrame, carried: list[str]) -> DataFrame:
    """One row per contest having exactly two sides: every column of the smaller side id, plus struct ``f2``.

    Both sides come from one sort by contest, so the side table is computed once.
    """
    w = Window.partitionBy("contest_id").orderBy("side_id")
    paired = sides.select(
        "*", F.row_number().over(w).alias("_rn"), F.lead(F.struct(*carried), 1).over(w).alias("f2"),
        F.lead("side_id", 2).over(w).alias("_third"))
    return paired.filter("_rn = 1 AND f2 IS NOT NULL AND _third IS NULL").drop("_rn", "_third")


def build_matchups(sides: DataFrame) -> DataFrame:
    """Two sides to one row: ``f1_``, ``f2_`` and ``diff_`` columns plus style, experience and momentum.

    ``f1`` is the side with the smaller id.
    """
    feats = [f for f in spec.SIDE_FEATURES if f.name in sides.columns]
    pairs = pair_sides(sides, ["side_id"] + [f.name for f in feats])
    one = lambda n: F.col(n)
    two = lambda n: F.col("f2")[n]
    columns = ["contest_id", "contest_date", "event_name", "division", "method", "round", "duration_s",
               one("side_id").alias("f1_id"), two("side_id").alias("f2_id"), one("won").alias("f1_won")]
    for f in feats:
        columns += [one(f.name).alias("f1_" + f.name), two(f.name).alias("f2_" + f.name)]
        if f.diff:
            columns.append((one(f.name) - two(f.name)).alias("diff_" + f.name))
    return style_ratios(pairs.select(*columns))


def style_ratios(matchups: DataFrame) -> DataFrame:
    """Strike volume per minute, grappling tendency, experience ratio, momentum difference, where their columns are there."""
    def volume(s: str) -> Column:
        return F.try_divide(F.col(f"{s}_sig_landed_last_5"), F.col(f"{s}_duration_last_5") / 60 + F.lit(0.01))

    def grappling(s: str) -> Column:
        return F.try_divide(F.col(f"{s}_td_landed_last_5"), F.col(f"{s}_sig_landed_last_5") + F.lit(0.01))

    def ratio(s: str) -> Column:
        return F.col(f"{s}_n_prior") / (F.col("f1_n_prior") + F.col("f2_n_prior") + 1)

    both = lambda name, fn: {f"{s}_{name}": fn(s) for s in ("f1", "f2")}
    new: dict[str, Column] = {}
    if {"f1_sig_landed_last_5", "f1_duration_last_5"} <= set(matchups.columns):
        new |= both("strike_volume", volume) | {"diff_strike_volume": volume("f1") - volume("f2")}
    if {"f1_sig_landed_last_5", "f1_td_landed_last_5"} <= set(matchups.columns):
        new |= both("grappling", grappling) | {"diff_grappling": grappling("f1") - grappling("f2")}
    new |= both("experience_ratio", ratio)
    if "diff_win_streak" in matchups.columns:
        new["diff_momentum"] = F.col("diff_win_streak") - F.col("diff_loss_streak")
    return matchups.withColumns(new)


def temporal_flags(matchups: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return matchups.withColumns({
        **{f"{s}_layoff": flag(F.col(f"{s}_days_since_last") > spec.LAYOFF_DAYS) for s in ("f1", "f2")},
        **{f"{s}_new_to_division": flag(F.col(f"{s}_division_prior") <= 2) for s in ("f1", "f2")},
        "is_title": flag(F.col("event_name").rlike("(?i)Title")),
        "contest_year": F.year("contest_date"), "contest_month": F.month("contest_date")})


def one_hot_dynamic(df: DataFrame, column: str, prefix: str, values: list[str] | None = None) -> DataFrame:
    """One 0/1 column per value. Without ``values`` those present are read first; use :func:`one_hot_long` where they are very many."""
    if values is None:
        present = df.select(column).filter(F.col(column).isNotNull()).distinct()
        values = [r[0] for r in present.toLocalIterator()]
    return df.select("*", *[F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(prefix + v) for v in sorted(values)])


def one_hot_long(df: DataFrame, key: str, column: str, prefix: str) -> DataFrame:
    """The ones of the same encoding as (key, feature) rows: any number of values, nothing is read ahead."""
    return df.filter(F.col(column).isNotNull()).select(key, F.concat(F.lit(prefix), F.col(column)).alias("feature"))


def division_column(name: str) -> str:
    return "div_" + name.lower().replace("'", "").replace(" ", "_")


def one_hot_fixed(df: DataFrame, column: str = "division", match: str = "substring") -> DataFrame:
    """Fixed divisions. ``substring`` sets several flags for nested names, ``exact`` at most one."""
    text = F.lower(column)
    test = (lambda d: text.contains(d.lower())) if match == "substring" else (lambda d: text == d.lower())
    return df.withColumns({division_column(d): F.coalesce(test(d), F.lit(False)).cast("int") for d in spec.DIVISIONS})


def temporal_split(df: DataFrame, cutoff: str, column: str = "contest_date") -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff date, and rows on or after it."""
    at = F.lit(cutoff).cast("date")
    return df.filter(F.col(column) < at), df.filter(F.col(column) >= at)


def event_on_or_after(contests: DataFrame, day: str) -> DataFrame:
    """All contests of the first event on or after ``day`` (date, then event name)."""
    later = contests.filter(F.col("contest_date") >= F.lit(day).cast("date"))
    first = later.agg(F.min(F.struct("contest_date", "event_name")).alias("e")).select("e.contest_date", "e.event_name")
    return later.join(F.broadcast(first), ["contest_date", "event_name"], "left_semi")


def fill_missing_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=columns)
