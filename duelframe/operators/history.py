"""Ordered history of a key (a competitor, or a competitor inside a division).

Every measure looks at contests *before* the current one, in the total order
``(contest_date, contest_id)``. Two layouts give the same values:

* plain - one window per key, one shuffle, all measures share its sort;
* split - for keys with more than ``duelframe.hotKeyRows`` rows. A hot key's dates are cut
  into chunks of about that many rows, windows run per (key, chunk), running measures
  get the totals of earlier chunks added, and trailing measures see copies of the last
  few rows of the preceding chunks. No task holds the whole history of a hot key.

``hot_chunks`` decides which one is needed from a pre-aggregated count per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import int_setting

HOT_KEY_ROWS = 1_000_000
DAY, ID = "contest_date", "contest_id"


@dataclass(frozen=True)
class Prefix:
    """``sum``, ``max`` or ``min`` of ``expr`` over all earlier rows."""

    name: str
    agg: str
    expr: Column


@dataclass(frozen=True)
class Trailing:
    """Mean of ``expr`` over the last ``n`` earlier rows, null when there are none."""

    name: str
    expr: Column
    n: int


@dataclass(frozen=True)
class Lagged:
    """``expr`` of the row ``n`` places earlier."""

    name: str
    expr: Column
    n: int = 1


@dataclass(frozen=True)
class RecentDays:
    """Rows dated 1 to ``days`` days before the current date."""

    name: str
    days: int


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}
_JOIN = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}


def hot_chunks(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Chunk number per (key, date) for keys above the row bound, or None when there are none.

    Runs one counting job, pre-aggregated per key. The table has one row per date of each
    hot key, so its window over a key never exceeds the number of calendar dates.
    """
    bound = int_setting(df.sparkSession, "duelframe.hotKeyRows", HOT_KEY_ROWS)
    hot = df.groupBy(*keys).count().filter(F.col("count") > bound).select(*keys)
    if hot.isEmpty():
        return None
    daily = df.join(hot, keys, "left_semi").groupBy(*keys, DAY).agg(F.count(F.lit(1)).alias("_rows"))
    over_days = Window.partitionBy(*keys).orderBy(DAY)
    before = F.coalesce(F.sum("_rows").over(over_days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (daily.withColumn("_slot", F.floor(before / bound))
            .select(*keys, DAY, "_rows", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_slot")).alias("_chunk")))


def with_history(df: DataFrame, keys: list[str], measures: list, chunks: DataFrame | None = None) -> DataFrame:
    """Add one column per measure; ``chunks`` comes from :func:`hot_chunks` on the same keys."""
    return _plain(df, keys, measures) if chunks is None else _split(df, keys, measures, chunks)


def _row_measures(measures: list, window) -> list[Column]:
    out = []
    for m in measures:
        if isinstance(m, Prefix):
            out.append(_AGG[m.agg](m.expr).over(window.rowsBetween(Window.unboundedPreceding, -1)).alias(m.name))
        elif isinstance(m, Trailing):
            out.append(F.avg(m.expr).over(window.rowsBetween(-m.n, -1)).alias(m.name))
        elif isinstance(m, Lagged):
            out.append(F.lag(m.expr, m.n).over(window).alias(m.name))
    return out


def _recent(m: RecentDays, keys: list[str], rows: str) -> Column:
    # As SQL text: the frame bounds must be INT for a DATE order, and the date order reuses the row frames' sort.
    frame = f"PARTITION BY {', '.join(keys)} ORDER BY {DAY} RANGE BETWEEN {m.days} PRECEDING AND 1 PRECEDING"
    return F.coalesce(F.expr(f"sum({rows}) OVER ({frame})"), F.lit(0)).alias(m.name)


def _plain(df: DataFrame, keys: list[str], measures: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(DAY, ID)
    out = df.select("*", *_row_measures(measures, w))
    recent = [_recent(m, keys, "1") for m in measures if isinstance(m, RecentDays)]
    # A second select keeps the date-only frame above the row frames, whose sort it can reuse.
    return out.select("*", *recent) if recent else out


def _split(df: DataFrame, keys: list[str], measures: list, chunks: DataFrame) -> DataFrame:
    names = df.columns
    prefixes = [m for m in measures if isinstance(m, Prefix)]
    reach = max([m.n for m in measures if isinstance(m, (Trailing, Lagged))], default=0)
    spots = [*keys, "_chunk"]

    tagged = df.join(chunks.select(*keys, DAY, "_chunk"), [*keys, DAY], "left").select(
        *names, F.coalesce("_chunk", F.lit(0)).alias("_chunk"), F.lit(False).alias("_copy"))
    rows = tagged
    if reach:
        from_end = Window.partitionBy(*spots).orderBy(F.desc(DAY), F.desc(ID))
        tail = (tagged.filter("_chunk > 0").withColumn("_back", F.row_number().over(from_end))
                .filter(F.col("_back") <= reach).drop("_back"))
        later = F.explode(F.sequence(F.col("_chunk") + 1, F.col("_chunk") + reach))
        last = chunks.groupBy(*keys).agg(F.max("_chunk").alias("_last"))
        copies = (tail.select(*names, later.alias("_chunk"), F.lit(True).alias("_copy"))
                  .join(last, keys).filter("_chunk <= _last").drop("_last"))
        rows = tagged.unionByName(copies)

    w = Window.partitionBy(*spots).orderBy(DAY, ID)
    # Copies only serve trailing measures; running measures must not count them.
    own = [Prefix(m.name, m.agg, F.when(~F.col("_copy"), m.expr)) if isinstance(m, Prefix) else m for m in measures]
    out = rows.select(*names, *spots[-1:], "_copy", *_row_measures(own, w)).filter("NOT _copy").drop("_copy")

    if prefixes:
        totals = tagged.filter("_chunk > 0").groupBy(*spots).agg(*[_AGG[m.agg](m.expr).alias(m.name) for m in prefixes])
        before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*spots, *[_AGG[m.agg](m.name).over(before).alias("_c_" + m.name) for m in prefixes])
        out = out.join(carried, spots, "left")
        fixed = {m.name: _JOIN[m.agg](F.col(m.name), F.col("_c_" + m.name)) for m in prefixes}
        out = out.withColumns(fixed).drop(*["_c_" + m.name for m in prefixes])

    recent = [m for m in measures if isinstance(m, RecentDays)]
    if recent:
        daily = df.groupBy(*keys, DAY).agg(F.count(F.lit(1)).alias("_rows"))
        daily = daily.select(*keys, DAY, *[_recent(m, keys, "_rows") for m in recent])
        out = out.join(daily, [*keys, DAY])
    return out.select(*names, *[m.name for m in measures])


def at_day_start(df: DataFrame, keys: list[str], columns: list[str], prefix: str) -> DataFrame:
    """For each column add its value on the key's first contest of the day.

    Applied to "all earlier rows" measures this turns them into "strictly earlier dates".
    The window is per (key, date), so it stays small for hot keys and needs no new shuffle
    after a window over the key.
    """
    w = Window.partitionBy(*keys, DAY).orderBy(ID)
    return df.select("*", *[F.first(c).over(w).alias(prefix + c) for c in columns])
