"""As-of join: the last row of another table before each row, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], ties: list[str] | None = None,
              strict: bool = True, cell_days: int | None = None) -> DataFrame:
    """``left`` with ``values`` and ``<time>_asof`` of the last ``right`` row of its key before ``time`` (a date); null where none is.

    Both tables are united and sorted once by key and time; there is no range join. ``strict`` leaves out right rows at
    the same time. Right rows of one time are told apart by ``ties``, the greatest counts. Rows whose key or time is null
    keep nulls; repeated left rows each stay.

    With ``cell_days`` a key's rows are dealt to cells of so many days, and the last right row of the cells before is
    carried in, so a key with a third of all rows spreads over many tasks.
    """
    ties = ties or []
    columns, taken = left.columns, [f"{time}_asof", *values]
    found = F.struct(F.col(time).alias(f"{time}_asof"), *values)
    seen = right.where(F.col(time).isNotNull()).select(
        *by, F.col(time).alias("_t"), F.lit(1 if strict else 0).alias("_turn"), F.struct(F.lit(0), *ties).alias("_tie"), found.alias("_r"))
    asked = left.select(*by, F.col(time).alias("_t"), F.lit(0 if strict else 1).alias("_turn"), F.struct(*columns).alias("_l"))
    rows = asked.unionByName(seen, allowMissingColumns=True)
    keyed = F.col("_t").isNotNull()
    for k in by:
        keyed = keyed & F.col(k).isNotNull()

    def cell(at: Column) -> Column:
        return F.floor(F.unix_date(at) / cell_days) if cell_days else F.lit(0)
    rows = rows.withColumn("_cell", cell(F.col("_t")))
    upto = Window.partitionBy(*by, "_cell").orderBy("_t", "_turn", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("_last", F.last("_r", ignorenulls=True).over(upto)).where("_l IS NOT NULL")
    if cell_days:
        latest = seen.withColumn("_cell", cell(F.col("_t"))).groupBy(*by, "_cell").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_end"))
        spots = latest.unionByName(told.select(*by, "_cell").distinct(), allowMissingColumns=True).groupBy(*by, "_cell").agg(F.first("_end", ignorenulls=True).alias("_end"))
        earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = spots.select(*by, "_cell", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
        told = told.join(carried, [*by, "_cell"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    last = F.when(keyed, F.col("_last"))
    return told.select(*[F.col("_l")[c].alias(c) for c in columns], *[last[v].alias(v) for v in taken])
