"""Global order statistics without a single-task sort.

Values are first counted per distinct value (a value held by a third of the rows becomes
one row), then running totals are taken in two levels: over at most 65,537 buckets, and
over the distinct values inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 65_536


def running_before(values: DataFrame, value: str, bucket: Column, sums: list[str]) -> DataFrame:
    """For one row per value, add ``<sum>_before``: totals over all smaller values.

    ``bucket`` must rise with the value and take at most about 65,000 distinct values.
    """
    tagged = values.withColumn("_b", bucket)
    over = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    level1 = tagged.groupBy("_b").agg(*[F.sum(s).alias(s) for s in sums]).select(
        "_b", *[F.coalesce(F.sum(s).over(over), F.lit(0)).alias("_up_" + s) for s in sums])
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    level2 = tagged.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias("_in_" + s) for s in sums])
    return level2.join(level1, "_b").select(
        *values.columns, *[(F.col("_up_" + s) + F.col("_in_" + s)).alias(s + "_before") for s in sums])


def unit_bucket(c: Column) -> Column:
    """Bucket of a value in [0, 1]."""
    return F.floor(c * BUCKETS).cast("int")


def exact_median(df: DataFrame, column: str, bucket: Column) -> DataFrame:
    """One row ``median`` of the non-null values."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    placed = running_before(counted, column, bucket, ["n"])
    total = counted.agg(F.sum("n").alias("_total"))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda at: (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
    return placed.join(F.broadcast(total)).filter(holds(low) | holds(high)).agg(F.avg(column).alias("median"))


def hash_bucket(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int")


def number_rows(df: DataFrame, by: list[str], key: Column, name: str) -> DataFrame:
    """Exact zero-based row number within ``by``, in the order of a hexadecimal hash ``key``.

    ``key`` must be unique per row within ``by``. Rows are numbered inside 65,536 hash
    buckets and shifted by the bucket totals, so a large group spreads over many tasks.
    """
    spots = [*by, "_b"]
    tagged = df.withColumn("_key", key).withColumn("_b", hash_bucket(F.col("_key")))
    over = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = tagged.groupBy(*spots).agg(F.count(F.lit(1)).alias("_n")).select(
        *spots, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_start"))
    inside = tagged.withColumn("_i", F.row_number().over(Window.partitionBy(*spots).orderBy("_key")) - 1)
    return inside.join(starts, spots).select(*df.columns, (F.col("_start") + F.col("_i")).alias(name))
