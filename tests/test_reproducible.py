"""Results do not depend on how rows are dealt to tasks; direct and indexed name matching agree and stay small."""

import random
from decimal import Decimal

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from duelframe.functions import names
from duelframe.operators import matching, opponents
from duelframe.plans.tables import Tables


def test_feature_table_is_the_same_for_any_partitions(spark, setting):
    def cells(partitions):
        setting("spark.sql.shuffle.partitions", partitions)
        setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
        table = Tables(spark, SF, staged=("sides", "profiled")).feature_table()
        doubles = [f.name for f in table.schema.fields if f.dataType.typeName() == "double"]
        return rows(table, "contest_id", *doubles)
    assert cells(4) == cells(17)


def test_moments_are_exact_in_any_order(spark):
    rng = random.Random(4)
    values = [rng.random() for _ in range(3000)] + [None] * 5
    found = set()
    for parts in (1, 4, 17):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts).select(opponents.fixed(F.col("v")).alias("v"))
        found.add(tuple(df.agg(*opponents.exact_moments(F.col("v"))).first()))
    assert len(found) == 1
    exact = [Decimal(round(v * opponents.UNITS)) / opponents.UNITS for v in values if v is not None]
    mean = sum(exact) / len(exact)
    deviation = (sum((x - mean) ** 2 for x in exact) / (len(exact) - 1)).sqrt()
    got_mean, got_deviation = found.pop()
    assert abs(got_mean - float(mean)) < 1e-12 and abs(got_deviation - float(deviation)) < 1e-12


def test_moments_of_few_values(spark):
    few = lambda values: spark.createDataFrame([(v,) for v in values], "v double").agg(*opponents.exact_moments(F.col("v"))).first()
    assert tuple(few([])) == (None, None) and tuple(few([None])) == (None, None)
    assert tuple(few([0.5])) == (0.5, None) and tuple(few([0.5, 0.5])) == (0.5, 0.0)


def scoped(spark, seed):
    """Names of two cards, some misspelt, one card much larger."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrstmdkbgv") for _ in range(rng.randint(1, 9)))
    left = [(card, f"{word()} {word()}") for card, n in (("x", 60), ("y", 9), ("z", 1)) for _ in range(n)]
    right = [(card, "".join(c for c in n if rng.random() > .15) + rng.choice(["", "é", "ss"])) for card, n in left for _ in range(2)]
    frame = lambda r: spark.createDataFrame(sorted({x for x in r if x[1]}), "card string, key string")
    return frame(left), frame(right)


@pytest.mark.parametrize("threshold", [0.6, 0.85])
@pytest.mark.parametrize("direct", [1 << 22, 500, 0])
def test_scoped_names_equal_all_pairs(spark, monkeypatch, threshold, direct):
    monkeypatch.setattr(matching, "DIRECT", direct)
    left, right = scoped(spark, 3)
    every = left.withColumnRenamed("key", "left_key").join(right.withColumnRenamed("key", "right_key"), "card")
    expected = every.filter(names.edit_similarity(F.col("left_key"), F.col("right_key")) >= threshold)
    found = matching.scoped_names(left, right, "edit", threshold, ["card"])
    assert rows(found, "card", "left_key", "right_key") == rows(expected, "card", "left_key", "right_key")


def test_letter_bounds_leave_few_candidates(spark):
    left, right = scoped(spark, 5)
    every = left.join(right.withColumnRenamed("key", "other"), "card").count()
    strict, loose = (matching.bounded_pairs(left, right, "edit", t, ["card"]).count() for t in (0.85, 0.6))
    assert strict < every / 10 and loose < every / 2
