"""The as-of join against a loop over all rows, and backtests that do not see later contests."""

import datetime
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from duelframe.operators import serving
from duelframe.operators.asof import asof_join

DAY = datetime.date(2000, 1, 1)


def sample(spark, seed=1, n=300):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < .03 else DAY + datetime.timedelta(days=rng.randint(0, 60))
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])  # one key holds most rows
    left = [(i, key(), day(), f"note {i % 3}") for i in range(n)] + [(7, 1, DAY, "again")] * 2
    right = [(key(), day(), rng.randint(0, 4), rng.choice([None, "a", "b"])) for _ in range(n)]
    right = list({(k, t, c): (k, t, c, v) for k, t, c, v in right}.values())
    return left, right, spark.createDataFrame(left, "id long, k long, t date, v string"), spark.createDataFrame(right, "k long, t date, c long, note string")


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("cell", [None, 1, 7, 1000])
def test_asof_matches_a_loop(spark, strict, cell):
    left, right, l, r = sample(spark)
    found = asof_join(l, r, ["k"], "t", ["note", "c"], ["c"], strict, cell)
    assert found.columns == ["id", "k", "t", "v", "t_asof", "note", "c"]
    expected = []
    for i, k, t, v in left:
        past = [] if k is None or t is None else [x for x in right if x[0] == k and x[1] is not None and (x[1] < t or not strict and x[1] == t)]
        _, when, c, note = max(past, key=lambda x: (x[1], x[2]), default=(None,) * 4)
        expected.append((i, k, t, v, when, note, c))
    assert rows(found) == sorted(expected, key=str)


def test_asof_of_empty_tables(spark):
    _, _, l, r = sample(spark)
    for cell in (None, 7):
        assert asof_join(l, r.limit(0), ["k"], "t", ["c"], cell_days=cell).where("c IS NOT NULL").count() == 0
        assert asof_join(l.limit(0), r, ["k"], "t", ["c"], cell_days=cell).count() == 0


def test_a_backtest_sees_no_later_contest(t):
    history = t.imputed.select("side_id", "contest_date", "contest_id", "win_rate")
    asked = t.imputed.filter("contest_date >= DATE '1998-01-01'").select("contest_id", "contest_date", "side_id")
    whole = serving.serving_features_asof(asked, history, ["win_rate"])
    early = F.col("contest_date") < F.lit("1999-01-01").cast("date")
    other = history.withColumn("win_rate", F.when(early, F.col("win_rate")).otherwise(F.lit(-1.0)))
    changed = serving.serving_features_asof(asked, other, ["win_rate"])
    assert rows(whole.filter(early)) == rows(changed.filter(early))
    assert rows(whole) != rows(changed)
    assert whole.filter("known").count() > whole.count() / 2
