"""Rows travel as bits of a few numbers and come back unchanged, whatever they hold."""

import datetime

from conftest import SF, rows
from duelframe.operators import packing
from duelframe.plans import q_eval, tables as tables_module
from duelframe.plans.tables import Tables

WORDS = [[packing.integer("n", 4), packing.integer("big", 30), packing.day("d"), packing.text("x", ["a", "b", "c"]), packing.flag("f")],
         [packing.share("r", "n", 4), packing.fraction("m", 60, 12), packing.derived("twice", lambda known: known["n"] * 2)]]


def _odd(spark):
    day, inf = datetime.date, float("inf")
    return spark.createDataFrame([
        (1, 3, 5, day(1995, 1, 1), "a", True, 1 / 3, 25.4, 6), (2, 15, (1 << 30) - 1, day(1970, 1, 1), "c", False, 7 / 15, 0.0, 30),
        (3, 16, 1 << 30, day(1969, 12, 31), "d", None, 0.52, 1 / 7, 31), (4, -1, -(1 << 63), day(9999, 12, 31), "", True, -0.5, float("nan"), None),
        (5, None, None, None, None, None, None, None, None), (6, 0, (1 << 63) - 1, day(1, 1, 1), "b", False, inf, -inf, 0), (7, 0, 0, None, "a", True, 0.0, 1e300, 1),
        (8, None, 1, day(2000, 2, 29), None, False, 0.25, 4095 / 60, 2)],
        "k long, n int, big long, d date, x string, f boolean, r double, m double, twice int")


def test_dealt_rows_come_back_unchanged(spark):
    df = _odd(spark)
    out = packing.deal(df, "k", WORDS)
    assert out.schema.simpleString() == df.schema.simpleString() and str(rows(out)) == str(rows(df))


def test_dealt_rows_are_words(spark):
    df = spark.range(100).selectExpr("id AS k", "CAST(id % 15 AS INT) AS n", "date_add(DATE '1995-01-01', CAST(id AS INT)) AS d", "'a' AS x")
    sent = packing.deal(df, "k", WORDS)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].split("\n")[1]
    assert "AS _w0" in sent and "AS n#" not in sent and packing.deal(df, "k", WORDS).filter("n IS NULL OR x <> 'a'").count() == 0


def test_styles_read_written_columns_once_made(spark, monkeypatch):
    """Three medians and the report took four passes over all features of all pairs."""
    monkeypatch.setattr(tables_module, "LARGE", 0)
    plan = q_eval._styled(Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Window" not in plan.split("_ms")[0] and "sig_landed_last_10" not in plan


def test_medians_read_the_exchange_of_the_windows(spark, monkeypatch):
    monkeypatch.setattr(tables_module, "LARGE", 0)
    pairs = Tables(spark, SF).matchups_of("sig_landed_last_5", "td_landed_last_5", "sub_rate")
    read = pairs.select("f1_won", "f1_sub_rate", "f2_sig_landed_last_5", "f2_td_landed_last_5")
    read.collect()
    assert "ReusedExchange" in read._jdf.queryExecution().executedPlan().toString()


def test_adjusted_columns_of_a_large_table_equal_the_others(spark, monkeypatch):
    from duelframe.plans.q_features import _AVG, _ROLL, spec
    small = Tables(spark, SF, staged=False).adjusted
    monkeypatch.setattr(tables_module, "LARGE", 0)
    large, skills = Tables(spark, SF), list(spec.SKILLS)
    for outputs, measures, read in ((["adj_win_rate"], ["won"], ["quality"]), (_AVG + _ROLL, ["won", "sig_landed", "td_landed", "control_s", "kd"], skills)):
        assert rows(large.adjusted_of(outputs, measures, read)) == rows(small.select("contest_id", "side_id", *outputs))
    assert "profiled" not in large.__dict__
