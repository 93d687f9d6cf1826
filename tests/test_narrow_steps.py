"""Steps that many queries share read and move only what a query uses."""

from pyspark.sql import functions as F

from conftest import SF, rows
from duelframe.operators import matching
from duelframe.plans import tables as tables_module
from duelframe.plans.tables import Tables


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_lines_are_shuffled_once(spark):
    physical = _plan(Tables(spark, SF, staged=False)._pairs).split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") == 1 and "hashpartitioning(l_orderkey" in physical


def test_counting_sides_parses_nothing(spark):
    sides = Tables(spark, SF, staged=False).sides
    assert "_sig_str" not in _plan(sides.groupBy("side_id").count()).split("== Optimized Logical Plan ==")[1]


def test_large_tables_are_never_written_whole(spark, monkeypatch):
    monkeypatch.setattr(tables_module, "LARGE", 0)
    large, small = Tables(spark, SF), Tables(spark, SF, staged=False)
    assert large.career is not None and large.career is not None and "career" not in large.__dict__
    names = [c for c in large.called.columns]
    assert rows(large.called, *names) == rows(small.ledger_contests, *names)
    assert "parquet" in _plan(large.other_source).lower() and "facts-" in _plan(large.other_source)


def test_names_compared_once_or_by_card_link_the_same_contests(spark, monkeypatch):
    from duelframe.plans.tables import tables
    t = tables(spark, SF)
    once = rows(matching.match_contest_pair(t.ledger_names, t.other_names, ["event_date"]))
    made = []
    scoped = matching.scoped_names
    monkeypatch.setattr(matching, "scoped_names", lambda *a: made.append(1) or scoped(*a))
    monkeypatch.setattr(matching, "THRESHOLD", 0.9)
    assert once == rows(matching.match_contest_pair(t.ledger_names, t.other_names, ["event_date"], threshold=0.85)) and made and once


def test_keys_keep_their_letters(spark):
    from duelframe.functions import names
    df = spark.createDataFrame([(" O'Neil-Smith  Jr.",), ("Card 1: A.B",), ("",), (None,)], "n string")
    assert [tuple(r) for r in df.select(names.basic_key(F.col("n")), names.slug(F.col("n"))).collect()] == [
        ("oneil smith jr", "-o'neil-smith--jr"), ("card 1: ab", "card-1-ab"), ("", ""), (None, None)]
