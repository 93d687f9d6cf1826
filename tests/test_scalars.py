import pytest
from pyspark.sql import functions as F

from duelframe.functions import labels, market, names, parsing


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    out = df.select(fn(F.col("x")).alias("y")).first()[0]
    return tuple(out) if hasattr(out, "asDict") else out


@pytest.mark.parametrize("text,want", [
    ("25 of 50", (25, 50)), ("0 of 10", (0, 10)), ("100 of 100", (100, 100)), ("", (0, 0)), ("N/A", (0, 0)), (None, (0, 0)),
    ("invalid", (0, 0)), ("  25 of 50  ", (25, 50)), ("25  of  50", (25, 50)), ("1 of 2 of 3", (0, 0)), ("a of 3", (0, 0))])
def test_landed_attempted(spark, text, want):
    assert one(spark, text, parsing.landed_attempted) == want


@pytest.mark.parametrize("text,want", [("5:00", 300), ("1:30", 90), ("0:45", 45), ("", 0), ("N/A", 0), (None, 0), ("invalid", 0), ("1:2:3", 0)])
def test_mmss(spark, text, want):
    assert one(spark, text, parsing.mmss_seconds) == want


@pytest.mark.parametrize("text,want", [("50%", .5), ("100%", 1.0), ("0%", 0.0), ("0.5", .5), ("0.75", .75), ("", 0.0), ("N/A", 0.0), (None, 0.0),
                                       ("1%", 1.0), ("150%", 1.0), ("-5", 0.0)])
def test_percent(spark, text, want):
    assert one(spark, text, parsing.percent) == want


@pytest.mark.parametrize("text,want", [("5' 9\"", 69), ("--", None), ("", None), (None, None)])
def test_height(spark, text, want):
    assert one(spark, text, parsing.height_inches) == want


@pytest.mark.parametrize("line,want", [(-250, .7143), (200, .3333), (100, .5), (-100, .5)])
def test_implied(spark, line, want):
    assert round(one(spark, line, market.implied, "int"), 4) == want


@pytest.mark.parametrize("name,key", [("Zoé  Núñez Jr.", "zoe nunez"), ("Jan-Luca O’Neil III", "jan luca oneil"), ("", ""), ("Ivan", "ivan")])
def test_unicode_key(spark, name, key):
    assert one(spark, name, names.unicode_key) == key


@pytest.mark.parametrize("name,want", [("Ana de la Cruz", "de la Cruz"), ("Ana Cruz", "Cruz"), ("Ana", "Ana"), ("Ana Maria van Dyk", "van Dyk"),
                                       ("Ana Maria Dyk", "Maria Dyk"), ("", "")])
def test_surname(spark, name, want):
    assert one(spark, name, names.surname) == want


@pytest.mark.parametrize("name,want", [("  MARTA McBRIDE ", "Marta McBride"), ("lena O'BRIEN", "Lena O'Brien"), ("Mac", "Mac"), ("MacDONALD x", "MacDonald X")])
def test_clean_person(spark, name, want):
    assert one(spark, name, names.clean_person) == want


@pytest.mark.parametrize("name,want", [("Ana Cruz", "AC"), ("Ana", "AN"), ("A", "??"), ("", "??")])
def test_initials(spark, name, want):
    assert one(spark, name, names.initials) == want


def test_fair_pair_sums_to_one(spark):
    df = spark.createDataFrame([(0.6, 0.5), (0.0, 0.0)], "a double, b double")
    got = [tuple(r[0]) for r in df.select(market.fair_pair(F.col("a"), F.col("b"))).collect()]
    assert all(abs(sum(p) - 1) < 1e-12 for p in got) and got[1] == (0.5, 0.5)


@pytest.mark.parametrize("text,want", [("October 26, 2024", "2024-10-26"), ("Mar 17, 1988", "1988-03-17"), ("2024-01-05", "2024-01-05"),
                                       ("2024-01-05T10:00:00Z", "2024-01-05"), ("soon", None)])
def test_any_date(spark, text, want):
    got = one(spark, text, parsing.any_date)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("method,want", [("KO/TKO", "KO/TKO"), ("Submission (Choke)", "Submission"), ("Decision - Split", "Decision"), ("DQ", "Other"), (None, "Other")])
def test_method_category(spark, method, want):
    assert one(spark, method, labels.method_category) == want
