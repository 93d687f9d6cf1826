"""Accuracy and log loss in overlapping segments.

Every cut is an array of the labels a row belongs to; one explode and one grouped
aggregate (combined before the shuffle) then serve any number of cuts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import spec
from . import order_stats
from .metrics import predicted, row_log_loss

# Labels and limits of the segment report.
CONFIDENCE = ((0.50, 0.55, "50-55%"), (0.55, 0.60, "55-60%"), (0.60, 0.65, "60-65%"), (0.65, 0.70, "65-70%"),
              (0.70, 0.75, "70-75%"), (0.75, 1.01, "75%+"))
ELO_GAPS = ((0, 25, "gap <25"), (25, 75, "gap 25-75"), (75, 150, "gap 75-150"), (150, 250, "gap 150-250"), (250, 9999, "gap 250+"))
ERAS = ((1994, 2005, "1994-2005"), (2006, 2010, "2006-2010"), (2011, 2015, "2011-2015"), (2016, 2020, "2016-2020"),
        (2021, 2023, "2021-2023"), (2024, 2030, "2024-2030"))
MIN_ROWS = {"division": 10, "era": 10, "style": 30}


def analysis_frame(matchups: DataFrame, p: Column, cutoff: str) -> DataFrame:
    """Prediction, correctness, confidence and the columns the cuts use."""
    y = F.col("f1_won")
    return matchups.withColumns({"y": y, "p": p}).withColumns({
        "predicted": predicted(F.col("p")), "confidence": F.greatest(F.col("p"), 1 - F.col("p")),
        "is_test": (F.col("contest_date") >= F.lit(cutoff).cast("date")).cast("int")}).withColumn(
        "correct", (F.col("predicted") == F.col("y")).cast("int"))


def _between(value: Column, ranges, closed: bool = False) -> list[tuple[str, Column]]:
    return [(label, (value >= low) & ((value <= high) if closed else (value < high))) for low, high, label in ranges]


def confidence_cut() -> list:
    return _between(F.col("confidence"), CONFIDENCE)


def streak_cut() -> list:
    w1, w2, l1, l2 = (F.col(c) for c in ("f1_win_streak", "f2_win_streak", "f1_loss_streak", "f2_loss_streak"))
    return [("Both streaking (2+)", (w1 >= 2) & (w2 >= 2)),
            ("One streaking", ((w1 >= 2) & (w2 < 2)) | ((w2 >= 2) & (w1 < 2))),
            ("Both losing", (l1 >= 2) & (l2 >= 2)),
            ("Streak 5+ vs <2", ((w1 >= 5) & (w2 < 2)) | ((w2 >= 5) & (w1 < 2)))]


def experience_cut() -> list:
    a, b = F.col("f1_n_prior"), F.col("f2_n_prior")
    return [("Both experienced (10+)", (a >= 10) & (b >= 10)), ("Both inexperienced (<5)", (a < 5) & (b < 5)),
            ("Large gap (>8)", F.abs(a - b) > 8), ("Debut vs veteran", ((a == 0) & (b >= 5)) | ((b == 0) & (a >= 5))),
            ("Any debut", (a == 0) | (b == 0)), ("No debuts", (a > 0) & (b > 0))]


def division_cut(match: str = "substring") -> list:
    text = F.lower(F.coalesce("division", F.lit("")))
    return [(d, text.contains(d.lower()) if match == "substring" else text == d.lower()) for d in spec.SEGMENT_DIVISIONS]


def _method(pattern: str) -> Column:
    return F.upper(F.coalesce("method", F.lit("Unknown"))).rlike(pattern)


def method_cut() -> list:
    return [("KO/TKO", _method("KO|TKO")), ("Submission", _method("SUB")), ("Unanimous Decision", _method("U-DEC|UNANIMOUS")),
            ("Split Decision", _method("S-DEC|SPLIT")), ("Majority Decision", _method("M-DEC|MAJORITY")), ("All Decisions", _method("DEC|DECISION"))]


def finish_cut() -> list:
    return [("Finishes", _method("KO|TKO|SUB")), ("Decisions", _method("DEC|DECISION"))]


def elo_gap_cut() -> list:
    return _between(F.abs("diff_elo"), ELO_GAPS)


def era_cut() -> list:
    return _between(F.year("contest_date"), ERAS, closed=True)


def with_style(df: DataFrame) -> DataFrame:
    """Striker, Grappler or Balanced per side, against the medians of side one.

    The medians are exact and need no global sort.
    """
    at = lambda c: F.least(F.floor(F.col(c) * 64), F.lit(order_stats.BUCKETS)).cast("int")
    med = reduce(lambda a, b: a.join(F.broadcast(b)), [order_stats.exact_median(df, c, at(c)).withColumnRenamed("median", n) for c, n in (
        ("f1_sig_landed_last_5", "_ms"), ("f1_td_landed_last_5", "_mt"), ("f1_sub_rate", "_mb"))])

    def style(s: str) -> Column:
        strikes, tds, subs = (F.coalesce(f"{s}_{c}", F.lit(0.0)) for c in ("sig_landed_last_5", "td_landed_last_5", "sub_rate"))
        striker = (strikes > F.col("_ms")) & (tds < F.col("_mt"))
        grappler = (tds > F.col("_mt")) | (subs > F.col("_mb"))
        return F.when(striker & ~grappler, F.lit("Striker")).when(grappler & ~striker, F.lit("Grappler")).otherwise(F.lit("Balanced"))

    out = df.join(F.broadcast(med)).withColumns({"f1_style": style("f1"), "f2_style": style("f2")}).drop("_ms", "_mt", "_mb")
    return out.withColumn("style_pair", F.array_join(F.array_sort(F.array("f1_style", "f2_style")), " vs "))


CUTS = {"confidence": confidence_cut, "streaks": streak_cut, "experience": experience_cut, "division": division_cut,
        "method": method_cut, "finish": finish_cut, "elo_gap": elo_gap_cut, "era": era_cut}


def labelled(df: DataFrame, cuts: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, category, segment) the row belongs to, ``Overall`` included for each category."""
    found = [F.when(c, F.struct(F.lit(name).alias("category"), F.lit(label).alias("segment")))
             for name in cuts if name != "style" for label, c in CUTS[name]()]
    if "style" in cuts:
        found.append(F.struct(F.lit("style").alias("category"), F.col("style_pair").alias("segment")))
    found += [F.struct(F.lit(name).alias("category"), F.lit("Overall").alias("segment")) for name in cuts]
    tags = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return df.select("y", "p", *keep, tags.alias("t")).select("y", "p", *keep, "t.*")


def metrics_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, accuracy in percent to one decimal and log loss to three."""
    hit = (predicted(F.col("p")) == F.col("y")).cast("double")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit) * 100, 1).alias("accuracy"),
                                 F.round(F.avg(row_log_loss(F.col("y"), F.col("p"))), 3).alias("log_loss"))


def segment_report(df: DataFrame, cuts: list[str], split: list[str] | None = None) -> DataFrame:
    """All asked cuts in one pass; categories with a minimum size drop smaller segments."""
    keep = split or []
    out = metrics_of(labelled(df, cuts, keep), [*keep, "category", "segment"])
    small = F.lit(False)
    for name, least in MIN_ROWS.items():
        small = small | ((F.col("category") == name) & (F.col("n") < least) & (F.col("segment") != "Overall"))
    return out.filter(~small)


def style_matrix(df: DataFrame, least: int = 20) -> DataFrame:
    """Accuracy per unordered pair of styles, one column per style."""
    per = metrics_of(df.withColumns({"style": F.least("f1_style", "f2_style"), "other": F.greatest("f1_style", "f2_style")}), ["style", "other"])
    return per.filter(F.col("n") >= least).groupBy("style").pivot("other", ["Balanced", "Grappler", "Striker"]).agg(F.first("accuracy"))


def strengths_weaknesses(report: DataFrame, overall: float | Column, k: int = 8, least: int = 30) -> DataFrame:
    """Segments of 30 or more rows: up to ``k`` best above the overall accuracy; up to ``k`` at or below 55 %,
    or the ``k`` worst when fewer than five are that low. The report has one row per segment."""
    overall = overall if isinstance(overall, Column) else F.lit(overall)
    big = report.filter((F.col("n") >= least) & (F.col("segment") != "Overall")).withColumn(
        "diff_from_overall", F.round(F.col("accuracy") - overall, 1))
    best_first = [F.desc("accuracy"), "category", "segment"]
    worst_first = ["accuracy", F.desc("category"), F.desc("segment")]
    strong = big.filter("diff_from_overall > 0").orderBy(*best_first).limit(k).withColumn("kind", F.lit("strength"))
    low = big.filter("accuracy <= 55").orderBy(*best_first).limit(k)
    count = low.agg(F.count(F.lit(1)).alias("_c"))
    weak = low.join(F.broadcast(count)).filter("_c >= 5").drop("_c").unionByName(
        big.orderBy(*worst_first).limit(k).join(F.broadcast(count)).filter("_c < 5").drop("_c"))
    return strong.unionByName(weak.withColumn("kind", F.lit("weakness")))
