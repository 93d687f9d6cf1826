"""Hand-written edge cases and invariants."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from duelframe.operators import career, imputation, ledger, opponents, quality, ratings, reshape, segments
from duelframe.streaming import incremental

D = dt.date


def contests(spark, games):
    """(id, date, red, blue, winner, method)"""
    df = spark.createDataFrame(games, "contest_id long, contest_date date, red_id long, blue_id long, winner string, method string")
    fixed = {"event_name": F.lit("Night"), "division": F.lit("Open"), "round_text": F.lit("1"), "time_text": F.lit("1:00")}
    stats = {f"{s}_{c}": F.lit(v) for s in ("red", "blue") for c, v in (("sig_str", "10 of 20"), ("total_str", "12 of 25"), ("td", "1 of 2"),
                                                                      ("kd", "0"), ("sub_att", "1"), ("ctrl", "0:30"))}
    return df.withColumns({**fixed, **stats})


def test_draw_and_no_contest_count_as_losses_for_both(spark):
    c = contests(spark, [(1, D(2000, 1, 1), 1, 2, "Draw", "Draw"), (2, D(2000, 2, 1), 1, 2, "No Contest", "No Contest"), (3, D(2000, 3, 1), 1, 2, "1", "KO/TKO")])
    f = career.career_features(reshape.explode_sides(c)).filter("contest_id = 3")
    assert rows(f, "side_id", "n_prior", "wins_prior", "losses_prior", "loss_streak") == [(1, 2, 0, 2, 2), (2, 2, 0, 2, 2)]


def test_same_day_rows_count_by_position_but_not_for_profiles(spark):
    c = contests(spark, [(i, D(2000, 1, 1), 1, 10 + i, "1", "KO/TKO") for i in range(4)] + [(9, D(2000, 1, 2), 1, 50, "1", "KO/TKO")])
    sides = reshape.explode_sides(c)
    f = career.career_features(sides).filter("side_id = 1")
    assert [r[1] for r in rows(f, "contest_id", "n_prior")] == [0, 1, 2, 3, 4]
    assert [r[1] for r in rows(f, "contest_id", "contests_last_365d")] == [0, 1, 2, 3, 4]
    p = opponents.opponent_profiles(sides).filter("opp_id = 1")
    assert [r[1] for r in rows(p, "contest_id", "opp_earlier")] == [0, 0, 0, 0, 4]
    assert p.filter("contest_id = 9 AND raw_opp_striking IS NOT NULL").count() == 1


def test_contest_with_one_side_is_skipped(spark):
    c = contests(spark, [(1, D(2000, 1, 1), 1, 2, "1", "KO/TKO"), (2, D(2000, 2, 1), 1, 3, "3", "KO/TKO")])
    sides = career.career_features(reshape.explode_sides(c)).filter("NOT (contest_id = 2 AND side_id = 3)")
    med = imputation.division_medians(sides)
    assert rows(reshape.build_matchups(imputation.impute_early_career(sides, med)), "contest_id", "f1_id", "f1_won") == [(1, 1, 1)]


def test_missing_round_and_missing_stats(spark):
    c = contests(spark, [(1, D(2000, 1, 1), 1, 2, "1", "KO/TKO")]).withColumns({"round_text": F.lit(None).cast("string"), "red_sig_str": F.lit(None).cast("string")})
    s = reshape.explode_sides(c)
    assert rows(s, "side_id", "duration_s", "detailed", "sig_landed") == [(1, -240, False, 0), (2, -240, False, 10)]


def test_division_without_seasoned_side_uses_overall_median(t):
    odd = t.career.withColumn("division", F.when(F.col("n_prior") < 2, "New").otherwise(F.col("division")))
    med = {r["division"]: r for r in imputation.division_medians(odd).collect()}
    want = odd.filter("n_prior >= 6").agg(F.median("sig_landed")).first()[0]
    assert med["New"]["med_sig_landed"] == want


def test_counters_add_up(t):
    assert t.career.filter("wins_prior + losses_prior <> n_prior OR win_streak * loss_streak <> 0").count() == 0


def test_swapping_sides_negates_differences(t):
    m = t.matchups
    flipped = reshape.build_matchups(t.imputed.withColumns({"side_id": -F.col("side_id"), "opp_id": -F.col("opp_id")}))
    j = m.select("contest_id", "diff_win_rate", "diff_n_prior").join(flipped.select("contest_id", F.col("diff_win_rate").alias("w"), F.col("diff_n_prior").alias("n")), "contest_id")
    assert j.count() == m.count() and j.filter("abs(diff_win_rate + w) > 1e-12 OR diff_n_prior + n <> 0").count() == 0


def test_later_contests_do_not_change_earlier_features(t):
    cut = F.lit("1999-01-01").cast("date")
    early = career.career_features(t.sides.filter(F.col("contest_date") < cut))
    whole = t.career.filter(F.col("contest_date") < cut)
    assert early.exceptAll(whole.select(early.columns)).count() == 0
    p = opponents.opponent_profiles(t.sides.filter(F.col("contest_date") < cut))
    assert p.exceptAll(t.profiled.filter(F.col("contest_date") < cut).select(p.columns)).count() == 0


def test_unknown_opponent_is_neutral(t):
    assert quality.leakage_check(t.skilled).first()["leaks"] == 0


def test_no_contest_keeps_rating_but_counts(spark):
    c = contests(spark, [(1, D(2000, 1, 1), 1, 2, "No Contest", "No Contest"), (2, D(2000, 2, 1), 1, 2, "Draw", "Draw"), (3, D(2000, 3, 1), 1, 2, "1", "KO/TKO")])
    r = ratings.elo_ratings(ratings.rating_input(c))
    assert rows(r, "contest_id", "f1_elo", "f1_seen") == [(1, 1500.0, 0), (2, 1500.0, 1), (3, 1500.0, 2)]
    assert rows(ratings.final_ratings(r), "side_id", "elo", "peak", "seen") == [(1, 1516.0, 1516.0, 3), (2, 1484.0, 1500.0, 3)]


def ledger_tables(spark):
    events = spark.createDataFrame([("a", D(2000, 1, 1), True), ("b", D(2000, 2, 1), False), ("c", D(2000, 3, 1), False)], "event_id string, event_date date, locked boolean")
    cs = spark.createDataFrame([("a", 1, 0, "Ann One", "Bea Two", "Ann One", "Ann One"), ("b", 2, 0, "Cat Three", "Dee Four", "Cat Three", None),
                                ("b", 3, 1, "Eve Five", "Fay Six", "Fay Six", None), ("c", 4, 0, "Gil Seven", "Hal Eight", "Gil Seven", None)],
                               "event_id string, contest_id long, position int, name_1 string, name_2 string, predicted_winner string, actual_winner string")
    none = {"actual_method": F.lit(None).cast("string"), "actual_round": F.lit(None).cast("long"), "correct": F.lit(None).cast("boolean")}
    stats = {c: F.lit(None).cast("double" if c.endswith("acy") else "long") for c in ("overall_correct", "overall_total", "overall_accuracy")}
    return events.withColumns(stats), cs.withColumns(none)


def test_lock_is_orientation_aware_and_leaves_locked_events(spark):
    events, cs = ledger_tables(spark)
    results = spark.createDataFrame([("a", 1, "Ann One", "Bea Two", "Bea Two", "KO", 1), ("b", 2, "Dee Four", "Cat Three", "Dee Four", "KO", 2),
                                     ("b", 3, "Eve Five", "Fay Six", "Draw", "Draw", 3)], "event_id string, r_id long, name_1 string, name_2 string, winner string, method string, round long")
    e, c = ledger.lock(events, cs, results, "2000-12-31")
    assert rows(c, "contest_id", "actual_winner", "correct") == [(1, "Ann One", None), (2, "Dee Four", False), (3, "Draw", None), (4, None, None)]
    assert rows(e, "event_id", "locked", "overall_correct", "overall_total") == [("a", True, None, None), ("b", True, 0, 1), ("c", False, None, None)]


def test_record_replaces_only_unlocked(spark):
    events, cs = ledger_tables(spark)
    e, c = ledger.record(events, cs, events, cs.withColumn("predicted_winner", F.lit("X")))
    assert rows(c, "contest_id", "predicted_winner") == [(1, "Ann One"), (2, "X"), (3, "X"), (4, "X")] and e.count() == 3


def test_segments_overlap(t):
    from duelframe.plans.q_eval import frame
    f = frame(t)
    rep = {r["segment"]: r["n"] for r in segments.segment_report(f, ["experience"]).collect()}
    assert rep["Any debut"] + rep["No debuts"] == rep["Overall"] == f.count()


def test_late_contest_is_flagged_and_recomputed(spark, tmp_path):
    rows_ = [[(1, D(2000, 1, 1), 7, 1), (2, D(2000, 3, 1), 7, 0)], [(3, D(2000, 2, 1), 7, 1), (4, D(2000, 2, 1), 8, 1)]]
    arrivals = str(tmp_path / "in")
    for part in rows_:
        spark.createDataFrame(part, incremental.SIDE_ROWS).coalesce(1).write.mode("append").parquet(arrivals)
    out = incremental.stream_career_counters(spark, arrivals, str(tmp_path / "out"), files_per_batch=1)
    assert rows(out, "contest_id", "n_prior", "late") == [(1, 0, False), (2, 1, False), (3, None, True), (4, 0, False)]
    fixed = incremental.recompute_late(spark, arrivals, out)
    assert rows(fixed, "contest_id", "n_prior", "wins_prior") == [(1, 0, 0), (2, 2, 2), (3, 1, 1)]
