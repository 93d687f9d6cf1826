"""The layouts for hot keys and large pools give the same values as the plain ones."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from duelframe.operators import career, history, matching, opponents, order_stats, ratings
from duelframe.functions import names


def hot_sides(t):
    """One competitor takes part in a third of the contests, often several times a day."""
    hot = (F.pmod(F.xxhash64("contest_id"), F.lit(3)) == 0)
    return t.sides.withColumn("side_id", F.when(hot & (F.col("side_id") < F.col("opp_id")), F.lit(9999).cast("long")).otherwise(F.col("side_id"))).withColumn(
        "opp_id", F.when(hot & (F.col("opp_id") < F.col("side_id")) & (F.col("side_id") != 9999), F.lit(9999).cast("long")).otherwise(F.col("opp_id")))


def same(a, b, keys=("contest_id", "side_id")):
    left = {tuple(r[k] for k in keys): r.asDict() for r in a.collect()}
    right = {tuple(r[k] for k in keys): r.asDict() for r in b.collect()}
    assert left.keys() == right.keys() and len(left) > 0
    for k, x in left.items():
        for c, v in x.items():
            w = right[k][c]
            assert v == w or (isinstance(v, float) and isinstance(w, float) and abs(v - w) < 1e-9), (k, c, v, w)


@pytest.mark.parametrize("bound", [10, 60])
def test_split_history_equals_plain(t, setting, bound):
    sides = hot_sides(t).cache()
    setting("duelframe.hotKeyRows", bound)
    chunks = history.hot_chunks(sides, ["side_id"])
    assert chunks is not None and chunks.agg(F.max("_chunk")).first()[0] > 3
    division = history.hot_chunks(sides, ["side_id", "division"])
    same(career.career_features(sides), career.career_features(sides, chunks, division))
    same(opponents.own_profiles(sides), opponents.own_profiles(sides, chunks))
    skilled = opponents.adjust_by_opponent(opponents.zscore_skills(opponents.opponent_profiles(sides)))
    same(opponents.adjusted_features(skilled), opponents.adjusted_features(skilled, chunks))


def test_no_chunks_below_bound(t, setting):
    setting("duelframe.hotKeyRows", 10_000_000)
    assert history.hot_chunks(t.sides, ["side_id"]) is None


def test_window_chain_equals_fold(t, setting):
    plain = ratings.elo_ratings(t.games, dynamic_k=True)
    setting("duelframe.poolRows", 25)
    chained = ratings.elo_ratings(t.games, dynamic_k=True)
    same(plain.drop("k"), chained.drop("k"), ("contest_id",))


def test_ratings_keep_their_sum(t):
    final = ratings.final_ratings(ratings.elo_ratings(t.games))
    for r in final.groupBy("pool").agg(F.sum(F.col("elo") - 1500).alias("s")).collect():
        assert abs(r["s"]) < 1e-6


def brute_auc(data):
    pos = [p for y, p in data if y == 1]
    neg = [p for y, p in data if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_and_median_with_one_value_in_a_third_of_rows(spark):
    rnd = random.Random(1)
    data = [(rnd.randint(0, 1), 0.5 if rnd.random() < 0.34 else rnd.choice([rnd.random(), round(rnd.random(), 2), 0.0, 1.0])) for _ in range(601)]
    df = spark.createDataFrame(data, "y int, p double")
    from duelframe.operators import metrics
    assert abs(metrics.roc_auc(df).first()[0] - brute_auc(data)) < 1e-12
    import statistics
    for n in (601, 600):
        sub = spark.createDataFrame(data[:n], "y int, p double")
        got = order_stats.exact_median(sub, "p", order_stats.unit_bucket(F.col("p"))).first()[0]
        assert abs(got - statistics.median(p for _, p in data[:n])) < 1e-12


def test_row_numbers_are_exact(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    got = order_stats.number_rows(df, ["g"], F.md5(F.col("id").cast("string")), "n")
    for g in ("a", "b"):
        ns = sorted(r[0] for r in got.filter(F.col("g") == g).select("n").collect())
        assert ns == list(range(len(ns)))


def random_names(rnd, n):
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 16))) for _ in range(n)]
    out = set(base)
    for b in base:
        s = list(b)
        for _ in range(rnd.randint(1, 4)):
            at = rnd.randrange(len(s) + 1)
            kind = rnd.random()
            if kind < 0.4 and s:
                s.pop(min(at, len(s) - 1))
            elif kind < 0.8:
                s.insert(at, rnd.choice("abcde"))
            elif s:
                s[min(at, len(s) - 1)] = rnd.choice("abcde")
        if s:
            out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("metric,threshold", [("edit", 0.85), ("edit", 0.7), ("gestalt", 0.85), ("gestalt", 0.7)])
def test_similar_names_equals_all_pairs(spark, metric, threshold):
    import difflib
    rnd = random.Random(7)
    a, b = random_names(rnd, 90), random_names(rnd, 90)
    b = sorted(set(b) | set(rnd.sample(a, 40)))

    def lev(x, y):
        prev = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            now = [i]
            for j, d in enumerate(y, 1):
                now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (c != d)))
            prev = now
        return prev[-1]

    score = {"edit": lambda x, y: 1.0 - lev(x, y) / max(len(x), len(y)), "gestalt": lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()}[metric]
    want = sorted((x, y) for x in a for y in b if score(x, y) >= threshold)
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "key string")
    got = rows(matching.similar_names(frame(a), frame(b), metric, threshold), "left_key", "right_key")
    assert got == sorted(want, key=str) and len(want) > 50


def test_names_are_not_handed_to_the_driver(spark):
    df = spark.createDataFrame([("Ann Able",), ("Bob Baker",)], "name string")
    out = matching.fuzzy_best_match(df.selectExpr("upper(name) AS name"), df)
    assert out.count() == 2 and "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_best_match_gestalt_equals_brute_force(spark):
    import difflib
    rnd = random.Random(3)
    known = [n + " " + m for n, m in zip(random_names(rnd, 40), reversed(random_names(rnd, 40)))]
    wanted = sorted({k[:3] + k[4:] for k in known} | {k.upper() for k in known[:10]} | {"zzz qqq"})
    df = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    got = {r["name"]: (r["match"], r["score"]) for r in matching.fuzzy_best_match(df(wanted), df(known), metric="gestalt").collect()}
    for w in wanted:
        k = " ".join(w.lower().split())
        scored = sorted((-(1.0 if k == x else difflib.SequenceMatcher(None, k, " ".join(x.split())).ratio()), x) for x in known)
        best = (scored[0][1], -scored[0][0]) if -scored[0][0] >= 0.85 else (None, None)
        assert got[w] == best, w


def test_contest_pair_gestalt_equals_brute_force(spark):
    import difflib
    rnd = random.Random(5)
    pool = [f"{a} {b}" for a, b in zip(random_names(rnd, 30), random_names(rnd, 30))][:40]
    right = [(i % 3, i, *rnd.sample(pool, 2)) for i in range(60)]
    left = []
    for i, (d, _, a, b) in enumerate(right):
        a, b = (b, a) if i % 2 else (a, b)
        left.append((d, 1000 + i, a[:2] + a[3:] if i % 4 == 0 else a, b))
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    want = {}
    for d, lid, a, b in left:
        best = []
        for e, rid, x, y in right:
            if d == e:
                s, c = ratio(a, x) + ratio(b, y), ratio(a, y) + ratio(b, x)
                if max(s, c) >= 1.7:
                    best.append((-max(s, c), rid, c > s))
        if best:
            want[lid] = min(best)[1:]
    got = matching.match_contest_pair(spark.createDataFrame(left, "d int, l_id long, l1 string, l2 string"),
                                      spark.createDataFrame(right, "d int, r_id long, r1 string, r2 string"), ["d"], "gestalt")
    assert {r["l_id"]: (r["r_id"], r["flipped"]) for r in got.collect()} == want
