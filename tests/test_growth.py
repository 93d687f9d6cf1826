"""What a task, the driver or the disk holds must not grow faster than the input."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from conftest import SF
from test_scale_paths import same

from duelframe.models import training
from duelframe.operators import ratings
from duelframe.plans import q_models
from duelframe.plans.tables import Tables
from duelframe.session import app_folder


def test_rating_stream_hands_on_each_batch():
    def batch(first):
        ids = list(range(first, first + 4))
        return pa.RecordBatch.from_pydict({
            "contest_id": ids, "pool": ["a"] * 4, "k": [32.0] * 4, "contest_date": ids, "f1_id": [1, 2, 1, 3], "f2_id": [2, 3, 3, 4],
            "score": [1.0, 0.5, None, 0.0], "elo0": pa.nulls(4, pa.float64()), "peak0": pa.nulls(4, pa.float64()), "seen0": pa.nulls(4, pa.int64())})

    read = []
    def batches():
        for first in (0, 4, 8):
            read.append(first)
            yield batch(first)

    out = ratings._fold(False, 1500.0, True, False)(batches())
    assert next(out).num_rows == 4 and read == [0]
    assert sum(b.num_rows for b in out) == 8


@pytest.mark.parametrize("bound, k", [(400, [20.0, 40.0]), (10_000_000, 32.0)])
def test_latest_ratings_equal_the_last_rows(t, setting, bound, k):
    setting("duelframe.poolRows", bound)
    last = ratings.final_ratings(ratings.elo_ratings(t.games, k=k))
    same(ratings.latest_ratings(t.games, k=k), last, ("pool", "k", "side_id"))


def test_pool_without_a_name(t):
    games = t.games.withColumn("pool", F.when(F.col("pool") != "Heavyweight", F.col("pool")))
    assert games.filter("pool IS NULL").count() > 0
    rated = ratings.elo_ratings(games)
    assert rated.count() == games.count()
    same(ratings.latest_ratings(games), ratings.final_ratings(rated), ("pool", "k", "side_id"))


def written(spark, name):
    return list(Path(app_folder(spark).removeprefix("file://")).glob(f"{name}-*"))


def test_first_query_reads_through_wide_tables(spark):
    fresh = Tables(spark, SF)
    before = {n: written(spark, n) for n in ("sides", "career", "imputed", "matchups", "adjusted")}
    first = fresh.matchups.select("contest_id", "diff_n_prior").orderBy("contest_id").collect()
    assert "avg_opp_quality" in fresh.adjusted.columns
    assert before == {n: written(spark, n) for n in before}
    again = fresh.matchups
    assert len(written(spark, "matchups")) == len(before["matchups"]) + 1 and written(spark, "career") == before["career"]
    assert again.select("contest_id", "diff_n_prior").orderBy("contest_id").collect() == first


def test_importance_numbers_and_scores_unshuffled_rows_once(spark):
    rows = [(i, i % 2, float(i % 2) + (i % 7) / 10, float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "contest_id long, y int, a double, b double")
    shaped = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumn("weight", F.lit(1.0)))
    model, before = training.logistic().fit(shaped), len(written(spark, "placed"))
    found = training.permutation_importance(model, df, ["a", "b"], repeats=3)
    out = {r.feature: r for r in found.collect()}
    assert out["a"].importance > 0.1 > abs(out["b"].importance) and out["a"].std > 0
    assert len(written(spark, "placed")) == before + 1


def test_reports_write_scores_once(spark):
    before = len(written(spark, "scored"))
    df = spark.createDataFrame([(0, 0.2, 1), (1, 0.9, 2)], "y int, p double, other int")
    assert q_models._report(df, "m").first().accuracy == 1.0 and len(written(spark, "scored")) == before + 1


def test_pairs_of_few_features_ship_only_those(spark):
    fresh = Tables(spark, SF)
    narrow, whole = fresh.matchups_of("win_rate"), fresh.matchups
    columns = ["contest_id", "f1_id", "f2_id", "f1_won", "diff_n_prior", "diff_win_rate"]
    assert "td_landed_last_5" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    same(narrow.select(*columns), whole.select(*columns), ("contest_id",))


def test_scaled_skills_write_no_measures(spark):
    fresh = Tables(spark, SF)
    before = len(written(spark, "profiled")), len(written(spark, "skills"))
    columns = ["contest_id", "side_id", "opp_striking", "opp_quality"]
    narrow = fresh.skills.select(*columns)
    assert (len(written(spark, "profiled")), len(written(spark, "skills"))) == (before[0], before[1] + 1)
    same(narrow, fresh.skilled.select(*columns), ("contest_id", "side_id"))
