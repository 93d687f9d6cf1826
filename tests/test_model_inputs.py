"""Fits that read no folds neither shuffle nor write training rows a second time."""

from conftest import SF, rows
from test_growth import written

from duelframe.operators import serving
from duelframe.plans import q_models
from duelframe.plans.tables import SNAPSHOT_FEATURES, Tables, tables


def test_rows_without_folds_are_not_written_again(spark):
    fresh = tables(spark, SF)
    q_models.modelled(fresh)
    before = len(written(spark, "train")), len(written(spark, "test"))
    train, test = q_models.plain.__wrapped__(fresh)
    plan = train._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "fold" not in train.columns and "modelled-" in plan + train._jdf.queryExecution().executedPlan().toString()
    columns = ["contest_id", "y", "weight", *q_models.COLUMNS]
    assert rows(train, *columns) == rows(q_models.split(fresh)[0], *columns) and test.count() > 0
    assert len(written(spark, "test")) == before[1]


def test_snapshot_of_few_features_equals_the_whole_one(spark):
    t = tables(spark, SF)
    both = [f"{s}_{f}" for s in ("f1", "f2") for f in SNAPSHOT_FEATURES]
    pairs = Tables(spark, SF).matchups_of(*SNAPSHOT_FEATURES).select("contest_id", "contest_date", "f1_id", "f2_id", *both)
    assert rows(serving.latest_snapshot(pairs, SNAPSHOT_FEATURES)) == rows(t.snapshot)
