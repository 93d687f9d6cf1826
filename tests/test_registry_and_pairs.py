"""Terms of model versions, and correlations from Gram matrices against numpy."""

import datetime
import json

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from duelframe.operators import metrics
from duelframe.sources import readers


def test_the_version_in_force(spark, tmp_path):
    models = [("a", "2024-01-01T00:00:00Z", "2024-03-01T00:00:00Z"), ("b", "2024-03-01T00:00:00Z", "2024-05-01T00:00:00Z"),
              ("c", "2024-06-01T00:00:00Z", None), ("never", None, None)]
    doc = {"registry_version": "1", "current": "c", "models": [{"version": v, "deployed_at": d, "retired_at": r} for v, d, r in models]}
    (tmp_path / "registry.json").write_text(json.dumps(doc))
    registry = readers.read_model_registry(spark, str(tmp_path / "registry.json"))
    assert [r.version for r in registry.where("is_current").collect()] == ["c"]
    days = ["2023-12-31", "2024-01-02", "2024-02-28", "2024-03-02", "2024-05-02", "2025-01-01", None]
    asked = spark.createDataFrame([(d and datetime.date.fromisoformat(d), "own") for d in days], "day date, version string")
    found = rows(readers.model_in_force(asked, registry, "day"))
    told = dict(zip(days, [None, "a", "a", "b", None, "c", None]))
    assert found == sorted(((d and datetime.date.fromisoformat(d), "own", v) for d, v in told.items()), key=str)
    assert {r.v for r in readers.model_in_force(asked, registry.limit(0), "day", "v").collect()} == {None}


def test_correlations_skip_missing_values_by_pair(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(1e6, 1, 400)
    x = {"a": a, "b": a + rng.normal(0, .3, 400), "c": -a + rng.normal(0, .5, 400), "same": np.full(400, 0.1), "free": rng.normal(0, 1, 400)}
    x["b"][::7] = np.nan
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values())], ", ".join(f"{c} double" for c in x)).repartition(5)
    df = df.withColumn("c", F.when(F.abs("free") < 2, F.col("c")))  # nulls
    c = np.where(np.abs(x["free"]) < 2, x["c"], np.nan)
    full = {**x, "c": c}
    found = {(r.left, r.right): r["corr"] for r in metrics.correlated_pairs(df, list(x), 0.5).collect()}
    both = lambda l, r: ~np.isnan(full[l]) & ~np.isnan(full[r])
    assert found.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    assert all(abs(v - abs(np.corrcoef(full[l][both(l, r)], full[r][both(l, r)])[0, 1])) < 1e-9 for (l, r), v in found.items())
    assert metrics.correlated_pairs(df.limit(0), list(x), 0.5).count() == 0
