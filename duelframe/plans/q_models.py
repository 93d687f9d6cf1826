"""Model fits. Spark ML has no SQL twin: these are checked by their row counts and by tests."""

from __future__ import annotations

from functools import cache

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..models import isotonic, training as tr
from ..operators import metrics, ratings, reshape, serving
from ..session import stage
from .q_market import _upcoming
from .registry import query, r6
from .sqltext import sql
from .tables import CUTOFF, SNAPSHOT_FEATURES, Tables

C = F.col
COLUMNS = ["diff_win_rate", "diff_n_prior", "diff_win_streak", "diff_loss_streak", "diff_sig_landed_last_5", "diff_sig_absorbed_last_5",
           "diff_td_landed_last_5", "diff_win_rate_last_3", "diff_days_since_last", "diff_elo"]


@cache
def modelled(t: Tables) -> DataFrame:
    """The columns that models use, written once: preparing rows takes several passes over them."""
    own = [c for c in COLUMNS if c != "diff_elo"]
    pairs = t.matchups_of(*[c.removeprefix("diff_") for c in own])
    rows = pairs.select("contest_id", "contest_date", "f1_won", "f1_n_prior", "f2_n_prior", *own)
    return stage(rows.join(t.rated.select("contest_id", "diff_elo"), "contest_id"), "modelled")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(rows)


@cache
def plain(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Training rows without folds, and test rows: projections of the written columns, which are not written again."""
    train, test = reshape.temporal_split(modelled(t), CUTOFF)
    held = test.select("contest_id", "contest_date", C("f1_won").alias("y"), *[F.coalesce(C(c).cast("double"), F.lit(0.0)).alias(c) for c in COLUMNS])
    return tr.prepare(train, COLUMNS, folds=None), _assembled(held.withColumn("weight", F.lit(1.0)))


@cache
def split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Training rows with folds, which are written as they take a shuffle, and test rows. Vectors are made where they are read."""
    train, _ = reshape.temporal_split(modelled(t), CUTOFF)
    return _assembled(stage(tr.prepare(train, COLUMNS).drop("features"), "train")), plain(t)[1]


def small_gbt():
    return tr.gbt(maxIter=20, maxDepth=3)


@cache
def main_model(t: Tables):
    return small_gbt().fit(plain(t)[0])


@cache
def oof(t: Tables) -> DataFrame:
    return stage(tr.out_of_fold(tr.logistic, split(t)[0]), "oof")


def _report(scored: DataFrame, name: str) -> DataFrame:
    # The metrics take several passes; labels and scores are written once, so that no pass runs the models again.
    return metrics.binary_metrics(stage(scored.select("y", "p"), "scored")).withColumn("model", F.lit(name))


@query("fit_gbt")
def _(t):
    train, test = split(t)
    flagged = train.withColumn("held_out", C("fold") == 0)
    stopped = tr.gbt_early_stop(maxIter=20).fit(flagged)
    return _report(tr.score(main_model(t), test), "gbt").unionByName(_report(tr.score(stopped, test), "gbt early stop"))


@query("fit_logistic")
def _(t):
    train, test = plain(t)
    return _report(tr.score(tr.logistic().fit(train), test), "logistic")


@query("random_search")
def _(t):
    found = tr.random_search(split(t)[0], tries=3, folds=5)
    rows = [(i, float(loss), str(sorted(pick.items()))) for i, (loss, pick) in enumerate(found)]
    return t.spark.createDataFrame(rows, "rank int, log_loss double, settings string")


@query("stacking")
def _(t):
    train, test = split(t)
    stack = tr.stacking(train, [lambda: tr.gbt(maxIter=10, maxDepth=2), lambda: tr.gbt(maxIter=5, maxDepth=4), tr.logistic], folds=5)
    return _report(stack.transform_scores(test), "stack")


def _calibrated(t, calibrator, name):
    _, test = split(t)
    base = tr.score(tr.logistic().fit(split(t)[0]), test)
    return _report(calibrator.apply(base).drop("p").withColumnRenamed("p_cal", "p"), name)


@query("calibrate_platt")
def _(t):
    return _calibrated(t, tr.calibrate_platt(oof(t)), "platt")


@query("calibrate_isotonic")
def _(t):
    return _calibrated(t, tr.calibrate_isotonic(oof(t)), "isotonic")


_POINTS = """SELECT CAST(diff_n_prior AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS w, CAST(sum(f1_won) AS DOUBLE) AS s
FROM bout_matchups WHERE diff_n_prior IS NOT NULL GROUP BY 1"""
_SUMS = "SELECT x, w, s, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs FROM pts"
_MEANS = "SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM sums a JOIN sums b ON b.i >= a.i"


@query("isotonic_experience", sql(f"""
SELECT x, CAST(w AS BIGINT) AS n, {r6('value')} AS value FROM sums JOIN (
  SELECT i, max(least_mean) AS value FROM (SELECT b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS least_mean FROM means) GROUP BY i) USING (i)""",
                               pts=_POINTS, sums=_SUMS, means=_MEANS))
def _(t):
    """Share of contests won as a rising function of the lead in earlier contests."""
    rows = stage(t.matchups_of().select(C("diff_n_prior").cast("double").alias("x"), C("f1_won").alias("y")).where("x IS NOT NULL"), "experience")
    values = isotonic.fit(rows).values(rows.select("x").distinct())
    return rows.groupBy("x").agg(F.count("*").alias("n")).join(values, "x")


@query("calibrate_two_stage")
def _(t):
    return _calibrated(t, tr.calibrate_two_stage(oof(t)), "two stage")


@query("debut_routing")
def _(t):
    train, test = plain(t)
    tag = modelled(t).select("contest_id", ((C("f1_n_prior") == 0) | (C("f2_n_prior") == 0)).alias("is_debut"))
    small = tr.logistic().fit(train.join(tag.filter("is_debut"), "contest_id", "left_semi"))
    return _report(tr.debut_routing(main_model(t), small, test.join(tag, "contest_id"), C("is_debut")), "routed")


@query("permutation_importance")
def _(t):
    return tr.permutation_importance(main_model(t), plain(t)[1], COLUMNS)


@query("permutation_importance_accuracy")
def _(t):
    return tr.permutation_importance(main_model(t), plain(t)[1], COLUMNS, scoring="accuracy")


@query("top_features")
def _(t):
    return tr.top_features(tr.permutation_importance(main_model(t), plain(t)[1], COLUMNS), 5)


@query("single_feature_baselines")
def _(t):
    # Fitted and scored on the test rows, as a reference line rather than an honest estimate.
    test = plain(t)[1].select("y", "diff_elo", "diff_win_rate")
    return tr.single_feature_baselines(test, test, {"elo": ["diff_elo"], "win rate": ["diff_win_rate"], "both": ["diff_elo", "diff_win_rate"]})


@query("weight_ablation")
def _(t):
    train, test = plain(t)
    flat = train.withColumn("weight", F.lit(1.0))
    return _report(tr.score(tr.logistic().fit(train), test), "weighted").unionByName(_report(tr.score(tr.logistic().fit(flat), test), "unweighted"))


@query("calibration_ablation")
def _(t):
    train, test = split(t)
    raw = tr.score(tr.logistic().fit(train), test)
    forms = {"platt": tr.calibrate_platt(oof(t)), "isotonic": tr.calibrate_isotonic(oof(t))}
    out = _report(raw, "raw")
    for name, cal in forms.items():
        out = out.unionByName(_report(cal.apply(raw).drop("p").withColumnRenamed("p_cal", "p"), name))
    return out


@query("elo_validation")
def _(t):
    return tr.validate_elo(t.rated, stage(t.matchups_of("win_rate").select("contest_id", "f1_won", "diff_win_rate"), "rates"))


@query("elo_k_tuning")
def _(t):
    return tr.tune_k(stage(ratings.elo_ratings(t.games, k=[20.0, 32.0, 40.0]), "elo_grid"), CUTOFF)


@query("score_contests")
def _(t):
    """Every announced pair scored by one model in one pass, with picks, confidence and factors."""
    columns = [f"diff_{f}" for f in SNAPSHOT_FEATURES]
    # The model and the snapshot read the same few features of both sides, so those are written once.
    both = [f"{s}_{f}" for s in ("f1", "f2") for f in SNAPSHOT_FEATURES]
    pairs = stage(t.matchups_of(*SNAPSHOT_FEATURES).select("contest_id", "contest_date", "f1_id", "f2_id", "f1_won", *both), "snapshot_pairs")
    past = pairs.filter(C("contest_date") < F.lit(CUTOFF).cast("date")).withColumns({f"diff_{f}": C(f"f1_{f}") - C(f"f2_{f}") for f in SNAPSHOT_FEATURES})
    model = tr.logistic().fit(tr.prepare(past, columns, folds=None))
    snapshot = serving.latest_snapshot(pairs, SNAPSHOT_FEATURES)
    wide = serving.serving_matchup(serving.serving_features(_upcoming(t), snapshot, SNAPSHOT_FEATURES), SNAPSHOT_FEATURES)
    scored = tr.score(model, VectorAssembler(inputCols=columns, outputCol="features").transform(wide), "_p")
    out = serving.top_factors(serving.score_contests(scored, C("_p")), columns, 5)
    return out.select("contest_id", "f1_id", "f2_id", "p1", "p2", "predicted", "win_probability", "confidence", F.to_json("factors").alias("factors"))
