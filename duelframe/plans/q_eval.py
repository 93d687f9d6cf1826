"""Ratings, evaluation metrics, weights, folds and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import spec
from ..operators import metrics, ratings, segments
from ..session import stage
from .registry import big, query, r6, real
from .sqltext import CTE, spread_sql, sql
from .tables import CUTOFF, spread

C = F.col

# ---------------------------------------------------------------- ratings
_R = ["f1_elo", "f2_elo", "f1_peak", "f2_peak", "f1_expected"]


@query("elo_ratings", sql(f"SELECT contest_id, pool, f1_id, f2_id, {real(*_R)}, {big('f1_seen', 'f2_seen')} FROM bout_rated"))
def _(t):
    return t.rated.select("contest_id", "pool", "f1_id", "f2_id", *_R, "f1_seen", "f2_seen")


@query("elo_dynamic_k", sql(f"SELECT contest_id, {real('f1_elo', 'f2_elo')} FROM bout_rated", elo="greatest(16.0, 32.0 - {n} * 0.5)"))
def _(t):
    return ratings.elo_ratings(t.games, dynamic_k=True).select("contest_id", "f1_elo", "f2_elo")


_E = ["diff_elo", "f1_elo_expected", "f1_elo_momentum", "f2_elo_momentum", "diff_elo_momentum", "f1_elo_vs_peak", "f2_elo_vs_peak"]
_MOM = dict(
    appear="""SELECT contest_id, pool, seq, 'f1' AS role, f1_id AS side_id, f1_elo AS elo, f1_peak AS peak FROM bout_rated
      UNION ALL SELECT contest_id, pool, seq, 'f2', f2_id, f2_elo, f2_peak FROM bout_rated""",
    mom="""SELECT *, elo - coalesce(lag(elo, 3) OVER w, first_value(elo) OVER w) AS momentum, elo / greatest(peak, 1.0) AS vs_peak
      FROM appear WINDOW w AS (PARTITION BY pool, side_id ORDER BY seq)""")


@query("elo_features", sql(f"""
SELECT contest_id, {real(*_E)} FROM (SELECT r.contest_id, f1_elo - f2_elo AS diff_elo, f1_expected AS f1_elo_expected, a.momentum AS f1_elo_momentum,
  b.momentum AS f2_elo_momentum, a.momentum - b.momentum AS diff_elo_momentum, a.vs_peak AS f1_elo_vs_peak, b.vs_peak AS f2_elo_vs_peak
  FROM bout_rated r JOIN mom a ON a.contest_id = r.contest_id AND a.role = 'f1' JOIN mom b ON b.contest_id = r.contest_id AND b.role = 'f2')""", **_MOM))
def _(t):
    return ratings.elo_features(t.rated).select("contest_id", *_E)


@query("elo_momentum", sql(f"SELECT contest_id, role, {real('momentum', 'vs_peak')} FROM mom", **_MOM))
def _(t):
    wide = ratings.elo_features(t.rated)
    side = lambda s: F.struct(F.lit(s).alias("role"), C(f"{s}_elo_momentum").alias("momentum"), C(f"{s}_elo_vs_peak").alias("vs_peak"))
    return wide.select("contest_id", F.explode(F.array(side("f1"), side("f2"))).alias("s")).select("contest_id", "s.*")


_FINAL = dict(final="""SELECT pool, side_id, elo, peak, seen FROM (
  SELECT *, row_number() OVER (PARTITION BY pool, side_id ORDER BY seq DESC) AS back FROM (
    SELECT pool, seq, f1_id AS side_id, f1_elo + coalesce(32.0 * (g.score - f1_expected), 0) AS elo,
      greatest(f1_peak, f1_elo + coalesce(32.0 * (g.score - f1_expected), 0)) AS peak, f1_seen + 1 AS seen FROM bout_rated JOIN bout_games g USING (pool, seq)
    UNION ALL SELECT pool, seq, f2_id, f2_elo + coalesce(32.0 * ((1 - g.score) - (1 - f1_expected)), 0),
      greatest(f2_peak, f2_elo + coalesce(32.0 * ((1 - g.score) - (1 - f1_expected)), 0)), f2_seen + 1 FROM bout_rated JOIN bout_games g USING (pool, seq)
  )) WHERE back = 1""".replace("SELECT pool, seq, f1_id", "SELECT pool, seq, bout_rated.f1_id").replace("SELECT pool, seq, f2_id", "SELECT pool, seq, bout_rated.f2_id"))


@query("final_ratings", sql(f"SELECT pool, side_id, {real('elo', 'peak')}, {big('seen')} FROM final", **_FINAL))
def _(t):
    return t.latest


@query("top_rated", sql(f"SELECT pool, side_id, {real('elo')} FROM (SELECT * FROM final ORDER BY elo DESC, side_id LIMIT 25)", **_FINAL))
def _(t):
    return ratings.top_rated(t.latest, 25).select("pool", "side_id", "elo")


@query("rating_distribution", sql(f"""
SELECT {real('mean', 'std', 'min', 'max', 'median')}, n FROM (
  SELECT avg(elo) AS mean, stddev_pop(elo) AS std, min(elo) AS min, max(elo) AS max, median(elo) AS median, count(*) AS n FROM final)""", **_FINAL))
def _(t):
    return ratings.rating_distribution(t.latest)


# ---------------------------------------------------------------- metrics
_SCORED = dict(scored=f"SELECT doc_id, quality AS y, {spread_sql('doc_id')} AS p FROM labels",
               ranked="SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS mid FROM scored",
               auc="""SELECT (sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS roc_auc FROM ranked""",
               bins="""SELECT CAST(greatest(ceil(p * 10) - 1, 0) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM scored GROUP BY 1""")


def _scored(t):
    return t.read("labels").select("doc_id", C("quality").alias("y"), spread(C("doc_id")).alias("p"))


_BASIC = """SELECT count(*) AS n, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss, avg((p - y) * (p - y)) AS brier FROM scored"""


@query("binary_metrics", sql(f"""
SELECT n, {real('accuracy', 'log_loss', 'brier', 'roc_auc', 'mce')} FROM basic, auc, (SELECT avg(abs(mean_p - rate)) AS mce FROM bins)""", basic=_BASIC, **_SCORED))
def _(t):
    return metrics.binary_metrics(_scored(t))


@query("confusion_matrix", sql("SELECT CAST(y AS BIGINT) AS y, CAST(p > 0.5 AS BIGINT) AS predicted, count(*) AS n FROM scored GROUP BY 1, 2", **_SCORED))
def _(t):
    return metrics.confusion_matrix(_scored(t))


@query("calibration_bins", sql(f"SELECT bin, n, {real('mean_p', 'rate')} FROM bins", **_SCORED))
def _(t):
    return metrics.calibration_bins(_scored(t))


@query("mce_mean", sql(f"SELECT {r6('avg(abs(mean_p - rate))')} AS mce_mean FROM bins", **_SCORED))
def _(t):
    return metrics.calibration_error(_scored(t)).select("mce_mean")


@query("mce_max", sql(f"SELECT {r6('max(abs(mean_p - rate))')} AS mce_max FROM bins", **_SCORED))
def _(t):
    return metrics.calibration_error(_scored(t)).select("mce_max")


@query("accuracy_ceiling", sql(f"""
SELECT {r6('c')} AS ceiling, {r6('a')} AS current, {r6('c - a')} AS headroom, {r6('0.65 - c')} AS market_gap FROM (
  SELECT avg(CASE WHEN (rate > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS c, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a FROM (
    SELECT y, p, avg(y) OVER (PARTITION BY least(floor(p * 10), 9)) AS rate FROM scored))""", **_SCORED))
def _(t):
    return metrics.accuracy_ceiling(_scored(t))


_FRAME = dict(frame=f"SELECT m.*, f1_won AS y, {spread_sql('contest_id')} AS p, {spread_sql('(contest_id * 31 + 7)')} AS p2 FROM bout_matchups m")
_ACC = "avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)"
_LL = "avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END)"


def frame(t):
    return segments.analysis_frame(t.matchups, spread(C("contest_id")), CUTOFF)


@query("bucket_comparison", sql(f"""
SELECT bucket, count(*) AS n, {r6('avg(a)')} AS base_accuracy, {r6('avg(b)')} AS other_accuracy, {r6('avg(b) - avg(a)')} AS improvement FROM (
  SELECT CASE WHEN s >= 0.5 AND s < 0.55 THEN '50-55%' WHEN s >= 0.55 AND s < 0.6 THEN '55-60%' WHEN s >= 0.6 AND s < 0.65 THEN '60-65%'
    WHEN s >= 0.65 AND s < 0.7 THEN '65-70%' WHEN s >= 0.7 AND s < 1 THEN '70%+' END AS bucket, a, b FROM (
    SELECT greatest(p, 1 - p) AS s, CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS a, CASE WHEN (p2 > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS b FROM frame))
WHERE bucket IS NOT NULL GROUP BY bucket""", **_FRAME))
def _(t):
    return metrics.bucket_comparison(frame(t).withColumn("p2", spread(C("contest_id") * 31 + 7)))


@query("recency_weight_year", sql(f"SELECT contest_id, {r6('pow(0.5, ((SELECT max(year(contest_date)) FROM bouts) - year(contest_date)) / 8.0)')} AS weight FROM bouts"))
def _(t):
    return metrics.recency_weight_year(t.contests.select("contest_id", "contest_date")).select("contest_id", "weight")


@query("recency_weight_day", sql(f"SELECT contest_id, {r6('''exp(-ln(2.0) / 2920 * date_diff('day', contest_date, (SELECT max(contest_date) FROM bouts)))''')} AS weight FROM bouts"))
def _(t):
    return metrics.recency_weight_day(t.contests.select("contest_id", "contest_date")).select("contest_id", "weight")


@query("stratified_folds", sql("""
SELECT doc_id, CAST(y AS BIGINT) AS y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42')) - 1) % 5 AS BIGINT) AS fold FROM scored""", **_SCORED))
def _(t):
    return metrics.stratified_folds(_scored(t), "y", "doc_id").select("doc_id", "y", "fold")


_CORR = ["diff_n_prior", "diff_wins_prior", "diff_losses_prior", "diff_win_rate", "diff_win_rate_last_3", "diff_win_rate_last_5",
         "diff_win_rate_last_10", "diff_sig_landed_last_5", "diff_sig_landed_last_10"]
_CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", abs(corr({a}, {b})) AS corr FROM bout_matchups"
                               for i, a in enumerate(_CORR) for b in _CORR[i + 1:])


# Every difference of the two sides is a model column.
_ROLLED = [f"diff_{c}_last_{n}" for n in (3, 5, 10) for c in ("win_rate", "finish_rate", "sig_landed", "sig_absorbed", "td_landed", "duration")]
_DIFFS = [*[f"diff_{c}" for c in (
    "n_prior", "wins_prior", "losses_prior", "win_rate", "ko_rate", "sub_rate", "dec_rate", "finish_rate", "win_streak", "loss_streak",
    "days_since_last", "contests_per_year", "division_prior", "contests_last_365d", "is_debut", "completeness", "strike_volume", "grappling",
    "momentum")], *_ROLLED]
_ALL_PAIRS = "SELECT unnest([" + ", ".join(
    f"{{'a': '{a}', 'b': '{b}', 'corr': abs(corr({a}, {b}))}}" for i, a in enumerate(_DIFFS) for b in _DIFFS[i + 1:]) + "], recursive := true) FROM bout_matchups"


@query("correlated_pairs", sql(f"SELECT a AS \"left\", b AS \"right\", {real('corr')} FROM apairs WHERE corr > 0.7 AND NOT isnan(corr)", apairs=_ALL_PAIRS))
def _(t):
    return metrics.correlated_pairs(_columns(t, _DIFFS), _DIFFS, 0.7)


def _columns(t, names):
    """The named columns alone, written: correlations take two or more passes."""
    return stage(t.matchups.select(*names), "columns")


# Importance stand-in computed from the data: absolute correlation with the target minus a floor.
def _importance(columns):
    row = columns.agg(*[(F.abs(F.corr(c, "f1_won")) - 0.002).alias(c) for c in _CORR])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), C(c).alias("importance")) for c in _CORR])).alias("r")).select("r.*")


_PRUNE = dict(cpairs=_CORR_SQL, imp=" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, f1_won)) - 0.002 AS importance FROM bout_matchups" for c in _CORR))


@query("prune_features", sql(f"""
SELECT feature, {real('importance')} FROM imp WHERE importance > 0 AND feature NOT IN (
  SELECT CASE WHEN a.importance > b.importance THEN p."right" ELSE p."left" END FROM (
    SELECT p.* FROM cpairs p JOIN imp x ON x.feature = p."left" AND x.importance > 0 JOIN imp y ON y.feature = p."right" AND y.importance > 0
    WHERE corr > 0.7 ORDER BY corr DESC, "left", "right" LIMIT 5) p
  JOIN imp a ON a.feature = p."left" JOIN imp b ON b.feature = p."right")""", **_PRUNE))
def _(t):
    columns = _columns(t, [*_CORR, "f1_won"])
    return metrics.prune_features(_importance(columns), metrics.correlated_pairs(columns, _CORR, 0.7))


_INTER = ["diff_win_rate", "diff_n_prior", "diff_sig_landed_last_5"]


def _inter_sql() -> str:
    out = []
    for i, a in enumerate(_INTER):
        for b in _INTER[i + 1:]:
            out += [f"{r6(f'{a} * {b}')} AS {a}_x_{b}", f"{r6(f'CASE WHEN {b} = 0 THEN 0 ELSE {a} / (abs({b}) + 1e-10) END')} AS {a}_div_{b}",
                    f"{r6(f'abs({a} - {b})')} AS abs_{a}_minus_{b}"]
    return ", ".join(out)


@query("interaction_features", sql(f"SELECT contest_id, {_inter_sql()} FROM bout_matchups"))
def _(t):
    out = metrics.interaction_features(t.matchups.select("contest_id", *_INTER), _INTER)
    # A ratio to exactly zero is a huge number whose digits depend on rounding: shown as zero here.
    ratios = {c: F.when(C(c.split("_div_")[1]) == 0, F.lit(0.0)).otherwise(C(c)) for c in out.columns if "_div_" in c}
    return out.withColumns(ratios).drop(*_INTER)


_CAND = dict(models=" UNION ALL ".join(
    f"SELECT '{n}' AS model, {spread_sql(k)} AS p, f1_won AS y, contest_id FROM bout_matchups" for n, k in (
        ("base", "contest_id"), ("a", "(contest_id * 3 + 1)"), ("b", "(contest_id * 5 + 2)"), ("c", "(contest_id * 11 + 3)"))),
    mvals=f"SELECT model, {_ACC} AS accuracy, {_LL} AS log_loss, avg((p - y) * (p - y)) AS brier FROM models GROUP BY model")


def _candidates(t):
    m = t.matchups.select("contest_id", C("f1_won").alias("y"))
    frames = None
    for n, k in (("base", C("contest_id")), ("a", C("contest_id") * 3 + 1), ("b", C("contest_id") * 5 + 2), ("c", C("contest_id") * 11 + 3)):
        one = m.select(F.lit(n).alias("model"), "y", spread(k).alias("p"))
        frames = one if frames is None else frames.unionByName(one)
    hit = (metrics.predicted(C("p")) == C("y")).cast("double")
    return frames.groupBy("model").agg(F.avg(hit).alias("accuracy"), F.avg(metrics.row_log_loss(C("y"), C("p"))).alias("log_loss"),
                                       F.avg((C("p") - C("y")) * (C("p") - C("y"))).alias("brier"))


@query("compare_candidates", sql(f"""
SELECT model, wins, catastrophic, {real('log_loss')}, beats, coalesce(beats AND log_loss = min(CASE WHEN beats THEN log_loss END) OVER (), false) AS chosen FROM (
  SELECT m.model, CAST(m.accuracy > b.accuracy AS BIGINT) + CAST(m.log_loss < b.log_loss AS BIGINT) + CAST(m.brier < b.brier AS BIGINT) AS wins,
    CAST(b.accuracy - m.accuracy > 0.03 OR m.log_loss - b.log_loss > 0.03 AS BIGINT) AS catastrophic, m.log_loss,
    (CAST(m.accuracy > b.accuracy AS BIGINT) + CAST(m.log_loss < b.log_loss AS BIGINT) + CAST(m.brier < b.brier AS BIGINT) >= 2)
      AND NOT (b.accuracy - m.accuracy > 0.03 OR m.log_loss - b.log_loss > 0.03) AS beats
  FROM mvals m, (SELECT * FROM mvals WHERE model = 'base') b WHERE m.model <> 'base')""", **_CAND))
def _(t):
    return metrics.compare_candidates(metrics.long_metrics(_candidates(t), "model"), "base", min_wins=2)


@query("target_check", sql(f"""
SELECT 'accuracy' AS metric, {r6('accuracy')} AS value, {r6('0.62')} AS target, accuracy >= 0.62 AS met FROM basic
UNION ALL SELECT 'log_loss', {r6('log_loss')}, {r6('0.60')}, log_loss < 0.60 FROM basic UNION ALL SELECT 'roc_auc', {r6('roc_auc')}, {r6('0.68')}, roc_auc >= 0.68 FROM auc
UNION ALL SELECT 'brier', {r6('brier')}, {r6('0.25')}, brier < 0.25 FROM basic""", basic=_BASIC, **_SCORED))
def _(t):
    return metrics.target_check(metrics.binary_metrics(_scored(t)))


# ---------------------------------------------------------------- segments
def _seg(body: str, extra: str = "") -> str:
    return f"round({_ACC} * 100 + 1e-9, 1) AS accuracy, round({_LL} + 1e-9, 3) AS log_loss"


def _cut_sql(category: str, cuts: list[tuple[str, str]]) -> str:
    parts = [f"SELECT '{category}' AS category, '{label}' AS segment, y, p FROM frame WHERE {cond}" for label, cond in cuts]
    parts.append(f"SELECT '{category}', 'Overall', y, p FROM frame")
    return " UNION ALL ".join(parts)


_sure = "greatest(p, 1 - p)"
_up = "upper(method)"
CUT_SQL = {
    "confidence": [(n, f"{_sure} >= {a} AND {_sure} < {b}") for a, b, n in segments.CONFIDENCE],
    "streaks": [("Both streaking (2+)", "f1_win_streak >= 2 AND f2_win_streak >= 2"),
                ("One streaking", "(f1_win_streak >= 2) <> (f2_win_streak >= 2)"),
                ("Both losing", "f1_loss_streak >= 2 AND f2_loss_streak >= 2"),
                ("Streak 5+ vs <2", "(f1_win_streak >= 5 AND f2_win_streak < 2) OR (f2_win_streak >= 5 AND f1_win_streak < 2)")],
    "experience": [("Both experienced (10+)", "least(f1_n_prior, f2_n_prior) >= 10"), ("Both inexperienced (<5)", "greatest(f1_n_prior, f2_n_prior) < 5"),
                   ("Large gap (>8)", "abs(f1_n_prior - f2_n_prior) > 8"),
                   ("Debut vs veteran", "least(f1_n_prior, f2_n_prior) = 0 AND greatest(f1_n_prior, f2_n_prior) >= 5"),
                   ("Any debut", "least(f1_n_prior, f2_n_prior) = 0"), ("No debuts", "least(f1_n_prior, f2_n_prior) > 0")],
    "division": [(d.replace("'", "''"), f"contains(lower(division), '{d.lower().replace(chr(39), chr(39) * 2)}')") for d in spec.SEGMENT_DIVISIONS],
    "method": [("KO/TKO", f"{_up} LIKE '%KO%'"), ("Submission", f"{_up} LIKE '%SUB%'"), ("Unanimous Decision", f"{_up} LIKE '%UNANIMOUS%'"),
               ("Split Decision", f"{_up} LIKE '%SPLIT%'"), ("Majority Decision", f"{_up} LIKE '%MAJORITY%'"), ("All Decisions", f"{_up} LIKE '%DEC%'")],
    "finish": [("Finishes", f"{_up} LIKE '%KO%' OR {_up} LIKE '%SUB%'"), ("Decisions", f"{_up} LIKE '%DEC%'")],
    "era": [(n, f"year(contest_date) BETWEEN {a} AND {b}") for a, b, n in segments.ERAS],
}
_LEAST = "NOT (category IN ('division', 'era') AND n < 10 AND segment <> 'Overall') AND NOT (category = 'style' AND n < 30 AND segment <> 'Overall')"


def _report_sql(rows: str, **own: str) -> str:
    return sql(f"SELECT category, segment, n, accuracy, log_loss FROM (SELECT category, segment, count(*) AS n, {_seg('')} FROM ({rows}) GROUP BY 1, 2) WHERE {_LEAST}",
               **_FRAME, **own)


def _segment(name: str, cut: str):
    @query(name, _report_sql(_cut_sql(cut, CUT_SQL[cut])))
    def _(t):
        return segments.segment_report(frame(t), [cut])


for _name, _cut in (("segment_confidence", "confidence"), ("segment_streaks", "streaks"), ("segment_experience", "experience"),
                    ("segment_division", "division"), ("segment_method", "method"), ("segment_finish", "finish"), ("segment_era", "era")):
    _segment(_name, _cut)


@query("segment_metrics", sql(f"SELECT is_title, n, accuracy, log_loss FROM (SELECT CAST(is_title AS BIGINT) AS is_title, count(*) AS n, {_seg('')} FROM frame GROUP BY 1)", **_FRAME))
def _(t):
    return segments.metrics_of(frame(t), ["is_title"])


_GAP = dict(frame=f"SELECT m.*, m.f1_won AS y, {spread_sql('m.contest_id')} AS p, r.f1_elo - r.f2_elo AS diff_elo FROM bout_matchups m JOIN bout_rated r ON r.contest_id = m.contest_id")


@query("segment_elo_gap", sql(f"SELECT category, segment, n, accuracy, log_loss FROM (SELECT category, segment, count(*) AS n, {_seg('')} FROM ("
       + _cut_sql("elo_gap", [(n, f"abs(diff_elo) >= {a} AND abs(diff_elo) < {b}") for a, b, n in segments.ELO_GAPS]) + ") GROUP BY 1, 2)", **_GAP))
def _(t):
    return segments.segment_report(frame(t).join(t.rated.select("contest_id", "diff_elo"), "contest_id"), ["elo_gap"])


def _style_sql(s: str) -> str:
    a, b, c = f"coalesce({s}_sig_landed_last_5, 0)", f"coalesce({s}_td_landed_last_5, 0)", f"coalesce({s}_sub_rate, 0)"
    striker, grappler = f"({a} > ms AND {b} < mt)", f"({b} > mt OR {c} > mb)"
    return f"CASE WHEN {striker} AND NOT {grappler} THEN 'Striker' WHEN {grappler} AND NOT {striker} THEN 'Grappler' ELSE 'Balanced' END"


_STYLED = dict(styled=f"""SELECT *, least(f1_style, f2_style) || ' vs ' || greatest(f1_style, f2_style) AS style_pair FROM (SELECT frame.*, {_style_sql('f1')} AS f1_style, {_style_sql('f2')} AS f2_style FROM frame,
  (SELECT median(f1_sig_landed_last_5) AS ms, median(f1_td_landed_last_5) AS mt, median(f1_sub_rate) AS mb FROM frame))""")


def _styled(t, *features):
    """The analysis frame with styles and the named features of both sides, written: medians take passes of their own."""
    own = [f"{s}_{c}" for s in ("f1", "f2") for c in dict.fromkeys(["sig_landed_last_5", "td_landed_last_5", "sub_rate", *features])]
    pairs = t.matchups_of(*[c.removeprefix("f1_") for c in own if c.startswith("f1_")])
    rows = stage(pairs.select("contest_id", "contest_date", "division", "method", "f1_won", *own), "styled")
    return segments.with_style(segments.analysis_frame(rows, spread(C("contest_id")), CUTOFF))


_CUT_FEATURES = ("win_streak", "loss_streak", "n_prior")


@query("style_class", sql("SELECT contest_id, f1_style, f2_style FROM styled", **_FRAME, **_STYLED))
def _(t):
    return _styled(t).select("contest_id", "f1_style", "f2_style")


@query("segment_style", _report_sql("SELECT 'style' AS category, style_pair AS segment, y, p FROM styled UNION ALL SELECT 'style', 'Overall', y, p FROM styled", **_STYLED))
def _(t):
    return segments.segment_report(_styled(t), ["style"])


@query("style_matrix", sql(f"""
SELECT style, max(CASE WHEN other = 'Balanced' THEN accuracy END) AS "Balanced", max(CASE WHEN other = 'Grappler' THEN accuracy END) AS "Grappler", max(CASE WHEN other = 'Striker' THEN accuracy END) AS "Striker" FROM (
  SELECT least(f1_style, f2_style) AS style, greatest(f1_style, f2_style) AS other, {_seg('')}, count(*) AS n FROM styled GROUP BY 1, 2) WHERE n >= 20 GROUP BY style""", **_FRAME, **_STYLED))
def _(t):
    return segments.style_matrix(_styled(t))


_ALL = ["confidence", "streaks", "experience", "division", "method", "finish", "era", "style"]
_ALL_ROWS = " UNION ALL ".join(_cut_sql(c, CUT_SQL[c]).replace("y, p FROM frame", "y, p, contest_date FROM styled") for c in _ALL if c != "style") + \
    " UNION ALL SELECT 'style', style_pair, y, p, contest_date FROM styled UNION ALL SELECT 'style', 'Overall', y, p, contest_date FROM styled"


@query("segment_report", sql(f"""
SELECT is_test, category, segment, n, accuracy, log_loss FROM (
  SELECT CAST(contest_date >= DATE '{CUTOFF}' AS BIGINT) AS is_test, category, segment, count(*) AS n, {_seg('')} FROM ({_ALL_ROWS}) GROUP BY 1, 2, 3) WHERE {_LEAST}""", **_FRAME, **_STYLED))
def _(t):
    return segments.segment_report(_styled(t, *_CUT_FEATURES), _ALL, ["is_test"])


@query("strengths_weaknesses", sql(f"""
WITHREP SELECT kind, category, segment, n, accuracy, diff_from_overall FROM (
  SELECT 'strength' AS kind, * FROM (SELECT * FROM rep WHERE diff_from_overall > 0 ORDER BY accuracy DESC, category, segment LIMIT 8)
  UNION ALL SELECT 'weakness', * FROM (SELECT * FROM rep WHERE accuracy <= 55 ORDER BY accuracy DESC, category, segment LIMIT 8) WHERE (SELECT count(*) FROM rep WHERE accuracy <= 55) >= 5
  UNION ALL SELECT 'weakness', * FROM (SELECT * FROM rep ORDER BY accuracy, category DESC, segment DESC LIMIT 8) WHERE (SELECT count(*) FROM rep WHERE accuracy <= 55) < 5)""".replace("WITHREP ", ""),
    rep=f"""SELECT category, segment, n, accuracy, round(accuracy - 50.0 + 1e-9, 1) AS diff_from_overall FROM (
      SELECT category, segment, count(*) AS n, {_seg('')} FROM ({_ALL_ROWS}) GROUP BY 1, 2) WHERE n >= 30 AND segment <> 'Overall' AND {_LEAST}""", **_FRAME, **_STYLED))
def _(t):
    report = segments.segment_report(_styled(t, *_CUT_FEATURES), _ALL)
    return segments.strengths_weaknesses(report, 50.0).select("kind", "category", "segment", "n", "accuracy", "diff_from_overall")


@query("analysis_frame", sql(f"""
SELECT contest_id, {big('y')}, {real('p')}, CAST(p > 0.5 AS BIGINT) AS predicted, CAST((p > 0.5) = (y = 1) AS BIGINT) AS correct,
  {r6('greatest(p, 1 - p)')} AS confidence, CAST(contest_date >= DATE '{CUTOFF}' AS BIGINT) AS is_test FROM frame""", **_FRAME))
def _(t):
    return frame(t).select("contest_id", "y", "p", "predicted", "correct", "confidence", "is_test")
