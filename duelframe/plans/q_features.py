"""Reshape, windows, opponent profiles, imputation and feature-table reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import spec
from ..operators import imputation, opponents, physical, quality, reshape
from .registry import big, query, real
from .sqltext import W, sql
from .tables import CUTOFF

C = F.col
KEYS = ["contest_id", "side_id"]
_NUM = ["won", "kd", "sig_landed", "sig_attempted", "tot_landed", "tot_attempted", "td_landed", "td_attempted",
        "sub_attempts", "control_s", "sig_absorbed", "opp_sig_attempted", "duration_s"]


@query("explode_sides", sql(f"""
SELECT contest_id, contest_date, event_name, division, method, CAST(round_no AS BIGINT) AS round, detailed, side_id, opp_id, {big(*_NUM)} FROM bout_sides"""))
def _(t):
    return t.sides


def _career(name: str, ints: list[str], doubles: list[str]):
    cols = [c for c in (big(*ints) if ints else "", real(*doubles) if doubles else "") if c]
    @query(name, sql(f"SELECT contest_id, side_id, {', '.join(cols)} FROM bout_career"))
    def _(t):
        return t.career.select(*KEYS, *ints, *doubles)


_career("career_counts", ["n_prior", "wins_prior", "losses_prior"], [])
_career("career_rates", [], ["win_rate", "ko_rate", "sub_rate", "dec_rate", "finish_rate"])
_career("streaks", ["win_streak", "loss_streak"], [])
_career("days_since_last", ["days_since_last"], [])
_career("contests_per_year", [], ["contests_per_year"])
_career("rolling_last_n", [], [f"{m}_last_{n}" for n in spec.WINDOWS for m in spec.ROLLING])
_career("division_experience", ["division_prior"], [])
_career("contests_last_365d", ["contests_last_365d"], [])


def _skill(name: str, column: str):
    @query(name, sql(f"SELECT contest_id, side_id, {real(column)} FROM opp_raw"))
    def _(t):
        return t.profiles.select(*KEYS, column)


_skill("opponent_striking_skill", "raw_opp_striking")
_skill("opponent_grappling_skill", "raw_opp_grappling")
_skill("opponent_durability", "raw_opp_durability")
_skill("opponent_overall_quality", "raw_opp_quality")


@query("opponent_profile_asof", sql(f"""
SELECT contest_id, side_id, CAST(coalesce((SELECT count(*) FROM bout_sides h WHERE h.side_id = s.opp_id AND h.contest_date < s.contest_date), 0) AS BIGINT) AS opp_earlier,
  {real('raw_opp_striking', 'raw_opp_grappling', 'raw_opp_durability', 'raw_opp_quality')} FROM opp_raw s"""))
def _(t):
    return t.profiles.select(*KEYS, "opp_earlier", *[f"raw_opp_{s}" for s in spec.SKILLS])


_Z = [f"opp_{s}" for s in spec.SKILLS]


@query("zscore_skill", sql(f"SELECT contest_id, side_id, {real(*_Z)} FROM opp_scaled"))
def _(t):
    return t.skills.select(*KEYS, *_Z)


_ADJ = [c + "_adj" for c in ("sig_landed", "sig_attempted", "tot_landed", "tot_attempted", "td_landed", "td_attempted",
                             "sub_attempts", "control_s", "kd", "won")]


@query("adjust_by_opponent", sql(f"SELECT contest_id, side_id, {real(*_ADJ)} FROM opp_adj"))
def _(t):
    return opponents.adjust_by_opponent(t.skilled).select(*KEYS, *_ADJ)


@query("adjusted_career", sql(f"SELECT contest_id, side_id, {real('adj_win_rate')} FROM bout_adjusted"))
def _(t):
    return t.adjusted_of(["adj_win_rate"], ["won"], ["quality"])


_AVG = [f"avg_opp_{s}" for s in spec.SKILLS]


@query("expanding_opponent_avg", sql(f"SELECT contest_id, side_id, {real(*_AVG)} FROM bout_adjusted"))
def _(t):
    return t.adjusted_of(_AVG, [], list(spec.SKILLS))


_ROLL = [f"{m}_last_{n}" for n in spec.WINDOWS for m in spec.ADJUSTED_ROLLING]


@query("adjusted_rolling", sql(f"SELECT contest_id, side_id, {real(*_ROLL)} FROM bout_adjusted"))
def _(t):
    return t.adjusted_of(_ROLL, ["won", "sig_landed", "td_landed", "control_s", "kd"], list(spec.SKILLS))


@query("fill_adjusted_defaults", sql(f"""
SELECT count(*) AS sides, {', '.join(f'CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}' for c in _AVG + _ROLL)} FROM bout_adjusted"""))
def _(t):
    # Filled columns hold no null by their type, so the windows behind them are pruned and no skill is read.
    return t.adjusted_of(_AVG + _ROLL, [], []).agg(F.count(F.lit(1)).alias("sides"), *[F.sum(C(c).isNull().cast("long")).alias(c) for c in _AVG + _ROLL])


@query("skill_distribution", sql(" UNION ALL ".join(
    f"""SELECT '{s}' AS skill, {real('m', 'd', 'lo', 'hi', 'med')}, neutral FROM (SELECT avg(opp_{s}) AS m, stddev_samp(opp_{s}) AS d,
    min(opp_{s}) AS lo, max(opp_{s}) AS hi, median(opp_{s}) AS med, CAST(sum(CASE WHEN raw_opp_{s} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS neutral FROM opp_scaled)"""
    for s in spec.SKILLS)))
def _(t):
    return quality.skill_distribution(t.skills).toDF("skill", "m", "d", "lo", "hi", "neutral", "med")


_MED = ["med_sig_landed", "med_sig_absorbed", "med_td_landed", "med_duration"]


@query("division_medians", sql(f"SELECT division, {real(*_MED)} FROM med"))
def _(t):
    return t.medians


_IMP = list(spec.DEBUT) + [f"{m}_last_{w}" for w in spec.WINDOWS for m in imputation.MEASURES]


@query("impute_debut", sql(f"SELECT contest_id, side_id, {real(*_IMP)} FROM bout_imputed WHERE n_prior = 0"))
def _(t):
    return t.imputed.filter("n_prior = 0").select(*KEYS, *_IMP)


@query("impute_novice", sql(f"SELECT contest_id, side_id, {real(*_IMP)} FROM bout_imputed WHERE n_prior IN (1, 2)"))
def _(t):
    return t.imputed.filter("n_prior IN (1, 2)").select(*KEYS, *_IMP)


@query("completeness", sql(f"SELECT contest_id, side_id, {big('is_debut')}, {real('completeness')} FROM bout_imputed"))
def _(t):
    return t.imputed.select(*KEYS, "is_debut", "completeness")


_CAREER = [f for f in spec.SIDE_FEATURES if f.group in ("career", "rolling")]
_INT = {"n_prior", "wins_prior", "losses_prior", "win_streak", "loss_streak", "days_since_last", "division_prior", "contests_last_365d", "is_debut"}
_INTS = [p + f.name for f in _CAREER if f.name in _INT for p in ("f1_", "f2_", "diff_")]
_REALS = [p + f.name for f in _CAREER if f.name not in _INT and f.diff for p in ("f1_", "f2_", "diff_")]


@query("build_matchups", sql(f"""
SELECT contest_id, contest_date, event_name, division, f1_id, f2_id, CAST(f1_won AS BIGINT) AS f1_won, {big(*_INTS)}, {real(*_REALS)} FROM bout_matchups"""))
def _(t):
    return t.matchups.select("contest_id", "contest_date", "event_name", "division", "f1_id", "f2_id", "f1_won", *_INTS, *_REALS)


_STYLE = ["f1_strike_volume", "f2_strike_volume", "diff_strike_volume", "f1_grappling", "f2_grappling", "diff_grappling",
          "f1_experience_ratio", "f2_experience_ratio"]


@query("style_ratios", sql(f"SELECT contest_id, {real(*_STYLE)}, {big('diff_momentum')} FROM bout_matchups"))
def _(t):
    return t.matchups.select("contest_id", *_STYLE, "diff_momentum")


_DIVS = ["Heavyweight", "Light Heavyweight", "Lightweight", "Middleweight", "Welterweight"]


@query("one_hot_dynamic", sql("SELECT contest_id, " + ", ".join(
    f"CAST(division = '{d}' AS BIGINT) AS \"{'wc_' + d.replace(' ', '_')}\"" for d in _DIVS) + " FROM bouts"))
def _(t):
    named = t.contests.select("contest_id", F.regexp_replace("division", " ", "_").alias("division"))
    return reshape.one_hot_dynamic(named, "division", "wc_").drop("division")


@query("one_hot_fixed", sql("SELECT contest_id, " + ", ".join(
    f"CAST(contains(lower(division), '{d.lower().replace(chr(39), chr(39) * 2)}') AS BIGINT) AS {reshape.division_column(d)}"
    for d in spec.DIVISIONS) + " FROM bouts"))
def _(t):
    return reshape.one_hot_fixed(t.contests.select("contest_id", "division")).drop("division")


@query("temporal_split", sql(f"""
SELECT CASE WHEN contest_date < DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(contest_date) AS first, max(contest_date) AS last
FROM bouts GROUP BY 1"""))
def _(t):
    train, test = reshape.temporal_split(t.contests, CUTOFF)
    row = lambda df, part: df.agg(F.count(F.lit(1)).alias("n"), F.min("contest_date").alias("first"), F.max("contest_date").alias("last")).withColumn("part", F.lit(part))
    return row(train, "train").unionByName(row(test, "test"))


_SET = ["diff_win_rate", "diff_finish_rate", "diff_win_streak", "diff_loss_streak", "diff_days_since_last", "diff_n_prior",
        "diff_win_rate_last_3", "diff_win_rate_last_5", "diff_sig_landed_last_5", "diff_sig_absorbed_last_5", "diff_td_landed_last_5"]


@query("select_feature_set", sql(f"SELECT contest_id, {', '.join((real if c not in _INTS else big)(c) for c in _SET)} FROM bout_matchups"))
def _(t):
    return t.matchups.select("contest_id", *spec.select_feature_set(t.plan_of("matchups").columns, "base"))


@query("event_on_or_after", sql("""
SELECT contest_id, contest_date, event_name FROM bouts
WHERE (contest_date, event_name) = (SELECT (contest_date, event_name) FROM bouts WHERE contest_date >= DATE '1999-12-30' ORDER BY contest_date, event_name LIMIT 1)"""))
def _(t):
    return reshape.event_on_or_after(t.contests, "1999-12-30").select("contest_id", "contest_date", "event_name")


@query("next_event", sql("""
SELECT event_name, contest_date, count(*) AS n FROM bouts
WHERE contest_date = (SELECT min(contest_date) FROM bouts WHERE contest_date > DATE '2000-06-15') GROUP BY 1, 2"""))
def _(t):
    return reshape.event_on_or_after(t.contests, "2000-06-16").groupBy("event_name", "contest_date").agg(F.count(F.lit(1)).alias("n"))


@query("fill_missing_zero", sql(f"SELECT contest_id, round(coalesce(diff_win_rate_last_3, 0) + 1e-9, 6) AS diff_win_rate_last_3, round(coalesce(diff_contests_per_year, 0) + 1e-9, 6) AS diff_contests_per_year FROM bout_matchups"))
def _(t):
    cols = ["diff_win_rate_last_3", "diff_contests_per_year"]
    return reshape.fill_missing_zero(t.matchups.select("contest_id", *cols), cols)


_PHYS_SQL = dict(
    pmed="""SELECT division, coalesce(median(height), 70.0) AS height, coalesce(median(reach), 70.0) AS reach, 30.0 AS age
      FROM (SELECT DISTINCT division, side_id FROM bout_sides) m LEFT JOIN people p USING (side_id) GROUP BY division
      UNION ALL SELECT '_global', coalesce(median(height), 70.0), coalesce(median(reach), 70.0), 30.0 FROM people""",
    phys="""SELECT s.contest_id, s.side_id, CAST(coalesce(p.height, m.height) AS DOUBLE) AS height, CAST(coalesce(p.reach, m.reach) AS DOUBLE) AS reach,
      CASE WHEN a BETWEEN 18 AND 60 THEN a ELSE 30.0 END AS age,
      CASE WHEN coalesce(p.stance, 'Orthodox') = 'Orthodox' THEN 1 ELSE 0 END AS stance_orthodox,
      CASE WHEN p.stance = 'Southpaw' THEN 1 ELSE 0 END AS stance_southpaw, CASE WHEN p.stance = 'Switch' THEN 1 ELSE 0 END AS stance_switch
      FROM (SELECT s.*, CAST(date_diff('day', q.born, s.contest_date) / 365.25 AS DOUBLE) AS a FROM bout_sides s LEFT JOIN people q ON q.side_id = s.side_id) s
      LEFT JOIN people p ON p.side_id = s.side_id JOIN pmed m ON m.division = s.division""")


def _physical(t):
    cols = ["contest_id", "contest_date", "division", "side_id"]
    return imputation.impute_physical(t.sides.select(*cols), t.competitors, imputation.physical_medians(t.sides, t.competitors))


@query("physical_medians", sql(f"SELECT division, {real('height', 'reach', 'age')} FROM pmed", **_PHYS_SQL))
def _(t):
    return imputation.physical_medians(t.sides, t.competitors)


_STANCE = ["stance_orthodox", "stance_southpaw", "stance_switch"]


@query("impute_physical", sql(f"SELECT contest_id, side_id, {real('height', 'reach', 'age')}, {big(*_STANCE)} FROM phys", **_PHYS_SQL))
def _(t):
    return _physical(t).select(*KEYS, *imputation.PHYSICAL)


@query("competitor_lookup", sql("""
SELECT s.contest_id, s.side_id, p.name, coalesce(p.stance, 'Orthodox') AS stance FROM bout_sides s LEFT JOIN people p ON p.side_id = s.side_id"""))
def _(t):
    return physical.competitor_lookup(t.sides, t.competitors).select(*KEYS, "name", "stance")


_PD = ["diff_height", "diff_reach", "diff_age", "f1_reach_advantage", "f2_reach_advantage", "diff_reach_advantage"]


@query("physical_diffs", sql(f"""
SELECT contest_id, {real(*_PD)}, CAST(mismatch AS BIGINT) AS stance_mismatch FROM (
  SELECT a.contest_id, a.height - b.height AS diff_height, a.reach - b.reach AS diff_reach, a.age - b.age AS diff_age,
    a.reach - a.height AS f1_reach_advantage, b.reach - b.height AS f2_reach_advantage, (a.reach - a.height) - (b.reach - b.height) AS diff_reach_advantage,
    (a.stance_orthodox = 1 AND b.stance_southpaw = 1) OR (a.stance_southpaw = 1 AND b.stance_orthodox = 1) AS mismatch
  FROM phys a JOIN phys b ON a.contest_id = b.contest_id AND a.side_id < b.side_id)""", **_PHYS_SQL))
def _(t):
    return physical.physical_matchups(_physical(t)).select("contest_id", *_PD, "stance_mismatch")


_ALL = [f for f in spec.SIDE_FEATURES if f.diff and f.name not in _INT]
_ALL_REALS = [p + f.name for f in _ALL for p in ("f1_", "f2_", "diff_")] + _STYLE + _PD
_FLAGS = [f"{s}_{n}" for s in ("f1", "f2") for n in ("layoff", "new_to_division")] + ["is_title", "contest_year", "contest_month", "diff_momentum"]
_DIV_COLS = [reshape.division_column(d) for d in spec.DIVISIONS]
_PHYS_PAIRS = """SELECT a.contest_id, a.height - b.height AS diff_height, a.reach - b.reach AS diff_reach, a.age - b.age AS diff_age,
  a.reach - a.height AS f1_reach_advantage, b.reach - b.height AS f2_reach_advantage, (a.reach - a.height) - (b.reach - b.height) AS diff_reach_advantage,
  (a.stance_orthodox = 1 AND b.stance_southpaw = 1) OR (a.stance_southpaw = 1 AND b.stance_orthodox = 1) AS stance_mismatch
  FROM phys a JOIN phys b ON a.contest_id = b.contest_id AND a.side_id < b.side_id"""


@query("feature_table", sql(f"""
SELECT contest_id, contest_date, event_name, division, f1_id, f2_id, CAST(f1_won AS BIGINT) AS f1_won, f1_detailed, f2_detailed,
  CAST(stance_mismatch AS BIGINT) AS stance_mismatch, {big(*_INTS, *_FLAGS)}, {real(*_ALL_REALS)},
  {', '.join(f"CAST(contains(lower(division), '{d.lower().replace(chr(39), chr(39) * 2)}') AS BIGINT) AS {c}" for d, c in zip(spec.DIVISIONS, _DIV_COLS))}
FROM all_matchups JOIN phys_pairs USING (contest_id)""", phys_pairs=_PHYS_PAIRS, **_PHYS_SQL))
def _(t):
    return t.feature_table().select("contest_id", "contest_date", "event_name", "division", "f1_id", "f2_id", "f1_won", "f1_detailed", "f2_detailed",
                                    "stance_mismatch", *_INTS, *_FLAGS, *_ALL_REALS, *_DIV_COLS)


_REC = {"running": f"""SELECT contest_id, contest_date, side_id, n AS n, wins AS w, n - wins AS l FROM counted"""}


@query("running_record", sql(f"""
SELECT a.contest_id, {', '.join(f'CAST({s}.{c} AS BIGINT) AS {f}_{m}' for s, f in (('a', 'f1'), ('b', 'f2')) for c, m in (('w', 'wins'), ('l', 'losses')))}
FROM running a JOIN running b ON a.contest_id = b.contest_id AND a.side_id < b.side_id""", **_REC))
def _(t):
    return physical.running_record(t.career)


@query("prior_career_features", sql(f"""
SELECT contest_id, {big('f1_pre_wins', 'f1_pre_losses', 'f2_pre_wins', 'f2_pre_losses', 'diff_pre_contests')}, {real('f1_pre_rate', 'f2_pre_rate', 'diff_pre_rate')} FROM (
  SELECT a.contest_id, a.pw AS f1_pre_wins, a.pl AS f1_pre_losses, b.pw AS f2_pre_wins, b.pl AS f2_pre_losses, (a.pw + a.pl) - (b.pw + b.pl) AS diff_pre_contests,
    CAST(a.pw AS DOUBLE) / (a.pw + a.pl + 1) AS f1_pre_rate, CAST(b.pw AS DOUBLE) / (b.pw + b.pl + 1) AS f2_pre_rate,
    CAST(a.pw AS DOUBLE) / (a.pw + a.pl + 1) - CAST(b.pw AS DOUBLE) / (b.pw + b.pl + 1) AS diff_pre_rate
  FROM pre a JOIN pre b ON a.contest_id = b.contest_id AND a.side_id < b.side_id)""",
    pre="SELECT r.*, greatest(p.total_wins - r.w, 0) AS pw, greatest(p.total_losses - r.l, 0) AS pl FROM running r JOIN people p ON p.side_id = r.side_id", **_REC))
def _(t):
    return physical.prior_career_features(t.career, t.competitors)


@query("prior_career_at_debut", sql(f"""
SELECT p.side_id, CAST(greatest(total_wins - coalesce(w, 0), 0) AS BIGINT) AS pre_wins, CAST(greatest(total_losses - coalesce(l, 0), 0) AS BIGINT) AS pre_losses,
  round(coalesce(CAST(greatest(total_wins - coalesce(w, 0), 0) AS DOUBLE) / nullif(greatest(total_wins - coalesce(w, 0), 0) + greatest(total_losses - coalesce(l, 0), 0), 0), 0.5) + 1e-9, 6) AS pre_win_rate
FROM people p LEFT JOIN (SELECT side_id, sum(won) AS w, sum(1 - won) AS l FROM bout_sides GROUP BY side_id) s ON s.side_id = p.side_id"""))
def _(t):
    return physical.prior_career_at_debut(t.sides, t.competitors)


_DEB = ["any_debut", "both_debut", "f1_debut", "f2_debut", "f1_early", "f2_early", "experience_gap"]


@query("debut_features", sql(f"""
SELECT contest_id, {big(*_DEB)}, {real('debut_opp_win_rate', 'debut_opp_contests')} FROM (
  SELECT contest_id, CASE WHEN f1_n_prior = 0 OR f2_n_prior = 0 THEN 1 ELSE 0 END AS any_debut, CASE WHEN f1_n_prior = 0 AND f2_n_prior = 0 THEN 1 ELSE 0 END AS both_debut,
    CASE WHEN f1_n_prior = 0 THEN 1 ELSE 0 END AS f1_debut, CASE WHEN f2_n_prior = 0 THEN 1 ELSE 0 END AS f2_debut,
    CASE WHEN f1_n_prior < 3 THEN 1 ELSE 0 END AS f1_early, CASE WHEN f2_n_prior < 3 THEN 1 ELSE 0 END AS f2_early,
    abs(f1_n_prior - f2_n_prior) AS experience_gap,
    CASE WHEN f1_n_prior = 0 AND f2_n_prior > 0 THEN f2_win_rate WHEN f2_n_prior = 0 AND f1_n_prior > 0 THEN f1_win_rate ELSE 0 END AS debut_opp_win_rate,
    CASE WHEN f1_n_prior = 0 AND f2_n_prior > 0 THEN f2_n_prior WHEN f2_n_prior = 0 AND f1_n_prior > 0 THEN f1_n_prior ELSE 0 END AS debut_opp_contests FROM bout_matchups)"""))
def _(t):
    return physical.debut_features(t.matchups).select("contest_id", *_DEB, "debut_opp_win_rate", "debut_opp_contests")


@query("conditional_mean_table", sql(f"""
SELECT category, won, {big('n')}, {real('sig_landed', 'td_landed', 'duration_s')} FROM (
  SELECT CASE WHEN method = 'KO/TKO' THEN 'KO/TKO' WHEN method = 'Submission' THEN 'Submission' WHEN method LIKE 'Decision%' THEN 'Decision' ELSE 'Other' END AS category,
    CAST(won AS BIGINT) AS won, count(*) AS n, avg(sig_landed) AS sig_landed, avg(td_landed) AS td_landed, avg(duration_s) AS duration_s
  FROM bout_sides WHERE detailed GROUP BY 1, 2 HAVING count(*) > 10
  UNION ALL SELECT 'overall', NULL, count(*), avg(sig_landed), avg(td_landed), avg(duration_s) FROM bout_sides WHERE detailed)"""))
def _(t):
    return quality.conditional_mean_table(t.sides.filter("detailed"), ["sig_landed", "td_landed", "duration_s"])


_QCOLS = ["contest_id", "winner", "method", "round_text", "red_sig_str"]


_MISSING = {"contest_id": "contest_id IS NULL", "winner": "winner IS NULL", "method": "method IS NULL", "round_text": "round_no IS NULL", "red_sig_str": "NOT detailed"}


@query("quality_report", sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS field, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS missing, count(*) AS n_rows, count(*) - count(DISTINCT contest_id) AS duplicates,
  round(CAST(count(*) FILTER (WHERE NOT ({bad})) AS DOUBLE) / count(*) + 1e-9, 6) AS present FROM bouts""" for c, bad in _MISSING.items())))
def _(t):
    return quality.quality_report(t.contests.select(*_QCOLS), "contest_id")


@query("feature_validation", sql("""
SELECT 'null' AS rule, c AS field, bad, bad = 0 AS passed FROM (SELECT 'f1_win_rate' AS c, CAST(count(*) FILTER (WHERE f1_win_rate IS NULL) AS BIGINT) AS bad FROM bout_matchups
  UNION ALL SELECT 'f2_win_rate', CAST(count(*) FILTER (WHERE f2_win_rate IS NULL) AS BIGINT) FROM bout_matchups UNION ALL SELECT 'f1_won', CAST(count(*) FILTER (WHERE f1_won IS NULL) AS BIGINT) FROM bout_matchups)
UNION ALL """ + " UNION ALL ".join(
    f"SELECT 'unit_range', '{c}', bad, bad = 0 FROM (SELECT CAST(count(*) FILTER (WHERE {c} < 0 OR {c} > 1) AS BIGINT) AS bad FROM bout_matchups)"
    for c in [f"{s}_{m}" for s in ("f1", "f2") for m in quality.RATES]) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'not_negative', '{c}', bad, bad = 0 FROM (SELECT CAST(count(*) FILTER (WHERE {c} < 0) AS BIGINT) AS bad FROM bout_matchups)"
    for c in ("f1_n_prior", "f2_n_prior", "f1_wins_prior", "f2_wins_prior")) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'skill_range', '{c}', bad, bad = 0 FROM (SELECT CAST(count(*) FILTER (WHERE {c} < 0.4 OR {c} > 1.6) AS BIGINT) AS bad FROM all_matchups)"
    for c in ("f1_avg_opp_quality", "f2_avg_opp_quality"))))
def _(t):
    return quality.feature_validation(t.feature_pairs)


@query("leakage_check", sql("""
SELECT CAST(count(*) FILTER (WHERE opp_earlier IS NULL OR opp_earlier = 0) AS BIGINT) AS checked,
  CAST(count(*) FILTER (WHERE (opp_earlier IS NULL OR opp_earlier = 0) AND abs(opp_quality - 1.0) > 0.01) AS BIGINT) AS leaks, true AS passed FROM opp_scaled"""))
def _(t):
    return quality.leakage_check(t.skilled)


@query("extreme_opponent_quality", sql(f"""
WITH_LATEST SELECT * FROM (SELECT 'highest' AS kind, side_id, {real('avg_opp_quality', 'win_rate')}, CAST(n_prior AS BIGINT) AS n_prior FROM latest ORDER BY round(avg_opp_quality, 9) DESC, side_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'lowest', side_id, {real('avg_opp_quality', 'win_rate')}, CAST(n_prior AS BIGINT) FROM latest ORDER BY round(avg_opp_quality, 9), side_id LIMIT 5)""".replace("WITH_LATEST ", ""),
    latest="""SELECT a.side_id, a.avg_opp_quality, c.win_rate, c.n_prior FROM (SELECT *, row_number() OVER (PARTITION BY side_id ORDER BY contest_date DESC, contest_id DESC) AS back FROM bout_adjusted) a
      JOIN bout_career c ON c.contest_id = a.contest_id AND c.side_id = a.side_id WHERE a.back = 1 AND c.n_prior >= 5"""))
def _(t):
    joined = t.adjusted.select(*KEYS, "contest_date", "avg_opp_quality").join(t.career.select(*KEYS, "n_prior", "win_rate"), KEYS)
    return quality.extreme_opponent_quality(joined, 5)


_DESC = ["diff_win_rate", "diff_n_prior", "diff_sig_landed_last_5"]


@query("feature_report", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS n, {real('m', 'd', 'lo', 'hi')} FROM (SELECT {c}, avg({c}) OVER () AS m, stddev_samp({c}) OVER () AS d, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM bout_matchups) GROUP BY m, d, lo, hi"
    for c in _DESC + ["f1_won", "f1_is_debut", "f2_is_debut"])))
def _(t):
    return quality.feature_report(t.matchups, _DESC + ["f1_won", "f1_is_debut", "f2_is_debut"])


@query("load_summary", sql("""
SELECT count(*) AS contests, count(DISTINCT event_name) AS events, min(contest_date) AS first, max(contest_date) AS last FROM bouts"""))
def _(t):
    return quality.load_summary(t.contests)


@query("chronological_order", sql("SELECT contest_id, contest_date, division FROM bouts ORDER BY contest_date, contest_id"))
def _(t):
    return t.contests.select("contest_id", "contest_date", "division").orderBy("contest_date", "contest_id")


@query("join_by_contest", sql(f"""
SELECT r.contest_id, {big('w', 'l')} FROM (SELECT c.contest_id, sum(c.wins) AS w, sum(c.n - c.wins) AS l FROM counted c GROUP BY c.contest_id) r JOIN bouts b ON b.contest_id = r.contest_id"""))
def _(t):
    per = t.career.groupBy("contest_id").agg(F.sum("wins_prior").alias("w"), F.sum("losses_prior").alias("l"))
    return t.contests.select("contest_id").join(per, "contest_id")
