"""DuckDB text of the shared tables, written independently of the Spark operators.

``sql(body)`` puts every named table the body mentions in front of it, dependencies first.
"""

from __future__ import annotations

import re

from .. import spec

CTE: dict[str, str] = {}
W = "(PARTITION BY side_id ORDER BY contest_date, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def trailing(n: int) -> str:
    return f"(PARTITION BY side_id ORDER BY contest_date, contest_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def name_sql(key: str) -> str:
    letters = f"translate(md5(CAST({key} AS VARCHAR)), '0123456789abcdef', 'aeioulnrstmdkbgv')"
    word = lambda at, n: f"upper(substr({letters}, {at}, 1)) || substr({letters}, {at + 1}, {n - 1})"
    return f"({word(1, 6)} || ' ' || {word(9, 8)})"


def spread_sql(key: str) -> str:
    return f"(CAST(({key} * 7919) % 1000 AS DOUBLE) + 0.5) / 1000.0"


def clock_sql(seconds: str) -> str:
    return f"(CAST(({seconds}) // 60 AS VARCHAR) || ':' || lpad(CAST(({seconds}) % 60 AS VARCHAR), 2, '0'))"


CTE["line_sides"] = """
SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS landed,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
  CAST(sum(l_linenumber) AS BIGINT) AS lines,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, min(l_returnflag) AS flag
FROM lineitem GROUP BY l_orderkey, l_suppkey"""

CTE["ranked_sides"] = """
SELECT *, l_orderkey * 101 + rn - 1 AS contest_id FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_line, l_suppkey) AS rn FROM line_sides)"""

CTE["bouts"] = """
SELECT r.contest_id, CAST(o.o_orderdate AS DATE) AS contest_date,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Lightweight' WHEN '2-HIGH' THEN 'Light Heavyweight'
    WHEN '3-MEDIUM' THEN 'Heavyweight' WHEN '4-NOT SPECIFIED' THEN 'Welterweight' WHEN '5-LOW' THEN 'Middleweight' END AS division,
  r.l_suppkey AS red_id, b.l_suppkey AS blue_id,
  'Card ' || CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) || CASE WHEN day(o.o_orderdate) = 1 THEN ' Title Night' ELSE '' END AS event_name,
  CASE WHEN r.contest_id % 53 = 9 THEN 'No Contest' WHEN r.contest_id % 41 = 7 THEN 'Draw'
    WHEN r.cents >= b.cents THEN CAST(r.l_suppkey AS VARCHAR) ELSE CAST(b.l_suppkey AS VARCHAR) END AS winner,
  CASE WHEN r.contest_id % 53 = 9 THEN 'No Contest' WHEN r.contest_id % 41 = 7 THEN 'Draw' WHEN r.flag = 'A' THEN 'KO/TKO'
    WHEN r.flag = 'R' THEN 'Submission' ELSE 'Decision - ' || (CASE r.cents % 3 WHEN 0 THEN 'Unanimous' WHEN 1 THEN 'Split' ELSE 'Majority' END) END AS method,
  CASE WHEN r.contest_id % 29 <> 0 THEN 1 + r.contest_id % 3 END AS round_no, b.cents % 300 AS clock_s,
  r.landed - b.landed AS margin, CAST(o.o_orderdate AS DATE) >= DATE '1995-07-01' AS detailed,
  r.landed AS red_landed, r.disc AS red_disc, r.tax % 6 AS red_td, r.lines AS red_lines, r.cents AS red_cents,
  b.landed AS blue_landed, b.disc AS blue_disc, b.tax % 6 AS blue_td, b.lines AS blue_lines, b.cents AS blue_cents
FROM ranked_sides r JOIN ranked_sides b ON r.l_orderkey = b.l_orderkey AND b.rn = r.rn + 1
JOIN orders o ON o.o_orderkey = r.l_orderkey"""


def _side(me: str, other: str) -> str:
    seen = lambda e: f"CASE WHEN detailed THEN {e} ELSE 0 END"
    return f"""SELECT contest_id, contest_date, event_name, division, method, round_no,
  (coalesce(round_no, 0) - 1) * 300 + clock_s AS duration_s, detailed, {me}_id AS side_id, {other}_id AS opp_id,
  CASE WHEN winner = CAST({me}_id AS VARCHAR) THEN 1 ELSE 0 END AS won, {seen(me + '_lines % 3')} AS kd,
  {seen(me + '_landed')} AS sig_landed, {seen(f'{me}_landed + {me}_disc')} AS sig_attempted,
  {seen(f'{me}_landed + {me}_lines')} AS tot_landed, {seen(f'{me}_landed + {me}_disc + {me}_lines')} AS tot_attempted,
  {seen(me + '_td')} AS td_landed, {seen(f'{me}_td + {me}_lines % 4')} AS td_attempted,
  {seen(f'({me}_cents // 7) % 3')} AS sub_attempts, {seen(me + '_cents % 600')} AS control_s,
  {seen(other + '_landed')} AS sig_absorbed, {seen(f'{other}_landed + {other}_disc')} AS opp_sig_attempted FROM bouts"""


CTE["bout_sides"] = _side("red", "blue") + " UNION ALL " + _side("blue", "red")

CTE["counted"] = f"""
SELECT *, row_number() OVER (PARTITION BY side_id ORDER BY contest_date, contest_id) - 1 AS n,
  CAST(coalesce(sum(won) OVER {W}, 0) AS BIGINT) AS wins,
  CAST(coalesce(sum(CASE WHEN won = 1 AND method = 'KO/TKO' THEN 1 ELSE 0 END) OVER {W}, 0) AS BIGINT) AS kos,
  CAST(coalesce(sum(CASE WHEN won = 1 AND method = 'Submission' THEN 1 ELSE 0 END) OVER {W}, 0) AS BIGINT) AS subs,
  CAST(coalesce(sum(CASE WHEN won = 1 AND method LIKE 'Decision%' THEN 1 ELSE 0 END) OVER {W}, 0) AS BIGINT) AS decs,
  min(contest_date) OVER {W} AS first_day, max(contest_date) OVER {W} AS last_day,
  row_number() OVER (PARTITION BY side_id, division ORDER BY contest_date, contest_id) - 1 AS division_prior,
  {', '.join(f"avg(won) OVER {trailing(n)} AS win_rate_last_{n}, avg(CASE WHEN won = 1 AND method IN ('KO/TKO', 'Submission') THEN 1 ELSE 0 END) OVER {trailing(n)} AS finish_rate_last_{n}, avg(sig_landed) OVER {trailing(n)} AS sig_landed_last_{n}, avg(sig_absorbed) OVER {trailing(n)} AS sig_absorbed_last_{n}, avg(td_landed) OVER {trailing(n)} AS td_landed_last_{n}, avg(duration_s) OVER {trailing(n)} AS duration_last_{n}" for n in spec.WINDOWS)}
FROM bout_sides"""

CTE["bout_career"] = f"""
SELECT *, n AS n_prior, wins AS wins_prior, n - wins AS losses_prior,
  CAST(wins AS DOUBLE) / greatest(n, 1) AS win_rate, CAST(kos AS DOUBLE) / greatest(wins, 1) AS ko_rate,
  CAST(subs AS DOUBLE) / greatest(wins, 1) AS sub_rate, CAST(decs AS DOUBLE) / greatest(wins, 1) AS dec_rate,
  CAST(kos + subs AS DOUBLE) / greatest(wins, 1) AS finish_rate,
  n - 1 - coalesce(max(CASE WHEN won = 0 THEN n END) OVER {W}, -1) AS win_streak,
  n - 1 - coalesce(max(CASE WHEN won = 1 THEN n END) OVER {W}, -1) AS loss_streak,
  coalesce(date_diff('day', last_day, contest_date), 365) AS days_since_last,
  CASE WHEN n > 0 THEN coalesce(n / nullif(date_diff('day', first_day, contest_date) / 365.25, 0), 0) END AS contests_per_year,
  CAST(coalesce(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY side_id ORDER BY
    date_diff('day', DATE '1970-01-01', contest_date) * 1000000 + same_day
    RANGE BETWEEN 364500000 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS contests_last_365d
FROM (SELECT *, row_number() OVER (PARTITION BY side_id, contest_date ORDER BY contest_id) AS same_day FROM counted)"""

CTE["daily_profile"] = """
SELECT side_id, contest_date, count(*) AS n, sum(won) AS won, sum(duration_s) AS time,
  sum(CASE WHEN method LIKE 'Decision%' THEN 1 ELSE 0 END) AS decs,
  sum(CASE WHEN method = 'KO/TKO' AND won = 0 THEN 1 ELSE 0 END) AS ko_lost,
  sum(CASE WHEN detailed THEN 1 ELSE 0 END) AS seen, sum(sig_landed) AS sl, sum(sig_attempted) AS sa, sum(sig_absorbed) AS sb,
  sum(kd) AS kd, sum(td_landed) AS tl, sum(td_attempted) AS ta, sum(control_s) AS ctl, sum(sub_attempts) AS sub
FROM bout_sides GROUP BY side_id, contest_date"""

_P = "(PARTITION BY side_id ORDER BY contest_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
CTE["before_day"] = "SELECT side_id, contest_date, " + ", ".join(
    f"CAST(coalesce(sum({c}) OVER {_P}, 0) AS DOUBLE) AS {c}"
    for c in ("n", "won", "time", "decs", "ko_lost", "seen", "sl", "sa", "sb", "kd", "tl", "ta", "ctl", "sub")) + " FROM daily_profile"

CTE["form_day"] = f"""
SELECT side_id, contest_date, avg_form FROM (SELECT side_id, contest_date, contest_id,
  avg(won) OVER {trailing(5)} AS avg_form,
  row_number() OVER (PARTITION BY side_id, contest_date ORDER BY contest_id) AS first_row FROM bout_sides) WHERE first_row = 1"""

def fixed_sql(expr: str) -> str:
    """The nearest multiple of 2 ** -30."""
    return f"floor(({expr}) * 1073741824.0::DOUBLE + 0.5) / 1073741824.0::DOUBLE"


CTE["own_skill"] = f"SELECT side_id, contest_date, earlier, {', '.join(f'{fixed_sql(s)} AS {s}' for s in spec.SKILLS)} FROM free_skill"

CTE["free_skill"] = """
SELECT p.side_id, p.contest_date, CAST(n AS BIGINT) AS earlier,
  CASE WHEN n >= 3 AND seen > 0 THEN 0.40 * least(sl / seen / 100, 1.0) + 0.30 * coalesce(sl / nullif(sa, 0), 0.5)
    + 0.20 * greatest(0, 1 - sb / seen / 100) + 0.10 * least(kd / seen / 3, 1.0) END AS striking,
  CASE WHEN n >= 3 AND seen > 0 THEN 0.35 * coalesce(tl / nullif(ta, 0), 0.5) + 0.30 * least(tl / seen / 5, 1.0)
    + 0.25 * least(ctl / seen / 300, 1.0) + 0.10 * least(sub / seen / 3, 1.0) END AS grappling,
  CASE WHEN n >= 3 THEN 0.40 * decs / n + 0.30 * (1 - ko_lost / n)
    + 0.20 * CASE WHEN seen > 0 THEN greatest(0, 1 - sb / seen / 100) ELSE 0.5 END + 0.10 * least(time / n / 900, 1.0) END AS durability,
  CASE WHEN n > 0 THEN 0.50 * won / n + 0.25 * least(n / 10, 1.0) + 0.25 * f.avg_form END AS quality
FROM before_day p JOIN form_day f ON p.side_id = f.side_id AND p.contest_date = f.contest_date"""

CTE["opp_raw"] = """
SELECT s.*, k.striking AS raw_opp_striking, k.grappling AS raw_opp_grappling, k.durability AS raw_opp_durability,
  k.quality AS raw_opp_quality, k.earlier AS opp_earlier
FROM bout_sides s LEFT JOIN own_skill k ON k.side_id = s.opp_id AND k.contest_date = s.contest_date"""

CTE["skill_sums"] = "SELECT " + ", ".join(
    f"CAST(count({s}) AS DOUBLE) AS n_{s}, CAST(sum({s}) AS DOUBLE) AS s_{s}, CAST(sum({s}::HUGEINT * {s}) AS DOUBLE) AS q_{s}" for s in spec.SKILLS) + (
    " FROM (SELECT " + ", ".join(f"CAST(raw_opp_{s} * 1073741824 AS BIGINT) AS {s}" for s in spec.SKILLS) + " FROM opp_raw)")
CTE["skill_stats"] = "SELECT " + ", ".join(
    f"mean_{s}, CASE WHEN std_{s} > 0 THEN std_{s} ELSE 0.1 END AS std_{s}" for s in spec.SKILLS) + " FROM (SELECT " + ", ".join(
    f"s_{s} / n_{s} / 1073741824 AS mean_{s}, sqrt(greatest(0, (q_{s} - s_{s} * s_{s} / n_{s}) / nullif(n_{s} - 1, 0))) / 1073741824 AS std_{s}"
    for s in spec.SKILLS) + " FROM skill_sums)"

CTE["opp_scaled"] = "SELECT r.*, " + ", ".join(
    f"CASE WHEN raw_opp_{s} IS NULL THEN 1.0 ELSE {fixed_sql(f'1 + 0.25 * greatest(-2.0, least(2.0, (raw_opp_{s} - mean_{s}) / std_{s}))')} END AS opp_{s}"
    for s in spec.SKILLS) + " FROM opp_raw r CROSS JOIN skill_stats"

CTE["opp_adj"] = """
SELECT *, sig_landed * opp_striking AS sig_landed_adj, sig_attempted * opp_striking AS sig_attempted_adj,
  tot_landed * opp_striking AS tot_landed_adj, tot_attempted * opp_striking AS tot_attempted_adj,
  td_landed * opp_grappling AS td_landed_adj, td_attempted * opp_grappling AS td_attempted_adj,
  sub_attempts * opp_grappling AS sub_attempts_adj, control_s * opp_grappling AS control_s_adj,
  floor(kd * sqrt(opp_striking * opp_durability) * 1073741824.0::DOUBLE + 0.5) / 1073741824.0::DOUBLE AS kd_adj, won * opp_quality AS won_adj FROM opp_scaled"""

_ROLL = {"adj_win_rate": "won_adj", "opp_striking": "opp_striking", "opp_grappling": "opp_grappling", "opp_quality": "opp_quality",
         "adj_sig_landed": "sig_landed_adj", "adj_td_landed": "td_landed_adj", "adj_control": "control_s_adj", "adj_kd": "kd_adj"}
CTE["bout_adjusted"] = f"""
SELECT *, coalesce(sum(won_adj) OVER {W}, 0) / greatest(count(*) OVER {W}, 1) AS adj_win_rate,
  {', '.join(f'coalesce(avg(opp_{s}) OVER {W}, 1.0) AS avg_opp_{s}' for s in spec.SKILLS)},
  {', '.join(f"coalesce(avg({c}) OVER {trailing(n)}, {1.0 if m.startswith('opp_') else 0.0}) AS {m}_last_{n}" for n in spec.WINDOWS for m, c in _ROLL.items())}
FROM opp_adj"""

CTE["med"] = """
SELECT d.division, coalesce(g.a, t.a) AS med_sig_landed, coalesce(g.b, t.b) AS med_sig_absorbed,
  coalesce(g.c, t.c) AS med_td_landed, coalesce(g.d, t.d) AS med_duration
FROM (SELECT DISTINCT division FROM bout_career) d
LEFT JOIN (SELECT division, median(sig_landed) AS a, median(sig_absorbed) AS b, median(td_landed) AS c, median(duration_s) AS d
  FROM bout_career WHERE n_prior >= 6 GROUP BY division) g ON g.division = d.division
CROSS JOIN (SELECT median(sig_landed) AS a, median(sig_absorbed) AS b, median(td_landed) AS c, median(duration_s) AS d
  FROM bout_career WHERE n_prior >= 6) t"""


def _imputed() -> str:
    out = [f"CASE WHEN n_prior = 0 THEN {v} ELSE {k} END AS {k}" for k, v in spec.DEBUT.items()]
    for w in spec.WINDOWS:
        for m in ("sig_landed", "sig_absorbed", "td_landed", "duration"):
            blend = (f"WHEN n_prior IN (1, 2) AND n_prior < {w} THEN n_prior / {float(w)} * coalesce({m}_last_{w}, 0) "
                     f"+ (1 - n_prior / {float(w)}) * med_{m} " if m.startswith("sig") else "")
            out.append(f"CASE WHEN n_prior = 0 THEN med_{m} {blend}ELSE {m}_last_{w} END AS {m}_last_{w}")
    return ", ".join(out)


CTE["bout_imputed"] = f"""
SELECT * EXCLUDE ({', '.join(spec.DEBUT)}, {', '.join(f'{m}_last_{w}' for w in spec.WINDOWS for m in ('sig_landed', 'sig_absorbed', 'td_landed', 'duration'))}),
  {_imputed()}, CASE WHEN n_prior = 0 THEN 1 ELSE 0 END AS is_debut, least(n_prior / 6.0, 1.0) AS completeness,
  CASE WHEN n_prior <= 0 THEN 'debut' WHEN n_prior <= 2 THEN 'novice' WHEN n_prior <= 5 THEN 'developing' ELSE 'established' END AS tier
FROM (SELECT c.*, med_sig_landed, med_sig_absorbed, med_td_landed, med_duration FROM bout_career c JOIN med USING (division))"""


def _matchups(table: str, *groups: str) -> str:
    feats = [f for f in spec.SIDE_FEATURES if f.group in groups]
    cols = []
    for f in feats:
        cols += [f"a.{f.name} AS f1_{f.name}", f"b.{f.name} AS f2_{f.name}"]
        if f.diff:
            cols.append(f"a.{f.name} - b.{f.name} AS diff_{f.name}")
    return f"""SELECT a.contest_id, a.contest_date, a.event_name, a.division, a.method, a.round_no, a.duration_s,
  a.side_id AS f1_id, b.side_id AS f2_id, a.won AS f1_won, {', '.join(cols)}
FROM {table} a JOIN {table} b ON a.contest_id = b.contest_id AND a.side_id < b.side_id"""


_VOL = "{s}_sig_landed_last_5 / nullif({s}_duration_last_5 / 60 + 0.01, 0)"
_GRAP = "{s}_td_landed_last_5 / nullif({s}_sig_landed_last_5 + 0.01, 0)"
_STYLED = "SELECT *, " + ", ".join(
    f"{_VOL.format(s=s)} AS {s}_strike_volume, {_GRAP.format(s=s)} AS {s}_grappling, "
    f"CAST({s}_n_prior AS DOUBLE) / (f1_n_prior + f2_n_prior + 1) AS {s}_experience_ratio, "
    f"CASE WHEN {s}_days_since_last > 180 THEN 1 ELSE 0 END AS {s}_layoff, "
    f"CASE WHEN {s}_division_prior <= 2 THEN 1 ELSE 0 END AS {s}_new_to_division" for s in ("f1", "f2")) + f""",
  {_VOL.format(s='f1')} - {_VOL.format(s='f2')} AS diff_strike_volume, {_GRAP.format(s='f1')} - {_GRAP.format(s='f2')} AS diff_grappling,
  diff_win_streak - diff_loss_streak AS diff_momentum, CASE WHEN event_name LIKE '%Title%' THEN 1 ELSE 0 END AS is_title,
  CAST(year(contest_date) AS INTEGER) AS contest_year, CAST(month(contest_date) AS INTEGER) AS contest_month FROM {{pairs}}"""

CTE["pairs"] = _matchups("bout_imputed", "career", "rolling")
CTE["bout_matchups"] = _STYLED.format(pairs="pairs")
CTE["bout_full"] = "SELECT i.*, " + ", ".join(f"a.{n}" for n in spec.names("adjusted")) + """
FROM bout_imputed i JOIN bout_adjusted a ON a.contest_id = i.contest_id AND a.side_id = i.side_id"""
CTE["all_pairs"] = _matchups("bout_full", "career", "rolling", "adjusted")
CTE["all_matchups"] = _STYLED.format(pairs="all_pairs")

CTE["people"] = f"""
SELECT s_suppkey AS side_id, {name_sql('s_suppkey')} AS name,
  CASE WHEN s_suppkey % 10 <> 0 THEN 64 + s_suppkey % 14 END AS height, CASE WHEN s_suppkey % 7 <> 0 THEN 65 + s_suppkey % 16 END AS reach,
  CASE WHEN s_suppkey % 11 <> 0 THEN CASE s_suppkey % 3 WHEN 0 THEN 'Orthodox' WHEN 1 THEN 'Southpaw' ELSE 'Switch' END END AS stance,
  CASE WHEN s_suppkey % 13 <> 0 THEN DATE '1935-01-01' + CAST(s_suppkey * 911 % 15000 AS INTEGER) END AS born,
  20 + s_suppkey % 60 AS total_wins, 10 + s_suppkey % 45 AS total_losses, s_suppkey % 3 AS total_draws FROM supplier"""

CTE["bout_games"] = """
SELECT contest_id, contest_date, division AS pool, least(red_id, blue_id) AS f1_id, greatest(red_id, blue_id) AS f2_id,
  CASE WHEN method = 'No Contest' THEN NULL WHEN method = 'Draw' THEN 0.5
    WHEN winner = CAST(least(red_id, blue_id) AS VARCHAR) THEN 1.0 ELSE 0.0 END AS score,
  row_number() OVER (PARTITION BY division ORDER BY contest_date, contest_id) AS seq FROM bouts"""


def elo_cte(k: str = "32.0") -> str:
    """The rating chain: one recursion step per contest, all pools in parallel, ratings in a map."""
    return f"""elo_run AS (
  SELECT pool, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS contest_id, CAST(NULL AS BIGINT) AS f1_id, CAST(NULL AS BIGINT) AS f2_id,
    CAST(0 AS DOUBLE) AS f1_elo, CAST(0 AS DOUBLE) AS f2_elo, CAST(0 AS BIGINT) AS f1_seen, CAST(0 AS BIGINT) AS f2_seen,
    CAST(0 AS DOUBLE) AS f1_peak, CAST(0 AS DOUBLE) AS f2_peak,
    MAP {{}}::MAP(BIGINT, STRUCT(r DOUBLE, n BIGINT, p DOUBLE)) AS held
  FROM (SELECT DISTINCT pool FROM bout_games)
  UNION ALL
  SELECT pool, seq, contest_id, f1_id, f2_id, r1, r2, n1, n2, p1, p2,
    map_concat(held, MAP([f1_id, f2_id], [
      {{'r': q1, 'n': n1 + 1, 'p': greatest(p1, q1)}}, {{'r': q2, 'n': n2 + 1, 'p': greatest(p2, q2)}}]))
  FROM (SELECT *, r1 + coalesce({k.format(n='n1')} * (score - e), 0) AS q1, r2 + coalesce({k.format(n='n2')} * ((1 - score) - (1 - e)), 0) AS q2
    FROM (SELECT *, 1.0 / (1.0 + pow(10.0, (r2 - r1) / 400.0)) AS e
      FROM (SELECT g.pool, g.seq, g.contest_id, g.f1_id, g.f2_id, CAST(g.score AS DOUBLE) AS score, s.held,
          coalesce(s.held[g.f1_id].r, 1500.0) AS r1, coalesce(s.held[g.f2_id].r, 1500.0) AS r2,
          coalesce(s.held[g.f1_id].n, 0) AS n1, coalesce(s.held[g.f2_id].n, 0) AS n2,
          coalesce(s.held[g.f1_id].p, 1500.0) AS p1, coalesce(s.held[g.f2_id].p, 1500.0) AS p2
        FROM elo_run s JOIN bout_games g ON g.pool = s.pool AND g.seq = s.seq + 1))))"""


CTE["bout_rated"] = "SELECT * EXCLUDE (held), 1.0 / (1.0 + pow(10.0, (f2_elo - f1_elo) / 400.0)) AS f1_expected FROM elo_run WHERE seq > 0"


CTE["led"] = f"""
SELECT *, CASE WHEN p1 > 0.5 THEN name_1 ELSE name_2 END AS predicted_winner,
  CASE WHEN abs(p1 - 0.5) >= 0.15 THEN 'HIGH' WHEN abs(p1 - 0.5) >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN past THEN won_name END AS actual_winner, CASE WHEN past THEN method END AS actual_method, CASE WHEN past THEN round_no END AS actual_round,
  CASE WHEN past AND won_name NOT IN ('Draw', 'No Contest') THEN (CASE WHEN p1 > 0.5 THEN name_1 ELSE name_2 END) = won_name END AS correct
FROM (SELECT contest_id, replace(lower(event_name), ' ', '-') AS event_id, contest_date, division, method, round_no,
    row_number() OVER (PARTITION BY contest_date ORDER BY contest_id) - 1 AS position,
    {name_sql('red_id')} AS name_1, {name_sql('blue_id')} AS name_2, {spread_sql('contest_id')} AS p1, contest_date < DATE '2000-01-01' AS past,
    CASE WHEN winner = CAST(red_id AS VARCHAR) THEN {name_sql('red_id')} WHEN winner = CAST(blue_id AS VARCHAR) THEN {name_sql('blue_id')} ELSE winner END AS won_name
  FROM bouts)"""

CTE["led_events"] = """
SELECT event_id, contest_date AS event_date, contest_date < DATE '2000-01-01' AS locked,
  CASE WHEN day(contest_date) % 2 = 0 THEN 'live' ELSE 'backtest' END AS prediction_type,
  CASE WHEN contest_date < DATE '2000-01-01' THEN CAST(count(*) FILTER (WHERE correct) AS BIGINT) END AS overall_correct,
  CASE WHEN contest_date < DATE '2000-01-01' THEN count(correct) END AS overall_total,
  CASE WHEN contest_date < DATE '2000-01-01' THEN coalesce(round(CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / nullif(count(correct), 0) + 1e-12, 3), 0.0) END AS overall_accuracy
FROM led GROUP BY event_id, contest_date"""

CTE["other"] = f"""
SELECT contest_id AS r_id, contest_date AS event_date, replace(lower(event_name), ' ', '-') AS event_id, event_name, method, round_no,
  CASE WHEN division = 'Heavyweight' THEN substr(a, 1, 2) || substr(a, 4) ELSE a END AS name_1, b AS name_2,
  CASE WHEN odd THEN back ELSE line END AS f1_line, CASE WHEN odd THEN line ELSE back END AS f2_line,
  CASE WHEN winner = CAST(red_id AS VARCHAR) THEN CASE WHEN odd THEN b ELSE CASE WHEN division = 'Heavyweight' THEN substr(a, 1, 2) || substr(a, 4) ELSE a END END
    WHEN winner = CAST(blue_id AS VARCHAR) THEN CASE WHEN odd THEN CASE WHEN division = 'Heavyweight' THEN substr(a, 1, 2) || substr(a, 4) ELSE a END ELSE b END ELSE winner END AS winner
FROM (SELECT *, contest_id % 2 = 1 AS odd, CASE WHEN contest_id % 2 = 1 THEN {name_sql('blue_id')} ELSE {name_sql('red_id')} END AS a,
    CASE WHEN contest_id % 2 = 1 THEN {name_sql('red_id')} ELSE {name_sql('blue_id')} END AS b,
    CASE WHEN margin >= 0 THEN -(110 + 3 * margin) ELSE 100 - 2 * margin END AS line,
    CASE WHEN -margin >= 0 THEN -(110 - 3 * margin) ELSE 100 + 2 * margin END AS back FROM bouts WHERE round_no IS NOT NULL)"""

CTE["prices"] = """
SELECT r_id, event_date, event_name, name_1, name_2, 'alpha' AS book, f1_line, f2_line FROM other
UNION ALL SELECT r_id, event_date, event_name, name_1, name_2, 'beta', f1_line + CASE WHEN f1_line > 0 THEN 7 ELSE -7 END, f2_line + CASE WHEN f2_line > 0 THEN 7 ELSE -7 END FROM other"""

_I = "CASE WHEN {x} < 0 THEN CAST(-{x} AS DOUBLE) / (100 - {x}) ELSE 100.0 / ({x} + 100) END"
CTE["fair"] = f"""
SELECT *, round(i1 / (i1 + i2) + 1e-12, 4) AS f1_fair, round(i2 / (i1 + i2) + 1e-12, 4) AS f2_fair
FROM (SELECT *, CAST({_I.format(x='f1_line')} AS DOUBLE) AS i1, CAST({_I.format(x='f2_line')} AS DOUBLE) AS i2 FROM prices)"""

CTE["agreed"] = """
SELECT r_id, event_date, name_1, name_2, round(avg(round(f1_fair * 10000))) / 10000 AS f1_fair, round(avg(round(f2_fair * 10000))) / 10000 AS f2_fair, count(*) AS sources
FROM fair GROUP BY r_id, event_date, name_1, name_2"""

# All contest pairs of one date with both orientations scored: the brute-force form of pair matching.
_SIM = "1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b}))"
CTE["date_pairs"] = f"""
SELECT l.contest_id AS l_id, o.r_id, {_SIM.format(a='lower(l.name_1)', b='lower(o.name_1)')} AS s11, {_SIM.format(a='lower(l.name_2)', b='lower(o.name_2)')} AS s22,
  {_SIM.format(a='lower(l.name_1)', b='lower(o.name_2)')} AS s12, {_SIM.format(a='lower(l.name_2)', b='lower(o.name_1)')} AS s21
FROM led l JOIN other o ON o.event_date = l.contest_date"""

CTE["best_pairs"] = """
SELECT l_id, r_id, score, crossed > straight AS flipped FROM (
  SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS rn FROM (
    SELECT *, greatest(straight, crossed) AS score FROM (SELECT *, s11 + s22 AS straight, s12 + s21 AS crossed FROM date_pairs)) WHERE score >= 1.7) WHERE rn = 1"""

CTE["snap"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY side_id ORDER BY contest_date DESC, contest_id DESC) AS rn FROM bout_imputed) WHERE rn = 1"""


def sql(body: str, elo: str | None = None, **own: str) -> str:
    """A complete statement: ``body`` preceded by the tables it uses; ``own`` adds private ones."""
    known = {**CTE, **own}
    order: list[str] = []
    chain = elo_cte(elo or "32.0")

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\w+", text)):
            if word == "elo_run" and word not in order:
                visit(CTE["bout_games"])
                if "bout_games" not in order:
                    order.append("bout_games")
                order.append("elo_run")
            elif word in known and word not in order:
                visit(known[word])
                if word not in order:
                    order.append(word)

    visit(body)
    if not order:
        return body
    parts = [chain if n == "elo_run" else f"{n} AS ({known[n]})" for n in order]
    return f"WITH {'RECURSIVE ' if 'elo_run' in order else ''}{', '.join(parts)} {body}"
