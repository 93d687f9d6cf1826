"""Names, pair matching, odds, ledger and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import ledger, market, matching, serving
from ..session import stage
from .registry import big, query, r6, real
from .sqltext import _SIM, name_sql, spread_sql, sql
from .tables import SNAPSHOT_FEATURES, person_name, spread

C = F.col
CUTOFF_SQL = "DATE '2000-01-01'"

# ---------------------------------------------------------------- single names
_KNOWN = f"SELECT c_custkey, {name_sql('c_custkey')} AS name FROM customer"
_WANTED = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN upper(name) WHEN 1 THEN substr(name, 1, 2) || substr(name, 4)
  WHEN 2 THEN split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1) WHEN 3 THEN substr(name, 1, 3) || 'z' || substr(name, 5)
  ELSE substr(name, 1, 8) || '-' || substr(name, 9) END AS name FROM known"""
_KEYED = dict(known=_KNOWN, wanted=_WANTED,
              keyed="SELECT name, trim(regexp_replace(translate(lower(name), '-', ' '), ' +', ' ', 'g')) AS k FROM (SELECT DISTINCT name FROM wanted)",
              knownk="SELECT lower(name) AS k, min(name) AS match FROM known GROUP BY 1",
              allpairs=f"SELECT a.name, b.match, {_SIM.format(a='a.k', b='b.k')} AS score FROM keyed a, knownk b",
              best="""SELECT name, match, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, match) AS rn FROM allpairs WHERE score >= 0.85) WHERE rn = 1""")


def _known(t):
    return t.read("customer").select("c_custkey", person_name(C("c_custkey")).alias("name"))


def _wanted(t):
    n, kind = C("name"), F.pmod("c_custkey", F.lit(5))
    cut = lambda a, b: F.substring(n, a, b)
    rest = lambda a: F.substring(n, a, F.length(n))
    return _known(t).select("c_custkey", F.when(kind == 0, F.upper(n)).when(kind == 1, F.concat(cut(1, 2), rest(4)))
                            .when(kind == 2, F.concat_ws(" ", F.split(n, " ")[1], F.split(n, " ")[0]))
                            .when(kind == 3, F.concat(cut(1, 3), F.lit("z"), rest(5)))
                            .otherwise(F.concat(cut(1, 8), F.lit("-"), rest(9))).alias("name"))


@query("fuzzy_best_match", sql(f"SELECT k.name, b.match, {real('score')} FROM keyed k LEFT JOIN best b ON b.name = k.name", **_KEYED))
def _(t):
    return matching.fuzzy_best_match(_wanted(t).select("name"), _known(t).select("name"))


@query("fuzzy_score", sql(f"""
SELECT c_custkey, {r6(_SIM.format(a='lower(w.name)', b='lower(k.name)'))} AS score FROM wanted w JOIN known k USING (c_custkey)""", known=_KNOWN, wanted=_WANTED))
def _(t):
    both = _wanted(t).withColumnRenamed("name", "other").join(_known(t), "c_custkey")
    return both.select("c_custkey", names.edit_similarity(F.lower("other"), F.lower("name")).alias("score"))


@query("name_join_ci", sql("""
SELECT w.name, coalesce(k.name, c.name) AS match, CASE WHEN k.name IS NOT NULL THEN 'exact' WHEN c.name IS NOT NULL THEN 'case' ELSE 'none' END AS kind
FROM (SELECT DISTINCT name FROM wanted) w LEFT JOIN (SELECT DISTINCT name FROM known) k ON k.name = w.name
LEFT JOIN (SELECT lower(name) AS low, min(name) AS name FROM known GROUP BY 1) c ON c.low = lower(w.name)""", known=_KNOWN, wanted=_WANTED))
def _(t):
    return matching.name_join_ci(_wanted(t), _known(t))


@query("known_competitors", sql("SELECT DISTINCT name FROM (SELECT name_1 AS name FROM led UNION ALL SELECT name_2 FROM led)"))
def _(t):
    return matching.known_competitors(t.called, ["name_1", "name_2"])


# ---------------------------------------------------------------- contest pairs
def _left(t):
    return t.ledger_names


def _right(t):
    return t.other_names


SCOPE = ["event_date"]


@query("match_contest_pair", sql(f"SELECT l_id, r_id, {real('score')}, flipped FROM best_pairs"))
def _(t):
    return matching.match_contest_pair(_left(t), _right(t), SCOPE)


@query("match_both_members", sql("""
SELECT l_id, coalesce(x, n) AS r_id, CASE WHEN x IS NOT NULL THEN 'exact' ELSE 'both members' END AS kind FROM (
  SELECT l_id, min(CASE WHEN (s11 = 1 AND s22 = 1) OR (s12 = 1 AND s21 = 1) THEN r_id END) AS x,
    min(CASE WHEN (s11 > 0.85 OR s12 > 0.85) AND (s21 > 0.85 OR s22 > 0.85) THEN r_id END) AS n FROM date_pairs GROUP BY l_id)
WHERE coalesce(x, n) IS NOT NULL"""))
def _(t):
    return matching.match_both_members(_left(t), _right(t), SCOPE)


_LAST = "least(split_part(lower({a}), ' ', 2), split_part(lower({b}), ' ', 2)) || '|' || greatest(split_part(lower({a}), ' ', 2), split_part(lower({b}), ' ', 2))"


@query("match_last_names", sql(f"""
SELECT l.contest_id AS l_id, min(o.r_id) AS r_id FROM led l JOIN other o ON o.event_date = l.contest_date
  AND {_LAST.format(a='l.name_1', b='l.name_2')} = {_LAST.format(a='o.name_1', b='o.name_2')} GROUP BY 1"""))
def _(t):
    return matching.match_last_names(_left(t), _right(t), SCOPE)


@query("pair_key_join", sql("""
SELECT l.contest_id AS l_id, max(o.r_id) AS r_id FROM led l LEFT JOIN other o ON o.event_date = l.contest_date
  AND least(l.name_1, l.name_2) = least(o.name_1, o.name_2) AND greatest(l.name_1, l.name_2) = greatest(o.name_1, o.name_2) GROUP BY 1"""))
def _(t):
    return matching.pair_key_join(_left(t), _right(t), SCOPE)


@query("match_gaps", sql(f"""
SELECT 'left' AS side, l.contest_id, g.r_id AS closest, {r6('g.score')} AS score, CAST(0.6 AS DOUBLE) AS floor FROM led l LEFT JOIN (
  SELECT l_id, r_id, score FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS rn FROM (
    SELECT l_id, r_id, greatest(s11 + s22, s12 + s21) AS score FROM date_pairs WHERE greatest(s11, s22, s12, s21) >= 0.6)) WHERE rn = 1) g ON g.l_id = l.contest_id
WHERE l.contest_id NOT IN (SELECT l_id FROM best_pairs)
UNION ALL SELECT 'right', r_id, NULL, NULL, 0.6 FROM other WHERE r_id NOT IN (SELECT r_id FROM best_pairs)"""))
def _(t):
    return matching.match_gaps(_left(t), _right(t), t.matched, SCOPE)


@query("match_gap_reason", sql(f"""
SELECT l.contest_id AS l_id, {r6('score')} AS score, CASE WHEN score > 0.6 THEN 'transliteration' WHEN score IS NOT NULL THEN 'different competitor' ELSE 'no data' END AS reason
FROM led l LEFT JOIN (SELECT l_id, max(s) AS score FROM (SELECT l_id, s22 AS s FROM date_pairs WHERE s11 = 1 AND s22 < 1 UNION ALL SELECT l_id, s11 FROM date_pairs WHERE s22 = 1 AND s11 < 1) GROUP BY 1) g
  ON g.l_id = l.contest_id WHERE l.contest_id NOT IN (SELECT l_id FROM best_pairs)"""))
def _(t):
    return matching.match_gap_reason(_left(t), _right(t), t.matched, SCOPE)


_CANON = dict(
    lk="SELECT lower(name) AS k, min(name) AS match FROM (SELECT name_1 AS name FROM led UNION ALL SELECT name_2 FROM led) GROUP BY 1",
    on_="SELECT DISTINCT name, lower(name) AS k FROM (SELECT name_1 AS name FROM other UNION ALL SELECT name_2 FROM other)",
    cpairs=f"SELECT a.name, b.match, {_SIM.format(a='a.k', b='b.k')} AS score FROM on_ a, lk b",
    cbest="SELECT name, match FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, match) AS rn FROM cpairs WHERE score >= 0.85) WHERE rn = 1")


def _canonical(t):
    both = t.other_source.select("r_id", "name_1", "name_2")
    return matching.canonicalize_names(both, matching.known_competitors(t.called, ["name_1", "name_2"]))


@query("canonicalize_names", sql("""
SELECT o.r_id, coalesce(a.match, o.name_1) AS name_1, coalesce(b.match, o.name_2) AS name_2 FROM other o
LEFT JOIN cbest a ON a.name = o.name_1 LEFT JOIN cbest b ON b.name = o.name_2""", **_CANON))
def _(t):
    return _canonical(t).select("r_id", C("name_1_canonical").alias("name_1"), C("name_2_canonical").alias("name_2"))


@query("canonical_counts", sql("""
SELECT CAST(sum(h) AS BIGINT) AS matched, CAST(sum(2 - h) AS BIGINT) AS unmatched FROM (
  SELECT CAST(a.match IS NOT NULL AS BIGINT) + CAST(b.match IS NOT NULL AS BIGINT) AS h FROM other o
  LEFT JOIN cbest a ON a.name = o.name_1 LEFT JOIN cbest b ON b.name = o.name_2)""", **_CANON))
def _(t):
    return matching.match_counts(_canonical(t))


@query("date_band_join", sql("""
SELECT l_event, l_day, r_day, r_event FROM (
  SELECT l.event_id AS l_event, l.event_date AS l_day, r.d AS r_day, r.e AS r_event,
    row_number() OVER (PARTITION BY l.event_id ORDER BY r.d, r.e) AS rn
  FROM led_events l JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, 'ship ' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS e FROM lineitem) r
    ON abs(date_diff('day', r.d, l.event_date)) <= 2) WHERE rn = 1"""))
def _(t):
    ship = t.read("lineitem").select(C("l_shipdate").cast("date").alias("day")).distinct()
    right = ship.withColumn("event", F.concat(F.lit("ship "), C("day").cast("string")))
    return matching.date_band_join(t.ledger_events.select(C("event_id").alias("event"), C("event_date").alias("day")), right)


# ---------------------------------------------------------------- odds
@query("fair_consensus", sql(f"SELECT r_id, {real('f1_fair', 'f2_fair')}, sources FROM agreed"))
def _(t):
    return t.consensus.select("r_id", "f1_fair", "f2_fair", "sources")


@query("book_fair", sql(f"SELECT r_id, book, {r6('round(i1 + 1e-12, 4)')} AS f1_implied, {r6('round(i2 + 1e-12, 4)')} AS f2_implied, {real('f1_fair', 'f2_fair')} FROM fair"))
def _(t):
    return market.book_fair(t.odds).select("r_id", "book", "f1_implied", "f2_implied", "f1_fair", "f2_fair")


@query("odds_board", sql(f"""
SELECT event_date AS contest_date, event_name, r_id AS contest_id, {', '.join(f"CAST(max(CASE WHEN book = '{b}' THEN {s}_line END) AS BIGINT) AS {b}_{s}" for b in ('alpha', 'beta') for s in ('f1', 'f2'))}
FROM prices GROUP BY 1, 2, 3"""))
def _(t):
    return market.odds_board(t.odds.withColumnsRenamed({"event_date": "contest_date", "r_id": "contest_id"}), ["alpha", "beta"])


_ORI = dict(oriented="""SELECT b.l_id AS contest_id, b.flipped, CASE WHEN b.flipped THEN a.f2_fair ELSE a.f1_fair END AS f1_fair, CASE WHEN b.flipped THEN a.f1_fair ELSE a.f2_fair END AS f2_fair
  FROM best_pairs b JOIN agreed a ON a.r_id = b.r_id""",
            edged="""SELECT o.*, l.p1, l.event_id, l.past, round(CASE WHEN l.p1 > 0.5 THEN l.p1 - o.f1_fair ELSE (1 - l.p1) - o.f2_fair END + 1e-12, 4) AS edge FROM oriented o JOIN led l ON l.contest_id = o.contest_id""")


def _oriented(t):
    priced = t.matched.join(t.consensus.select("r_id", "f1_fair", "f2_fair"), "r_id")
    return market.orient(priced, [("f1_fair", "f2_fair")]).select(C("l_id").alias("contest_id"), "flipped", "f1_fair", "f2_fair")


@query("orient_odds", sql(f"SELECT contest_id, flipped, {real('f1_fair', 'f2_fair')} FROM oriented", **_ORI))
def _(t):
    return _oriented(t)


@query("edge_vs_market", sql(f"SELECT contest_id, {r6('CAST(round(CAST(edge * 10000 AS DOUBLE)) AS DOUBLE) / 10000')} AS edge FROM edged", **_ORI))
def _(t):
    joined = _oriented(t).join(t.called.select("contest_id", "p1"), "contest_id")
    return joined.select("contest_id", market.edge(C("p1"), C("f1_fair"), C("f2_fair")).alias("edge"))


_MVM = "(p1 - f1_fair) * 100"


@query("model_vs_market", sql(f"""
SELECT contest_id, {r6(_MVM)} AS edge_points, CASE WHEN round({_MVM}, 9) >= 5 THEN 'VALUE' WHEN round({_MVM}, 9) <= -5 THEN 'MODEL DISAGREES' ELSE '' END AS flag FROM edged""", **_ORI))
def _(t):
    return _compared(t).select("contest_id", "edge_points", "flag")


def _compared(t):
    joined = _oriented(t).join(t.called.select("contest_id", "p1"), "contest_id")
    return market.model_vs_market(joined)


@query("value_picks", sql(f"SELECT contest_id, {r6(_MVM)} AS edge_points, CASE WHEN {_MVM} > 0 THEN 'OVER' ELSE 'UNDER' END AS direction FROM edged WHERE abs(round({_MVM}, 9)) >= 5", **_ORI))
def _(t):
    return market.value_picks(_compared(t)).select("contest_id", "edge_points", "direction")


# ---------------------------------------------------------------- ledger
@query("event_accuracy", sql("""
SELECT event_id, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS overall_correct, count(correct) AS overall_total,
  round(coalesce(round(CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / nullif(count(correct), 0) + 1e-12, 3), 0.0) + 1e-9, 6) AS overall_accuracy FROM led GROUP BY event_id"""))
def _(t):
    return ledger.event_accuracy(t.called)


@query("ledger_stats", sql(f"""
SELECT CASE WHEN grouping(prediction_type) = 1 THEN 'all' ELSE prediction_type END AS prediction_type, count(*) AS events, CAST(sum(overall_correct) AS BIGINT) AS correct, CAST(sum(overall_total) AS BIGINT) AS total,
  {r6('CAST(sum(overall_correct) AS DOUBLE) / nullif(sum(overall_total), 0)')} AS accuracy FROM led_events WHERE locked GROUP BY ROLLUP (prediction_type)"""))
def _(t):
    return ledger.stats(t.ledger_events)


@query("confidence_counts", sql("SELECT confidence, count(*) AS n FROM led GROUP BY 1"))
def _(t):
    return ledger.confidence_counts(t.called)


@query("ledger_calendar", sql("""
SELECT e.event_id, e.event_date, e.locked, l.name_1 || ' vs ' || l.name_2 AS main_contest, n.n AS contests FROM led_events e
JOIN led l ON l.event_id = e.event_id AND l.position = 0 JOIN (SELECT event_id, count(*) AS n FROM led GROUP BY 1) n ON n.event_id = e.event_id"""))
def _(t):
    return ledger.calendar(t.ledger_events, t.ledger_contests).select("event_id", "event_date", "locked", "main_contest", "contests")


def _recorded(t):
    changed = t.called.withColumns({"p1": 1 - C("p1"), "predicted_winner": F.when(C("p1") < 0.5, C("name_1")).otherwise(C("name_2"))})
    return ledger.record(t.ledger_events, t.called, t.ledger_events.withColumn("prediction_type", F.lit("redo")), changed)


@query("ledger_record", sql(f"""
SELECT l.contest_id, l.event_id, {r6('CASE WHEN past THEN p1 ELSE 1 - p1 END')} AS p1,
  CASE WHEN past THEN predicted_winner WHEN p1 < 0.5 THEN name_1 ELSE name_2 END AS predicted_winner, CASE WHEN past THEN e.prediction_type ELSE 'redo' END AS prediction_type
FROM led l JOIN led_events e ON e.event_id = l.event_id"""))
def _(t):
    events, contests = _recorded(t)
    return contests.select("contest_id", "event_id", "p1", "predicted_winner").join(events.select("event_id", "prediction_type"), "event_id")


_LOCK = dict(
    ep="""SELECT l.contest_id AS l_id, o.r_id, l.event_id, SIM11 AS s11, SIM22 AS s22, SIM12 AS s12, SIM21 AS s21 FROM led l JOIN other o ON o.event_id = l.event_id
      WHERE NOT l.past AND l.contest_date < DATE '2001-01-01'""".replace("SIM11", _SIM.format(a="lower(l.name_1)", b="lower(o.name_1)"))
    .replace("SIM22", _SIM.format(a="lower(l.name_2)", b="lower(o.name_2)")).replace("SIM12", _SIM.format(a="lower(l.name_1)", b="lower(o.name_2)"))
    .replace("SIM21", _SIM.format(a="lower(l.name_2)", b="lower(o.name_1)")),
    lp="""SELECT l_id, r_id, flipped FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS rn FROM (
      SELECT *, greatest(s11 + s22, s12 + s21) AS score, s12 + s21 > s11 + s22 AS flipped FROM ep) WHERE score >= 1.7) WHERE rn = 1""",
    settled="""SELECT l.contest_id, l.event_id, l.predicted_winner, CASE WHEN p.r_id IS NULL THEN NULL WHEN lower(o.winner) IN ('draw', 'no contest') THEN o.winner
        WHEN (o.winner = o.name_1) <> p.flipped THEN l.name_1 ELSE l.name_2 END AS actual_winner, o.method AS actual_method, o.round_no AS actual_round, p.r_id
      FROM led l LEFT JOIN lp p ON p.l_id = l.contest_id LEFT JOIN other o ON o.r_id = p.r_id WHERE l.event_id IN (SELECT l2.event_id FROM led l2 JOIN lp ON lp.l_id = l2.contest_id)""",
    verdict="SELECT *, CASE WHEN r_id IS NOT NULL AND lower(actual_winner) NOT IN ('draw', 'no contest') THEN lower(predicted_winner) = lower(actual_winner) END AS correct FROM settled")


@query("ledger_lock", sql("""
SELECT contest_id, event_id, actual_winner, actual_method, CAST(actual_round AS BIGINT) AS actual_round, correct FROM verdict
UNION ALL SELECT contest_id, event_id, actual_winner, actual_method, CAST(actual_round AS BIGINT), correct FROM led WHERE event_id NOT IN (SELECT event_id FROM verdict)""", **_LOCK))
def _(t):
    _, contests = ledger.lock(t.ledger_events, t.called, t.other_source, "2001-01-01")
    return contests.select("contest_id", "event_id", "actual_winner", "actual_method", "actual_round", "correct")


@query("ledger_lock_events", sql("""
SELECT e.event_id, e.locked OR v.event_id IS NOT NULL AS locked, coalesce(v.c, e.overall_correct) AS overall_correct, coalesce(v.n, e.overall_total) AS overall_total
FROM led_events e LEFT JOIN (SELECT event_id, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS c, count(correct) AS n FROM verdict GROUP BY 1) v ON v.event_id = e.event_id""", **_LOCK))
def _(t):
    events, _ = ledger.lock(t.ledger_events, t.called, t.other_source, "2001-01-01")
    return events.select("event_id", "locked", "overall_correct", "overall_total")


@query("attach_odds", sql(f"SELECT contest_id, event_id, {real('f1_fair', 'f2_fair')}, {r6('CAST(round(CAST(edge * 10000 AS DOUBLE)) AS DOUBLE) / 10000')} AS edge FROM edged WHERE NOT past", **_ORI))
def _(t):
    out = ledger.attach_odds(t.ledger_events, t.called, t.consensus)
    return out.select("contest_id", "event_id", "f1_fair", "f2_fair", "edge")


# ---------------------------------------------------------------- serving
_SI = [f for f in SNAPSHOT_FEATURES if f in ("n_prior", "wins_prior", "losses_prior", "win_streak", "loss_streak", "days_since_last")]
_SR = [f for f in SNAPSHOT_FEATURES if f not in _SI]


@query("latest_snapshot", sql(f"""
SELECT s.side_id, s.contest_date AS last_date, n.n AS contests, {big(*_SI)}, {real(*_SR)} FROM snap s JOIN (SELECT side_id, count(*) AS n FROM bout_sides GROUP BY 1) n ON n.side_id = s.side_id"""))
def _(t):
    return t.snapshot


def _upcoming(t):
    """Every contest announced again for the day after the last one; in each thirteenth a newcomer steps in for the second side."""
    last = t.contests.agg(F.date_add(F.max("contest_date"), 1).alias("contest_date"))
    second = F.when(C("contest_id") % 13 == 0, -C("blue_id")).otherwise(C("blue_id"))
    side = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("side_id"))
    rows = t.contests.select("contest_id", F.explode(F.array(side(1, C("red_id")), side(2, second))).alias("s"))
    return rows.join(F.broadcast(last)).select("contest_id", "contest_date", "s.role", "s.side_id")


_UP = dict(up="""SELECT contest_id, (SELECT max(contest_date) + 1 FROM bouts) AS contest_date, 1 AS role, red_id AS side_id FROM bouts
  UNION ALL SELECT contest_id, (SELECT max(contest_date) + 1 FROM bouts), 2, CASE WHEN contest_id % 13 = 0 THEN -blue_id ELSE blue_id END FROM bouts""")
_DEF = serving.DEBUT_FEATURES
_FEATSQL = ", ".join(
    (f"CASE WHEN s.side_id IS NOT NULL THEN date_diff('day', s.contest_date, u.contest_date) ELSE 365 END + 0.0 AS days_since_last" if f == "days_since_last"
     else f"coalesce(CAST(s.{f} AS DOUBLE), {float(_DEF.get(f, 0.0))}) AS {f}") for f in SNAPSHOT_FEATURES)
_UP["served"] = f"SELECT u.contest_id, u.role, u.side_id, s.side_id IS NOT NULL AS known, {_FEATSQL} FROM up u LEFT JOIN snap s ON s.side_id = u.side_id"


@query("serving_features", sql(f"SELECT contest_id, CAST(role AS BIGINT) AS role, side_id, known, {real(*SNAPSHOT_FEATURES)} FROM served", **_UP))
def _(t):
    return serving.serving_features(_upcoming(t), t.snapshot, SNAPSHOT_FEATURES).drop("contest_date")


_SM = [f"diff_{f}" for f in SNAPSHOT_FEATURES]


_NAMED = dict(
    asked="""SELECT r_id AS contest_id, (SELECT max(contest_date) + 1 FROM bouts) AS contest_date, 1 AS role, CASE WHEN r_id % 13 = 0 THEN reverse(name_1) ELSE name_1 END AS name FROM other
  UNION ALL SELECT r_id, (SELECT max(contest_date) + 1 FROM bouts), 2, name_2 FROM other""",
    person="SELECT name, lower(name) AS k, min(side_id) AS side_id FROM people GROUP BY 1, 2",
    spelt="SELECT DISTINCT name, trim(lower(name)) AS k FROM asked",
    close=f"SELECT a.name, b.side_id, b.name AS match, {_SIM.format(a='a.k', b='b.k')} AS score FROM spelt a, person b",
    resolved="SELECT name, side_id, CASE WHEN score >= 1 THEN 'exact' ELSE 'similar' END AS how FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, match) AS rn FROM close WHERE score >= 0.85) WHERE rn = 1",
    who="SELECT q.contest_id, q.contest_date, q.role, q.name, r.side_id, coalesce(r.how, 'debut') AS how FROM asked q LEFT JOIN resolved r ON r.name = q.name")


@query("serving_by_name", sql(f"""
SELECT contest_id, CAST(role AS BIGINT) AS role, name, side_id, how, known, {real(*SNAPSHOT_FEATURES)} FROM (
  SELECT u.contest_id, u.role, u.name, u.side_id, u.how, s.side_id IS NOT NULL AS known, {_FEATSQL} FROM who u LEFT JOIN snap s ON s.side_id = u.side_id)""", **_NAMED))
def _(t):
    """The second source's contests announced again, some names misspelt and some unknown."""
    last = t.contests.agg(F.date_add(F.max("contest_date"), 1).alias("contest_date"))
    name = F.when(C("r_id") % 13 == 0, F.reverse("name_1")).otherwise(C("name_1"))
    asked = t.other_source.select(C("r_id").alias("contest_id"), name.alias("name_1"), "name_2").join(F.broadcast(last))
    sides = serving.resolve_names(asked, t.competitors)
    return serving.serving_features(sides, t.snapshot, SNAPSHOT_FEATURES).drop("contest_date")


@query("serving_matchup", sql(f"""
SELECT a.contest_id, a.side_id AS f1_id, b.side_id AS f2_id, {', '.join(f"{r6(f'a.{f} - b.{f}')} AS diff_{f}" for f in SNAPSHOT_FEATURES)},
  {r6('a.n_prior / (a.n_prior + b.n_prior + 1)')} AS f1_experience_ratio, {r6('a.win_streak - a.loss_streak - b.win_streak + b.loss_streak')} AS diff_momentum
FROM served a JOIN served b ON a.contest_id = b.contest_id AND a.role = 1 AND b.role = 2""", **_UP))
def _(t):
    sides = serving.serving_features(_upcoming(t), t.snapshot, SNAPSHOT_FEATURES)
    return serving.serving_matchup(sides, SNAPSHOT_FEATURES).select("contest_id", "f1_id", "f2_id", *_SM, "f1_experience_ratio", "diff_momentum")


_FAC = ["diff_win_rate", "diff_win_streak", "diff_loss_streak", "diff_n_prior", "diff_sig_landed_last_5", "diff_td_landed_last_5", "diff_win_rate_last_3"]
_FACSQL = dict(
    longf=" UNION ALL ".join(f"SELECT contest_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM bout_matchups" for c in _FAC),
    rankf="SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY abs(value) DESC, feature) AS rank FROM longf WHERE value IS NOT NULL AND value <> 0")


@query("top_factors", sql(f"SELECT contest_id, CAST(rank AS BIGINT) AS rank, feature, {real('value')} FROM rankf WHERE rank <= 5", **_FACSQL))
def _(t):
    out = serving.top_factors(t.matchups.select("contest_id", *_FAC), _FAC, 5)
    return out.select("contest_id", F.posexplode("factors").alias("i", "f")).select("contest_id", (C("i") + 1).alias("rank"), "f.*")


@query("factor_rank_widths", sql("""
SELECT contest_id, CAST(rank AS BIGINT) AS rank, feature, CAST(CASE WHEN value > 0 THEN 1 ELSE 2 END AS BIGINT) AS favours,
  CAST(CASE rank WHEN 1 THEN 85 WHEN 2 THEN 68 WHEN 3 THEN 52 WHEN 4 THEN 36 ELSE 22 END AS BIGINT) AS width FROM rankf WHERE rank <= 5""", **_FACSQL))
def _(t):
    return serving.factor_rank_widths(serving.top_factors(t.matchups.select("contest_id", *_FAC), _FAC, 5))


@query("backfill_factors", sql(f"SELECT r.contest_id, CAST(r.rank AS BIGINT) AS rank, r.feature, {real('value')} FROM rankf r WHERE rank <= 5", **_FACSQL))
def _(t):
    # Locked events keep the factors they have; the open ones arrive without any.
    rows = stage(t.matchups.select("contest_id", "contest_date", *_FAC), "factors")
    have = serving.top_factors(rows, _FAC, 5).select(
        "contest_id", F.when(C("contest_date") < F.lit("2000-01-01").cast("date"), C("factors")).alias("factors"))
    out = serving.backfill_factors(have, rows, _FAC)
    return out.select("contest_id", F.posexplode("factors").alias("i", "f")).select("contest_id", (C("i") + 1).alias("rank"), "f.*")


@query("event_predictions", sql(f"""
SELECT event_id, contest_date AS event_date, CAST(position // 5 AS BIGINT) AS part, count(*) AS contests, string_agg(CAST(contest_id AS VARCHAR), ',' ORDER BY position) AS card FROM led GROUP BY 1, 2, 3"""))
def _(t):
    docs = serving.event_documents(t.ledger_contests, 5)
    return docs.select("event_id", "event_date", "part", F.size("contests").cast("long").alias("contests"),
                       F.array_join(F.transform("contests", lambda x: x["contest_id"].cast("string")), ",").alias("card"))


_BT = dict(bt="""SELECT side_id, contest_date, win_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY side_id, contest_date ORDER BY contest_id DESC) AS rn FROM bout_imputed) WHERE rn = 1""")


@query("backtest_event", sql(f"""
SELECT m.contest_id, m.f1_id, m.f2_id, CAST(p > 0.5 AS BIGINT) AS call, CAST(f1_won AS BIGINT) AS f1_won, CAST((p > 0.5) = (f1_won = 1) AS BIGINT) AS hit, {real('p')} FROM (
  SELECT m.contest_id, m.f1_id, m.f2_id, m.f1_won, 1 / (1 + exp(-2 * (coalesce(a.win_rate, 0.52) - coalesce(b.win_rate, 0.52)))) AS p FROM bout_matchups m
  ASOF LEFT JOIN bt a ON a.side_id = m.f1_id AND a.contest_date < m.contest_date
  ASOF LEFT JOIN bt b ON b.side_id = m.f2_id AND b.contest_date < m.contest_date WHERE m.contest_date >= {CUTOFF_SQL}) m""", **_BT))
def _(t):
    """Every event from the cutoff on, scored from the states of its sides strictly before that event."""
    later = t.matchups_of().filter(C("contest_date") >= F.lit("2000-01-01").cast("date")).select("contest_id", "contest_date", "f1_id", "f2_id", "f1_won")
    history = t.imputed.select("side_id", "contest_date", "contest_id", "win_rate")
    side = lambda r: F.struct(F.lit(r).alias("role"), C(f"f{r}_id").alias("side_id"))
    sides = later.select("contest_id", "contest_date", F.explode(F.array(side(1), side(2))).alias("s")).select("contest_id", "contest_date", "s.*")
    wide = serving.serving_matchup(serving.serving_features_asof(sides, history, ["win_rate"]), ["win_rate"])
    scored = serving.score_contests(wide, 1 / (1 + F.exp(-2 * C("diff_win_rate"))))
    call = (C("p1") > 0.5).cast("int")
    return scored.join(later.select("contest_id", "f1_won"), "contest_id").select(
        "contest_id", "f1_id", "f2_id", call.alias("call"), "f1_won", (call == C("f1_won")).cast("int").alias("hit"), C("p1").alias("p"))
