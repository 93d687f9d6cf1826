"""Scalar functions over the contest and competitor tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, market, names, parsing
from .registry import big, query, real
from .sqltext import clock_sql, name_sql, spread_sql, sql
from .tables import person_name, spread

C = F.col


@query("parse_landed_attempted", sql(f"""
SELECT contest_id, CAST(CASE WHEN detailed THEN red_landed ELSE 0 END AS BIGINT) AS landed,
  CAST(CASE WHEN detailed THEN red_landed + red_disc ELSE 0 END AS BIGINT) AS attempted FROM bouts"""))
def _(t):
    return t.contests.select("contest_id", parsing.landed_attempted(C("red_sig_str")).alias("p")).select("contest_id", "p.*")


@query("parse_landed_attempted_prefix", sql(f"""
SELECT contest_id, CAST(CASE WHEN detailed THEN blue_landed ELSE 0 END AS BIGINT) AS landed,
  CAST(CASE WHEN detailed THEN blue_landed + blue_disc ELSE 0 END AS BIGINT) AS attempted FROM bouts"""))
def _(t):
    text = F.concat(F.lit("  "), C("blue_sig_str"), F.lit(" (corrected)"))
    return t.contests.select("contest_id", parsing.landed_attempted_prefix(text).alias("p")).select("contest_id", "p.*")


@query("parse_mmss", sql(f"""
SELECT contest_id, CAST(clock_s AS BIGINT) AS clock_s, CAST(CASE WHEN detailed THEN red_cents % 600 ELSE 0 END AS BIGINT) AS control_s,
  CAST(CASE WHEN detailed THEN red_cents % 600 ELSE 0 END AS BIGINT) AS control_prefix_s FROM bouts"""))
def _(t):
    return t.contests.select("contest_id", parsing.mmss_seconds(C("time_text")).alias("clock_s"),
                             parsing.mmss_seconds(C("red_ctrl")).alias("control_s"),
                             parsing.mmss_seconds_prefix(C("red_ctrl")).alias("control_prefix_s"))


@query("parse_percent", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, round(CASE WHEN q > 1 THEN q / 100 ELSE q END + 1e-9, 6) AS share,
  round(CASE WHEN d > 1 THEN d / 100 ELSE d END + 1e-9, 6) AS discount
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(round(l_quantity) AS DOUBLE) AS q,
  CAST(round(l_discount * 100) AS DOUBLE) AS d FROM lineitem)""")
def _(t):
    text = lambda c: F.concat(F.lit(" "), F.round(c).cast("long").cast("string"), F.lit("% "))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", parsing.percent(text(C("l_quantity"))).alias("share"),
                                     parsing.percent(text(C("l_discount") * 100)).alias("discount"))


@query("parse_first_int", "SELECT p_partkey, CAST(p_size AS BIGINT) AS size, CAST(0 AS BIGINT) AS none FROM part")
def _(t):
    return t.read("part").select(
        "p_partkey", parsing.first_int(F.concat(F.lit("  "), C("p_size").cast("string"), F.lit(" units"))).alias("size"),
        parsing.first_int(C("p_name")).alias("none"))


@query("strike_accuracy_pct", sql("""
SELECT contest_id, round(coalesce(100.0 * l / nullif(a, 0), 0) + 1e-9, 6) AS pct FROM (
  SELECT contest_id, CAST(CASE WHEN detailed THEN red_landed ELSE 0 END AS DOUBLE) AS l,
    CASE WHEN detailed THEN red_landed + red_disc ELSE 0 END AS a FROM bouts)"""))
def _(t):
    p = parsing.landed_attempted(C("red_sig_str"))
    return t.contests.select("contest_id", parsing.accuracy_percent(p["landed"], p["attempted"]).alias("pct"))


@query("parse_height_in", sql("SELECT side_id, CAST(height AS BIGINT) AS height FROM people"))
def _(t):
    h = C("height")
    text = F.when(h.isNull(), F.lit("--")).otherwise(F.concat(F.floor(h / 12).cast("string"), F.lit("' "), (h % 12).cast("string"), F.lit('"')))
    return t.competitors.select("side_id", parsing.height_inches(text).alias("height"))


@query("parse_reach_in", sql("SELECT side_id, CAST(reach AS BIGINT) AS reach FROM people"))
def _(t):
    text = F.coalesce(F.concat(C("reach").cast("string"), F.lit('"')), F.lit("--"))
    return t.competitors.select("side_id", parsing.reach_inches(text).alias("reach"))


@query("parse_record", sql(f"""
SELECT side_id, {big('total_wins', 'total_losses', 'total_draws')}, CAST(total_wins + total_losses + total_draws AS BIGINT) AS total FROM people"""))
def _(t):
    text = F.concat(F.lit("Record: "), F.concat_ws("-", *[C(c).cast("string") for c in ("total_wins", "total_losses", "total_draws")]))
    return t.competitors.select("side_id", parsing.record(text).alias("r")).select(
        "side_id", C("r.wins").alias("total_wins"), C("r.losses").alias("total_losses"), C("r.draws").alias("total_draws"), "r.total")


@query("parse_multi_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(t):
    d = C("o_orderdate")
    shapes = [F.date_format(d, f) for f in ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd")] + [
        F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T12:00:00Z"))]
    text = F.element_at(F.array(*shapes), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    return t.read("orders").select("o_orderkey", parsing.any_date(text).alias("day"))


@query("age_at_date", sql("""
SELECT contest_id, s.side_id, round(CASE WHEN a BETWEEN 18 AND 60 THEN a ELSE 30.0 END + 1e-9, 6) AS age FROM (
  SELECT s.contest_id, s.side_id, CAST(date_diff('day', p.born, s.contest_date) / 365.25 AS DOUBLE) AS a
  FROM bout_sides s JOIN people p ON p.side_id = s.side_id) s"""))
def _(t):
    return t.sides.join(t.competitors, "side_id").select(
        "contest_id", "side_id", parsing.age_at(C("contest_date"), C("born"), F.lit(30.0)).alias("age"))


@query("age_years_today", sql("""
SELECT side_id, CAST(year(d) - year(born) - CASE WHEN (month(d), day(d)) < (month(born), day(born)) THEN 1 ELSE 0 END AS BIGINT) AS age
FROM (SELECT side_id, born, DATE '2001-08-01' AS d FROM people)"""))
def _(t):
    return t.competitors.select("side_id", parsing.calendar_age(C("born"), F.lit("2001-08-01").cast("date")).alias("age"))


@query("elapsed_seconds", sql("""
SELECT contest_id, CAST((coalesce(round_no, 0) - 1) * 300 + clock_s AS BIGINT) AS seconds,
  CAST((round_no - 1) * 300 + clock_s AS BIGINT) AS seconds_or_null FROM bouts"""))
def _(t):
    r, s = C("round_text").try_cast("int"), parsing.mmss_seconds(C("time_text"))
    return t.contests.select("contest_id", parsing.elapsed_seconds(r, s).alias("seconds"),
                             parsing.elapsed_seconds(r, s, null_when_missing=True).alias("seconds_or_null"))


_CUST = f"SELECT c_custkey, {name_sql('c_custkey')} AS name FROM customer"


def _customers(t):
    return t.read("customer").select("c_custkey", person_name(C("c_custkey")).alias("name"))


@query("clean_person_name", sql("SELECT c_custkey, name AS clean, 'Mc' || name AS clean_mc FROM cust", cust=_CUST).replace(
    "'Mc' || name", "'Mc' || upper(substr(name, 1, 1)) || lower(substr(split_part(name, ' ', 1), 2)) || ' ' || split_part(name, ' ', 2)"))
def _(t):
    return _customers(t).select("c_custkey", names.clean_person(F.concat(F.lit("  "), F.regexp_replace(F.upper("name"), " ", "   "))).alias("clean"),
                                names.clean_person(F.concat(F.lit("Mc"), F.upper("name"))).alias("clean_mc"))


@query("normalize_name_basic", sql("SELECT c_custkey, replace(lower(name), ' ', ' j ') AS key FROM cust", cust=_CUST))
def _(t):
    text = F.regexp_replace(F.upper("name"), " ", " J. - ")
    return _customers(t).select("c_custkey", names.basic_key(F.concat(text, F.lit("'"))).alias("key"))


@query("normalize_name_unicode", sql(
    "SELECT c_custkey, lower(name) AS key FROM cust", cust=_CUST))
def _(t):
    accented = F.translate(C("name"), "aeiouAEIOU", "áèîõüÁÈÎÕÜ")
    return _customers(t).select("c_custkey", names.unicode_key(F.concat(accented, F.lit(" Jr."))).alias("key"))


@query("last_name", sql("""SELECT c_custkey, split_part(name, ' ', 2) AS plain, 'de ' || split_part(name, ' ', 2) AS particle,
  split_part(name, ' ', 2) AS last_word FROM cust""", cust=_CUST))
def _(t):
    return _customers(t).select(
        "c_custkey", names.surname(C("name")).alias("plain"),
        names.surname(F.regexp_replace("name", " ", " Xe de ")).alias("particle"), names.last_token(C("name")).alias("last_word"))


@query("initials", sql("SELECT c_custkey, substr(name, 1, 1) || substr(split_part(name, ' ', 2), 1, 1) AS two, upper(substr(name, 1, 2)) AS one FROM cust", cust=_CUST))
def _(t):
    return _customers(t).select("c_custkey", names.initials(C("name")).alias("two"), names.initials(F.split("name", " ")[0]).alias("one"))


@query("slugify", sql("""SELECT contest_id, replace(lower(event_name), ' ', '-') AS slug, replace(lower(event_name), ' ', '-') AS strict FROM bouts"""))
def _(t):
    return t.contests.select("contest_id", names.slug(F.concat("event_name", F.lit(":."))).alias("slug"),
                             names.strict_slug(F.concat("event_name", F.lit(" !?"))).alias("strict"))


@query("contest_pair_key", sql(f"""
SELECT contest_id, least(a, b) || '|' || greatest(a, b) AS pair FROM (
  SELECT contest_id, lower({name_sql('red_id')}) AS a, lower({name_sql('blue_id')}) AS b FROM bouts)"""))
def _(t):
    key = lambda c: names.basic_key(person_name(C(c)))
    return t.contests.select("contest_id", names.pair_key(key("red_id"), key("blue_id")).alias("pair"))


LINES = "CASE WHEN margin >= 0 THEN -(110 + 3 * margin) ELSE 100 - 2 * margin END"


def line_of(margin):
    return F.when(margin >= 0, -(110 + 3 * margin)).otherwise(100 - 2 * margin).cast("int")


_IMPL = "CASE WHEN {x} < 0 THEN CAST(-{x} AS DOUBLE) / (-{x} + 100) ELSE 100.0 / ({x} + 100) END"


@query("moneyline_to_implied", sql(f"SELECT contest_id, CAST(o AS BIGINT) AS line, round(CAST({_IMPL.format(x='o')} AS DOUBLE) + 1e-9, 6) AS implied FROM (SELECT contest_id, {LINES} AS o FROM bouts)"))
def _(t):
    line = line_of(C("margin"))
    return t.contests.select("contest_id", line.alias("line"), market.implied(line).alias("implied"))


@query("remove_vig", sql(f"""
SELECT contest_id, round(CAST(a / (a + b) AS DOUBLE) + 1e-9, 6) AS f1, round(CAST(b / (a + b) AS DOUBLE) + 1e-9, 6) AS f2 FROM (
  SELECT contest_id, {_IMPL.format(x='o')} AS a, {_IMPL.format(x='p')} AS b FROM (
    SELECT contest_id, {LINES} AS o, {LINES.replace('margin', '(-margin)')} AS p FROM bouts))"""))
def _(t):
    p1, p2 = market.implied(line_of(C("margin"))), market.implied(line_of(-C("margin")))
    return t.contests.select("contest_id", market.fair_pair(p1, p2).alias("f")).select("contest_id", "f.*")


@query("format_moneyline", sql(f"""
SELECT contest_id, CASE WHEN round_no IS NULL THEN 'N/A' WHEN o > 0 THEN '+' || CAST(o AS VARCHAR) ELSE CAST(o AS VARCHAR) END AS text
FROM (SELECT contest_id, round_no, {LINES} AS o FROM bouts)"""))
def _(t):
    line = F.when(C("round_text").isNotNull(), line_of(C("margin")))
    return t.contests.select("contest_id", market.line_text(line).alias("text"))


@query("confidence_level", sql(f"""
SELECT contest_id, CASE WHEN abs(p - 0.5) >= 0.15 THEN 'HIGH' WHEN abs(p - 0.5) >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM (SELECT contest_id, {spread_sql('contest_id')} AS p FROM bouts)"""))
def _(t):
    return t.contests.select("contest_id", market.confidence(spread(C("contest_id"))).alias("level"))


@query("method_flags", sql("""
SELECT contest_id, CAST(method = 'KO/TKO' AS BIGINT) AS ko, CAST(method = 'Submission' AS BIGINT) AS sub,
  CAST(method LIKE 'Decision%' AS BIGINT) AS decision FROM bouts"""))
def _(t):
    m = C("method")
    return t.contests.select("contest_id", labels.is_knockout(m).cast("int").alias("ko"), labels.is_submission(m).cast("int").alias("sub"),
                             labels.is_decision(m).cast("int").alias("decision"))


_CAT = "CASE WHEN method = 'KO/TKO' THEN 'KO/TKO' WHEN method = 'Submission' THEN 'Submission' WHEN method LIKE 'Decision%' THEN 'Decision' ELSE 'Other' END"


@query("method_category", sql(f"SELECT contest_id, {_CAT} AS category, {_CAT} AS short_category FROM bouts"))
def _(t):
    short = F.regexp_replace(F.regexp_replace("method", "Submission", "SUB"), "Decision - (.).*", "$1-DEC")
    return t.contests.select("contest_id", labels.method_category(C("method")).alias("category"),
                             labels.method_category(short, short_forms=True).alias("short_category"))


@query("elo_expected", sql("""
SELECT contest_id, round(1.0 / (1.0 + pow(10.0, (b - a) / 400.0)) + 1e-9, 6) AS expected FROM (
  SELECT contest_id, 1400.0 + 4 * red_landed AS a, 1400.0 + 4 * blue_landed AS b FROM bouts)"""))
def _(t):
    return t.contests.select("contest_id", labels.elo_expected(4.0 * C("margin"), F.lit(0.0)).alias("expected"))


@query("temporal_flags", sql(f"""
SELECT contest_id, {big('f1_layoff', 'f2_layoff', 'f1_new_to_division', 'f2_new_to_division', 'is_title', 'contest_year', 'contest_month')}
FROM bout_matchups"""))
def _(t):
    return t.matchups.select("contest_id", "f1_layoff", "f2_layoff", "f1_new_to_division", "f2_new_to_division",
                             "is_title", "contest_year", "contest_month")


@query("experience_tier", sql("SELECT contest_id, side_id, tier FROM bout_imputed"))
def _(t):
    return t.career.select("contest_id", "side_id", labels.experience_tier(C("n_prior")).alias("tier"))


@query("card_position", sql("""
SELECT contest_id, CASE i WHEN 0 THEN 'Main Event' WHEN 1 THEN 'Co-Main' ELSE '' END AS label,
  CASE WHEN i < least(5, n) THEN 'main' ELSE 'prelim' END AS section FROM (
  SELECT contest_id, row_number() OVER (PARTITION BY contest_date ORDER BY contest_id) - 1 AS i,
    count(*) OVER (PARTITION BY contest_date) AS n FROM bouts)"""))
def _(t):
    from ..operators.serving import card_places
    return card_places(t.contests).select("contest_id", labels.card_slot(C("position"), C("card_size")).alias("s")).select("contest_id", "s.*")
