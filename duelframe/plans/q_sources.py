"""Sources, sinks and page extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import spec
from ..functions import parsing
from ..operators import serving
from ..session import app_folder
from ..sources import pages, readers, writers
from .q_market import _FAC, _FACSQL
from .registry import big, query, r6, real
from .sqltext import clock_sql, name_sql, spread_sql, sql
from .tables import person_name, spread

C = F.col


def _folder(t, name: str) -> str:
    return f"{app_folder(t.spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query("read_contests", sql(f"""
SELECT contest_id, contest_date, event_name, division, red_id, blue_id, winner, method, CAST(round_no AS VARCHAR) AS round_text, {clock_sql('clock_s')} AS time_text,
  CASE WHEN detailed THEN CAST(red_landed AS VARCHAR) || ' of ' || CAST(red_landed + red_disc AS VARCHAR) END AS red_sig_str FROM bouts"""))
def _(t):
    path = _folder(t, "contests")
    raw = t.contests.withColumn("event_date", F.date_format("contest_date", "MMMM d, yyyy"))
    from .. import schema
    raw.select(*schema.RAW_CONTESTS.fieldNames()).write.option("header", True).csv(path)
    return readers.read_contests(t.spark, path).select("contest_id", "contest_date", "event_name", "division", "red_id", "blue_id", "winner", "method",
                                                       "round_text", "time_text", "red_sig_str")


@query("read_competitors", sql(f"SELECT side_id, name, {big('height', 'reach')}, stance, born, {big('total_wins', 'total_losses', 'total_draws')} FROM people"))
def _(t):
    path, c = _folder(t, "competitors"), F.col
    mark = lambda col, text: F.when(col.isNull(), F.lit("--")).otherwise(text)
    raw = t.competitors.select(
        "side_id", "name", mark(c("height"), F.concat(F.floor(c("height") / 12).cast("string"), F.lit("' "), (c("height") % 12).cast("string"), F.lit('"'))).alias("height"),
        mark(c("reach"), F.concat(c("reach").cast("string"), F.lit('"'))).alias("reach"), F.coalesce("stance", F.lit("N/A")).alias("stance"),
        mark(c("born"), F.date_format("born", "MMM d, yyyy")).alias("dob"),
        F.concat(F.lit("Record: "), F.concat_ws("-", *[c(x).cast("string") for x in ("total_wins", "total_losses", "total_draws")])).alias("record"))
    raw.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_competitors(t.spark, path)


@query("read_ledger", sql(f"""
SELECT l.event_id, l.contest_date AS event_date, l.past AS locked, CAST(position AS BIGINT) AS position, contest_id, name_1, name_2, {real('p1')}, predicted_winner, actual_winner, correct FROM led l"""))
def _(t):
    path = _folder(t, "ledger")
    item = F.struct("position", "contest_id", "name_1", "name_2", "division", "p1", "predicted_winner", "confidence",
                    "actual_winner", "actual_method", "actual_round", "correct")
    cards = t.ledger_contests.groupBy("event_id").agg(F.array_sort(F.collect_list(item)).alias("contests"))
    entries = t.ledger_events.join(cards, "event_id").select(F.lit("1").alias("ledger_version"), F.array(F.struct(
        "event_id", C("event_id").alias("event_name"), C("event_date").cast("string").alias("event_date"), "locked", "prediction_type", "contests")).alias("entries"))
    entries.write.json(path)
    events, contests = readers.read_ledger(t.spark, path)
    return contests.join(events.select("event_id", "event_date", "locked"), "event_id").select(
        "event_id", "event_date", "locked", "position", "contest_id", "name_1", "name_2", "p1", "predicted_winner", "actual_winner", "correct")


def _odds(t):
    return t.odds.withColumnRenamed("r_id", "contest_id")


@query("read_odds_snapshot", sql(f"SELECT r_id AS contest_id, event_date, name_1, name_2, book, {big('f1_line', 'f2_line')} FROM prices"))
def _(t):
    docs = writers.odds_documents(_odds(t), "2001-08-02T00:00:00Z").select(F.to_json(F.struct("*")).alias("value"))
    return readers.parse_odds(docs).select("contest_id", "event_date", "name_1", "name_2", "book", "f1_line", "f2_line")


@query("append_odds_history", sql(f"""
SELECT s AS scraped_at, r_id AS contest_id, book, CAST(f1_line + d AS BIGINT) AS f1_line, CAST(f2_line + d AS BIGINT) AS f2_line FROM prices,
  (VALUES ('2001-08-02T00:00:00Z', 0), ('2001-08-03T00:00:00Z', 1)) AS v(s, d)"""))
def _(t):
    path = _folder(t, "odds_history")
    writers.append_odds_history(_odds(t), path, "2001-08-02T00:00:00Z")
    moved = _odds(t).withColumns({c: C(c) + 1 for c in ("f1_line", "f2_line")})
    writers.append_odds_history(moved, path, "2001-08-03T00:00:00Z")
    return readers.read_odds_snapshot(t.spark, path).select("scraped_at", "contest_id", "book", "f1_line", "f2_line")


@query("write_features", sql(f"SELECT contest_id, {big('contest_year')}, {real('diff_win_rate')} FROM bout_matchups"))
def _(t):
    path = _folder(t, "features")
    writers.write_features(t.matchups.select("contest_id", "contest_date", "diff_win_rate"), path)
    return t.spark.read.parquet(path).select("contest_id", C("year").alias("contest_year"), "diff_win_rate")


@query("write_predictions", sql(f"""
SELECT m.contest_id, {r6(spread_sql('m.contest_id'))} AS p1, f.factors FROM bout_matchups m LEFT JOIN (
  SELECT contest_id, string_agg(feature || ':' || printf('%.3f', value), '; ' ORDER BY rank) AS factors FROM rankf WHERE rank <= 5 GROUP BY 1) f ON f.contest_id = m.contest_id""",
    **_FACSQL).replace("printf('%.3f', value)", "replace(printf('%.3f', round(value + 1e-9, 3)), '-0.000', '0.000')"))
def _(t):
    path = _folder(t, "predictions")
    out = serving.top_factors(t.matchups.select("contest_id", *_FAC), _FAC, 5).withColumn(
        "factors", F.transform("factors", lambda x: F.struct(x["feature"].alias("feature"), F.round(x["value"] + 1e-9, 3).alias("value"))))
    writers.write_predictions(out.select("contest_id", spread(C("contest_id")).alias("p1"), "factors"), path)
    return t.spark.read.option("header", True).schema("contest_id long, p1 double, factors string").csv(path)


@query("write_event_docs", sql(f"""
SELECT event_id, CAST(contest_date AS VARCHAR) AS event_date, CAST(position // 500 AS BIGINT) AS part, count(*) AS contests,
  string_agg(CAST(contest_id AS VARCHAR), ',' ORDER BY position) AS card, round(sum(round(p1 + 1e-9, 3)) + 1e-9, 6) AS p1 FROM led GROUP BY 1, 2, 3"""))
def _(t):
    path = _folder(t, "event_docs")
    writers.write_event_docs(serving.event_documents(t.ledger_contests), path)
    docs = t.spark.read.schema("event_id string, event_date string, part long, contests array<struct<position:int,contest_id:long,p1:double>>").json(path)
    return docs.select("event_id", "event_date", "part", F.size("contests").cast("long").alias("contests"),
                       F.array_join(F.transform("contests", lambda x: x["contest_id"].cast("string")), ",").alias("card"),
                       F.aggregate("contests", F.lit(0.0), lambda s, x: s + x["p1"]).alias("p1"))


@query("save_imputation_tables", sql(f"SELECT division, {real('med_sig_landed', 'med_sig_absorbed', 'med_td_landed', 'med_duration')} FROM med"))
def _(t):
    path = _folder(t, "imputation")
    config = t.medians.agg(F.count(F.lit(1)).alias("divisions")).withColumns({k: F.lit(v) for k, v in spec.DEBUT.items()})
    writers.save_imputation_tables(t.medians, config, path)
    return t.spark.read.parquet(f"{path}/medians")


@query("model_registry", sql(f"""
SELECT version, year, {real('test_accuracy')}, retired_at IS NULL AS is_current, deployed_at, retired_at, CAST((
  SELECT count(*) FROM led l WHERE l.correct IS NOT NULL AND l.contest_date >= deployed_at AND (retired_at IS NULL OR l.contest_date < retired_at)) AS BIGINT) AS in_force
FROM (
  SELECT 'v' || CAST(row_number() OVER (ORDER BY y) AS VARCHAR) AS version, CAST(y AS BIGINT) AS year, test_accuracy, CAST(d AS DATE) AS deployed_at,
    CAST(lead(d) OVER (ORDER BY y) AS DATE) AS retired_at
  FROM (SELECT year(contest_date) AS y, max(contest_date) AS d, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS test_accuracy FROM led WHERE correct IS NOT NULL GROUP BY 1))"""))
def _(t):
    """A version per season of the ledger, deployed on its last day and in force until the next one is; with the contests it was in force for."""
    path = _folder(t, "registry")
    scored = t.called.filter("correct IS NOT NULL").select("contest_date", C("correct").cast("double").alias("hit"))
    per = scored.groupBy(F.year("contest_date").alias("y")).agg(F.max("contest_date").cast("string").alias("d"), F.avg("hit").alias("test_accuracy"))
    seasons = F.array_sort(F.collect_list(F.struct("y", "d", "test_accuracy")))
    doc = per.agg(seasons.alias("s")).select(
        F.lit("1").alias("registry_version"), F.concat(F.lit("v"), F.size("s").cast("string")).alias("current"),
        F.transform("s", lambda x, i: F.struct(
            F.concat(F.lit("v"), (i + 1).cast("string")).alias("version"), x["y"].cast("string").alias("description"), x["d"].alias("deployed_at"),
            F.get("s", i + 1)["d"].alias("retired_at"), x["test_accuracy"].alias("test_accuracy"))).alias("models"))
    doc.coalesce(1).write.json(path)
    registry = readers.read_model_registry(t.spark, path)
    # A date has one version in force, so its contests are counted before the lookup.
    daily = scored.groupBy("contest_date").agg(F.count("*").alias("n"))
    served = readers.model_in_force(daily, registry, "contest_date", "version").groupBy("version").agg(F.sum("n").alias("in_force"))
    return registry.join(served, "version", "left").select(
        "version", C("description").cast("long").alias("year"), "test_accuracy", "is_current", C("deployed_at").cast("date").alias("deployed_at"),
        C("retired_at").cast("date").alias("retired_at"), F.coalesce("in_force", F.lit(0)).alias("in_force"))


@query("refresh_since", sql("""
SELECT contest_id, contest_date FROM bouts WHERE contest_date < DATE '2001-03-01' AND contest_id % 5 <> 0
  OR contest_date >= (SELECT max(contest_date) FROM bouts WHERE contest_date < DATE '2001-03-01' AND contest_id % 5 <> 0)"""))
def _(t):
    base = t.contests.select("contest_id", "contest_date")
    return readers.refresh_since(base.filter((C("contest_date") < F.lit("2001-03-01").cast("date")) & (C("contest_id") % 5 != 0)), base)


# ---------------------------------------------------------------- pages
@query("extract_event_list", """
SELECT page_id, CAST(i - 1 AS BIGINT) AS position, regexp_extract(item, '>([^<]*)</a>', 1) AS name, regexp_extract(item, 'href="([^"]*)"', 1) AS url FROM (
  SELECT page_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages))""")
def _(t):
    return pages.extract_event_list(t.read("pages"))


def contest_pages(t):
    """One page per contest in the layout the extraction reads: a result row, totals, and strikes by target."""
    n1, n2 = person_name(C("red_id")), person_name(C("blue_id"))
    td = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    s = lambda c: F.coalesce(C(c), F.lit("--"))
    lit = F.lit
    flag = lambda who: F.when(C("winner") == C(who).cast("string"), lit('<a class="flag win">win</a>')).when(
        C("winner").isin("Draw", "No Contest"), F.concat(lit('<a class="flag">'), F.lower("winner"), lit("</a>"))).otherwise(lit(""))
    detail = F.concat(F.coalesce(F.concat(lit("Round: "), C("round_text")), lit("")), lit(" Time: "), C("time_text"))
    row = F.concat(lit("<table><tr>"), td(flag("red_id")), td(F.concat(lit('<p><a href="/a">'), n1, lit('</a></p><p><a href="/b">'), n2, lit("</a></p>"))),
                   td(flag("blue_id")), td(lit("")), td(lit("")), td(lit("")), td(C("division")),
                   td(F.concat(lit("<p>"), C("method"), lit("</p><p>"), detail, lit("</p>"))), lit("</tr></table>"))
    total = lambda x: F.concat(lit("<tr>"), td(lit(x)), td(s(f"{x}_kd")), td(s(f"{x}_sig_str")), td(lit("50%")), td(s(f"{x}_total_str")), td(s(f"{x}_td")), td(lit("0%")),
                               td(s(f"{x}_sub_att")), td(lit("0")), td(s(f"{x}_ctrl")), lit("</tr>"))
    aim = lambda x: F.concat(lit("<tr>"), td(lit(x)), td(s(f"{x}_sig_str")), td(lit("50%")), *[td(s(f"{x}_{c}")) for c in ("kd", "sub_att", "td", "total_str", "sig_str", "ctrl")], lit("</tr>"))
    page = F.concat(lit("<html><style>td{}</style><body>"), row, lit("<table>"), total("red"), total("blue"), lit("</table><table>"), aim("red"), aim("blue"), lit("</table></body></html>"))
    # Parsing is bound by Python time, so the small contest rows are spread over all cores before they become pages.
    spread_out = t.contests.repartition(t.spark.sparkContext.defaultParallelism, "contest_id")
    return spread_out.select(C("contest_id").alias("page_id"), F.concat(lit("http://x/"), C("contest_id").cast("string")).alias("url"), page.alias("html"))


@query("extract_contest_rows", sql(f"""
SELECT contest_id AS page_id, CAST(contest_id AS VARCHAR) AS contest, {name_sql('red_id')} AS name_1, {name_sql('blue_id')} AS name_2,
  CASE WHEN winner = CAST(red_id AS VARCHAR) THEN {name_sql('red_id')} WHEN winner = CAST(blue_id AS VARCHAR) THEN {name_sql('blue_id')} ELSE winner END AS winner,
  division, method, coalesce(CAST(round_no AS VARCHAR), '') AS round_text, {clock_sql('clock_s')} AS time_text FROM bouts"""))
def _(t):
    return pages.extract_contest_rows(contest_pages(t))


_OF = "CASE WHEN detailed THEN CAST({a} AS VARCHAR) || ' of ' || CAST({b} AS VARCHAR) ELSE '--' END"
_ONE = "CASE WHEN detailed THEN CAST({a} AS VARCHAR) ELSE '--' END"


def _stat_sql(s: str, c: str) -> str:
    return {"kd": _ONE.format(a=f"{s}_lines % 3"), "sub_att": _ONE.format(a=f"({s}_cents // 7) % 3"),
            "sig_str": _OF.format(a=f"{s}_landed", b=f"{s}_landed + {s}_disc"), "td": _OF.format(a=f"{s}_td", b=f"{s}_td + {s}_lines % 4"),
            "total_str": _OF.format(a=f"{s}_landed + {s}_lines", b=f"{s}_landed + {s}_disc + {s}_lines"),
            "ctrl": f"CASE WHEN detailed THEN {clock_sql(f'{s}_cents % 600')} ELSE '--' END", "sig_str_pct": "'50%'", "td_pct": "'0%'", "rev": "'0'"}[c]


@query("extract_contest_totals", sql("SELECT contest_id AS page_id, " + ", ".join(
    f"{_stat_sql(s, c)} AS {s}_{c}" for s in ("red", "blue") for c in ("kd", "sig_str", "sig_str_pct", "total_str", "td", "td_pct", "sub_att", "rev", "ctrl")) + " FROM bouts"))
def _(t):
    return pages.extract_contest_totals(contest_pages(t))


@query("extract_target_strikes", sql("SELECT contest_id AS page_id, " + ", ".join(
    f"{_stat_sql(s, c)} AS {s}_{n}" for s in ("red", "blue") for n, c in (("head", "kd"), ("body", "sub_att"), ("leg", "td"), ("distance", "total_str"), ("clinch", "sig_str"), ("ground", "ctrl"))) + " FROM bouts"))
def _(t):
    return pages.extract_target_strikes(contest_pages(t))


@query("extract_profiles", sql(f"""
SELECT side_id AS page_id, {big('height', 'reach')}, CAST(side_id % 90 + 115 AS VARCHAR) || ' lbs.' AS weight, stance, born, {', '.join(f"'{i}.5' AS {n}" for i, n in enumerate(('slpm', 'str_acc', 'sapm', 'str_def', 'td_avg', 'td_acc', 'td_def', 'sub_avg')))} FROM people"""))
def _(t):
    c, lit = F.col, F.lit
    dash = lambda col, text: F.when(col.isNull(), lit("--")).otherwise(text)
    li = lambda label, v: F.concat(lit(f"<li><i>{label}:</i> "), v, lit("</li>"))
    labels = ("SLpM", "Str. Acc.", "SApM", "Str. Def", "TD Avg.", "TD Acc.", "TD Def.", "Sub. Avg.")
    page = F.concat(lit("<ul>"), li("Height", dash(c("height"), F.concat(F.floor(c("height") / 12).cast("string"), lit("' "), (c("height") % 12).cast("string"), lit("&quot;")))),
                    li("Weight", F.concat((c("side_id") % 90 + 115).cast("string"), lit(" lbs."))), li("Reach", dash(c("reach"), F.concat(c("reach").cast("string"), lit('"')))),
                    li("STANCE", dash(c("stance"), c("stance"))), li("DOB", dash(c("born"), F.date_format("born", "MMM d, yyyy"))),
                    *[li(n, lit(f"{i}.5")) for i, n in enumerate(labels)], lit("</ul>"))
    return pages.extract_profiles(t.competitors.select(c("side_id").alias("page_id"), lit("").alias("url"), page.alias("html")))


@query("extract_upcoming", sql(f"""
SELECT contest_id AS page_id, {name_sql('red_id')} AS name_1, {name_sql('blue_id')} AS name_2, division, contains(lower(division), 'title') AS is_title FROM bouts"""))
def _(t):
    return pages.extract_upcoming(contest_pages(t))
