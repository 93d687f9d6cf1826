"""Named queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import collocations, credentials, decontaminate, forest, licenses, mixing, pii, quality, runs, simhash, topk, toxicity, urls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


WINNOW_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item AS (
  SELECT item_id, words, CAST(least(10, len(words)) AS BIGINT) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL)
  WHERE len(words) > 0),
item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(words[s + 1:s + n], ' ') AS w
  FROM (SELECT item_id, words, n, unnest(range(len(words) - n + 1)) AS s FROM item)),
doc_window AS (
  SELECT row_id, n, s, array_to_string(words[s + 1:s + n], ' ') AS w
  FROM (SELECT row_id, words, n, unnest(range(len(words) - n + 1)) AS s FROM doc, (SELECT DISTINCT n FROM item) WHERE len(words) >= n)),
hit AS (SELECT row_id, item_id, s, d.n FROM doc_window d JOIN item_window i ON d.n = i.n AND d.w = i.w),
place AS (SELECT row_id, count(DISTINCT pos) AS n_hit FROM (SELECT row_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY row_id),
found AS (
  SELECT row_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN place USING (row_id) LEFT JOIN found USING (row_id)"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS h
  FROM documents),
w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (
  SELECT *, row_number() OVER o AS n,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
           / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT arg_min(level, n) AS level FROM l WHERE cap >= level * weight),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), f.level * weight) AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS size, CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS upto
  FROM d GROUP BY source, h),
b AS (
  SELECT p.source, c.h, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget, c.upto, c.size
  FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, d.size, b.source_size, b.target, d.size * (b.passes + CASE
         WHEN b.upto <= b.budget THEN 1
         WHEN b.upto - b.size <= b.budget AND b.upto - b.budget < b.budget - (b.upto - b.size) THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.h = b.h"""


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def trusted_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where("quality = 1").select("doc_id")


@query("op3_credential_links")
def op3_credential_links(spark, folder):
    found = credentials.find_credentials(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*credentials.STRONG))
    counts = [count_of("spans", k).alias(f"n_{k}") for k in credentials.STRONG]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op5_winnowing", WINNOW_SQL)
def op5_winnowing(spark, folder):
    found = decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op7_simhash")
def op7_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op9_hash_mix", MIX_SQL)
def op9_hash_mix(spark, folder):
    return mixing.mix_table(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_kneser_ney")
def op10_kneser_ney(spark, folder):
    return quality.classify(table(spark, folder, "documents"), trusted_ids(spark, folder))


@query("op1_weak_supervision")
def op1_weak_supervision(spark, folder):
    found = pii.find_personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.STRICT))
    counts = [count_of("spans", k).alias(f"n_{k}") for k in pii.STRICT]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op2_multiple_instance")
def op2_multiple_instance(spark, folder):
    docs = table(spark, folder, "documents")
    scored = toxicity.score_toxicity(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


@query("op4_norm_sorted", """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op4_norm_sorted(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


@query("op6_boosted_urls")
def op6_boosted_urls(spark, folder):
    return urls.judge(table(spark, folder, "pages"), list(URL_RULES))


@query("op8_template_automata")
def op8_template_automata(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op11_lsh_forest")
def op11_lsh_forest(spark, folder):
    return forest.near_duplicates(table(spark, folder, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by the checksum of doc_id, the words after some place repeat those at that place."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    start = g % n
    period = 1 + F.floor((n - start) / (3 + g % 8))
    place = F.transform(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")), lambda i: F.when(i < start, i).otherwise(start + (i - start) % period))
    changed = F.array_join(F.transform(place, lambda i: F.get("words", i.cast("int"))), " ")
    told = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    return told.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), changed).otherwise(F.col("text")).alias("text"))


def op12_of(docs: DataFrame) -> DataFrame:
    found = runs.find_runs(with_repeats(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return told.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op12_square_catchers")
def op12_square_catchers(spark, folder):
    return op12_of(table(spark, folder, "documents"))


@query("op13_stripes", r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
size AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, phrase, k, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k))
  GROUP BY lang, phrase, k HAVING count(*) >= 30),
cut AS (
  SELECT lang, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS part, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
scored AS (
  SELECT cut.lang, cut.phrase, a, c, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
  FROM cut JOIN f l ON cut.lang = l.lang AND cut.part = l.phrase JOIN f r ON cut.lang = r.lang AND cut.rest = r.phrase),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
held AS (
  SELECT lang, part AS phrase, max(f) AS most FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[s:s + j - 1], ' ') AS part FROM (
      SELECT *, unnest(range(1, k - j + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS j FROM f WHERE k > 2)))
  GROUP BY lang, part),
alone AS (
  SELECT lowest.* FROM lowest LEFT JOIN held ON lowest.lang = held.lang AND lowest.phrase = held.phrase
  WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM alone JOIN size USING (lang) QUALIFY rank <= 2000""")
def op13_stripes(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))
