"""Secret scans: parts of credentials are found one by one and linked when complementary parts stand close together.

Strong parts (``assign``, ``access``, ``hex``) are reported always. Weak parts (an identifier such as ``client_id: x``,
a mixed string of 20 and more characters, an address) say little alone; an interval join brings together the parts
of one document whose starts are at most SCOPE code points apart, and a weak part is reported only when the parts it
lacks stand in its scope: an identifier beside a secret, a secret beside an identifier or an address, an address
beside both.

Only DataFrame functions are used. Positions come from the lengths of what stands between matches, summed up by a
window within the document, so the work is linear in the text.

Defined results: a null text is empty; no parts give zero counts, an empty ``spans`` and the hash of the empty
string. Repeated rows each get a row. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.session import stage

from .common import KEY, checked_join, content_key

# The patterns of the strong parts, in the order in which ties of start are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# The weak parts. A mixed string is looked through from its head alone, possessively, so its length costs linear time.
IDENTIFIER = r"""\b(?i:access_?key_?id|access_?id|client_?id|app_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]+"""
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+"
ADDRESS = r"\b(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3|ssh|ftp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "mixed": MIXED, "address": ADDRESS}
STRONG = ("assign", "access", "hex")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "identifier": "id", "mixed": "secret", "address": "address"}
SHORTEST = 6  # characters of an assigned value
SCOPE = 200
MASK = "[SECRET]"


def matches(text: Column, pattern: str) -> Column:
    """Of each match: the code points since the previous one, its length, and that of its first group."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(1)) if pattern == ASSIGN else found
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("size"), F.length(v).alias("value")))
    each = F.zip_with(gaps, sizes, lambda g, x: F.struct(F.length(g).alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    return F.when(F.rlike(text, p), each)


def find_parts(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (``carry``, KEY), and the parts of each content: KEY, kind, start, end."""
    keyed = docs.select(*carry, content_key("doc_id", "text").alias(KEY), *[matches(F.col("text"), p).alias(k) for k, p in KINDS.items()])
    scanned = stage(keyed, "scanned")
    some = scanned.where(F.greatest(*[F.col(k).isNotNull() for k in KINDS]))
    one = some.select(KEY, *KINDS).dropDuplicates([KEY])
    lists = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in KINDS]))
    flat = one.select(KEY, lists.alias("x")).where("x.found is not null").select(
        KEY, "x.kind", F.posexplode("x.found").alias("n", "f")).where("f.size is not null")
    upto = Window.partitionBy(KEY, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("f.gap") + F.col("f.size")).over(upto)
    parts = flat.select(KEY, "kind", "f", end.alias("end")).where((F.col("kind") != "assign") | (F.col("f.value") >= SHORTEST))
    return scanned.select(*carry, KEY), stage(parts.select(KEY, "kind", (F.col("end") - F.col("f.size")).alias("start"), "end"), "parts")


def link(parts: DataFrame) -> DataFrame:
    """The reported parts: strong ones, and weak ones with complementary parts in their scope."""
    role = F.element_at(F.create_map(*[F.lit(x) for k in ROLES.items() for x in k]), F.col("kind"))
    parts = parts.withColumn("role", role).withColumn("cell", F.floor(F.col("start") / SCOPE))
    # Starts at most SCOPE apart lie in the same cell or in neighbours; text length bounds the parts in a cell.
    near = parts.select(KEY, F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell"),
                        F.col("role").alias("other"), F.col("start").alias("there"), F.col("end").alias("stop")).distinct()
    weak = parts.where(~F.col("kind").isin(*STRONG))
    apart = (F.abs(F.col("start") - F.col("there")) <= SCOPE) & ((F.col("end") <= F.col("there")) | (F.col("stop") <= F.col("start")))
    met = weak.join(near, [KEY, "cell"]).where(apart).groupBy(KEY, "kind", "start", "end", "role").agg(
        *[F.max(F.col("other") == r).alias(r) for r in ("id", "secret", "address")])
    enough = (F.when(F.col("role") == "id", F.col("secret")).when(F.col("role") == "secret", F.col("id") | F.col("address"))
              .otherwise(F.col("id") & F.col("secret")))
    return parts.where(F.col("kind").isin(*STRONG)).select(KEY, "kind", "start", "end").unionByName(
        met.where(enough).select(KEY, "kind", "start", "end"))


def gathered(reported: DataFrame) -> DataFrame:
    """Per content the reported spans in order: (start, rank of kind, end, kind)."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return reported.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))


def find_credentials(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (doc_id) and ``spans``, an array of (start, rank, end, kind), for every row of ``docs`` (doc_id, text)."""
    carry = carry or ["doc_id"]
    base, parts = find_parts(docs, carry)
    spans = stage(gathered(link(parts)), "credentials")
    out = checked_join(base, spans, KEY, "left").drop(KEY)
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span replaced by MASK and ``n_chars`` counted anew; other rows stay as they are."""
    _, parts = find_parts(docs, ["doc_id"])
    before = Window.partitionBy(KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    open_ = link(parts).select(KEY, "start", "end").distinct().withColumn("first", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)))
    runs = open_.withColumn("run", F.sum(F.col("first").cast("int")).over(upto)).groupBy(KEY, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    # Each stretch between runs: from the end of the last run to the start of this one.
    ordered = Window.partitionBy(KEY).orderBy("run")
    cut = runs.select(KEY, "run", F.coalesce(F.lag("end").over(ordered), F.lit(0)).alias("from"), F.col("start").alias("to"), "end")
    cuts = stage(cut.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("run", "from", "to", "end"))).alias("__llm_cuts")), "cuts")
    keyed = checked_join(docs.withColumn(KEY, content_key("doc_id", "text")), cuts, KEY, "left")
    kept = F.transform("__llm_cuts", lambda c: F.concat(F.substring("text", c["from"] + 1, c["to"] - c["from"]), F.lit(MASK)))
    last = F.element_at("__llm_cuts", -1)["end"]
    text = F.when(F.col("__llm_cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), F.substring("text", last + 1, F.length("text"))))
    # The masked text stands under a name of its own, so that its length is not taken of a text masked twice.
    out = keyed.withColumn("__llm_masked", text)
    new = {"text": F.col("__llm_masked")}
    if "n_chars" in docs.columns:
        length = F.length("__llm_masked").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("__llm_cuts").isNull(), F.col("n_chars")).otherwise(length)
    return out.select(*[new[c].alias(c) if c in new else c for c in docs.columns])
