"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash of its content. A source's target is filled with whole passes over the source and, for the
rest, with the documents whose hash lies below a threshold. The threshold is found without sorting: words are
summed by (source, top LEVEL_BITS bits of the hash), the bucket in which the sum passes the budget is found, and only
the documents of that bucket are summed again by the next bits, until the hash is used up. The documents at
the threshold itself are taken if that ends nearer to the budget. Thresholds are nested: a larger budget keeps all
documents of a smaller one.

Defined results: a null text has size 0. A null source is a source, the last in order. A source of size 0 has
target 0. Rows that agree in doc_id and text share a hash and are taken or left together. Reruns agree, as
nothing but content decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.session import stage

from .common import small

LEVEL_BITS, LEVELS = 12, 4
MOST = 3  # times a document may be taken
WEIGHTS = (1, 2, 3)
SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; null has none."""
    bare = F.trim(text, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def content_hash(doc_id: Column, text: Column) -> Column:
    """The first 48 bits of the MD5 of doc_id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight, target): weights' shares of all words, none above MOST times its source.

    The excess of capped sources goes to the others by weight. Sources are capped in order of size over weight, so
    a running sum over the sources, one row each, finds where capping ends.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    each = each.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / F.sum("weight").over(rest)  # words for a weight of 1 if this source and the later ones are not capped
    each = each.withColumn("level", level)
    # The first source in order that its cap does not bind fixes the level of all later ones.
    first = F.first(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("cap").cast("double"), first * F.col("weight"))
    return each.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut, edge): take hashes below ``cut``, and ``cut`` itself if ``edge``.

    ``budgets`` has (source, budget). Both tables come staged; each level scans only narrow columns.
    """
    same = F.col("source").eqNullSafe(F.col("owner"))
    open_ = budgets.select(F.col("source").alias("owner"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), "budget")
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = sized.withColumn("bucket", F.shiftright("h", shift)).join(
            small(open_), same & (F.shiftright("bucket", LEVEL_BITS) == F.col("prefix")))
        sums = inside.groupBy("owner", "bucket").agg(F.sum("size").alias("size"), F.first("below").alias("below"), F.first("budget").alias("budget"))
        upto = Window.partitionBy("owner").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** LEVEL_BITS rows
        run = sums.withColumn("end", F.col("below") + F.sum("size").over(upto))
        passed = run.where(F.col("end") > F.col("budget"))
        first = passed.groupBy("owner").agg(F.min(F.struct("bucket", "end", "size", "budget")).alias("x"))
        open_ = stage(first.select("owner", F.col("x.bucket").alias("prefix"), (F.col("x.end") - F.col("x.size")).alias("below"),
                                   F.col("x.budget").alias("budget"), F.col("x.end").alias("end")), f"level{level}")
    edge = F.col("end") - F.col("budget") < F.col("budget") - F.col("below")
    return open_.select(F.col("owner").alias("source"), F.col("prefix").alias("cut"), edge.alias("edge"))


def plan(sized: DataFrame) -> DataFrame:
    """Per source: source_size, target, whole passes, cut and edge. ``sized`` has (source, size, h)."""
    goals = stage(targets(sized), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("passes", passes)
    budgets = goals.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"))
    cuts = thresholds(sized, stage(budgets, "budgets"))
    same = F.col("source").eqNullSafe(F.col("owner"))
    return stage(goals.join(cuts.withColumnRenamed("source", "owner"), same, "left").drop("owner"), "mix")


def copies() -> Column:
    """Times a document is taken, from its source's row of ``plan``."""
    under = F.coalesce((F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("edge")), F.lit(False))
    return (F.col("passes") + under.cast("long")).alias("copies")


def sizes(docs: DataFrame, carry: list[str]) -> DataFrame:
    return docs.select(*carry, "source", word_count(F.col("text")).alias("size"), content_hash(F.col("doc_id"), F.col("text")).alias("h"))


def with_plan(rows: DataFrame, mix: DataFrame) -> DataFrame:
    own = mix.withColumnRenamed("source", "owner")
    return rows.join(small(own), F.col("source").eqNullSafe(F.col("owner"))).drop("owner")


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    sized = stage(sizes(docs, ["doc_id"]), "sizes")
    out = with_plan(sized, plan(sized)).withColumn("copies", copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, numbered from 1 in ``copy``; documents not taken go."""
    mix = plan(stage(sizes(docs, []), "sizes"))
    names = docs.columns
    hashed = docs.withColumn("__llm_h", content_hash(F.col("doc_id"), F.col("text")))
    own = mix.select(F.col("source").alias("__llm_owner"), *[F.col(c).alias(f"__llm_{c}") for c in ("passes", "cut", "edge")])
    met = hashed.join(small(own), F.col("source").eqNullSafe(F.col("__llm_owner")))
    h, cut = F.col("__llm_h"), F.col("__llm_cut")
    under = F.coalesce((h < cut) | ((h == cut) & F.col("__llm_edge")), F.lit(False))
    times = (F.col("__llm_passes") + under.cast("long")).cast("int")
    return met.withColumn("__llm_times", times).where("__llm_times > 0").select(
        *names, F.explode(F.sequence(F.lit(1), F.col("__llm_times"))).alias("copy"))
