"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Texts are sequences of code points, each told apart (case, digits, marks and all scripts), and the model counts their
n-grams up to order 4 over every trusted row, by language. Counts, continuation counts, context totals and
discounts are joined by (language, n-gram). To score, the distinct n-grams of all texts are joined with the sharded model from the
lowest order up. Texts of one model are dealt into groups of about GROUP MB; each group asks once for each of its distinct
n-grams, and the costs meet its texts, where each sums its own. Nothing of the model passes through the driver.

``fit`` and ``perplexity`` also take coarser symbols: CLASSES has 32 classes of bytes (letters without case, all capitals
in one, white space, digits, sentence marks, other marks, and bytes of non-ASCII letters).

Defined results: a null or empty text has no symbols, null perplexity and ``keep`` false. A null language, or
one without trusted text, is scored by the model and thresholds of all languages together. Repeated rows are
each scored. An empty trusted set keeps every non-empty text; otherwise every non-empty text meets bounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from duelframe.session import stage

from .common import KEY, checked_join, column, content_key, rows_of, slices, small, utf8

ORDER, BASE = 4, 32
# MB of text in a group that asks for its n-grams together.
GROUP = 8
# Largest alphabet whose 4-grams fit 63 bits.
WIDE = 55_000
ALL = "*"
SPACE, CAPITAL, DIGIT, STOP, MARK, OTHER = range(26, 32)
# Bounds of the length bands (symbols) within which quantiles are taken: short texts vary more.
BANDS = (64, 256, 1024, 4096)
# Rows that bounds backed off to weigh, and rows that the corpus's bounds before any text weigh.
BACK, PRIOR = 20, 2


def symbol_classes() -> np.ndarray:
    lut = np.full(256, MARK, np.uint8)
    lut[0x80:] = OTHER
    lut[list(b" \t\r\n\x0b\x0c")] = SPACE
    lut[ord("a"):ord("z") + 1] = np.arange(26)
    lut[ord("A"):ord("Z") + 1] = CAPITAL
    lut[ord("0"):ord("9") + 1] = DIGIT
    lut[list(b".,;:?!'-")] = STOP
    return lut


LUT = symbol_classes()


@dataclass(frozen=True)
class Symbols:
    """What a text is a sequence of; ``size`` is the number of symbols, or None for those of the trusted texts and one unknown."""
    points: bool
    size: int | None


CLASSES, POINTS = Symbols(False, BASE), Symbols(True, None)


def _symbols(texts: pa.Array, kind: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols as code points, each text after ORDER - 1 spaces, and where each text begins and ends."""
    padded = pc.binary_join_element_wise(pa.scalar(" " * (ORDER - 1)), pc.fill_null(texts, ""), "")
    data, at = utf8(padded)
    if not kind.points:
        return LUT[data].astype(np.int64) + ord("@"), at
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64), heads[at]


def _texts(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    flat = points.ravel()
    size = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size.reshape(points.shape).sum(axis=1))]).astype(np.int32)
    data = flat.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(at), pa.py_buffer(data))


@dataclass
class Grams:
    """The distinct n-grams of some texts, how often each occurs, and the number of symbols of each text."""
    code: np.ndarray
    distinct: np.ndarray
    n: np.ndarray
    grams: pa.Array
    size: np.ndarray

    def sums(self, cost: np.ndarray) -> np.ndarray:
        """Each text's sum of the costs of its n-grams; it depends on no other text."""
        out = np.zeros(len(self.size))
        at, some = np.cumsum(self.size) - self.size, self.size > 0
        if some.any():
            out[some] = np.add.reduceat(cost[np.searchsorted(self.distinct, self.code)], at[some])
        return out


def ngrams(texts: pa.Array, kind: Symbols) -> Grams:
    """The n-grams that end at each symbol of the texts; a text begins after spaces."""
    s, at = _symbols(texts, kind)
    present = np.flatnonzero(np.bincount(s))
    rank = np.zeros(present[-1] + 1 if len(present) else 1, np.int64)
    rank[present] = np.arange(len(present))
    c, base = rank[s], max(1, len(present))
    pairs, wide, table = c[:-1] * base + c[1:], base * base, None
    if base > WIDE:
        table, pairs = np.unique(pairs, return_inverse=True)
        wide = len(table)
    inside = np.ones(max(0, len(s)), bool)
    inside[(at[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
    code = (pairs[:-2] * wide + pairs[2:])[inside[ORDER - 1:]]
    distinct, n = np.unique(code, return_counts=True)
    halves = np.divmod(distinct, wide)
    if table is not None:
        halves = [table[h] for h in halves]
    points = np.stack([present[x] for h in halves for x in np.divmod(h, base)], axis=1) if len(distinct) else np.zeros((0, ORDER), np.int64)
    return Grams(code, distinct, n, _texts(points), np.diff(at) - (ORDER - 1))


def _by_value(batch, name: str) -> Iterator[tuple[str, np.ndarray]]:
    """Each value of the column and the numbers of its rows."""
    coded = column(batch, name).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    at = coded.indices.to_numpy(zero_copy_only=False)
    for i, value in enumerate(coded.dictionary.to_pylist()):
        yield value, np.flatnonzero(at == i)


def _counter(kind: Symbols):
    def count(batches):
        for batch in slices(batches, "text", 4 << 20):
            for lang, rows in _by_value(batch, "lang"):
                found = ngrams(column(batch, "text").take(pa.array(rows)), kind)
                yield pa.record_batch({"lang": pa.array([lang] * len(found.n), pa.string()), "gram": found.grams, "n": pa.array(found.n, pa.int64())})
    return count


def count_ngrams(trusted: DataFrame, kind: Symbols) -> DataFrame:
    """(lang, gram, n) over all rows, and the same over all languages together under ``*``."""
    part = trusted.select(F.coalesce("lang", F.lit(ALL)).alias("lang"), "text").mapInArrow(_counter(kind), "lang string, gram string, n long")
    each = stage(part.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngram_counts")
    pooled = each.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "gram", "n")
    return each.where(F.col("lang") != ALL).unionByName(pooled)


def orders(top: DataFrame) -> DataFrame:
    """(lang, k, gram, n) for all orders: counts of the highest, and below it the kinds of symbols that stand before a k-gram."""
    counts, out = top, [top.withColumn("k", F.lit(ORDER))]
    for k in range(ORDER - 1, 0, -1):
        counts = counts.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        out.append(counts.withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, out)


def discounts(counts: DataFrame) -> DataFrame:
    """The three modified Kneser-Ney discounts of each language and order, from its counts of counts."""
    times = counts.groupBy("lang", "k").agg(*[F.sum((F.col("n") == j).cast("double")).alias(f"t{j}") for j in (1, 2, 3, 4)])
    y = F.when(F.col("t1") + F.col("t2") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.5)

    def d(j: int):
        raw = j - (j + 1) * y * F.col(f"t{j + 1}") / F.nullif(F.col(f"t{j}"), F.lit(0.0))
        return F.greatest(F.lit(0.05), F.least(F.lit(j - 0.05), F.coalesce(raw, F.lit(0.5 * j)))).alias(f"d{j}")
    return times.select("lang", "k", d(1), d(2), d(3))


def fit(trusted: DataFrame, kind: Symbols = CLASSES) -> DataFrame:
    """Rows (lang, gram, q, once, gamma): the discounted share of each seen n-gram in its context, whether its count is one, and its
    back-off weight as a context.

    The empty n-gram has the share of a uniform guess. Contexts sum whole numbers, so that reruns agree.
    """
    counts = stage(orders(count_ngrams(trusted, kind)), "ngrams")
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    found = small(stage(discounts(counts), "discounts"))
    seen = counts.withColumn("context", F.expr("substring(gram, 1, k - 1)"))
    times = [F.count_if(F.col("n") == j if j < 3 else F.col("n") >= 3) for j in (1, 2, 3)]
    context = stage(seen.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), *[t.alias(f"c{j}") for j, t in enumerate(times, 1)]), "contexts")
    q = seen.join(context.select("lang", "k", "context", "total"), ["lang", "k", "context"]).join(found, ["lang", "k"]).select(
        "lang", "gram", ((F.col("n") - cut) / F.col("total")).alias("q"), (F.col("n") == 1).alias("once"))
    back = context.join(found, ["lang", "k"]).select(
        "lang", F.col("context").alias("gram"), (sum(F.col(f"c{j}") * F.col(f"d{j}") for j in (1, 2, 3)) / F.col("total")).alias("gamma"))
    types = F.lit(float(kind.size)) if kind.size else F.count("*") + 1.0
    guess = counts.where("k = 1").groupBy("lang").agg((1 / types).alias("q")).withColumns({"gram": F.lit(""), "once": F.lit(False)})
    model = q.unionByName(guess).unionByName(back, allowMissingColumns=True)
    return stage(model.groupBy("lang", "gram").agg(*[F.max(c).alias(c) for c in ("q", "once", "gamma")]), "kn_model")


def _asker(kind: Symbols):
    def ask(batches):
        """The distinct n-grams of each slice, by model."""
        for batch in slices(batches, "text", 4 << 20):
            for model, rows in _by_value(batch, "model"):
                grams = ngrams(column(batch, "text").take(pa.array(rows)), kind).grams
                yield pa.record_batch({"model": pa.array([model] * len(grams), pa.string()), "gram": grams})
    return ask


def _deflate(batches):
    """Texts compressed, since the groups' shuffle is the largest of the job."""
    for batch in batches:
        packed = pa.array([zlib.compress(t, 1) for t in rows_of(batch, "text")], pa.binary())
        at = batch.schema.get_field_index("text")
        yield pa.record_batch([packed if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)


def _inflate(packed: pa.ChunkedArray, most: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in arrays of about ``most`` bytes; a longer text stands alone."""
    held, size = [], 0
    for chunk in packed.chunks:
        for value in chunk:
            text = zlib.decompress(value.as_buffer())
            if held and size + len(text) > most:
                yield pa.array(held, pa.binary()).cast(pa.string())
                held, size = [], 0
            held.append(text)
            size += len(text)
    if held:
        yield pa.array(held, pa.binary()).cast(pa.string())


def _grouper(kind: Symbols):
    def ask(texts: pa.Table) -> pa.Table:
        """The distinct n-grams of a group of texts."""
        found = pc.unique(pa.chunked_array([ngrams(t, kind).grams for t in _inflate(column(texts, "text"))], pa.string()))
        key = [pa.repeat(column(texts, c)[0], len(found)) for c in ("model", "part")]
        return pa.table([*key, found], names=["model", "part", "gram"])
    return ask


def _scorer(kind: Symbols, carry: list[str]):
    def score(texts: pa.Table, costs: pa.Table) -> pa.Table:
        """Number of symbols and perplexity of each text of a group, from the costs of the group's n-grams."""
        n, mean, first = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan), 0
        grams = column(costs, "gram").combine_chunks()
        cost = column(costs, "cost").combine_chunks()
        without, left_out = pc.coalesce(column(costs, "without").combine_chunks(), cost), mean.copy()
        for some in _inflate(column(texts, "text")):
            found, last = ngrams(some, kind), first + len(some)
            at = pc.index_in(found.grams, value_set=grams)
            n[first:last] = found.size
            for out, each in ((mean, cost), (left_out, without)):
                with np.errstate(invalid="ignore"):
                    out[first:last] = found.sums(each.take(at).to_numpy(zero_copy_only=False)) / found.size
            first = last
        ready = {c: column(texts, c) for c in carry}
        ready |= {"n_symbols": pa.array(n)}
        return pa.table(ready | {c: pa.array(np.exp(x), from_pandas=True) for c, x in (("perplexity", mean), ("left_out", left_out))})
    return score


def costs(asked: DataFrame, model: DataFrame) -> DataFrame:
    """(model, gram, cost, without) of the n-grams ``asked`` (model, gram): negative log-probabilities, joined from the lowest order up.

    ``without`` is that in a trusted text which is itself left out of the counts, where it differs: an n-gram counted once
    is then unseen, and takes its count of kinds from the next lower order with it.
    """
    q = model.select(F.col("lang").alias("model"), "gram", "q", "once").where("q is not null")
    back = model.select(F.col("lang").alias("model"), F.col("gram").alias("context"), "gamma").where("gamma is not null")
    wanted = [asked.select("model", "gram").distinct()]
    for _ in range(ORDER):
        wanted.append(wanted[-1].select("model", F.expr("substring(gram, 2)").alias("gram")).distinct())
    p = wanted.pop().join(q, ["model", "gram"]).select("model", "gram", F.col("q").alias("p"), F.col("q").alias("l"))
    for k in range(1, ORDER + 1):
        own = wanted.pop().withColumns({"context": F.expr(f"substring(gram, 1, {k - 1})"), "suffix": F.expr("substring(gram, 2)")})
        own = own.join(p.withColumnRenamed("gram", "suffix"), ["model", "suffix"]).join(back, ["model", "context"], "left").join(q, ["model", "gram"], "left")
        weight = F.coalesce("gamma", F.lit(1.0))
        whole = F.coalesce("q", F.lit(0.0)) + weight * F.col("p")
        p = own.select("model", "gram", whole.alias("p"), F.when(F.col("once"), weight * F.col("l")).otherwise(whole).alias("l"))
    return p.select("model", "gram", (-F.log("p")).alias("cost"), F.when(F.col("l") != F.col("p"), -F.log("l")).alias("without"))


def perplexity(docs: DataFrame, model: DataFrame, carry: list[str], kind: Symbols = CLASSES) -> DataFrame:
    """``carry``, the number of symbols, the perplexity and that left out of the counts (of trusted texts) of every row of ``docs``.

    Texts of one model are dealt into its groups by content and by the columns carried, so that copies spread.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in carry}
    given = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    langs = stage(model.where(f"gram = '' and lang <> '{ALL}'").select("lang", F.col("lang").alias("model")), "languages")
    docs = checked_join(docs.select(*dict.fromkeys([*carry, "lang", "text"])), langs, "lang", "left")
    docs = docs.select(*carry, "text", F.coalesce("model", F.lit(ALL)).alias("model"))
    bytes_ = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    groups = stage(docs.groupBy("model").agg(F.ceil(F.greatest(bytes_, F.lit(1)) / F.lit(GROUP << 20)).alias("parts")), "groups")
    price = stage(costs(stage(docs.select("model", "text").mapInArrow(_asker(kind), "model string, gram string").distinct(), "asked"), model), "costs")
    dealt = checked_join(docs, groups, "model", "inner").select(
        *carry, "text", "model", F.pmod(F.xxhash64("text", *carry), F.col("parts")).cast("int").alias("part"))
    # One shuffle of the texts serves both uses below.
    dealt = dealt.mapInArrow(_deflate, f"{given}, text binary, model string, part int").groupBy("model", "part")
    asked = dealt.applyInArrow(_grouper(kind), "model string, part int, gram string")
    found = asked.join(price.hint("merge"), ["model", "gram"]).select("model", "part", "gram", "cost", "without")
    return dealt.cogroup(found.groupBy("model", "part")).applyInArrow(_scorer(kind, carry), f"{given}, n_symbols long, perplexity double, left_out double")


def band() -> F.Column:
    return reduce(lambda e, b: e + (F.col("n_symbols") >= b).cast("int"), BANDS, F.lit(0))


def bounds(known: DataFrame, guess: DataFrame, quantile: float, slack: float, accuracy: int) -> DataFrame:
    """(lang, band, low, high) for every language of the trusted rows ``known`` and, under null, for all together; every band has a row.

    Low ends come from the texts as counted, since copies of trusted texts score so; high ends from each left out of the counts,
    as texts that the model never saw score. Own quantiles weigh as many rows as they rest on, those they back off to weigh BACK rows: a band backs off to its
    language and a language to the corpus; under null a band backs off to the corpus. The corpus itself meets the bounds
    0 and that of ``guess`` (one row: the perplexity of a uniform guess) at the weight of PRIOR rows. No number of rows switches bounds off.
    """
    q = [F.percentile_approx(c, [1 - quantile, 0.5, quantile], accuracy).alias(c) for c in ("perplexity", "left_out")]
    held = known.cube("lang", "band").agg(*q, F.count("*").alias("n"), F.grouping_id().alias("level"))
    (low, mid), (out, high) = [F.col("perplexity")[i] for i in (0, 1)], [F.col("left_out")[i] for i in (1, 2)]
    held = stage(held.select("lang", "band", "level", "n", (mid - (1 + slack) * (mid - low)).alias("a"), (out + (1 + slack) * (high - out)).alias("b")),
                 "quantiles")

    def back(a: F.Column, b: F.Column, weight: int) -> list[F.Column]:
        n = F.coalesce("n", F.lit(0))
        mean = [(F.coalesce(n * F.col(own), F.lit(0.0)) + weight * up) / (n + weight) for own, up in (("a", a), ("b", b))]
        return [mean[0].alias("low"), mean[1].alias("high")]
    corpus = held.where("level = 3").crossJoin(F.broadcast(guess)).select(*back(F.lit(0.0), F.col("guess"), PRIOR)).toDF("up_low", "up_high")
    langs = held.where("level = 1 and lang is not null").crossJoin(corpus).select("lang", *back(F.col("up_low"), F.col("up_high"), BACK))
    upper = langs.toDF("lang", "up_low", "up_high").unionByName(corpus.withColumn("lang", F.lit(None).cast("string")))
    upper = upper.withColumn("band", F.explode(F.array(*[F.lit(i) for i in range(len(BANDS) + 1)]))).alias("u")
    fine = held.where("level = 0 and lang is not null or level = 2").alias("f")
    both = upper.join(fine, F.col("u.lang").eqNullSafe(F.col("f.lang")) & (F.col("u.band") == F.col("f.band")), "left")
    return both.select("u.lang", "u.band", *back(F.col("up_low"), F.col("up_high"), BACK))


def classify(docs: DataFrame, trusted_ids: DataFrame, carry: list[str] | None = None, quantile: float = 0.98,
             slack: float = 1.0, accuracy: int = 2_000) -> DataFrame:
    """Score ``docs`` (doc_id, lang, text) by a model of the documents in ``trusted_ids`` (doc_id).

    A text is kept while its perplexity lies within the trusted texts' quantiles ``1 - quantile`` and
    ``quantile`` of its language and length band, widened by ``slack`` times their distance from the median;
    ``bounds`` backs off where few texts are trusted.
    Returns ``carry`` (doc_id and lang unless given), n_symbols, perplexity, low, high and keep.
    """
    carry = carry or ["doc_id", "lang"]
    trusted_ids = stage(trusted_ids.select("doc_id").where("doc_id is not null").distinct(), "trusted_ids")
    docs = docs.select(*dict.fromkeys([*carry, "doc_id", "lang", "text"]))
    model = fit(checked_join(docs, trusted_ids, "doc_id", "left_semi"), POINTS)
    guess = model.where(f"gram = '' and lang = '{ALL}'").select((1 / F.col("q")).alias("guess"))
    scored = stage(perplexity(docs, model, list(dict.fromkeys([*carry, "doc_id", "lang"])), POINTS).withColumn("band", band()), "perplexity")
    known = checked_join(scored, trusted_ids, "doc_id", "left_semi").where("perplexity is not null")
    each = stage(bounds(known, guess, quantile, slack, accuracy), "bounds")
    own = small(each.where("lang is not null"))
    pooled = small(each.where("lang is null").select("band", F.col("low").alias("low_all"), F.col("high").alias("high_all")))
    out = scored.join(own, ["lang", "band"], "left").join(pooled, "band", "left")
    out = out.withColumns({"low": F.coalesce("low", "low_all"), "high": F.coalesce("high", "high_all")})
    keep = (F.col("n_symbols") > 0) & (F.col("perplexity").isNull() | F.col("perplexity").between(F.col("low"), F.col("high")))
    return out.select(*carry, "n_symbols", "perplexity", "low", "high", keep.alias("keep"))


def keep_good(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    keyed = docs.withColumn(KEY, content_key("doc_id", "text", "lang"))
    gone = stage(classify(keyed, trusted_ids, [KEY]).where("not keep").select(KEY).distinct(), "rejected")
    return checked_join(keyed, gone, KEY, "left_anti").drop(KEY)
