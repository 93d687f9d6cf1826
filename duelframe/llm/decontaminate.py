"""Benchmark decontamination by winnowing.

K-grams of words are hashed; of each run of WINDOW consecutive k-grams the least hash is kept (all places that
hold it, so the choice depends on content alone). Any span of SPAN = K + WINDOW - 1 words that a document shares
with an item holds a kept k-gram at the same place in both, so a join on kept hashes finds every shared span.
Each kept hash carries the words around it, and a hit is extended by comparing those words, never hashes alone.
Items of fewer than SPAN words are looked for whole, as n-grams of their own length.

Before the shuffle a document's hashes pass a Bloom filter of the items' hashes, whose size is fixed; false
positives fall in the join, and a full filter only lets more rows through.

Defined results: null or empty text has no words, no hits and is clean; an item without words is in no document.
Repeated rows each get a row; repeated item rows count as one item, a null item_id counts as none. An empty benchmark leaves all clean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from duelframe.session import stage

from .common import KEY, checked_join, column, content_key, slices, utf8

SPAN, K, WINDOW = 10, 6, 5
BLOOM_BITS = 26
PAGE = 1 << 14
# Word characters: digits, letters and every byte of a non-ASCII character; capitals A to Z become small.
SPACES = bytes(32 if not (48 <= i <= 57 or 97 <= i <= 122 or i >= 128 or 65 <= i <= 90) else i for i in range(256)).lower()
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of the splitmix generator."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of several texts at once: their bytes, bounds, text numbers and 64-bit hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(at) - 1
        spread = np.full(len(data) + n, 32, np.uint8)  # a space after every text
        own = np.repeat(np.arange(n), np.diff(at))
        if len(data):
            spread[np.arange(len(data)) + own] = np.frombuffer(SPACES, np.uint8)[data]
        at = at + np.arange(n + 1)
        inside = spread != 32
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(n + 1))
        self.data = spread
        self.hash = self._hash(spread)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        """Polynomial hash of each word from prefix sums modulo 2 ** 64; the odd base can be divided out."""
        base = np.full(len(data) + 1, 0x9E3779B97F4A7C15 | 1, np.uint64)
        base[0] = 1
        power = np.cumprod(base)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        base[1:] = pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
        back = np.cumprod(base)
        raw = (sums[self.end] - sums[self.start]) * back[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k-gram that begins at each word; NEVER where the text ends before."""
        n = len(self.hash)
        out = np.full(n, NEVER)
        if n >= k:
            g = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                g = g * np.uint64(0xD6E8FEB86659FD93) + self.hash[j:n - k + 1 + j]
            g = mix(g + np.uint64(k)) >> np.uint64(1)
            out[:n - k + 1] = np.where(self.text[:n - k + 1] == self.text[k - 1:], g, NEVER)
        return out

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the winnowed k-grams."""
        g = self.grams(K)
        n = len(g) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = g[:n].copy()
        whole = g[:n] != NEVER
        for j in range(1, WINDOW):
            least = np.minimum(least, g[j:n + j])
            whole &= g[j:n + j] != NEVER
        least[~whole] = 0  # a window that crosses into the next text chooses nothing
        most = np.zeros(len(g), np.uint64)
        for j in range(WINDOW):
            most[j:n + j] = np.maximum(most[j:n + j], least)
        at = np.flatnonzero((most == g) & (g != NEVER))
        return at, g[at]

    def words(self, a: int, b: int, text: int, pad: str) -> list[str]:
        """Words a to b, ``pad`` where the text has none."""
        lo, hi = self.first[text], self.first[text + 1]
        return [bytes(self.data[self.start[i]:self.end[i]]).decode() if lo <= i < hi else pad for i in range(a, b)]


def _signatures(lengths: tuple[int, ...], bloom, pad: str, carry: list[str]):
    """Per row: the number of words and the hits (hash, place, words around), those that pass the filter."""
    hit = pa.struct([("hash", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("around", pa.list_(pa.string()))])

    def run(batches):
        bits = np.frombuffer(bloom.value, np.uint8) if bloom else None
        for batch in slices(batches, "text"):
            w = Words(*utf8(column(batch, "text")))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            sizes = np.diff(w.first)
            for n in (SPAN, *lengths):
                if n == SPAN:
                    at, h = w.kept()
                else:
                    h = w.grams(n)
                    at = np.flatnonzero(h != NEVER)
                    if bits is None:  # of the items, only those of this length
                        at = at[sizes[w.text[at]] == n]
                    h = h[at]
                if bits is not None:
                    pass_ = in_bloom(bits, h)
                    at, h = at[pass_], h[pass_]
                before, size = (SPAN - K, 2 * SPAN - K) if n == SPAN else (0, n)
                for i, v in zip(at.tolist(), h.view(np.int64).tolist()):
                    t = int(w.text[i])
                    found[t].append({"hash": v, "n": n, "at": i - int(w.first[t]), "around": w.words(i - before, i - before + size, t, pad)})
            yield pa.record_batch([*[column(batch, c) for c in carry], pa.array(sizes.astype(np.int64)), pa.array(found, pa.list_(hit))],
                                  names=[*carry, "n_words", "hits"])
    return run


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for i in range(2):
        p = (h >> np.uint64(1 + i * BLOOM_BITS)) & np.uint64((1 << BLOOM_BITS) - 1)
        out &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return out


def bloom_of(hashes: DataFrame) -> bytes:
    """A filter of 2 ** BLOOM_BITS bits, 8 MB, whatever the number of hashes; tasks make pages of it, which are merged by page."""
    def part(batches):
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            h = column(batch, "hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(2):
                bits[(h >> np.uint64(1 + i * BLOOM_BITS)) & np.uint64((1 << BLOOM_BITS) - 1)] = True
        pages = np.packbits(bits, bitorder="little").reshape(-1, PAGE)
        used = np.flatnonzero(pages.any(axis=1))
        yield pa.record_batch({"page": pa.array(used, pa.int64()), "bits": pa.array([pages[p].tobytes() for p in used], pa.binary())})

    def merge(pages: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pages.bits])
        return pd.DataFrame({"page": pages.page[:1], "bits": [both.tobytes()]})
    merged = hashes.mapInArrow(part, "page long, bits binary").groupBy("page").applyInPandas(merge, "page long, bits binary")
    out = np.zeros((1 << (BLOOM_BITS - 3)) // PAGE * PAGE, np.uint8).reshape(-1, PAGE)
    for r in merged.collect():  # at most 8 MB
        out[r.page] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


HIT = "array<struct<hash:bigint,n:int,at:int,around:array<string>>>"


def item_grams(benchmark: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """Kept hashes of the items with the words around them, one row for each item and content; and the lengths of short items."""
    items = benchmark.select(F.col("item_id"), "text").where("item_id is not null")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    run = _signatures(tuple(range(1, SPAN)), None, "\x02", ["item_id"])
    signed = stage(items.mapInArrow(run, f"item_id {kind}, n_words long, hits {HIT}"), "items")
    grams = stage(signed.select("item_id", F.explode("hits").alias("h")).select(
        "item_id", "h.hash", "h.n", F.col("h.around").alias("item_words")).distinct(), "item_grams")
    lengths = tuple(sorted(r.n for r in grams.where(F.col("n") < SPAN).select("n").distinct().toLocalIterator()))
    return grams, lengths


def shared_spans(docs: DataFrame, benchmark: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (``carry``, content key, n_words), and the shared spans (key, item_id, at, n) of their content."""
    grams, lengths = item_grams(benchmark)
    spark = docs.sparkSession
    bloom = spark.sparkContext.broadcast(bloom_of(grams.select("hash")))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    keyed = docs.select(*carry, content_key("doc_id", "text").alias(KEY), "text")
    run = _signatures(lengths, bloom, "\x01", [*carry, KEY])
    signed = stage(keyed.mapInArrow(run, f"{kinds}, {KEY} string, n_words long, hits {HIT}"), "signed")
    hits = signed.where(F.size("hits") > 0).select(KEY, F.explode("hits").alias("h")).select(
        KEY, "h.hash", "h.n", "h.at", F.col("h.around").alias("doc_words"))
    met = hits.join(grams, ["hash", "n"])
    # Extension: every span of n words around the k-gram that agrees word for word; padding of the two sides differs.
    n = F.col("n")
    steps = F.sequence(F.lit(0), F.size("doc_words") - n)
    same = F.filter(steps, lambda i: F.slice("doc_words", i + 1, n) == F.slice("item_words", i + 1, n))
    before = F.when(n == SPAN, SPAN - K).otherwise(0)
    spans = met.select(KEY, "item_id", "n", (F.col("at") - before).alias("left"), F.explode(same).alias("i"))
    return signed.drop("hits"), stage(spans.select(KEY, "item_id", (F.col("left") + F.col("i")).alias("at"), "n").distinct(), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (doc_id), n_words, n_hit, n_items, item_ids (strings in order) and contaminated for every row of ``docs``."""
    carry = carry or ["doc_id"]
    base, spans = shared_spans(docs, benchmark, carry)
    end = F.col("at") + F.col("n")
    before = Window.partitionBy(KEY).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    places = spans.select(KEY, "at", "n").distinct()
    fresh = F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(F.max(end).over(before), F.lit(0))))
    words = places.withColumn("fresh", fresh).groupBy(KEY).agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = spans.select(KEY, F.col("item_id").cast("string").alias("item")).distinct().groupBy(KEY).agg(
        F.sort_array(F.collect_list("item")).alias("item_ids"))
    out = base.join(words, KEY, "left").join(items, KEY, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(*carry, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
                      (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that share a span with an item."""
    _, spans = shared_spans(docs, benchmark, ["doc_id"])
    gone = stage(spans.select(KEY).distinct(), "contaminated")
    return checked_join(docs.withColumn(KEY, content_key("doc_id", "text")), gone, KEY, "left_anti").drop(KEY)
