"""Phrase collocations by the stripes pattern.

A stripe is a prefix of one to three words with an associative counter of the words that follow it. Tasks build the
stripes of a batch of texts; stripes of one prefix are merged elementwise. The stripe of a single word also has one element without
a next word: the prefix total, which counts places where the piece ends or the next word is rare as well; the total of a longer
prefix is the element of its last word in the stripe of the words before, from which it is read after the merge. The merged
structure gives everything a score needs: elements are the frequencies of extended phrases, totals those of prefixes,
and the largest element of a stripe is the right-hand subsumption maximum (elements seen from their last words give
the left-hand one). Containment in a phrase two words longer needs no look of its own: the phrase between is at least as frequent.

A phrase of frequency LEAST has parts of at least that frequency, so four passes build what can matter: words; pairs of
frequent words; triples of frequent pairs; then all stripes, whose elements end a frequent pair or triple. Pairs and triples are counted
as numbers of hashes packed by their leading bits, three bytes each beside those. What is frequent is told to tasks by Bloom filters of
fixed size (8 MB); what they or equal numbers let through in error is counted exactly and falls with its count. Elements are
merged by Spark's aggregation by (prefix, next word), with map-side combining, so the stripe of a very common
word is spread over all tasks and never held whole.

Defined results: null or empty text has no words; null lang counts as ``und``. Repeated rows all count. Ties in a score
go to the larger frequency, then to the smaller phrase in byte order. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.session import stage

from .common import checked_join, column, rows_of, slices
from .decontaminate import bloom_of, in_bloom, mix

LEAST, LONGEST, SCALE, SUBSUMED, TOP = 30, 4, 2_000_000, 80, 2000
#: Bytes of text whose stripes are built together, and numbers that a task counts together.
BATCH, TOGETHER = 2 << 20, 1 << 21
#: Pairs or triples that one part of their counts is meant for, and bits of a number beside those of its part.
IN_PART, REST = 1 << 17, 24
LOW = 0xFFFFFFFF
#: Parts of a language in which the leading phrases are found before the language's own are.
PARTS = 64
# End of a piece: stands where no text has a byte.
BREAK = b"\xff"
PIECES = bytes(0xFF if i in b".,;:!?\x0A\x0B\x0C\x0D" else i for i in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words in small letters (A to Z only), with BREAK between pieces and at the end."""
    return (text.lower().translate(PIECES).replace(BREAK, b" \xff ") + b" \xff").split()


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\n" + word, 13)


def code_of(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """A number of REST + ``bits`` bits for each phrase, from the hashes of its first words, second words and so on."""
    h = hashes[0]
    for following in hashes[1:]:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + following)
    return h >> np.uint64(64 - REST - bits)


def three_bytes(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def from_three_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def by_language(batches):
    """(lang, tokens) of the texts of each batch that share a language."""
    for batch in slices(batches, "text", BATCH):
        told: dict[str, list[bytes]] = {}
        for lang, text in zip(column(batch, "lang").to_pylist(), rows_of(batch, "text")):
            told.setdefault("und" if lang is None else lang, []).extend(tokens(text))
        yield from told.items()


def _words(batches):
    """(lang, word, count) of each batch."""
    for lang, words in by_language(batches):
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        counts = np.bincount(ids, minlength=len(numbers))
        counts[numbers[BREAK]] = 0
        at = np.flatnonzero(counts)
        names = list(numbers)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()),
                               "word": pa.array([names[i] for i in at.tolist()], pa.binary()).cast(pa.string()), "f": pa.array(counts[at])})


class Vocabulary:
    """Numbers of the words of a language that the filter of frequent words knows."""

    def __init__(self, lang: str, bits: np.ndarray):
        self.lang, self.bits = lang, bits
        self.number: dict[bytes, int] = {}
        self.names, self.hashes = [""], [0]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word; 0 for breaks and unknown words."""
        told = dict.fromkeys(words, 0)
        told.pop(BREAK, None)
        hashes = np.fromiter((word_hash(self.lang, w) for w in told), np.uint64, len(told))
        for word, known, h in zip(told, in_bloom(self.bits, hashes).tolist(), hashes.tolist()):
            if known:
                told[word] = self.number.setdefault(word, len(self.names))
                if told[word] == len(self.names):
                    self.names.append(word.decode())
                    self.hashes.append(h)
        told[BREAK] = 0
        return np.fromiter(map(told.__getitem__, words), np.int64, len(words))


def numbered(batches, bits: np.ndarray):
    """(vocabulary, word numbers) of the texts of each batch that share a language."""
    known: dict[str, Vocabulary] = {}
    for lang, told in by_language(batches):
        vocabulary = known.setdefault(lang, Vocabulary(lang, bits))
        yield vocabulary, vocabulary.numbers(told)


class Phrases:
    """Occurrences of phrases of one length in a batch: places of their first words, numbers of the distinct phrases; word numbers of
    those (an array for each place in the phrase) and codes."""

    def __init__(self, vocabulary: Vocabulary, at: np.ndarray, key: np.ndarray, words, bits: int):
        """``key`` tells the phrases at places ``at`` apart, ``words`` gives the word numbers of distinct keys."""
        self.at = at
        distinct, self.number = np.unique(key, return_inverse=True)
        self.words = words(distinct)
        hashes = np.array(vocabulary.hashes, np.uint64)
        self.codes = code_of([hashes[w] for w in self.words], bits)

    def frequent(self, bloom: np.ndarray, n: int) -> np.ndarray:
        """For each of n places, 1 + number of the phrase that begins there if the filter knows it, else 0."""
        known = in_bloom(bloom, mix(self.codes))
        out = np.zeros(n, np.int64)
        out[self.at] = np.where(known[self.number], self.number + 1, 0)
        return out


def pairs_of(vocabulary: Vocabulary, ids: np.ndarray, bits: int) -> Phrases:
    """Pairs of known words."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return Phrases(vocabulary, at, ids[at] << 32 | ids[at + 1], lambda key: [key >> 32, key & LOW], bits)


def triples_of(vocabulary: Vocabulary, ids: np.ndarray, pairs: Phrases, pair: np.ndarray, bits: int) -> Phrases:
    """Triples of two frequent pairs; ``pair`` is what ``frequent`` gave for ``pairs``."""
    at = np.flatnonzero((pair[:-1] > 0) & (pair[1:] > 0))
    return Phrases(vocabulary, at, (pair[at] - 1) << 32 | ids[at + 2], lambda key: [*(w[key >> 32] for w in pairs.words), key & LOW], bits)


def packed(codes):
    """By the leading bits of codes (``part``): the other bits of codes seen once, and of others with counts."""
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        code, f = np.unique(np.concatenate(held), return_counts=True)
        part = (code >> np.uint64(REST)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(code)]
        rest, f = (code & np.uint64((1 << REST) - 1)).astype(np.uint32), f.astype(np.uint32)
        once, more = [], []
        for a, b in zip(cuts, cuts[1:]):
            single = f[a:b] == 1
            once.append(three_bytes(rest[a:b][single]))
            more.append(np.stack([rest[a:b][~single], f[a:b][~single]]).tobytes())
        return pa.record_batch({"part": pa.array(part[cuts[:-1]]), "once": pa.array(once, pa.binary()), "more": pa.array(more, pa.binary())})

    held: list[np.ndarray] = []
    for some in codes:
        held.append(some)
        if sum(map(len, held)) > TOGETHER:
            yield counted(held)
            held = []
    if any(map(len, held)):
        yield counted(held)


def _pairs(words_bloom, bits: int):
    def codes(batches):
        for vocabulary, ids in numbered(batches, np.frombuffer(words_bloom.value, np.uint8)):
            pairs = pairs_of(vocabulary, ids, bits)
            yield pairs.codes[pairs.number]
    return lambda batches: packed(codes(batches))


def _triples(words_bloom, pairs_bloom, bits: int):
    def codes(batches):
        known = np.frombuffer(pairs_bloom.value, np.uint8)
        for vocabulary, ids in numbered(batches, np.frombuffer(words_bloom.value, np.uint8)):
            pairs = pairs_of(vocabulary, ids, bits)
            triples = triples_of(vocabulary, ids, pairs, pairs.frequent(known, len(ids)), bits)
            yield triples.codes[triples.number]
    return lambda batches: packed(codes(batches))


def _frequent(least: int):
    """``hash`` of the codes of one part that reach ``least`` in sum."""
    def run(table: pa.Table) -> pa.Table:
        once = from_three_bytes(b"".join(table["once"].to_pylist()))
        more = [np.frombuffer(m, np.uint32).reshape(2, -1) for m in table["more"].to_pylist()]
        code, place = np.unique(np.concatenate([once, *[m[0] for m in more]]), return_inverse=True)
        f = np.bincount(place, np.concatenate([np.ones(len(once)), *[m[1] for m in more]]), minlength=len(code))
        kept = code[f >= least].astype(np.uint64) | np.uint64(table["part"][0].as_py() << REST)
        return pa.table({"hash": mix(kept).view(np.int64)})
    return run


def stripes_of(lang: str, prefix: np.ndarray, nexts: np.ndarray, names: list[np.ndarray], words: pa.Array) -> pa.RecordBatch:
    """One row per prefix: the total of a single word and, for each next word but 0, a count. ``names`` has the word numbers of prefixes."""
    single = len(names) == 1
    keys, counts = np.unique(prefix.astype(np.int64) << 32 | nexts, return_counts=True)
    own, follow = keys >> 32, keys & LOW
    first = np.flatnonzero(np.diff(own, prepend=-1))
    totals = np.add.reduceat(counts, first) if len(first) else counts
    kept = follow > 0
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(kept.astype(np.int64), first))]) if len(first) else np.zeros(1, np.int64)
    element = pa.StructArray.from_arrays([words.take(pa.array(follow[kept])), pa.array(counts[kept])], names=["next", "f"])
    text = [words.take(pa.array(part[own[first]])) for part in names]
    joined = text[0] if len(text) == 1 else pc.binary_join_element_wise(*text, " ")
    return pa.record_batch({"lang": pa.array([lang] * len(first), pa.string()), "prefix": joined, "total": pa.array(totals) if single else pa.nulls(len(first), pa.int64()),
                            "stripe": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), element)})


def _stripes(words_bloom, pairs_bloom, triples_bloom, bits: int):
    """Stripes of prefixes of one, two and three words."""
    def run(batches):
        known = [np.frombuffer(b.value, np.uint8) for b in (words_bloom, pairs_bloom, triples_bloom)]
        for vocabulary, ids in numbered(batches, known[0]):
            lang, words, n = vocabulary.lang, pa.array(vocabulary.names, pa.string()), len(ids)
            pairs = pairs_of(vocabulary, ids, bits)
            pair = pairs.frequent(known[1], n)
            triples = triples_of(vocabulary, ids, pairs, pair, bits)
            triple = triples.frequent(known[2], n)
            at = np.flatnonzero(ids)  # the last is a break, so a word has a next
            yield stripes_of(lang, ids[at], np.where(pair[at] > 0, ids[at + 1], 0), [np.arange(len(words))], words)
            at = np.flatnonzero(triple)
            yield stripes_of(lang, pair[at] - 1, ids[at + 2], pairs.words, words)
            at = np.flatnonzero((triple[:-1] > 0) & (triple[1:] > 0))
            yield stripes_of(lang, triple[at] - 1, ids[at + 3], triples.words, words)
    return run


STRIPE = "lang string, prefix string, total long, stripe array<struct<next:string,f:bigint>>"


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """Elementwise sums (lang, prefix, next, f) of stripes, elements of at least ``least``; ``next`` is null in the prefix total."""
    one = F.array(F.struct(F.lit(None).cast("string").alias("next"), F.col("total").alias("f")))
    total = F.when(F.col("total").isNotNull(), one).otherwise(F.array().cast(stripes.schema["stripe"].dataType))
    rows = stripes.select("lang", "prefix", F.inline(F.concat(total, "stripe")))
    summed = rows.groupBy("lang", "prefix", "next").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    own = F.struct("prefix", "next", "f")
    longer = F.struct(phrase_of(F.col("prefix"), F.col("next")).alias("prefix"), F.lit(None).cast("string").alias("next"), "f")
    short = F.col("next").isNotNull() & (F.size(F.split("prefix", " ")) < LONGEST - 1)  # a phrase that is a prefix itself
    return summed.select("lang", F.inline(F.when(short, F.array(own, longer)).otherwise(F.array(own))))


def _hashed(batches):
    """``hash`` of each row's word."""
    for batch in batches:
        hashes = [word_hash(g, w) for g, w in zip(column(batch, "lang").to_pylist(), rows_of(batch, "word"))]
        yield pa.record_batch({"hash": pa.array(np.array(hashes, np.uint64).view(np.int64))})


def count_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Words per language (lang, n); and merged stripes (lang, prefix, next, f) of frequency ``least`` and more."""
    texts, told = docs.select("lang", "text"), docs.sparkSession.sparkContext.broadcast
    counted = texts.mapInArrow(_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    # Frequent words as they are, the rest summed by language under a null word.
    frequent = F.when(F.col("f") >= least, F.col("word"))
    words = stage(counted.groupBy("lang", frequent.alias("word")).agg(F.sum("f").alias("f")), "words")
    known = told(bloom_of(words.where("word is not null").mapInArrow(_hashed, "hash long")))
    total = words.agg(F.sum("f")).head()[0] or 0
    bits = min(32, max(8, (total // IN_PART).bit_length()))  # parts of about IN_PART at any size

    def frequent(codes) -> Broadcast:
        parts = texts.mapInArrow(codes, "part long, once binary, more binary").groupBy("part")
        return told(bloom_of(parts.applyInArrow(_frequent(least), "hash long")))

    pairs = frequent(_pairs(known, bits))
    triples = frequent(_triples(known, pairs, bits))
    elements = stage(merged(texts.mapInArrow(_stripes(known, pairs, triples, bits), STRIPE), least), "stripes")
    return words.groupBy("lang").agg(F.sum("f").alias("n")), elements


def phrase_of(prefix: Column, following: Column) -> Column:
    return F.concat_ws(" ", prefix, following)


def score_cuts(elements: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, score) with their lowest-scoring cut, from merged stripes."""
    phrases = elements.where("next is not null").select("lang", phrase_of(F.col("prefix"), F.col("next")).alias("phrase"), "f")
    totals = elements.where("next is null and instr(prefix, ' ') = 0").select("lang", F.col("prefix").alias("phrase"), "f")
    counts = stage(phrases.unionByName(totals), "phrases")  # every frequent phrase of one to four words
    words = F.split("phrase", " ")
    cut = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("left"),
        F.array_join(F.slice("words", k + 1, F.size("words") - k), " ").alias("right")))
    cuts = (counts.withColumn("words", words).where(F.size("words") > 1)
            .select("lang", "phrase", F.col("f").alias("a"), F.explode(cut).alias("cut")).select("lang", "phrase", "a", "cut.*"))
    first = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = checked_join(checked_join(cuts, first, ["lang", "left"], "inner"), rest, ["lang", "right"], "inner")
    exact = "cast(a as decimal(19,0)) * cast({} as decimal(8,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"
    scored = both.withColumn("score", F.expr(exact.format(SCALE)))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("lowest")
    return scored.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")


def subsumed(elements: DataFrame) -> DataFrame:
    """The greatest frequency ``most`` of a candidate one word longer, at either end, by (lang, phrase)."""
    longer = elements.where("next is not null")
    whole = phrase_of(F.col("prefix"), F.col("next"))
    inside = F.array(F.col("prefix"), F.regexp_replace(whole, "^[^ ]+ ", ""))
    return (longer.where("instr(prefix, ' ') > 0").select("lang", F.explode(inside).alias("phrase"), "f")
            .groupBy("lang", "phrase").agg(F.max("f").alias("most")))


def leading(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank, found in parts of a language first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = (rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
            .where(F.col("rank") <= top).drop("part"))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the leading phrases of each language of ``docs`` (text, lang).

    ``a`` is the phrase's frequency, ``l`` and ``r`` those of the two parts at its weakest cut, ``n`` the language's words.
    A phrase goes if a longer one that holds it has SUBSUMED % of its frequency.
    """
    sizes, elements = count_phrases(docs, least)
    scored = score_cuts(elements)
    within = stage(subsumed(elements), "subsumed")
    judged = checked_join(scored, within, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    alone = judged.where(F.col("most").isNull() | (100 * wide("most") < SUBSUMED * wide("a"))).drop("most")
    return checked_join(leading(alone, top), stage(sizes, "sizes"), "lang", "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
