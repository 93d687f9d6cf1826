"""Toxicity by multiple-instance learning: documents are bags of sentences, joined by noisy-or.

A sentence with features has probability sigmoid(bias + sum of their weights), one without has 0; a document is toxic
unless every sentence is clean, so its score is 1 - (1 - leak) * prod(1 - p), where leak stands for what no feature
explains. Weights are learned from document labels alone and then locate
the offending sentences. Features are words and five-letter beginnings of longer words that differ significantly
between toxic and other documents.

Weights are fitted on at most about FIT_ROWS labelled documents, chosen by hash of doc_id; all documents are scored.

Defined results: a null or empty text has no sentence with features and its score is the leak. A document
whose labels disagree counts as toxic. Null labels are left out. Without a toxic or a clean label every score is 0. Repeated
rows each get a row; a null doc_id counts as the empty text in the split.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.session import stage

from .common import column, slices

FIT_ROWS = 20_000
FEATURES = 2_048
CHI2 = 15.0
PREFIX = 5
SENTENCE = re.compile(r"[^.!?\n]+")
# Everything that is no letter separates words; bytes of non-ASCII characters count as letters.
GAPS = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words(text: str) -> set[str]:
    return {w.decode() for w in set(text.lower().encode().translate(GAPS).split())}


def features(text: str) -> set[str]:
    found = words(text)
    return found | {w[:PREFIX] + "*" for w in found if len(w) > PREFIX}


def _presence(batches):
    """Numbers of toxic and clean documents with each feature, summed within the task."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out():
        names = list({**seen[0], **seen[1]})
        yield pa.record_batch({"feature": pa.array(names, pa.string()), "toxic": pa.array([seen[1][n] for n in names], pa.int64()),
                               "clean": pa.array([seen[0][n] for n in names], pa.int64())})
        for c in seen.values():
            c.clear()
    for batch in slices(batches, "text"):
        for text, y in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist()):
            seen[y].update(features(text or ""))
        if sum(map(len, seen.values())) > 500_000:
            yield from out()
    yield from out()


def vocabulary(sample: DataFrame) -> dict[str, int]:
    """The FEATURES features with the largest chi-square above CHI2, numbered."""
    totals = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    pos, neg = totals[0] or 0, totals[1] or 0
    if not pos or not neg:
        return {}
    counts = sample.select("text", "toxic").mapInArrow(_presence, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n, with_ = pos + neg, a + b
    chi2 = n * F.pow(a * (neg - b) - b * (pos - a), 2) / (with_ * (n - with_) * pos * neg)
    best = counts.where((with_ < n) & (a >= 5)).withColumn("chi2", chi2).where(F.col("chi2") >= CHI2)
    rows = best.orderBy(F.desc("chi2"), "feature").limit(FEATURES).select("feature").collect()
    return {r.feature: i for i, r in enumerate(rows)}


def sentences(text: str, vocab: dict[str, int]) -> list[tuple[int, int, list[int]]]:
    """Start, end and feature numbers of the sentences that have features."""
    known = features(text) & vocab.keys()
    out = []
    for m in SENTENCE.finditer(text) if known else ():
        own = features(m.group()) & known
        if own:
            out.append((m.start(), m.end(), sorted(vocab[f] for f in own)))
    return out


def _bags(vocab):
    def run(batches):
        for batch in slices(batches, "text"):
            found = [[f for _, _, f in sentences(text or "", vocab.value)] for text in column(batch, "text").to_pylist()]
            yield pa.record_batch([column(batch, "toxic"), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["toxic", "found"])
    return run


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def train(bags: list[tuple[int, list[list[int]]]], size: int, rounds: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Weights, then the bias and the leak (as a logit), by Adam on the documents' log-likelihood."""
    y = np.array([b[0] for b in bags], float)
    doc = np.array([d for d, b in enumerate(bags) for _ in b[1]], np.int64)
    every = [f for b in bags for f in b[1]]
    row = np.repeat(np.arange(len(every)), [len(f) for f in every])
    col = np.array([i for f in every for i in f], np.int64)
    w = np.zeros(size + 2)
    w[-2:] = -3.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = w[-2] + np.bincount(row, w[col], minlength=len(every))
        s = np.maximum(np.bincount(doc, softplus(z), minlength=len(bags)) + softplus(w[-1]), 1e-12)
        d = np.where(y == 1, -np.exp(-s) / -np.expm1(-s), 1.0) / len(bags)  # loss by the document's sum of softplus
        dz = d[doc] / (1 + np.exp(-z))
        g = np.concatenate([np.bincount(col, dz[row], minlength=size) + l2 * w[:-2], [dz.sum(), d.sum() / (1 + np.exp(-w[-1]))]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def _scores(shared, carry: list[str]):
    def run(batches):
        vocab, w = shared.value
        for batch in slices(batches, "text"):
            scores, where = [], []
            for text in column(batch, "text").to_pylist():
                hits = sentences(text or "", vocab) if w is not None else []
                z = [w[-2] + float(w[f].sum()) for _, _, f in hits]
                clean = sum(softplus(x) for x in z) + softplus(w[-1]) if w is not None else 0.0
                scores.append(float(-np.expm1(-clean)))
                where.append(",".join(f"{a}:{b}" for (a, b, _), x in zip(hits, z) if x >= 0))
            yield pa.record_batch([*[column(batch, c) for c in carry], pa.array(scores), pa.array(where, pa.string())],
                                  names=[*carry, "score", "offending"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of about ``rows`` labelled documents at most that are not held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = min(1.0, rows / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * (1 << 40))
    # About ``rows`` rows: the broadcast does not grow with the tables.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (doc_id), score and ``offending`` (start:end of sentences with p of one half and more) for every row."""
    carry = carry or ["doc_id"]
    context = docs.sparkSession.sparkContext
    sample = stage(labelled_sample(docs, labels), "toxic_sample")
    vocab = vocabulary(sample)
    weights = None
    if vocab:
        bags = sample.mapInArrow(_bags(context.broadcast(vocab)), "toxic int, found array<array<int>>").collect()
        weights = train([(b.toxic, b.found) for b in bags], len(vocab))
    shared = context.broadcast((vocab, weights))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(_scores(shared, carry), f"{kinds}, score double, offending string")
