"""SimHash near-duplicates: bit-sliced comparison of 64-bit fingerprints within small Hamming radius.

Copies share a fingerprint, so the search runs over distinct fingerprints. For radius 2 a fingerprint is cut
into four 16-bit blocks: two fingerprints that link differ in at most two blocks and so agree in one of the six
pairs of blocks, which are the bucket keys (exact, no bucket is capped). A bucket of more than CHUNK
fingerprints is dealt into chunks and each pair of chunks is compared in a task of its own. Within a
comparison, bit planes are stored vertically, 64 fingerprints to a word; carry-save counters add the differing
planes for all lanes at once, and (query, word) blocks in which every lane exceeds the radius are abandoned.
A bucket emits a spanning forest of its links, never all pairs; components come from a distributed contraction.

Defined results: null or empty text and text of white space have fingerprint zero and link like any other.
Repeated rows each get a row. A null doc_id is no candidate for ``component_id``; a component of nulls has null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from duelframe.session import stage

from .common import KEY, checked_join, column, content_key, rows_of, slices, small

RADIUS, SHINGLE, SEED = 2, 3, 42
BLOCK_BITS = 16
CHUNK = 4096
KEYS = tuple(combinations(range(4), 2))


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - [len(w) + 1 for w in words])[:len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())], np.uint64)


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, max(1, len(h) // 65_536)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in slices(batches, "text"):
        prints = np.array([fingerprint(t) for t in rows_of(batch, "text")], np.uint64).view(np.int64)
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*[column(batch, c) for c in keep], pa.array(prints)], names=[*keep, "fp"])


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and the fingerprint, as a signed 64-bit ``fp``, of every row."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(_fingerprints, f"{kinds}, fp long")


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: 64 rows of words, bit j of word w belonging to fingerprint 64 w + j."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -len(prints) % 64))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def linked(queries: np.ndarray, prints: np.ndarray, radius: int = RADIUS, step: int = 8) -> np.ndarray:
    """For each query a bit set of the lanes within the radius (at most 3).

    ``ones`` and ``twos`` are the low bits of each lane's count, ``over`` marks counts past the radius.
    """
    sliced = planes(prints)
    words = sliced.shape[1]
    q, w = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(words), indexing="ij"))
    ones, twos, over = (np.zeros(len(q), np.uint64) for _ in range(3))
    valid = np.full(words, ~np.uint64(0))
    if len(prints) % 64:
        valid[-1] = np.uint64((1 << len(prints) % 64) - 1)
    over |= ~valid[w]
    for start in range(0, 64, step):
        for p in range(start, start + step):
            flip = np.uint64(0) - ((queries >> np.uint64(p)) & np.uint64(1))
            differ = sliced[p][w] ^ flip[q]
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if radius < 3:
                over |= (ones & twos) if radius == 2 else twos if radius == 1 else ones | twos
        alive = over != ~np.uint64(0)
        if not alive.all():
            q, w, ones, twos, over = (x[alive] for x in (q, w, ones, twos, over))
        if not len(q):
            break
    out = np.zeros((len(queries), words), np.uint64)
    out[q, w] = ~over
    return out


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (root, member) that connect what is linked within one bucket, one for each member but the root."""
    n = len(prints)
    if n == 2:
        return [(0, 1)] if int(prints[0] ^ prints[1]).bit_count() <= RADIUS else []
    lanes = np.concatenate([linked(prints[i:i + 512], prints) for i in range(0, n, 512)])
    todo, out = np.ones(n, bool), []
    for root in range(n):
        if not todo[root]:
            continue
        todo[root], front = False, np.array([root])
        while len(front):
            reach = np.bitwise_or.reduce(lanes[front], axis=0)
            near = np.unpackbits(reach.view(np.uint8), bitorder="little")[:n].astype(bool) & todo
            front = np.flatnonzero(near)
            todo[front] = False
            out += [(root, int(x)) for x in front]
    return out


def _links(batches):
    """Links within each run of rows with one key and pair of chunks; a run that batches cut is put together again."""
    held = None

    def out(groups: np.ndarray, prints: np.ndarray):
        cuts = np.flatnonzero(np.diff(groups).any(axis=0)) + 1
        a, b = [], []
        for part in np.split(prints, cuts):
            if len(part) > 1:
                for i, j in forest(part):
                    a.append(part[i])
                    b.append(part[j])
        if a:
            yield pa.record_batch({"a": pa.array(np.array(a, np.uint64).view(np.int64)), "b": pa.array(np.array(b, np.uint64).view(np.int64))})
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = np.stack([column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "pair")])
        prints = column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if held:
            groups, prints = np.concatenate([held[0], groups], axis=1), np.concatenate([held[1], prints])
        others = np.flatnonzero((groups != groups[:, -1:]).any(axis=0))
        last = int(others[-1]) + 1 if len(others) else 0
        yield from out(groups[:, :last], prints[:last])
        held = groups[:, last:], prints[last:]
    if held:
        yield from out(*held)


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints ``fp`` within the radius."""
    def block(i: int):
        return F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(0xFFFF)
    keys = [F.lit(n * 2 ** 32) + block(i) * 65_536 + block(j) for n, (i, j) in enumerate(KEYS)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda d: F.struct(F.least("mine", d).alias("i"), F.greatest("mine", d).alias("j")))
    dealt = (keyed.join(sizes, "key").select("fp", "key", parts.alias("parts")).withColumn("mine", mine)
             .select("fp", "key", F.explode(pair).alias("pair")))
    # A group is a key and a pair of its chunks; the pair has a number of its own, so a bucket may have any number of chunks.
    pair_id = F.shiftleft(F.col("pair.i").cast("long"), 32).bitwiseOR(F.col("pair.j").cast("long"))
    grouped = dealt.select("fp", "key", pair_id.alias("pair"))
    return grouped.repartition("key", "pair").sortWithinPartitions("key", "pair", "fp").mapInArrow(_links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), by contraction.

    Each round joins a node to its neighbour of least hash, or to itself, and contracts; hashes make chains short. Every round is
    a written table, so nothing is recomputed when an executor is lost, and only counts reach the driver.
    """
    def rank(c: str):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = stage(edges.where("a <> b").distinct(), "edges")
    steps = []
    while edges.count():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        parent = stage(least.select(F.col("a").alias("node"), F.least("least", rank("a"))["v"].alias("root")), "parents")
        steps.append(parent)
        to_a, to_b = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        moved = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        edges = stage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for parent in steps[1:]:
        nxt = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = stage(out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    return out


def classes(base: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``base``: its component and the least doc_id reachable."""
    distinct = stage(base.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return stage(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs`` (doc_id, text)."""
    base = stage(fingerprints(docs, ["doc_id"]), "simhash")
    out = base.join(classes(base), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null last), then least content key."""
    keyed = docs.withColumn(KEY, content_key("doc_id", "text"))
    base = stage(fingerprints(keyed, ["doc_id", KEY]), "simhash")
    rows = base.join(classes(base), "fp").groupBy("root", "doc_id", KEY).agg(F.count("*").alias("times"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)
    members = stage(rows.select("root", "times", place.alias("place")), "members")
    first = stage(members.groupBy("root").agg(F.min("place").alias("first")), "firsts")  # a join of tables, which Spark can split at a hot root
    judged = members.join(small(first), "root").select(F.col(f"place.{KEY}").alias(KEY), "times", (F.col("place") == F.col("first")).alias("stays"))
    judged = stage(judged, "judged")
    gone = stage(judged.where("not stays or times > 1").select(KEY), "gone")
    twice = stage(judged.where("stays and times > 1").select(KEY), "repeated")
    out = checked_join(keyed, gone, KEY, "left_anti")
    if not twice.isEmpty():  # rows that agree in doc_id and text: one of them stays
        out = out.unionByName(checked_join(keyed, twice, KEY, "left_semi").dropDuplicates([KEY]))
    return out.drop(KEY)
