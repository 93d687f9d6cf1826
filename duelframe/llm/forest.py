"""MinHash near-duplicates through an LSH forest.

A document's set of 4-word shingles gets ORDERS x DEPTH minhash values. Each order sorts all distinct sets by DEPTH
values of its own and the next ones (LCP values in all), so sets with long common prefixes of signature lie together.
Candidates are the neighbours in an order, and all pairs inside a region: the rows that share a prefix of the least depth
at which at most REGION of them are left, which is short where sets are sparse and long where they crowd. A region that
is still larger at full depth is walked in half-overlapping windows, so no row has more than a bounded number of partners in an order
and none is left out. Candidates must agree by a sketch of one bit a value and by their whole signatures (each 4.5 standard
deviations below similarity 0.8), may not already be connected, must be possible by the bitmaps of their sets (an element whose
bit the other side lacks is not shared, which bounds the similarity exactly), and are confirmed on full sets, recomputed from
the texts of the rows concerned.

Equal sets are one node. Three rounds spare groups of copies all their pairs, each looking only between components that
the rounds before left apart: neighbours of the first order; neighbours of all orders, which also notes the nodes that
have a likely partner in some region; and regions of all orders, of those nodes alone, by whole signatures and bitmaps.

What can be missed: a link at similarity s whose ends share a region in no order, (1 - s ** depth) ** ORDERS: at 0.8
4e-9 at depth 3, 3e-6 at 4, 7e-5 at 5; sketch and signature, 3e-6 each; and only if no chain of other links joins the two. Nothing found is untrue, up to
collisions of 64-bit shingle hashes inside one pair. Rows are dealt by ranges of (order, signature, set), which are unique, so a crowd
spreads over tasks; a region cut by a range loses its pairs across the cut in that order only.

Defined results: null text, empty text and white space have no shingles, are linked with nothing and keep their doc_id as
component. Repeated rows each get a row and share a component. A null doc_id is no candidate for ``component_id``, and
``kept`` is false for it; a component of nulls has null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from duelframe.session import stage

from .common import KEY, checked_join, column, content_key, rows_of, slices
from .decontaminate import mix
from .simhash import components

SHINGLE, PERCENT = 4, 80
ORDERS, DEPTH, LCP = 24, 8, 16
VALUES = ORDERS * DEPTH
REGION, BUFFER = 512, 1 << 16
#: Sketch bits that may differ, mean 19.2 at similarity 0.8, and signature values that must agree, mean 153.6; by 4.5 standard deviations.
FAR, AGREED = 38, 128
BITS = 2048
NODE, SKETCH, WHOLE = 2 * LCP, 2 * LCP + 16, 2 * LCP + 16 + VALUES // 8  # where the parts of a row begin
BITMAP = WHOLE + 2 * VALUES
GAIN = np.uint64(0xD6E8FEB86659FD93)
FACTORS = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mix(np.arange(1001, 1001 + VALUES, dtype=np.uint64))


STORED = ("node", "signature", "sketch", "bitmap")


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order; none for a text without words."""
    numbers: dict[bytes, int] = {}
    out = []
    told = [[numbers.setdefault(w, len(numbers)) for w in t.lower().split()] for t in texts]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 4) for w in numbers), np.uint64, len(numbers))
    for words in told:
        h = hashes[np.array(words, np.int64)]
        k = min(len(h), SHINGLE)
        g = np.full(len(h) - k + 1 if k else 0, k, np.uint64)
        for j in range(k):
            g = g * GAIN + h[j:len(h) - k + 1 + j]
        out.append(np.unique(mix(g)))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES minima of each of the sets, none of them empty."""
    joined = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), VALUES), np.uint64)
    for i in range(VALUES):
        out[:, i] = np.minimum.reduceat((joined ^ OFFSETS[i]) * FACTORS[i], first)
    return mix(out)


def _signatures(carry: list[str]):
    def run(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(list(rows_of(batch, "text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            signature, sketch, digest, bitmap = ([None] * len(sets) for _ in range(4))
            if full:
                values = minhashes([sets[i] for i in full])
                short = (values >> np.uint64(48)).astype(">u2")
                bits = np.packbits((values & np.uint64(1)).astype(bool), axis=1)
                for k, i in enumerate(full):
                    signature[i], sketch[i] = short[k].tobytes(), bits[k].tobytes()
                    digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    marked = np.zeros(BITS, bool)
                    marked[sets[i] % np.uint64(BITS)] = True
                    bitmap[i] = np.packbits(marked).tobytes()
            made = [pa.array(list(map(len, sets)), pa.int64()), *(pa.array(c, pa.binary()) for c in (digest, signature, sketch, bitmap))]
            yield pa.record_batch([*[column(batch, c) for c in carry], *made], names=[*carry, "n_shingles", *STORED])
    return run


def _sets(batches):
    for batch in slices(batches, "text"):
        sets = shingle_sets(list(rows_of(batch, "text")))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        values = np.concatenate(sets).view(np.int64)
        yield pa.record_batch({"node": column(batch, "node"), "shingles": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))})


def ordered(nodes: DataFrame, orders: list[int], whole: bool) -> DataFrame:
    """Rows of the orders, sorted: ``row`` is the path of LCP values, the node, the sketch and, if ``whole``, signature and bitmap in one."""
    order = F.explode(F.array(*[F.lit(o) for o in orders])).alias("order")
    spread = nodes.select(order, *STORED, "n_shingles", "component", F.expr("concat(signature, signature)").alias("cycle"))
    path = F.substring("cycle", F.col("order") * (2 * DEPTH) + 1, F.lit(2 * LCP))
    parts = [path, "node", "sketch", *(["signature", "bitmap"] if whole else [])]
    rows = spread.select("order", F.concat(*parts).alias("row"), "n_shingles", "component")
    return rows.repartitionByRange("order", "row").sortWithinPartitions("order", "row")


class Rows:
    """Sorted rows of one or more orders and the candidates among them."""

    def __init__(self, order, row, size, component):
        self.order, self.row, self.size, self.component = order, row, size, component

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        raw = np.frombuffer(b"".join(rows_of(batch, "row")), np.uint8).reshape(batch.num_rows, -1)
        return Rows(*(column(batch, "order").to_numpy(), raw, column(batch, "n_shingles").to_numpy(), column(batch, "component").to_numpy()))

    def parts(self):
        return self.order, self.row, self.size, self.component

    def __add__(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate(p) for p in zip(self.parts(), other.parts())))

    def __getitem__(self, at) -> Rows:
        return Rows(*(p[at] for p in self.parts()))

    def shared(self) -> np.ndarray:
        """Values that each row's path shares with that before it; -1 at the start of an order."""
        path = np.ascontiguousarray(self.row[:, :NODE]).view(">u2")
        equal = np.cumprod(path[1:] == path[:-1], axis=1, dtype=np.int8).sum(axis=1)
        return np.concatenate([[-1], np.where(self.order[1:] == self.order[:-1], equal, -1)])

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two rows may be linked and are not yet connected."""
        less, more = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        out = (self.component[a] != self.component[b]) & (100 * less >= PERCENT * more)
        sketch = np.ascontiguousarray(self.row[:, SKETCH:WHOLE]).view(np.uint64)
        out[out] = np.bitwise_count(sketch[a[out]] ^ sketch[b[out]]).sum(axis=1) <= FAR
        if self.row.shape[1] > WHOLE and out.any():
            signature = np.ascontiguousarray(self.row[:, WHOLE:BITMAP]).view(np.uint16)
            out[out] = (signature[a[out]] == signature[b[out]]).sum(axis=1) >= AGREED
            bitmap = np.ascontiguousarray(self.row[:, BITMAP:]).view(np.uint64)
            a, b = a[out], b[out]
            both = np.minimum(*(self.size[x] - np.bitwise_count(bitmap[x] & ~bitmap[y]).sum(axis=1, dtype=np.int64) for x, y in ((a, b), (b, a))))
            out[out] = 100 * both >= PERCENT * (self.size[a] + self.size[b] - both)
        return out

    def regions(self, shared: np.ndarray, most: int):
        """(start, end) of the regions of at most ``most`` rows, and of the windows over what still crowds at full depth."""
        open_ = np.ones(len(shared), bool)
        for depth in range(LCP + 1):
            starts = np.flatnonzero(shared < depth)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shared)]):
                if not open_[a]:
                    continue
                if b - a <= most:
                    open_[a:b] = False
                    if b - a > 1:
                        yield a, b
                elif depth == LCP:
                    for w in range(a, b - most // 2, most // 2):
                        yield w, min(b, w + most)
            if not open_.any():
                return

    def neighbours(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(shared > 0)
        at = at[self.near(at - 1, at)]
        return at - 1, at

    def inside(self, shared: np.ndarray, most: int):
        """Pairs of row numbers, those of one region or window at a time."""
        for start, end in self.regions(shared, most):
            if (self.component[start:end] != self.component[start]).any():
                part, (a, b) = self[start:end], np.triu_indices(end - start, 1)
                keep = part.near(a, b)
                yield a[keep] + start, b[keep] + start

    def nodes(self, at: np.ndarray) -> pa.Array:
        return pa.array([x.tobytes() for x in self.row[at, NODE:SKETCH]], pa.binary())


FIRST, ALL, REGIONS = range(3)


def _candidates(kind: int, most: int, buffer: int):
    """(a, b) of candidates; in the round ALL also (a, null) for nodes with a likely partner in a region."""
    def pairs(rows: Rows):
        shared = rows.shared()
        a, b = rows.neighbours(shared)
        yield rows.nodes(a), rows.nodes(b)
        for a, b in rows.inside(shared, most) if kind != FIRST else ():
            if kind == REGIONS:
                yield rows.nodes(a), rows.nodes(b)
            else:
                some = rows.nodes(np.unique(np.concatenate([a, b])))
                yield some, pa.nulls(len(some), pa.binary())

    def made(rows: Rows):
        for a, b in pairs(rows):
            if len(a):
                yield pa.record_batch({"a": a, "b": b})

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = Rows.of(batch) if held is None else held + Rows.of(batch)
            if len(held.order) >= buffer:
                # Cut where the last rows share least; what follows waits for the next batch.
                shared = held.shared()
                tail = buffer // 2
                cut = tail + int(shared[tail:].argmin())
                yield from made(held[:cut])
                held = held[cut:]
        if held is not None and len(held.order):
            yield from made(held)
    return run


def confirmed(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar; sets are made again from one text of each node."""
    needed = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "needed")
    keys = stage(checked_join(nodes, needed, "node", "left_semi").select("node", F.col("sample").alias(KEY)), "samples")
    texts = checked_join(keyed, keys, KEY, "inner").select("node", "text")
    made = texts.mapInArrow(_sets, "node binary, shingles array<bigint>")
    sets = stage(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")  # rows that agree in doc_id and text
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both.cast("long") >= PERCENT * union.cast("long")).select("a", "b")


def linked(nodes: DataFrame, keyed: DataFrame, most: int = REGION, buffer: int = BUFFER) -> DataFrame | None:
    """(node, root) of the nodes that have links, or None if there are none."""
    edges = roots = None
    looked = nodes
    for kind in (FIRST, ALL, REGIONS):
        if roots is None:
            told = looked.withColumn("component", F.xxhash64("node"))
        else:
            told = checked_join(looked, roots, "node", "left").withColumn("component", F.xxhash64(F.coalesce("root", "node"))).drop("root")
        rows = ordered(told, [0] if kind == FIRST else list(range(ORDERS)), kind == REGIONS)
        found = rows.mapInArrow(_candidates(kind, most, buffer), "a binary, b binary")
        either = F.col("b").isNull()  # a node alone
        first, second = F.when(either, F.col("a")).otherwise(F.least("a", "b")), F.when(~either, F.greatest("a", "b"))
        pairs = stage(found.select(first.alias("a"), second.alias("b")).distinct(), "pairs")
        if kind == ALL:
            looked = stage(checked_join(nodes, pairs.where("b is null").select(F.col("a").alias("node")), "node", "left_semi"), "likely")
        pairs = pairs.where("b is not null")
        if pairs.isEmpty():
            continue
        links = stage(confirmed(pairs, nodes, keyed), "links")
        if links.isEmpty():
            continue
        edges = links if edges is None else edges.union(links)
        roots = stage(components(edges), "components")
    return roots


def signed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, n_shingles, node (digest of the set), signature, sketch and bitmap of every row; the last four null without shingles."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(_signatures(carry), f"{kinds}, n_shingles long, {', '.join(f'{c} binary' for c in STORED)}")


def near_duplicates(docs: DataFrame, most: int = REGION, buffer: int = BUFFER) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the row's doc_id is its component's) of every row of ``docs`` (doc_id, text)."""
    keyed = docs.select("doc_id", "text").withColumn(KEY, content_key("doc_id", "text"))
    base = stage(signed(keyed, ["doc_id", KEY]), "minhash")
    grouped = base.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.min(KEY).alias("sample"), *[F.first(c).alias(c) for c in ("n_shingles", *STORED[1:])])
    nodes = stage(grouped, "nodes")
    roots = linked(nodes.drop("first"), keyed, most, buffer)
    classes = nodes.select("node", "first")
    if roots is not None:
        rooted = checked_join(classes, roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
        least = rooted.groupBy("root").agg(F.min("first").alias("first"))
        classes = rooted.drop("first").join(least, "root").select("node", "first")
    out = checked_join(base.select("doc_id", "n_shingles", "node"), stage(classes, "classes"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
