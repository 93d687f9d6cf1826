"""Exact top-k inner products over blocks of vectors in order of length.

Components become floor(1024 x). Vectors are dealt by range of length, packed into blocks of descending length, and
rotated into the basis of a singular value decomposition, in which the first HEAD coordinates hold most of an inner product.
A block of queries meets a block of candidates: the partial sum over HEAD coordinates plus the product of the residual
lengths bounds each score (Cauchy-Schwarz), and only candidates whose bound reaches the query's k-th best score so far
are scored exactly, in integers. A block stops once length times length falls below every query's bound. The longest
block goes first and gives the other blocks their starting bounds. Scores equal to the bound are kept, so ties are exact.

Up to QUERY_BLOCKS blocks of queries are broadcast. More of them are dealt into slots and candidates into parts, and each
(slot, part) of the grid meets in a join on that pair of numbers, without pairs of blocks whose lengths rule out a hit.

The rotation is fitted on at most FIT_ROWS vectors; it changes how much is pruned, never the result.

Defined results: vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. Rows with
the same vec_id and vector count once. A query's own rows (same vec_id) are no candidates. Vectors meet vectors
of the same number of components only. Fewer candidates than k give them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.session import stage

from .common import column

SCALE = 1024
HEAD = 16
FIT_ROWS = 4_096
BLOCK, QUERY_BLOCK = 8_192, 256
STEP = 2_048
# Query blocks that are broadcast, or that share a slot; candidate blocks of a part.
QUERY_BLOCKS, PART_BLOCKS = 64, 256
PACK = "block long, dim int, n int, top double, ids binary, exact binary, turned binary, length binary, rest binary"


def integers(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(SCALE * x.cast("double")).cast("long"))


def valid(embedding: Column) -> Column:
    return F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v, dim, length) of the rows that take part."""
    rows = table.where(F.col("vec_id").isNotNull() & F.coalesce(valid(F.col("embedding")), F.lit(False)))
    rows = rows.select("vec_id", integers(F.col("embedding")).alias("v")).dropDuplicates(["vec_id", "v"])
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"), F.sqrt(squares).alias("length"))


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal basis by number of components, from a sample of bounded size."""
    total = rows.count()
    share = min(1.0, FIT_ROWS / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < share * (1 << 40)).select("dim", "v").limit(2 * FIT_ROWS).collect()
    out = {}
    for dim in {r.dim for r in sample if r.dim}:
        m = np.array([r.v for r in sample if r.dim == dim], float)
        out[dim] = np.linalg.svd(m.T @ m)[0]
    return out


def _packer(basis, size: int):
    """Blocks of up to ``size`` rows of each partition, in the order in which rows come."""
    def pack(ids, rows, dim):
        exact = np.array(rows, np.int64).reshape(len(ids), dim)
        turn = basis.value.get(dim)
        turned = exact.astype(float) @ (turn if turn is not None else np.eye(dim))
        squares = (exact.astype(float) ** 2).sum(1)
        rest = np.sqrt(np.maximum(0, squares - (turned[:, :HEAD] ** 2).sum(1)))
        length = np.sqrt(squares)
        return {"block": int(ids[0]), "dim": dim, "n": len(ids), "top": float(length.max()), "ids": np.array(ids, np.int64).tobytes(),
                "exact": exact.tobytes(), "turned": np.ascontiguousarray(turned[:, :HEAD]).tobytes(), "length": length.tobytes(), "rest": rest.tobytes()}

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(column(batch, "vec_id").to_pylist(), column(batch, "v").to_pylist()):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield _batch([pack(*held.pop(len(v)), len(v))])
        for dim, (ids, rows) in held.items():
            yield _batch([pack(ids, rows, dim)])
    return run


SCHEMA = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("top", pa.float64()),
                    *[(c, pa.binary()) for c in ("ids", "exact", "turned", "length", "rest")]])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


class Block:
    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.dim, self.top = dim, row["top"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.exact = np.frombuffer(row["exact"], np.int64).reshape(n, dim)
        self.turned = np.frombuffer(row["turned"], float).reshape(n, -1)
        self.length, self.rest = np.frombuffer(row["length"], float), np.frombuffer(row["rest"], float)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can pass 2 ** 53, else in 64-bit integers."""
    if not q.size or not c.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2 ** 53:
        return np.rint(q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def best(queries: Block, block: Block, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and scores of its k best in the block that reach ``floor``."""
    floor = floor.astype(float).copy()
    ids = [np.zeros(0, np.int64)] * len(queries.ids)
    scores = [np.zeros(0, np.int64)] * len(queries.ids)
    for at in range(0, len(block.ids), STEP):
        part = slice(at, at + STEP)
        slack = 1e-6 + 1e-9 * queries.length * block.length[part].max(initial=0)
        live = np.flatnonzero(queries.length * block.length[part].max(initial=0) + slack >= floor)
        if not len(live):
            continue
        bound = queries.turned[live] @ block.turned[part].T + np.outer(queries.rest[live], block.rest[part]) + slack[live, None]
        open_ = (bound >= floor[live, None]) & (queries.ids[live, None] != block.ids[part])
        wanted = np.flatnonzero(open_.any(0))
        if not len(wanted):
            continue
        exact = products(queries.exact[live], block.exact[part][wanted])
        for r, q in enumerate(live):
            hits = np.flatnonzero(open_[r, wanted])
            if not len(hits):
                continue
            i = np.concatenate([ids[q], block.ids[part][wanted[hits]]])
            s = np.concatenate([scores[q], exact[r, hits]])
            order = np.lexsort((i, -s))[:k]
            ids[q], scores[q] = i[order], s[order]
            if len(order) == k:
                floor[q] = max(floor[q], s[order[-1]])
    return list(zip(ids, scores))


def _starter(first, k: int):
    """Query blocks with the k-th best score of each query in the longest block, and the least of them."""
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                q = Block(row)
                found = best(q, first.value[q.dim], k, np.full(len(q.ids), -np.inf))
                floor = np.array([s[-1] if len(s) == k else -np.inf for _, s in found], float)
                row |= {"floor": floor.tobytes(), "least": float(floor.min())}
            yield pa.RecordBatch.from_pylist(rows, SCHEMA.append(pa.field("floor", pa.binary())).append(pa.field("least", pa.float64())))
    return run


def _hits(queries: Block, floor: np.ndarray, block: Block, k: int) -> pa.RecordBatch:
    found = best(queries, block, k, floor)
    ids = np.repeat(queries.ids, [len(i) for i, _ in found])
    flat = lambda n: np.concatenate([x[n] for x in found]) if found else np.zeros(0, np.int64)
    return pa.record_batch({"query_id": pa.array(ids), "vec_id": pa.array(flat(0)), "score": pa.array(flat(1))})


def _searcher(shared, k: int):
    """Meets each block of candidates with all broadcast query blocks of the same number of components."""
    def run(batches):
        queries = [(Block(row), np.frombuffer(row["floor"], float)) for row in shared.value]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for q, floor in queries:
                    if q.dim == block.dim:
                        yield _hits(q, floor, block, k)
    return run


def _grid(k: int):
    """Rows that hold a block of candidates and, under ``q``, a block of queries."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield _hits(Block(row["q"]), np.frombuffer(row["q"]["floor"], float), Block(row), k)
    return run


PACKED = SCHEMA.names
FOUND = "query_id long, vec_id long, score long"


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every query among ``table`` (vec_id, embedding)."""
    context = table.sparkSession.sparkContext
    rows = stage(vectors(table), "vectors")
    basis = context.broadcast(rotations(rows))
    parts = max(1, -(-rows.count() // BLOCK))
    long_first = rows.repartitionByRange(parts, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    blocks = stage(long_first.select("vec_id", "v").mapInArrow(_packer(basis, BLOCK), PACK), "blocks")
    asked = rows.where(is_query).select("vec_id", "v")
    packed = stage(asked.coalesce(max(1, parts // 64)).mapInArrow(_packer(basis, QUERY_BLOCK), PACK), "query_blocks")
    dims = [r.dim for r in packed.select("dim").distinct().collect()]
    longest = {d: Block(blocks.where(F.col("dim") == d).orderBy(F.desc("top"), "block").first().asDict()) for d in dims}
    asked = stage(packed.mapInArrow(_starter(context.broadcast(longest), k), PACK + ", floor binary, least double"), "asked")
    count = asked.count()
    if count <= QUERY_BLOCKS:
        found = blocks.mapInArrow(_searcher(context.broadcast([r.asDict() for r in asked.collect()]), k), FOUND)
    else:
        slots, cells = -(-count // QUERY_BLOCKS), -(-blocks.count() // PART_BLOCKS)
        deal = lambda n: F.pmod(F.xxhash64("block", "dim"), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = asked.select(F.struct(*asked.columns).alias("q"), F.col("dim").alias("q_dim"), deal(slots).alias("q_slot"), each(cells).alias("q_cell"))
        c = blocks.select("*", deal(cells).alias("cell"), each(slots).alias("slot"))
        met = c.join(q, (c.dim == q.q_dim) & (c.slot == q.q_slot) & (c.cell == q.q_cell) & (c.top * q["q.top"] + 1 >= q["q.least"]))
        found = met.select(*PACKED, "q").mapInArrow(_grid(k), FOUND)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
