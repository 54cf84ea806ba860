"""Exact top-k by inner product with a pivot table.

Vectors become integer codes. With one more component that brings every candidate to the same length, a larger inner
product is a smaller distance, and the triangle inequality with distances to pivots bounds the distance from below: max
over pivots of |d(query, pivot) - d(candidate, pivot)|.

1. For each vector length, a sample of at most ``SAMPLE`` vectors (those with the smallest hashes of their ids) gives
   ``n_pivots`` pivots, each the one farthest from those before it.
2. The pivot table holds every vector with its distances to all pivots, in cells by nearest pivot. It is worked out once,
   stored in shared storage, and read in blocks of one cell.
3. A query starts with the k-th best score within the sample, a score that k candidates reach. Blocks of queries meet
   blocks of candidates. A block is left whole where the range of its distances excludes it; else its candidates are
   evaluated in the order of their bounds, ``STEP`` at a time, until the next bound is under the k-th best score so far. A
   task keeps the best scores of the queries that it has seen, so each block starts from what the blocks before it gave.
4. A window over what reached the k-th best score ranks it.

Vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths don't meet.
A query's own row is no candidate: rows are one's own by vec_id, so copies of a row with its id are not candidates either.
Codes of 2**53 and more are an error, and so are scores beyond 64 bits.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stored

SCALE = 64.0
PIVOTS, SAMPLE = 64, 2048
QUERY_BLOCK, CANDIDATE_BLOCK = 256, 4096
#: Blocks of queries that meet a block of candidates in one task, and whose best scores a task keeps.
STRIPE, KEPT = 64, 256
#: Queries whose bounds are worked out at a time, and candidates that are evaluated at a time.
TILE, STEP = 32, 256


def coded(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, dim and code: floor(scale * x) of every component, for the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    code = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a code of 2**53 or more")).cast("long"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("embedding") > 0) & finite)
        .select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", code).alias("code"))
    )


def _packed(codes: np.ndarray) -> bytes:
    """Whole numbers as 32-bit floats where these hold them."""
    return codes.astype("<f4" if np.abs(codes).max(initial=0) < 1 << 24 else "<f8").tobytes()


def _unpacked(body: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(body, "<f4" if len(body) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def _rows(ids: pa.Array, codes: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return ids.to_numpy(zero_copy_only=False), codes.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def far_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x at most: the longest one, then always the one farthest from those before it."""
    chosen = [int(np.argmax((x * x).sum(axis=1)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _basis(n_pivots: int):
    """Of the sample of a length: its pivots, and itself."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        ids, x = _rows(table.column("vec_id").combine_chunks(), table.column("code").combine_chunks(), dim)
        pivots = far_pivots(x, n_pivots)
        row = {"dim": [dim], "top": [table.column("top")[0].as_py()], "pivots": [pivots.astype("<f8").tobytes()], "s_ids": [ids.tobytes()], "sample": [_packed(x)]}
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(row.items(), (pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()))})

    return run


def to_pivots(x: np.ndarray, pivots: np.ndarray, top: float | None = None) -> np.ndarray:
    """Distances of candidates, all brought to the length sqrt(top), to the pivots; or of queries, if top is None."""
    square = (x * x).sum(axis=1)[:, None] if top is None else top
    return np.sqrt(np.maximum(square + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0)).astype(np.float32)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: of q[i] with each of x[i]."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**52:
        kind = np.float32 if most < 2**23 else np.float64
        return np.matmul(x.astype(kind, copy=False), q.astype(kind)[:, :, None])[:, :, 0].astype(np.float64)
    return np.array([[sum(int(u) * int(v) for u, v in zip(a, b)) for b in c] for a, c in zip(q, x)], object).reshape(x.shape[:2])


def bounds(q2: np.ndarray, q_far: np.ndarray, far: np.ndarray, top: float) -> np.ndarray:
    """No inner product of a query and a candidate is over its entry here.

    q2: the queries' squares; q_far and far: distances of queries and candidates to the pivots. With d the largest
    difference of the two, the product is at most (q2 + top - d * d) / 2.
    """
    gap = np.zeros((len(q_far), len(far)), np.float32)
    step = np.empty_like(gap)
    for p in range(far.shape[1]):
        np.subtract(far[None, :, p], q_far[:, None, p], out=step)
        np.abs(step, out=step)
        np.maximum(gap, step, out=gap)
    return _from_gap(q2, q_far, far, gap, top)


def _from_gap(q2: np.ndarray, q_far: np.ndarray, far: np.ndarray, gap: np.ndarray, top: float) -> np.ndarray:
    # single precision can be wrong by a few units of 2**-23 of the largest distance
    longest = float(max(far.max(initial=0), q_far.max(initial=0)))
    gap = np.maximum(gap - np.float32(longest * 2.0**-20), 0).astype(np.float64)
    return (q2[:, None] + top - gap * gap) / 2 + 1e-6 * (1 + top + float(q2.max(initial=0)))


class Best:
    """The k best scores that each query of a block has met, and how many candidates were evaluated."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.scores = np.full((len(floor), k), -np.inf)
        self.floor = floor.copy()
        self.evaluated = self.met = 0

    def take(self, who: np.ndarray, scores: np.ndarray) -> None:
        k = self.scores.shape[1]
        every = np.concatenate([self.scores[who], scores.astype(np.float64)], axis=1)
        self.scores[who] = np.partition(every, every.shape[1] - k, axis=1)[:, -k:]
        # a score of 2**53 and more is rounded: no floor may be over it
        least = self.scores[who].min(axis=1)
        slack = np.where(np.abs(least) < 2.0**52, 0, np.abs(np.where(np.isfinite(least), least, 0)) * 1e-9)
        self.floor[who] = np.maximum(self.floor[who], least - slack)


def block_top_k(q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, ids: np.ndarray, x: np.ndarray, far: np.ndarray, top: float, best: Best) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of all candidates of a block that may be among the best k; ``best`` goes on to other blocks."""
    found: list[tuple[int, int, int]] = []
    q2 = (q * q).sum(axis=1)
    best.met += len(q) * len(x)
    low, high = far.min(axis=0), far.max(axis=0)
    gap = np.maximum(np.maximum(q_far - high, low - q_far), 0).max(axis=1)
    near = np.flatnonzero(_from_gap(q2, q_far, far, gap[:, None], top)[:, 0] >= best.floor)
    small = x.astype(np.float32) if np.abs(x).max(initial=0) < 1 << 24 else x
    for t in range(0, len(near), TILE):
        who = near[t : t + TILE]
        most = bounds(q2[who], q_far[who], far, top)
        order = np.argsort(-most, axis=1)
        ranked = np.take_along_axis(most, order, axis=1)
        at, live = 0, np.arange(len(who))
        hits = []
        while at < len(x):
            live = live[ranked[live, at] >= best.floor[who[live]]]
            if not len(live):
                break
            some = order[live, at : at + STEP]
            scores = _products(q[who[live]], small[some])
            scores[ids[some] == q_ids[who[live]][:, None]] = -np.inf
            best.evaluated += some.size
            best.take(who[live], scores)
            hits.append((live, some, scores))
            at += STEP
        for live, some, scores in hits:
            i, j = np.nonzero((scores >= best.floor[who[live]][:, None]) & (scores != -np.inf))
            found += zip(q_ids[who[live[i]]].tolist(), ids[some[i, j]].tolist(), [int(s) for s in scores[i, j]])
    return found


def _blocks(codes: DataFrame, size: int) -> DataFrame:
    """Rows of about size vectors each: dim, block, ids and codes."""
    n = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("long")
    counts = codes.groupBy("dim").agg(n.alias("blocks"))
    dealt = codes.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "code"), F.col("blocks")))
    return dealt.groupBy("dim", "block").agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("code")).alias("codes"), F.first("blocks").alias("blocks"))


def _opened(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray]:
    dim = batch.column("dim")[i].as_py()
    ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
    return dim, ids, batch.column("codes")[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)


_TABLE = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("top", pa.float64()), ("ids", pa.binary()), ("codes", pa.binary()), ("far", pa.binary())])
_QUERIES = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("q_ids", pa.binary()), ("q", pa.binary()), ("q_far", pa.binary()), ("floor", pa.binary())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivot table's rows: vectors of a cell with their distances to the pivots."""
    for batch in batches:
        for i in range(batch.num_rows):
            dim, ids, x = _opened(batch, i)
            top = batch.column("top")[i].as_py()
            far = to_pivots(x, np.frombuffer(batch.column("pivots")[i].as_py(), "<f8").reshape(-1, dim), top)
            cell = far.argmin(axis=1)
            rows = []
            for c in np.unique(cell).tolist():
                own = cell == c
                rows.append((dim, c, int(own.sum()), top, ids[own].tobytes(), _packed(x[own]), far[own].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TABLE.types)], schema=_TABLE)


def _begin(k: int):
    """Blocks of queries with their distances to the pivots, and the k-th best score that each has within the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, q = _opened(batch, i)
                far = to_pivots(q, np.frombuffer(batch.column("pivots")[i].as_py(), "<f8").reshape(-1, dim))
                s_ids = np.frombuffer(batch.column("s_ids")[i].as_py(), np.int64)
                x = _unpacked(batch.column("sample")[i].as_py(), len(s_ids), dim)
                best = Best(np.full(len(q), -np.inf), k)
                for a in range(0, len(q), TILE):
                    who = np.arange(a, min(a + TILE, len(q)))
                    scores = _products(q[who], np.broadcast_to(x, (len(who), *x.shape)))
                    scores[s_ids[None, :] == ids[who][:, None]] = -np.inf
                    best.take(who, scores)
                row = (dim, batch.column("block")[i].as_py(), ids.tobytes(), _packed(q), far.tobytes(), best.floor.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _QUERIES.types)], schema=_QUERIES)

    return run


def _evaluate(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[tuple[int, int], Best] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                dim, block, top = row["dim"].as_py(), row["block"].as_py(), row["top"].as_py()
                q_ids = np.frombuffer(row["q_ids"].as_py(), np.int64)
                q = _unpacked(row["q"].as_py(), len(q_ids), dim)
                q_far = np.frombuffer(row["q_far"].as_py(), np.float32).reshape(len(q), -1)
                parts = row["parts"].as_py()
                ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
                x = np.concatenate([_unpacked(p["codes"], len(p["ids"]) // 8, dim) for p in parts])
                far = np.concatenate([np.frombuffer(p["far"], np.float32).reshape(-1, q_far.shape[1]) for p in parts])
                best = kept.pop((dim, block), None) or Best(np.frombuffer(row["floor"].as_py(), np.float64), k)
                kept[dim, block] = best
                if len(kept) > KEPT:
                    kept.popitem(last=False)
                found = block_top_k(q_ids, q, q_far, ids, x, far, top, best)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return run


def pivot_table(codes: DataFrame, basis: DataFrame) -> DataFrame:
    """The stored pivot table: dim, cell, n, top, ids, codes and far, in pieces of a cell."""
    blocks = _blocks(codes, CANDIDATE_BLOCK).drop("block", "blocks").join(basis.select("dim", "top", "pivots"), "dim")
    return stored(blocks.mapInArrow(_measure, "dim int, cell int, n long, top double, ids binary, codes binary, far binary"), "pivot-table")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = SCALE, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each vector for which is_query (of vec_id) holds."""
    codes = coded(vectors, scale)
    order = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "code"))
    square = F.aggregate("code", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    tops = codes.groupBy("dim").agg(F.max(square).alias("top"))
    sample = codes.withColumn("r", order).where(F.col("r") <= SAMPLE).join(tops, "dim").select("dim", "vec_id", "code", "top")
    basis = stored(sample.groupBy("dim").applyInArrow(_basis(n_pivots), "dim int, top double, pivots binary, s_ids binary, sample binary"), "pivot-basis")
    table = pivot_table(codes, basis)
    queries = _blocks(codes.where(is_query), QUERY_BLOCK).join(basis.drop("top"), "dim")
    stripes = F.ceil(F.col("blocks") / STRIPE).cast("long")
    queries = queries.withColumn("stripes", stripes)
    most = queries.groupBy("dim").agg(F.max("stripes").alias("stripes"))
    queries = stored(queries.mapInArrow(_begin(k), "dim int, block long, q_ids binary, q binary, q_far binary, floor binary"), "pivot-queries")
    # the pieces of a cell in blocks, each for every stripe of queries
    cells = table.groupBy("dim", "cell").agg(F.ceil(F.sum("n") / CANDIDATE_BLOCK).cast("long").alias("parts"))
    dealt = table.join(cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts"))).join(most, "dim")
    dealt = dealt.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)))
    blocks = dealt.groupBy("dim", "cell", "part", "stripe").agg(F.first("top").alias("top"), F.collect_list(F.struct("ids", "codes", "far")).alias("parts"))
    sent = queries.join(cells, "dim").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    sent = sent.join(most, "dim").withColumn("stripe", F.pmod("block", "stripes")).drop("stripes")
    pairs = sent.join(blocks, ["dim", "cell", "part", "stripe"])
    found = pairs.mapInArrow(_evaluate(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
