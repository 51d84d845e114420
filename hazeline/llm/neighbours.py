"""Nearest neighbours by cosine: a matrix join in blocks.

Vectors are packed into blocks of rows, each scaled to int8.  Every pair of a query block and a candidate block is one
tile: an integer product gives all its cosines with a bound on the rounding error, pairs that cannot be among the
nearest are dropped, the others are computed again in double precision.

Tiles lie on a grid of cells.  A cell holds some query blocks and sees its candidate blocks one after the other, with the
``k`` best of each query so far as a floor; so a query block travels once per column of the grid and a candidate block once
per row, not once per tile.  Bounded heaps merge what the cells found.  Blocks are spread evenly, so equal vectors make no
task large.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import stored

HELD_BYTES = 32 << 20  # of query vectors in a cell
BLOCK = "part bigint, dim int, ids binary, rows binary"


def packed(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Blocks of at most ``size`` usable vectors of one length: ids as int64, rows as float64."""
    def work(batches):
        held: dict[int, tuple[list, list]] = {}

        def block(dim):
            ids, rows = held.pop(dim)
            return pa.RecordBatch.from_pylist([{"part": 0, "dim": dim, "ids": np.array(ids, np.int64).tobytes(), "rows": np.concatenate(rows).tobytes()}], schema=kind)

        kind = pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())])
        for batch in batches:
            for i, v in zip(batch.column(key).to_pylist(), batch.column(vector)):
                if i is None or not v.is_valid:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                ids, rows = held.setdefault(len(x), ([], []))
                ids.append(i), rows.append(x)
                if len(ids) == size:
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)

    out = df.select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias(vector)).mapInArrow(work, BLOCK)
    return out.withColumn("part", F.monotonically_increasing_id())


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8 with their scales, and the length of what rounding left out."""
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    scale = np.abs(unit).max(1, keepdims=True) / 127
    whole = np.rint(unit / scale)
    return whole.astype(np.int8), scale[:, 0], np.sqrt(((unit - whole * scale) ** 2).sum(1))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines row by row in double precision, products added from left to right."""
    def dot(u, v):
        return np.add.accumulate(u * v, axis=1)[:, -1]

    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def tile_best(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int, least: np.ndarray | None = None):
    """``(query, candidate, cosine)`` of the ``k`` nearest candidates of every query within one tile, none below ``least``."""
    top_q, top_c = (np.abs(x).max(1, keepdims=True) for x in (q, c))  # keeps squares of extreme values finite
    q8, qs, qe = quantised(q / top_q)
    c8, cs, ce = quantised(c / top_c)
    out = []
    for a in range(0, len(q), 256):
        # Whole numbers: over a thousand dimensions a sum stays below 2**24 and so exact in single precision.
        sums = [q8[a : a + 256, j : j + 1024].astype(np.float32) @ c8[:, j : j + 1024].astype(np.float32).T for j in range(0, max(1, q8.shape[1]), 1024)]
        rough = sum(s.astype(np.float64) for s in sums) * qs[a : a + 256, None] * cs
        slack = qe[a : a + 256, None] * (1 + ce) + ce + 1e-6
        low, high = rough - slack, rough + slack
        own = qi[a : a + 256, None] == ci[None, :]
        low[own] = high[own] = -np.inf
        floor = np.partition(low, len(ci) - k, axis=1)[:, len(ci) - k] if len(ci) > k else np.full(len(low), -np.inf)
        floor = floor if least is None else np.maximum(floor, least[a : a + 256])
        r, s = np.nonzero((high >= floor[:, None]) & ~own)
        score = np.concatenate([exact(q[a + r[i : i + 65536]], c[s[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])
        order = np.lexsort((ci[s], -score, r))
        r, s, score = r[order], s[order], score[order]
        first = np.searchsorted(r, r, side="left")
        keep = np.arange(len(r)) - first < k
        out.append((qi[a + r[keep]], ci[s[keep]], score[keep]))
    return [np.concatenate(x) for x in zip(*out)]


class Cell:
    """Query blocks, and the ``k`` best candidates of each of their queries among the blocks seen so far."""

    def __init__(self, k: int):
        self.k, self.blocks = k, []

    def take(self, side: int, ids: np.ndarray, rows: np.ndarray) -> None:
        if side == 0:
            none = np.zeros(0, np.int64)
            self.blocks.append([ids, rows, (none, none, np.zeros(0)), np.full(len(ids), -np.inf)])
            return
        for block in self.blocks:
            qi, q, best, least = block
            block[2] = a, _, s = kept([np.concatenate(x) for x in zip(best, tile_best(qi, q, ids, rows, self.k, least))], self.k)
            # A query with k found already needs no candidate below the last of them.
            size = np.searchsorted(a, qi, "right") - np.searchsorted(a, qi, "left")
            full = size >= self.k
            least[full] = s[np.searchsorted(a, qi, "right")[full] - 1]

    def found(self) -> Iterator[pa.RecordBatch]:
        for _, _, best, _ in self.blocks:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", "id", "score"])


def kept(found: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best ``(query, candidate, cosine)`` of each query, by query, best first; a candidate once."""
    a, b, s = found
    order = np.lexsort((-s, b, a))
    a, b, s = a[order], b[order], s[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s = a[fresh], b[fresh], s[fresh]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    near = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
    return a[near], b[near], s[near]


def nearest(queries: DataFrame, candidates: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5,
            query_size: int = 1024, block_size: int = 4096) -> DataFrame:
    """``query_id, rank, <key>, score`` of the ``k`` nearest candidates by cosine, ties to the smaller key.

    A candidate with the query's own key is left out; of repeated candidates with one key only one is returned.
    Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do null keys; vectors of
    different lengths are not compared.  With fewer candidates all are returned.
    """
    q = stored(packed(queries, key, vector, query_size))
    c = stored(packed(candidates, key, vector, block_size))
    # Rows of the grid by the bytes of queries a task holds, columns as many as keep all cores busy.
    cores = 4 * queries.sparkSession.sparkContext.defaultParallelism
    high = q.groupBy("dim").agg(F.ceil(F.sum(F.octet_length("rows")) / HELD_BYTES).cast("int").alias("high"))
    wide = c.groupBy("dim").agg(F.count("*").alias("blocks")).join(high, "dim")
    grid = wide.select("dim", "high", F.least("blocks", F.ceil(F.lit(cores) / F.col("high"))).cast("int").alias("wide"))
    grid = stored(grid)

    def dealt(n: str):
        return F.pmod(F.xxhash64("part"), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = q.join(grid, "dim").select("dim", dealt("high").alias("down"), every("wide").alias("across"), F.lit(0).alias("side"), "ids", "rows")
    right = c.join(grid, "dim").select("dim", every("high").alias("down"), dealt("wide").alias("across"), F.lit(1).alias("side"), "ids", "rows")
    cell = ["dim", "down", "across"]
    cells = left.unionByName(right).repartition(cores, *cell).sortWithinPartitions(*cell, "side")

    def tiles(batches):
        own, now = Cell(k), None
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["dim"], row["down"], row["across"])
                if at != now:
                    yield from own.found()
                    own, now = Cell(k), at
                ids, once = np.unique(np.frombuffer(row["ids"], np.int64), return_index=True)
                own.take(row["side"], ids, np.frombuffer(row["rows"], np.float64).reshape(-1, row["dim"])[once])
        yield from own.found()

    found = cells.mapInArrow(tiles, "query_id bigint, id bigint, score double")

    def merge(own: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[float, int]] = []
        for batch in batches:
            for item in zip(batch.column("score").to_pylist(), (-i for i in batch.column("id").to_pylist())):
                twin = next((x for x in heap if x[1] == item[1]), None)
                if twin:
                    if item > twin:
                        heap[heap.index(twin)] = item
                        heapq.heapify(heap)
                elif len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        best = sorted(heap, reverse=True)
        columns = [[own[0].as_py()] * len(best), range(1, len(best) + 1), [-i for _, i in best], [s for s, _ in best]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "rank", key, "score"])

    return found.groupBy("query_id").applyInArrow(merge, f"query_id bigint, rank int, `{key}` bigint, score double")
