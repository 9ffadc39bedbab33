"""Nearest neighbours by a block matrix join with int8 tiles and error bounds.

Candidates are dealt to groups of bounded size, and every query is sent to each group. A task holds
its group as int8 codes with a scale and the exact norm of the rounding error of each vector. Block by
block, products of codes give a distance for each pair, which by the triangle inequality is off by at
most the two error norms. A pair whose lower bound is above the k-th smallest upper bound is out; the
others are computed in double precision from the original vectors. A heap per query keeps the
k nearest of the group, and the groups' answers are merged in the same order. No pair is lost, so
recall is 1; the codes only save work.

Vectors that are null, empty, all zero, or hold null or non-finite components take no part, as query or
candidate, and neither do rows without an id. Vectors of different lengths are never compared. Ties go
to the smaller id. Rows with the query's own id are left out; repeated rows of a candidate each count.
Components may have any finite size; a distance above the largest double is infinite. Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates that one task holds: about 100 MB at 64 dimensions.
GROUP_ROWS = 200_000
TILE_QUERIES, TILE_ROWS = 256, 4096
#: Pairs that are computed exactly at once.
PAIRS = 1 << 16
#: Vectors whose largest component is outside are never left out by their codes.
SMALLEST, LARGEST = 1e-100, 1e100


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v)`` of the vectors that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


class Quantised:
    """int8 codes of the rows of a matrix."""

    def __init__(self, rows: np.ndarray):
        # Products of codes are whole numbers below 2^24 up to a thousand dimensions: exact as float32.
        self.kind = np.float32 if rows.shape[1] <= 1000 else np.float64
        largest = np.abs(rows).max(axis=1)
        # Where squares would leave the range of doubles nothing is known from the codes: the pair is computed.
        odd = (largest < SMALLEST) | (largest > LARGEST)
        rows = np.where(odd[:, None], 1.0, rows)
        self.scale = np.where(odd, 1.0, largest) / 127
        self.codes = np.rint(rows / self.scale[:, None]).astype(np.int8)
        rounded = self.codes * self.scale[:, None]
        self.error = np.sqrt(((rows - rounded) ** 2).sum(axis=1))
        self.error[odd] = np.inf
        self.square = (rounded ** 2).sum(axis=1)

    def bounds(self, other: Quantised, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Distances between the rounded rows and rows ``at`` of ``other``, and how far off they may be."""
        products = self.codes.astype(self.kind) @ other.codes[at].astype(self.kind).T
        cross = products.astype(np.float64) * self.scale[:, None] * other.scale[at][None, :]
        squares = self.square[:, None] + other.square[at][None, :]
        # Rounding of this very sum: far below the quantisation error, but never left out.
        slack = 1e-7 * np.sqrt(squares)
        near = np.sqrt(np.maximum(squares - 2 * cross, 0))
        return near, self.error[:, None] + other.error[at][None, :] + slack


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed in order of the components.

    Where squares overflow or vanish, the differences are first divided by a power of two.
    """
    def summed(a, b, unit=1.0):
        total = np.zeros(len(a))
        for j in range(a.shape[1]):
            total += ((a[:, j] - b[:, j]) / unit) ** 2
        return np.sqrt(total)

    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        found = summed(a, b)
        odd = np.flatnonzero(~np.isfinite(found) | (found < SMALLEST))
        if len(odd):
            most = np.abs(a[odd] - b[odd]).max(axis=1)
            some = (most > 0) & np.isfinite(most)
            at = odd[some]
            unit = np.exp2(np.clip(np.floor(np.log2(most[some])), -1000, 1000))
            found[at] = summed(a[at], b[at], unit) * unit
    return found


def search_group(ids: np.ndarray, rows: np.ndarray, codes: Quantised, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """``(query, id, distance)`` of each query's k nearest of a group, own ids left out."""
    wanted = Quantised(queries)
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]  # negated: the farthest on top
    for begin in range(0, len(ids), TILE_ROWS):
        at = slice(begin, begin + TILE_ROWS)
        near, error = wanted.bounds(codes, at)
        upper = near + error
        upper[query_ids[:, None] == ids[at][None, :]] = np.inf
        limit = np.full(len(query_ids), np.inf)
        if upper.shape[1] >= k:
            limit = np.partition(upper, k - 1, axis=1)[:, k - 1]
        limit = np.minimum(limit, [-h[0][0] if len(h) == k else np.inf for h in heaps])
        q, c = np.nonzero((near - error <= limit[:, None]) & (query_ids[:, None] != ids[at][None, :]))
        for first in range(0, len(q), PAIRS):
            some = slice(first, first + PAIRS)
            exact = distances(queries[q[some]], rows[at][c[some]])
            for query, vec_id, distance in zip(q[some].tolist(), ids[at][c[some]].tolist(), exact.tolist(), strict=True):
                heap, item = heaps[query], (-distance, -vec_id)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
    return [(query_ids[i], -vec_id, -d) for i, heap in enumerate(heaps) for d, vec_id in heap]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest candidates of each query, all if fewer."""
    asked, given = usable(queries, key, vector), usable(candidates, key, vector)
    spark = candidates.sparkSession
    groups = max(spark.sparkContext.defaultParallelism, -(-given.count() // group_rows))

    def search(batches):
        # The partition is sorted: candidates of each group and length first, then the queries.
        group, parts, ids, rows, codes = None, [], None, None, None
        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "size", "asked", "id")]
            values = batch.column("v")
            flat = values.flatten().to_numpy(zero_copy_only=False)
            offsets = values.offsets.to_numpy() - values.offsets[0].as_py()
            step = np.flatnonzero(np.r_[True, (np.diff(numbers[0]) != 0) | (np.diff(numbers[1]) != 0) | (np.diff(numbers[2]) != 0)])
            for begin, end in zip(step, np.r_[step[1:], len(numbers[0])], strict=True):
                here = (numbers[0][begin], numbers[1][begin])
                vectors = flat[offsets[begin]:offsets[end]].reshape(end - begin, -1)
                if here != group:
                    group, parts, rows = here, [], None
                if not numbers[2][begin]:
                    parts.append((numbers[3][begin:end], vectors))
                    continue
                if rows is None and parts:
                    ids, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
                    codes, parts = Quantised(rows), []
                if rows is None:
                    continue
                for first in range(0, end - begin, TILE_QUERIES):
                    some = slice(first, first + TILE_QUERIES)
                    found = search_group(ids, rows, codes, numbers[3][begin:end][some], vectors[some], k)
                    columns = list(zip(*found, strict=True)) or [(), (), ()]
                    kinds = (pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"])

    # Dealt by a hash of id and vector, so that repeated ids spread too; equal rows may share a group.
    dealt = given.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).alias("group"), F.lit(0).alias("asked"), "id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(1).alias("asked"), "id", "v")
    both = dealt.unionByName(sent).withColumn("size", F.size("v"))
    found = (both.repartition(groups, "group").sortWithinPartitions("group", "size", "asked")
             .mapInArrow(search, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
