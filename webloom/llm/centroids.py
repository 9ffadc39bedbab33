"""Exact k-means over whole-number vectors with ns-bounds.

Each component becomes floor(scale * x). The centroids of every round are kept. A vector remembers, for
each centroid, a distance and the round in which it was computed. In a later round that distance is off
by at most the norm of the centroid's *total* displacement since then, which is never more than the sum
of its drifts round by round. If all other centroids must be farther than the vector's own, it stays
where it is; otherwise its own distance is computed anew, and then those that are still in doubt, in
whole numbers, so that ties are exact and go to the smaller number. Only computed distances are stored,
with their round.

The state is one row per vector, written after each round to the shared folder: points as whole
numbers, distances in single precision (bounds leave room for its rounding). Partitions keep their
rows, nothing but partial sums is shuffled, and a lost task repeats its own part of one round. Sums are
exact: they travel in limbs of 40 bits and are added as decimals. Only the centroids (k rows) reach the
driver and the tasks.

Vectors that are null, of another length, or hold null or non-finite components take no part and give
no row. Rows without an id take part; as start centroids they come last. Equal ids start in order of
their vectors. Repeated rows count each for itself. With fewer vectors than k, there are as many
centroids. Components of any finite size are exact; a distance or sum that does not fit a long is
returned as null. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import materialize

#: Whole numbers below this are kept as int; squared distances of up to 64 of them fit a long.
NARROW = 1 << 27
LIMB_BITS = 40
#: Relative room for the rounding of a stored single-precision distance and of sums of bounds.
SLACK = 2.0 ** -21
#: Distances from here on are stored as this one, which is then no upper bound.
FARTHEST = float(np.finfo(np.float32).max)
_STATE = "point array<int>, wide array<double>, cluster int, distance long, reach array<float>, seen array<smallint>, n_distances int"


def whole_numbers(vector, scale: int) -> list[int]:
    """floor(scale * x) of each component, without overflow."""
    products = (scale * x for x in vector)
    return [math.floor(p) if math.isfinite(p) else math.floor(x) * scale for p, x in zip(products, vector, strict=True)]


def norm_above(difference: list[int]) -> float:
    """The norm of a vector of whole numbers, or a little more."""
    try:
        return float(math.isqrt(sum(x * x for x in difference)) + 1)
    except OverflowError:
        return math.inf


def fits_long(value: int) -> int | None:
    return value if -(1 << 63) <= value < 1 << 63 else None


@dataclass
class Rounds:
    """All centroids so far: ``history[t][k]`` is centroid k as the vectors of round t see it."""

    history: list[list[list[int]]]

    @property
    def current(self) -> list[list[int]]:
        return self.history[-1]

    def displacement(self) -> np.ndarray:
        """``[t, k]``: how far centroid k is now from where it was in round t."""
        now = self.current
        moved = [[norm_above([a - b for a, b in zip(old, new, strict=True)]) if old != new else 0.0
                  for old, new in zip(then, now, strict=True)] for then in self.history]
        return np.array(moved).reshape(len(self.history), len(now))

    @property
    def narrow(self) -> bool:
        """Whether squared distances of narrow points fit a long."""
        return len(self.current[0]) <= 64 and all(-NARROW < c < NARROW for centroid in self.current for c in centroid)

    def squared(self, points: np.ndarray, k: int) -> np.ndarray:
        """Exact squared distances of the points to centroid k now."""
        kind = np.int64 if self.narrow else object
        difference = points.astype(kind) - np.array(self.current[k], kind)
        return (difference * difference).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots as doubles, of whole numbers of any size."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([math.sqrt(s) if s < 1 << 1000 else norm_above([math.isqrt(s)]) for s in squares.tolist()])


def assign(rounds: Rounds, points: np.ndarray, cluster: np.ndarray, reach: np.ndarray, seen: np.ndarray):
    """Nearest centroid of each point, its exact squared distance where it was computed (else -1), and
    how many distances each point needed. ``reach`` and ``seen`` are brought up to date in place; a
    ``seen`` of -1 stands for a distance that is not known yet."""
    n, k = reach.shape
    rows = np.arange(n)
    now = len(rounds.history) - 1
    drift = rounds.displacement()[np.maximum(seen, 0), np.arange(k)]
    own, own_drift = reach[rows, cluster], drift[rows, cluster]
    with np.errstate(invalid="ignore", over="ignore"):
        lower = np.where(seen < 0, -np.inf, reach * (1 - SLACK) - drift * (1 + SLACK))
        upper = np.where((seen[rows, cluster] < 0) | (own >= FARTHEST), np.inf, own * (1 + SLACK) + own_drift * (1 + SLACK))
    lower[rows, cluster] = np.inf
    # Written so that a bound that is no number counts as doubt.
    doubt = ~(upper[:, None] < lower)
    doubt[rows, cluster] = False
    exact = np.full(n, -1, np.int64 if rounds.narrow else object)
    computed = np.zeros(n, np.int32)

    def look(at: np.ndarray, number: int) -> np.ndarray:
        found = rounds.squared(points[at], number)
        reach[at, number] = np.minimum(roots(found), FARTHEST)
        seen[at, number] = now
        computed[at] += 1
        return found

    former = cluster.copy()
    waiting = doubt.any(axis=1)
    for number in range(k):
        at = np.flatnonzero(waiting & (former == number))
        if len(at):
            exact[at] = look(at, number)
            upper[at] = roots(exact[at]) * (1 + SLACK)
    for number in range(k):
        at = np.flatnonzero(doubt[:, number] & ~(upper < lower[:, number]))
        if not len(at):
            continue
        found, held = look(at, number), exact[at]
        nearer = ((found < held) | ((found == held) & (number < cluster[at]))).astype(bool)
        exact[at[nearer]] = found[nearer]
        cluster[at[nearer]] = number
        upper[at[nearer]] = roots(found[nearer]) * (1 + SLACK)
    return cluster, exact, computed


def kept_vectors(vectors: DataFrame, size: int, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where((F.size(v) == size) & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(key).alias("vec_id"), v.cast("array<double>").alias("v"))


def start_centroids(kept: DataFrame, k: int, scale: int, seed: str = "1:") -> list[list[int]]:
    """The vectors with the k smallest hashes of their ids."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    return [whole_numbers(row.v, scale) for row in first]


def _matrix(column: pa.ListArray, kind, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(matrix: np.ndarray, present: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per row where ``present``, taken in order from the matrix, else null."""
    ends = np.cumsum(np.r_[0, np.where(present, matrix.shape[1], 0)])
    offsets = pa.array(ends, pa.int32(), mask=np.r_[~present, False])
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), kind))


def _assign_batches(rounds: Rounds, size: int, scale: int, first: bool, last: bool):
    """Rows of the state after one more assignment; the first round reads ``(vec_id, v)``."""
    k = len(rounds.current)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if first:
                vectors = _matrix(batch.column("v"), np.float64, size)
                with np.errstate(over="ignore"):
                    products = np.floor(vectors * scale)
                narrow = (np.abs(products) < NARROW).all(axis=1)
                points, wide = products[narrow].astype(np.int64), vectors[~narrow]
                cluster, before = np.zeros(len(points), np.int64), np.zeros(n, np.int32)
                reach, seen = np.zeros((len(points), k), np.float64), np.full((len(points), k), -1, np.int64)
            else:
                narrow = batch.column("point").is_valid().to_numpy(zero_copy_only=False)
                points, wide = _matrix(batch.column("point"), np.int64, size), _matrix(batch.column("wide"), np.float64, size)
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)[narrow]
                before = batch.column("n_distances").to_numpy(zero_copy_only=False)
                reach, seen = _matrix(batch.column("reach"), np.float64, k), _matrix(batch.column("seen"), np.int64, k)
            cluster, exact, computed = assign(rounds, points, cluster, reach, seen)
            if last:  # distances that the bounds made unnecessary until now
                for number in range(k):
                    at = np.flatnonzero((cluster == number) & (exact == -1))
                    exact[at] = rounds.squared(points[at], number)
            clusters, distances, counts = np.zeros(n, np.int32), np.full(n, None, object), before.copy()
            clusters[narrow], counts[narrow] = cluster, before[narrow] + computed
            distances[narrow] = [fits_long(int(d)) if d >= 0 else None for d in exact]
            for row, vector in zip(np.flatnonzero(~narrow).tolist(), wide.tolist(), strict=True):
                point = whole_numbers(vector, scale)
                squares = [sum((a - b) ** 2 for a, b in zip(point, c, strict=True)) for c in rounds.current]
                clusters[row] = squares.index(min(squares))
                distances[row] = fits_long(min(squares))
                counts[row] += k
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), _lists(points, narrow, pa.int32()), _lists(wide, ~narrow, pa.float64()),
                pa.array(clusters, pa.int32()), pa.array(distances.tolist(), pa.int64()),
                _lists(reach, narrow, pa.float32()), _lists(seen, narrow, pa.int16()), pa.array(counts, pa.int32()),
            ], ["vec_id", "point", "wide", "cluster", "distance", "reach", "seen", "n_distances"])

    return run


def _limbs(value: int):
    """``value`` as signed limbs: the sum of ``limb << LIMB_BITS * number``."""
    number, sign = 0, -1 if value < 0 else 1
    value = abs(value)
    while value:
        yield number, sign * (value & (1 << LIMB_BITS) - 1)
        value >>= LIMB_BITS
        number += 1


def _partial_sums(size: int, scale: int, k: int):
    """Per partition, cluster and component the sum; the count stands in the slot after the last component."""

    def run(batches):
        counts, sums, wide_sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64), {}
        for batch in batches:
            narrow = batch.column("point").is_valid().to_numpy(zero_copy_only=False)
            points, wide = _matrix(batch.column("point"), np.int64, size), _matrix(batch.column("wide"), np.float64, size)
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            counts += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster[narrow], points)
            for number, vector in zip(cluster[~narrow].tolist(), wide.tolist(), strict=True):
                held = wide_sums.setdefault(number, [0] * size)
                wide_sums[number] = [a + b for a, b in zip(held, whole_numbers(vector, scale), strict=True)]
        rows = []
        for number in np.flatnonzero(counts).tolist():
            extra = wide_sums.get(number, [0] * size)
            values = [a + b for a, b in zip(sums[number].tolist(), extra, strict=True)] + [int(counts[number])]
            rows += [(number, slot, *limb) for slot, value in enumerate(values) for limb in _limbs(value)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cluster", "slot", "limb", "value"])

    return run


def moved_centroids(state: DataFrame, rounds: Rounds, size: int, scale: int) -> list[list[int]]:
    """The exact floored means of the clusters; empty clusters keep their centroid."""
    k = len(rounds.current)
    partial = state.select("point", "wide", "cluster").mapInArrow(
        _partial_sums(size, scale, k), "cluster int, slot int, limb int, value long")
    totals = partial.groupBy("cluster", "slot", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums = [[0] * (size + 1) for _ in range(k)]
    for row in totals:
        sums[row.cluster][row.slot] += int(row.value) << LIMB_BITS * row.limb
    return [[s // own[size] for s in own[:size]] if own[size] else old for own, old in zip(sums, rounds.current, strict=True)]


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64,
                    key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector that takes part: ``vec_id, cluster, distance`` (squared, to its centroid),
    ``cluster_inertia`` and ``inertia`` (its sums), ``centroid_sha256`` (of the components, joined by
    commas) and ``n_distances``, the distances that were computed for the vector in all rounds, of
    ``k * (rounds + 1)``."""
    if k < 1 or rounds < 0 or size < 1:
        raise ValueError("k and size must be positive, rounds not negative")
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    state = kept_vectors(vectors, size, key, vector)
    seen = Rounds([start_centroids(state, k, scale)])
    if not seen.current:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string, n_distances int")
    for number in range(rounds + 1):
        step = _assign_batches(seen, size, scale, number == 0, number == rounds)
        state = state.mapInArrow(step, f"vec_id {kind}, {_STATE}")
        if number == rounds:
            state = state.select("vec_id", "cluster", "distance", "n_distances")
        state = materialize(state, f"centroids-{number}")
        if number < rounds:
            seen = Rounds([*seen.history, moved_centroids(state, seen, size, scale)])
    sums = state.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), (F.count("*") == F.count("distance")).alias("known")).collect()
    inertia = {row.cluster: fits_long(int(row.total)) if row.known else None for row in sums}
    whole = None if None in inertia.values() else fits_long(sum(inertia.values()))
    rows = [(number, inertia[number], whole, hashlib.sha256(",".join(map(str, seen.current[number])).encode()).hexdigest())
            for number in sorted(inertia)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster: k at most.
    return state.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")
