import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from webloom.llm import centroids


def plain(vectors, k, rounds, size, scale):
    """Lloyd's rounds in whole numbers, every distance computed."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], v) for i, v in vectors
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    centres = [p for _, p, _ in order[:k]]
    for t in range(rounds + 1):
        squares = [[sum((a - b) ** 2 for a, b in zip(p, c)) for c in centres] for _, p, _ in kept]
        own = [s.index(min(s)) for s in squares]
        if t < rounds:
            for c in range(len(centres)):
                members = [p for (_, p, _), o in zip(kept, own) if o == c]
                if members:
                    centres[c] = [sum(column) // len(members) for column in zip(*members)]
    distances = [min(s) for s in squares]
    short = lambda x: x if x < 1 << 63 else None
    inertia = {c: short(sum(d for d, o in zip(distances, own) if o == c)) for c in set(own)}
    whole = short(sum(distances))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, o, short(d), inertia[o], whole, sha[o]) for (i, _, _), o, d in zip(kept, own, distances)), key=str)


def run(spark, vectors, kind="array<double>", parts=3, **settings):
    table = spark.createDataFrame([(*v, 7, "x", 1.5) for v in vectors], f"vec_id long, embedding {kind}, cluster int, v string, distance double")
    return centroids.cluster_vectors(table.repartition(parts), **settings)


def compare(spark, vectors, k, rounds, size, scale, **more):
    got = run(spark, vectors, k=k, rounds=rounds, size=size, scale=scale, **more).drop("n_distances").collect()
    assert sorted(map(tuple, got), key=str) == plain(vectors, k, rounds, size, scale)
    return got


@pytest.mark.parametrize("k, rounds", [(5, 6), (1, 2), (40, 3), (3, 0)])
def test_against_plain_rounds(spark, k, rounds):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 4))
    vectors = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=4) * 0.4]) for i in range(300)]
    compare(spark, vectors, k, rounds, 4, 64)


def test_ties_and_empty_clusters(spark):
    # A grid of few points: equal distances everywhere, equal start centroids, clusters that stay empty.
    vectors = [(i, [float(i % 3), float(i % 2)]) for i in range(60)] + [(7, [0.5, 0.5]), (7, [0.5, -0.5]), (7, [0.5, 0.5])]
    for k in (2, 4, 9, 20):
        compare(spark, vectors, k, 4, 2, 2)


def test_vectors_that_take_no_part(spark):
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.25, 0.0]), (None, [3.0, 4.0]), (None, [3.0, -4.0]), (3, [0.0, 0.0])]
    bad = [(4, None), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [1.0, float("-inf")])]
    for k in (2, 5, 16):
        got = compare(spark, good + bad, k, 3, 2, 64)
        assert len(got) == len(good)


def test_components_of_any_size(spark):
    vectors = [(i, [float(i), float(-i)]) for i in range(20)]
    vectors += [(100, [1e30, 1.0]), (101, [1e30, 1e12]), (102, [-1e200, 3.0]), (103, [1e308, -1e308]), (104, [2.0 ** 21, 1.0]),
                (105, [2.0 ** 21 - 0.02, -2.0 ** 21]), (106, [1e-320, -1e-320]), (107, [3e9, 3e9])]
    for k in (2, 6, 12):
        got = compare(spark, vectors, k, 3, 2, 64)
        assert any(r.distance is None for r in got)


def test_single_precision_input_and_empty_table(spark):
    vectors = [(i, [float(np.float32(0.1 * i)), float(np.float32(-0.3))]) for i in range(50)]
    compare(spark, vectors, 4, 3, 2, 64, kind="array<float>")
    empty = run(spark, [], size=2)
    assert empty.count() == 0 and empty.columns == run(spark, vectors, size=2).columns
    assert run(spark, [(1, None), (2, [1.0])], size=2).count() == 0
    with pytest.raises(ValueError):
        run(spark, vectors, k=0)


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 20
    vectors = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=16)]) for i in range(800)]
    table = run(spark, vectors, k=8, rounds=6, size=16)
    computed = table.agg({"n_distances": "sum"}).first()[0]
    assert computed < 0.5 * 800 * 8 * 7


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda size: st.tuples(
    st.lists(st.lists(st.integers(-3, 3), min_size=size, max_size=size), min_size=1, max_size=12),
    st.lists(st.lists(st.lists(st.integers(-3, 3), min_size=size, max_size=size), min_size=3, max_size=3), min_size=1, max_size=6))))
def test_bounds_lose_nothing(data):
    """Whatever way the centroids go, each assignment equals a full search with ties to the smaller number."""
    points, history = np.array(data[0]), data[1]
    n = len(points)
    cluster, reach, seen = np.zeros(n, np.int64), np.zeros((n, 3)), np.full((n, 3), -1)
    for t in range(len(history)):
        rounds = centroids.Rounds(history[:t + 1])
        cluster, exact, _ = centroids.assign(rounds, points, cluster, reach, seen)
        reach = reach.astype(np.float32).astype(np.float64)
        squares = ((points[:, None, :] - np.array(history[t])[None]) ** 2).sum(axis=2)
        assert cluster.tolist() == squares.argmin(axis=1).tolist()
        assert all(e in (-1, s) for e, s in zip(exact, squares.min(axis=1)))


def test_displacement_is_that_of_the_whole_way():
    """There and back again: the sum of drifts is 20, the total displacement 0."""
    rounds = centroids.Rounds([[[0, 0]], [[10, 0]], [[0, 0]]])
    assert rounds.displacement()[0, 0] == 0 and 10 <= rounds.displacement()[1, 0] <= 11


def test_whole_numbers():
    assert centroids.whole_numbers([0.5, -0.001, -1.0, 1e308, -1e308], 64) == [32, -1, -64, int(1e308) * 64, -int(1e308) * 64]
    for value in (0, 5, -5, 1 << 200, -(1 << 199) + 3):
        assert sum(limb << centroids.LIMB_BITS * n for n, limb in centroids._limbs(value)) == value
