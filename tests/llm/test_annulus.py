import hashlib
import random

import numpy as np
import pytest

from scriptloom.llm import annulus

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds, dim):
    """By the contract's words, in Python's whole numbers."""
    kept = [(i, [min(max(int(np.floor(64 * x)) if abs(x) < 1e300 else (1 << 62) * (1 if x > 0 else -1), -(1 << 62)), 1 << 62) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, of, strict=True) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    top = (1 << 63) - 1
    inertia = {n: sum(d for _, d, m in found if m == n) for n in range(len(centroids))}
    return sorted(((i, n, min(d, top), min(inertia[n], top), min(sum(inertia.values()), top), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 16])
def test_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 20])).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (900, None), (901, [1.0]), (902, []), (903, [float("nan")] * 6), (904, [None] * 6), (905, [float("inf")] * 6), (906, [0.0] * 6), (None, [1.0] * 6), (None, [2.0] * 6)]
    assert got(annulus.cluster(table(spark, rows), k=k, dim=6)) == brute(rows, k, 3, 6)


def test_ties_and_equal_lengths(spark):
    """Points of a lattice: many distances are equal, and centroids have equal lengths."""
    rng = random.Random(2)
    rows = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(4)]) for i in range(200)]
    assert got(annulus.cluster(table(spark, rows), k=12, dim=4)) == brute(rows, 12, 3, 4)


def test_large_components(spark):
    """Whole numbers beyond doubles, beyond 64 bits, and beyond the limit."""
    for most in (2.0**20, 2.0**27, 2.0**40, 1e300):
        rng = np.random.default_rng(5)
        rows = [(i, (rng.uniform(-1, 1, size=4) * most).tolist()) for i in range(40)]
        assert got(annulus.cluster(table(spark, rows), k=5, dim=4)) == brute(rows, 5, 3, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.5, 2.0])]
    assert got(annulus.cluster(table(spark, rows), dim=2)) == brute(rows, 16, 3, 2)
    assert annulus.cluster(table(spark, rows).filter("vec_id > 5"), dim=2).collect() == []
    assert annulus.cluster(table(spark, rows)).collect() == []  # none has 64 components


def test_bounds_spare_comparisons():
    """Centroids of other lengths are not compared; labels of the last round spare more than none do."""
    rng = np.random.default_rng(1)
    centre = np.rint(rng.normal(size=(64, 8)) * np.geomspace(10, 100_000, 64)[:, None]).astype(np.int64)
    x = centre[rng.integers(0, 64, 2000)] + rng.integers(-3, 4, (2000, 8))
    annuli = annulus.Annuli(centre)
    labels, distances, compared = annuli.nearest(x, None)
    again, same, fewer = annuli.nearest(x, labels)
    d = annulus.squared(x, centre)
    assert (labels == d.argmin(axis=1)).all() and (distances == d.min(axis=1)).all() and (again == labels).all() and (same == distances).all()
    assert fewer <= compared < 0.2 * 64 * 2000


def test_blocks_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(100)]
    want = got(annulus.cluster(table(spark, rows), k=4, dim=3))
    monkeypatch.setattr(annulus, "TILE_ROWS", 7)
    assert got(annulus.cluster(table(spark, rows), k=4, dim=3)) == want == brute(rows, 4, 3, 3)
