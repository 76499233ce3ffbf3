from __future__ import annotations

import hashlib

import numpy as np
import pytest

from plazametrics.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, _ints int"


def by_force(rows, size, k, rounds):
    """Plain Lloyd on Python integers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, v, far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        groups = {}
        for _, v, c, _ in assign():
            groups.setdefault(c, []).append(v)
        for c, vs in groups.items():
            centres[c] = [sum(x) // len(vs) for x in zip(*vs)]
    last = assign()
    inertia = {c: sum(r[3] for r in last if r[2] == c) for c in range(k)}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name[c]) for i, _, c, d in last), key=str)


def fit(spark, rows, size, k, rounds=5, pivots=centroids.PIVOTS):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    found = centroids.clustered(centroids.fitted(df, size=size, k=k, rounds=rounds, pivots=pivots))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("pivots", [1, 3, 32])
def test_equals_plain_lloyd(spark, pivots):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in middles[i % 6] + 0.4 * rng.normal(size=8)]) for i in range(300)]
    assert fit(spark, rows, 8, 12, pivots=pivots) == by_force([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 8, 12, 5)


def test_nulls_ties_repeated_rows_and_wrong_vectors(spark):
    point = [[0.0, 0.0], [1.0, 0.0], [0.5, 0.0], [-1.5, 0.25]]
    rows = [(i % 7, point[i % 4]) for i in range(40)] + [(None, [2.0, 2.0]), (50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [float("nan"), 0.0]), (55, [float("inf"), 0.0]), (56, [1.0, 2.0, 3.0])]
    for k in (1, 5, 60):
        assert fit(spark, rows, 2, k) == by_force(rows, 2, k, 5)


def test_empty_table(spark):
    assert fit(spark, [], 4, 3) == [] and fit(spark, [(1, [1.0])], 4, 3) == []


def test_vectors_of_one_value(spark):
    rows = [(i, [0.5, 0.5, 0.5]) for i in range(20)]
    assert fit(spark, rows, 3, 4) == by_force(rows, 3, 4, 5)


def test_refuses_what_64_bits_cannot_hold(spark):
    with pytest.raises(Exception, match="no exact 64-bit distance"):
        fit(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])], 2, 2)


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, size=(500, 16))
    centres = np.vstack([x[:10], rng.integers(-20, 20, size=(4, 16))])
    simplex = centroids.Simplex.of(centres, 11)
    exact = centroids.squared_distances(x, centres)
    own, theirs = (simplex.apexes(centroids.squared_distances(p, simplex.pivots)) for p in (x, centres))
    lower = ((own[:, None] - theirs) ** 2).sum(2)
    upper = lower + 4 * own[:, None, -1] * theirs[:, -1]
    assert (lower <= exact + 1e-3).all() and (upper >= exact - 1e-3).all()
    rows, picks = centroids.candidates(own.astype(np.float32), theirs)
    assert set(zip(range(500), exact.argmin(1).tolist())) <= set(zip(rows.tolist(), picks.tolist())) and len(rows) < 0.5 * exact.size
