"""Sums over all pairs of rows: against plain loops, in several blocks and tiles, with tasks of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plazametrics.operators import cluster, composition
from plazametrics.operators.blocks import block_pairs, block_sums, distances, stack


def test_sums_of_a_pair_of_blocks_are_added_before_they_leave(spark):
    x = np.random.default_rng(5).normal(size=(97, 3))
    ids = [None if i == 3 else i // 2 if i < 10 else i for i in range(97)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "i bigint, x array<double>").repartition(3)

    def kernel(left, right, same):
        d = distances(left[0], right[0])
        return d.sum(axis=1, keepdims=True), d.sum(axis=0)[:, None]

    def finish(rows, sums, times):
        return pd.DataFrame({"i": rows["i"], "s": sums[:, 0], "times": times})

    found = block_sums(
        df, "i", ["x"], lambda p: (stack(p["x"]),), kernel, 1, finish, "i bigint, s double, times bigint", keep=[], block_rows=20, tile_rows=7
    ).collect()
    whole = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).sum(axis=1)
    want = pd.DataFrame({"i": pd.array(ids, "Int64"), "s": whole}).groupby("i", dropna=False)["s"].agg(["sum", "size"])
    want = {None if pd.isna(i) else i: (round(s, 8), n) for i, (s, n) in zip(want.index, want.to_numpy())}
    assert len(found) == len(want)
    assert {r["i"]: (round(r["s"], 8), r["times"]) for r in found} == want


def test_medoids_equal_plain_ones_in_small_blocks(spark):
    x = np.random.default_rng(6).normal(size=(60, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i bigint, x array<double>").repartition(3)
    runs = cluster.kmedoids(df, "i", "x", (2, 3), range(2), block_rows=16, tile_rows=5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for run, start in zip(runs, cluster.random_starts(df, "i", "x", [2, 3], [0, 1])):
        ids, before = list(start.ids), None
        while before != set(ids):
            before, label = set(ids), d[:, ids].argmin(axis=1)
            ids = [int(min(np.flatnonzero(label == g), key=lambda i, g=g: (d[i, label == g].sum(), i))) for g in range(run.k)]
        assert set(run.ids) == set(ids)


def test_pairs_of_little_data_have_tasks_of_their_own(spark):
    df = spark.range(300).select(F.col("id").alias("i"))
    tasks = block_pairs(df, "i", [], lambda a, b, same: pd.DataFrame({"n": [len(a) * len(b)]}), "n bigint", block_rows=100)
    held = tasks.select(F.spark_partition_id().alias("p")).distinct().count()
    assert held == 6


def test_distances_of_near_far_and_missing_rows():
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=(30, 4)), 1e6 + 1e-3 * rng.normal(size=(9, 4))])
    b = np.concatenate([a[:5], rng.normal(size=(20, 4)), 1e6 + 1e-3 * rng.normal(size=(7, 4))])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    np.testing.assert_allclose(distances(a, b), want, rtol=1e-9)
    assert (np.diag(distances(a[:5], b[:5])) == 0).all()
    lone = rng.normal(size=(400, 4))
    np.testing.assert_allclose(distances(lone, lone[::-1]), np.sqrt(((lone[:, None] - lone[::-1][None]) ** 2).sum(axis=2)), rtol=1e-11)
    b[0, 0] = np.nan
    assert np.isnan(distances(a, b)[:, 0]).all() and np.isfinite(distances(a, b)[:, 1:]).all()


def test_null_is_drawn_where_its_pairs_meet(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.poisson(6.0, size=(50, 4)))]
    df = spark.createDataFrame(rows, "v bigint, counts array<double>").repartition(3)
    drawn = composition.multinomial_null(df, "v", 3).withColumn("x", composition.clr(F.col("counts")))
    want = composition.distance_statistics(drawn, "v", "x", ["rep"]).collect()
    found = composition.null_statistics(df, "v", 3, block_rows=20, tile_rows=8).collect()
    assert len(found) == 3
    for a, b in zip(sorted(found), sorted(want)):
        np.testing.assert_allclose([float(x) for x in a], [float(x) for x in b], rtol=1e-10)


def test_edges_in_both_directions_are_computed_once(spark):
    from plazametrics.operators import pairs

    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25)], "a bigint, b bigint, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = pairs.both_directions(edges)
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, both.collect())) == [(1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.25), (3, 2, 0.25)]
