"""Restarts and repetitions over few rows: as many jobs whatever the number of steps, and the results of distributed passes."""

from __future__ import annotations

import numpy as np
import pytest

from plazametrics.operators import cluster, composition, resident


@pytest.fixture
def jobs(spark):
    def count(work):
        spark.sparkContext.setJobGroup("counted", "counted")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        result = work()
        after = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return result, after - before

    return count


def test_kmeans_of_few_numbers_takes_no_job_a_step(spark, jobs, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "i bigint, x array<double>").repartition(3)
    runs, used = jobs(lambda: cluster.kmeans(df, "i", "x", (2, 4), range(3)))
    monkeypatch.setattr(resident, "HELD_NUMBERS", 0)
    passes, each = jobs(lambda: cluster.kmeans(df, "i", "x", (2, 4), range(3)))
    assert used < each / 2
    for a, b in zip(runs, passes):
        assert (a.k, a.seed, a.done, b.done) == (b.k, b.seed, True, True)
        np.testing.assert_allclose(a.centres, b.centres, atol=1e-12)


def test_shuffled_columns_and_holdout_of_few_numbers_stay_in_their_tasks(spark, jobs, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in x]) for i, x in enumerate(rng.poisson(rng.gamma(2.0, 4.0, size=(60, 5))))]
    df = spark.createDataFrame(rows, "v bigint, counts array<double>").repartition(3).checkpoint()
    work = lambda: (
        sorted(composition.parallel_analysis(df, "v", reps=12).collect()),
        sorted(composition.holdout_reconstruction(df, "v", max_k=3, iterations=12).collect()),
    )
    found, used = jobs(work)
    monkeypatch.setattr(resident, "HELD_NUMBERS", 0)
    passes, each = jobs(work)
    assert used < each / 2 and found == passes
