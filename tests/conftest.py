from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plazametrics.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    session.stop()


def apply(spark, fn, cases):
    """Results of a column function over a list of argument tuples, in order."""
    from pyspark.sql import functions as F

    width = len(cases[0])
    names = [f"a{i}" for i in range(width)]
    rows = [(i, *case) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    out = df.select("i", fn(*[F.col(n) for n in names]).alias("r")).orderBy("i").collect()
    return [row["r"] for row in out]
