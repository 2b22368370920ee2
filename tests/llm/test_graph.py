import random

import pytest
from sparkbars.llm.common import bucket_bounds, bucket_of
from sparkbars.llm.graph import components
from pyspark.sql import functions as F


def brute(edges):
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    moved = True
    while moved:
        moved = False
        for u, v in edges:
            if u in low and v in low and u != v and low[u] != low[v]:
                low[u] = low[v] = min(low[u], low[v])
                moved = True
    return low


@pytest.mark.parametrize("shape", ["random", "star", "chain", "odd"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)], "star": [(0, i) for i in range(1, 200)],
             "chain": [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)], "odd": [(1, 1), (2, None), (None, 3), (4, 5), (5, 4), (4, 5)]}[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == brute(edges)


def test_components_of_names_and_none(spark):
    got = components(spark.createDataFrame([("b", "c"), ("c", "a")], "u string, v string"))
    assert {r.node: r.component for r in got.collect()} == {"a": "a", "b": "a", "c": "a"}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_buckets_keep_the_order(spark):
    df = spark.createDataFrame([(i if i % 9 else None,) for i in range(500)], "x bigint")
    bounds = bucket_bounds(df, "x", 8)
    rows = df.select("x", bucket_of("x", bounds).alias("b")).orderBy(F.asc_nulls_first("x")).collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows}) == 8
    assert bucket_bounds(df.limit(0), "x", 8) == [] and df.select(bucket_of("x", []).alias("b")).distinct().count() == 1
