"""Exact order statistics under ties and skew."""

import math
import random
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkbars.operators import scale


def skewed(spark):
    """One group holds most rows, one value of it a third of them; signs, zeros and NULLs included."""
    rng = np.random.default_rng(3)
    big = np.concatenate([np.zeros(1000), rng.normal(0, 1, 1500), rng.integers(-3, 3, 500) / 7.0])
    rows = [("big", i, float(x)) for i, x in enumerate(big)] + [("small", i, float(x)) for i, x in enumerate(rng.lognormal(3, 2, 41))]
    rows += [("big", 9001, None), ("tiny", 0, 5.0)]
    return spark.createDataFrame(rows, "g string, id int, x double"), pd.DataFrame(rows, columns=["g", "id", "x"])


def test_ranks_equal_pandas(spark):
    df, pdf = skewed(spark)
    got = scale.with_ranks(df, ["g"], "x").toPandas().sort_values(["g", "id"], ignore_index=True)
    want = pdf.sort_values(["g", "id"], ignore_index=True)
    want["rank"] = want.groupby("g")["x"].rank(method="min")
    np.testing.assert_allclose(got["rank"].to_numpy(float), want["rank"].to_numpy(float), equal_nan=True)
    assert set(got.dropna().groupby("g")["n"].max().items()) == {("big", 3000), ("small", 41), ("tiny", 1)}


def test_quantiles_equal_pandas(spark):
    df, pdf = skewed(spark)
    got = scale.group_quantiles(df, ["g"], "x", {"q1": 0.25, "med": 0.5, "q9": 0.9}).toPandas().set_index("g").sort_index()
    for name, q in (("q1", 0.25), ("med", 0.5), ("q9", 0.9)):
        np.testing.assert_allclose(got[name], pdf.groupby("g")["x"].quantile(q).sort_index())


def test_cumulate_descending(spark):
    df, pdf = skewed(spark)
    got = scale.cumulate(df.filter("g = 'big'"), ["g"], "x", {"n": F.count(F.lit(1))}, descending=True).toPandas()
    x = pdf[pdf.g == "big"]["x"].dropna().to_numpy()
    for row in got.sample(50, random_state=1).itertuples():
        assert row.n_before == (x > row.x).sum() and row.n == (x == row.x).sum() and row.n_all == len(x)


def test_buckets_are_monotone(spark):
    xs = sorted({0.0, *[s * 10.0 ** e * m for s in (-1, 1) for e in range(-12, 13) for m in (1, 1.5, 9.99)]})
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("b", scale.bucket(F.col("x")))
    b = [r.b for r in df.orderBy("x").collect()]
    assert b == sorted(b)


def test_only_finite_values_rank(spark):
    values = [3.0, float("nan"), -0.0, 0.0, float("inf"), None, 1.0, float("-inf"), 1.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, id int, x double")
    got = {r.id: (r["rank"], r.n) for r in scale.with_ranks(df, ["g"], "x").collect()}
    assert {i: got[i] for i in (0, 2, 3, 6, 8)} == {0: (5, 5), 2: (1, 5), 3: (1, 5), 6: (3, 5), 8: (3, 5)}
    assert all(got[i][0] is None for i in (1, 4, 5, 7))


def test_numbered_equals_one_sort(spark):
    df, pdf = skewed(spark)
    more = df.unionByName(spark.createDataFrame([("big", -1, float("inf")), ("big", -2, float("-inf")), ("big", -3, float("nan")), ("big", -4, -0.0)], df.schema))
    got = scale.numbered(more, "x", [F.asc("g"), F.asc("id")]).toPandas().sort_values("rank")
    rows = [(r["g"], r["id"], r["x"]) for r in more.collect()]
    key = lambda r: (r[2] is None or r[2] != r[2], 0.0 if r[2] is None or r[2] != r[2] else -r[2], r[0], r[1])
    assert got["rank"].tolist() == list(range(1, len(rows) + 1))
    assert list(zip(got["g"], got["id"])) == [(g, i) for g, i, _ in sorted(rows, key=key)]


def test_all_ranks_meet_in_coarse_buckets(spark):
    """Several values ranked beside each other, ties, odd values and both signs; a row is sent once a value, and no window holds a group."""
    rng = random.Random(7)
    odd = [None, float("nan"), float("inf"), 0.0, -0.0, 1e-300, -1e300]
    rows = [(g, i, *[rng.choice(odd) if rng.random() < 0.1 else round(rng.gauss(0, 1), 2) for _ in "ab"]) for g in ("x", "y") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, a double, b double")
    ranked = scale.with_all_ranks(df, ["g"], ["a", "b"])
    got = {(r.g, r.id): r for r in ranked.collect()}
    assert len(got) == len(rows)
    for g, i, *values in rows:
        for k, (name, v) in enumerate(zip("ab", values)):
            r, others = got[g, i], [row[2 + k] for row in rows if row[0] == g and row[2 + k] is not None and math.isfinite(row[2 + k])]
            known = v is not None and math.isfinite(v)
            want = (1 + sum(x < v for x in others), sum(x == v for x in others), len(others)) if known else (None, None, None)
            assert (r[f"rank_{name}"], r[f"ties_{name}"], r[f"n_{name}"]) == want


def test_quantiles_look_at_few_buckets_only(spark):
    """Only values of the buckets a quantile falls into are grouped by value."""
    df = spark.range(2000).selectExpr("id % 3 AS g", "CAST(id * id % 1999 AS DOUBLE) - 700 AS x")
    out = scale.group_quantiles(df, ["g"], "x", {"m": 0.5, "p": 0.9})
    pdf = df.toPandas()
    for r in out.collect():
        xs = pdf[pdf.g == r.g].x
        assert math.isclose(r.m, xs.quantile(0.5), rel_tol=1e-12) and math.isclose(r.p, xs.quantile(0.9), rel_tol=1e-12)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_places_of_several_values(spark):
    """Medians, quantiles and the k-th from above of two values at once; ties, missing and endless values, a group without values and
    the NULL group, which is a group like any other."""
    rows = [(None if k % 4 == 3 else k % 4, float(k * k % 37) - 9, None if k % 5 == 0 else float("inf") if k % 11 == 0 else 1.5 ** (k % 50)) for k in range(900)]
    rows += [(9, None, float("nan")), (8, 2.0, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    wanted = {"a_mid": ("a", lambda n: (n - 1) * 0.5 + 1), "b_mid": ("b", lambda n: (n - 1) * 0.5 + 1), "b_q": ("b", lambda n: (n - 1) * 0.9 + 1),
              "a_7th": ("a", lambda n: n - F.least(n, F.lit(7)) + 1)}
    got = {r.g: r for r in scale.group_places(df, ["g"], wanted).collect()}
    assert set(got) == {0, 1, 2, None, 8}
    for g, r in got.items():
        a, b = ([row[k] for row in rows if row[0] == g and row[k] is not None and math.isfinite(row[k])] for k in (1, 2))
        assert math.isclose(r.a_mid, np.quantile(a, 0.5)) and r.a_7th == sorted(a)[-min(7, len(a))]
        if b:
            assert math.isclose(r.b_mid, np.quantile(b, 0.5)) and math.isclose(r.b_q, np.quantile(b, 0.9))
        else:
            assert r.b_mid is None and r.b_q is None
