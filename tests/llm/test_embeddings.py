import numpy as np
from sparkbars.llm import embeddings as em

from .conftest import by_id

KIND = "vec_id bigint, embedding array<float>, label int"


def cloud(seed, groups, n_random, dim=24, noise=0.02):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n_random)]
    for size in groups:
        base = rng.normal(size=dim)
        rows += [base + noise * np.linalg.norm(base) / np.sqrt(dim) * rng.normal(size=dim) * rng.uniform(1, 5) for _ in range(size)]
    return [np.asarray(r, np.float32).tolist() for r in rows]


def brute(rows):
    links, low = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    fine = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for a, (i, v, l) in enumerate(fine):
        for j, w, m in fine[:a]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    for _ in rows:
        moved = False
        for i, j in pairs:
            m = min(low[i], low[j])
            moved |= low[i] != m or low[j] != m
            low[i] = low[j] = m
        if not moved:
            break
    return {i: (links[i], low[i], low[i] == i) for i in links}


def test_links_and_components(spark):
    vectors = cloud(1, (150, 60, 5, 2), 250)
    vectors += [vectors[0]] * 4 + [[3 * x for x in vectors[1]]]
    order = np.random.default_rng(5).permutation(len(vectors))
    rows = [(int(i), vectors[k], int(k) % 2 if k < 250 else 1) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS shard", "2 AS n_links", "3 AS vec")
    want = brute(rows)
    for plan in (em.Plan(), em.Plan(most=64, pivots=8)):
        got = by_id(em.near_duplicates(df, plan), "vec_id")
        found, true = sum(r.n_links for r in got.values()), sum(w[0] for w in want.values())
        assert all(got[i].n_links <= want[i][0] for i in want) and found >= 0.98 * true
        assert {i: (r.component_id, r.kept) for i, r in got.items()} == {i: w[1:] for i, w in want.items()}


def test_unusable_vectors_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0),
            (8, [float("inf"), 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [], 0), (11, [1.0, 0.0], 1), (12, [1.0, 0.0], 0)]
    got = by_id(em.near_duplicates(spark.createDataFrame(rows, KIND)), "vec_id")
    assert {i: r.n_links for i, r in got.items() if r.n_links} == {1: 2, 2: 2, 12: 2}
    assert {i for i, r in got.items() if not r.kept} == {2, 12} and len(got) == 12
    assert em.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    null_id = em.near_duplicates(spark.createDataFrame([(None, [1.0], 0), (1, [1.0], 0)], KIND)).collect()
    assert sorted(str(r.component_id) for r in null_id) == ["1", "None"]
