import numpy as np
import pytest
from sparkbars.llm import hardneg as hn

KIND = "vec_id bigint, embedding array<double>, label int"


def brute(rows, every=100, k=5, n=10):
    fine = []
    for i, v, l in rows:
        if i is None or l is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        fine.append((i, [int(np.floor(256 * x)) for x in v], (l + 1) % 10 if i % 7 == 0 else l))
    out, seen = [], set()
    for i, v, l in fine:
        if i % every or (i, tuple(v), l) in seen:
            continue
        seen.add((i, tuple(v), l))
        met = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in fine if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in met if x[2] == l)[:k]:
            hard = sorted(x for x in met if x[2] != l and 30 * -s <= 100 * -x[0] <= 90 * -s)[:n]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, **plan):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS row", "2 AS key", "'x' AS dim", "3 AS nth", "4 AS rank", "5 AS a_block")
    return sorted(tuple(r) for r in hn.hard_negatives(df, 10, hn.Plan(**plan)).collect())


@pytest.mark.parametrize("dim", [1, 3, 32, 33, 64, 100])
def test_strassen_is_exact(dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-1 << 20, 1 << 20, (70, dim)), rng.integers(-1 << 20, 1 << 20, (130, dim))
    assert (hn.scores(a, b) == a @ b.T).all()
    side, depth = hn.tile_side(dim)
    assert side >= dim and side >> depth <= hn.LEAF and side % (1 << depth) == 0 and side < dim + (1 << depth)


def test_scores_beyond_the_exact_range_of_doubles():
    big = np.array([[(1 << 31) + 1, -3], [5, 1 << 30]], np.int64)
    assert hn.scores(big, big).tolist() == [[sum(x * y for x, y in zip(a, b)) for b in big.tolist()] for a in big.tolist()]
    with pytest.raises(OverflowError):
        hn.scores(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_heaps_merge_in_any_cut():
    rng = np.random.default_rng(2)
    values = rng.integers(-4, 5, (6, 90))
    for size in (1, 7, 90):
        heaps = hn.Heaps(6, 4)
        for start in range(0, 90, size):
            r, c = np.nonzero(heaps.wanted(values[:, start:start + size]))
            heaps.offer(r, values[:, start:start + size][r, c], c + start)
        want = [sorted((-v, j) for j, v in enumerate(line))[:4] for line in values.tolist()]
        assert [(-s, j) for s, j in zip(heaps.score.tolist(), heaps.id.tolist())] == [x for line in want for x in line]


def test_windows():
    p = np.array([-25, -1, 0, 1, 3, 10, 11, 99, (1 << 62) + 7])
    low, high = hn.window(p, hn.Plan())
    assert low.tolist() == [-(-3 * int(x) // 10) for x in p] and high.tolist() == [9 * int(x) // 10 for x in p]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    bases = rng.normal(size=(6, 12))
    rows = [(int(i), (bases[i % 6] + 0.6 * rng.normal(size=12)).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)]  # one hot vector: every score ties
    rows += [rows[10], rows[5], rows[5], (2000, [0.5] * 3, 1), (2010, [0.5, -0.25, 1.0], 1), (2001, [0.1, 0.2, 0.3], 2), (2020, [], 3), (2021, [], 3), (2022, [], 4)]
    want = brute(rows, 10)
    assert len(want) > 500
    assert mined(spark, rows) == want
    assert mined(spark, rows, anchors=8, candidates=32, panel=16) == want


def test_rows_that_take_no_part_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1.0, 0.0], 0), (11, [1.0, 0.0], 0), (12, [0.5, 0.0], 1), (None, [1.0, 0.0], 0), (13, None, 0), (15, [1.0, None], 0),
            (16, [nan, 1.0], 0), (17, [inf, 1.0], 0), (18, [1.0, 0.0], None), (19, [0.95, 0.0], 1), (21, [0.5, 0.0], 9)]
    assert mined(spark, rows) == brute(rows, 10) == [(10, 11, 1, 12, 65536, 32768)]
    assert mined(spark, []) == []
