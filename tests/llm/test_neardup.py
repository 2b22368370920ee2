import random

import numpy as np
from sparkbars.llm import neardup

from .conftest import by_id


def brute(rows, size):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


def family(prose, seed, n, words, edits):
    rng, base = random.Random(seed), prose(seed, words).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(documents, rows, plan, extra=""):
    got = by_id(neardup.near_duplicates(documents(rows, extra), plan))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute(rows, plan.words)


def test_families_around_the_bound(documents, prose):
    texts = family(prose, 1, 60, 120, 12) + family(prose, 2, 60, 200, 9) + [prose(100 + i, 80) for i in range(40)] + [prose(1, 120)] * 5
    random.Random(4).shuffle(texts)
    rows = list(enumerate(texts))
    check(documents, rows, neardup.Plan(words=4), "clash")
    check(documents, rows, neardup.Plan(words=4, pairs_up_to=3, slice_rows=16))  # crowded buckets go in blocks
    check(documents, rows, neardup.Plan())


def test_odd_texts(documents, prose):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "One two\nthree"), (8, "É"), (9, "é"),
            (10, "a\xa0b"), (11, prose(3, 60_000)), (12, prose(3, 60_000) + " end")]
    check(documents, rows, neardup.Plan(words=4))


def test_repeated_rows_null_ids_and_empty(documents):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(documents(rows)).collect()), key=str)
    assert got == [(2, 2, True), (3, 2, False), (3, 2, False), (None, None, True)]
    assert sorted(str(r.doc_id) for r in neardup.drop_near_duplicates(documents(rows, "clash")).collect()) == ["2", "None"]
    assert neardup.near_duplicates(documents([])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    same = (neardup.signature(a, 4000) == neardup.signature(b, 4000)).mean()
    assert abs(same - 1500 / 2500) < 0.05
