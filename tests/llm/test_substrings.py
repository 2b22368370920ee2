import hashlib
import random

import numpy as np
import pytest
from sparkbars.llm import substrings as ss

from .conftest import by_id


def brute(rows, window=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a:a + window]), i)
    for i, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a:a + window])] < i:
                keep[a:a + window] = [False] * window
        kept = [x for x, k in zip(w, keep) if k]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(prose):
    rng = random.Random(8)
    common, other = prose(900, 70), prose(901, 55)
    rows = []
    for i in range(120):
        parts = [prose(i, rng.randrange(10, 90))]
        if i % 2:
            parts.append(common)
        if i % 5 == 0:
            parts.append(other)
        parts.append(prose(i % 30, rng.randrange(5, 120)))
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, prose(1, 49)), (205, "again " * 3000), (206, "again " * 300), (207, prose(900, 50)),
             (208, prose(55, 40_000)), (209, "Again " * 300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("plan", [ss.Plan(), ss.Plan(crowded=3), ss.Plan(longest=7, shard_words=500)])
def test_like_brute_force(documents, prose, plan):
    rows = corpus(prose)
    got = by_id(ss.removal_digests(documents(rows, "clash"), plan))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == brute(rows)


def test_texts_are_cut_in_place(documents, prose):
    passage = prose(900, 60).split()
    rows = [(1, "Start.\n\n" + " ".join(passage)), (2, "Keep  this\t" + "\n".join(passage) + "  tail é "), (3, " untouched \n text "), (4, None), (5, " ".join(passage))]
    got = by_id(ss.remove_repeats(documents(rows, "clash")))
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "Keep  this\ttail é ", 3: rows[2][1], 4: None, 5: ""}
    assert got[2].n_chars == len("Keep  this\ttail é ") and got[1].lang == "en"


def test_null_ids_repeats_and_empty(documents, prose):
    text = prose(4, 60)
    rows = [(5, text), (5, text), (None, text), (6, text)]
    got = sorted(((r.doc_id, r.n_removed) for r in ss.removal_digests(documents(rows)).collect()), key=str)
    assert got == [(5, 0), (5, 0), (6, 60), (None, 0)]
    assert ss.removal_digests(documents([])).count() == 0 and ss.remove_repeats(documents([])).count() == 0


def test_wavelet_ranks_and_backward_search():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 11, 500)
    matrix = ss.WaveletMatrix(text, 4)
    for symbol in range(11):
        zero = matrix.rank(np.array([symbol]), np.array([0]))[0]
        for at in (0, 1, 63, 64, 65, 499, 500):
            assert matrix.rank(np.array([symbol]), np.array([at]))[0] - zero == (text[:at] == symbol).sum()
    pieces = [rng.integers(0, 3, n).astype(np.uint64) for n in (30, 40, 25)]
    index = ss.FMIndex(pieces, 20)
    for length in (1, 3, 8):
        for start in range(15):
            pattern = pieces[0][start:start + length]
            ids = index.text[start:start + length]
            low, high = np.array([0]), np.array([len(index.text)])
            for c in ids[::-1]:
                low, high = index.back(np.array([c]), low, high)
            assert high[0] - low[0] == sum((p[a:a + length] == pattern).all() for p in pieces for a in range(len(p) - length + 1))
