import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkbars.llm import collocations as co

DOCS = "doc_id bigint, text string, lang string"


def brute(rows, least, top=2000, longest=5):
    """All phrases by dictionaries and Python integers."""
    counts, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        table = counts.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                table.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, table in counts.items():
        often = {g: f for g, f in table.items() if len(g) > 1 and f >= least}
        gone = {g[i:j] for g, f in often.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1)
                if j - i < len(g) and f >= often[g[i:j]]}
        found = []
        for g in set(often) - gone:
            score, k = min((1000 * often[g] * n[lang] // (table[g[:k]] * table[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -often[g], " ".join(g).encode(), table[g[:k]], table[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    fixed = ["new york city", "as soon as possible", "state of the art method", "a b a b a", "x x x", "Über den Wolken"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(30))]
        text = "".join(p + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "\x1c", "é!"]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


def found(spark, rows, **plan):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS word", "1 AS n", "'y' AS phrase", "2 AS key", "3 AS rank")
    return sorted(tuple(r) for r in co.phrases(df, co.Plan(**plan)).collect())


def test_against_brute_force(spark):
    rows = corpus(1, 250) + [(900, None, "en"), (901, "", "en"), (902, " . ,\t", "fr"), (903, "zz " * 3000, "de"), (903, "zz " * 3000, "de")]
    want = brute(rows, 8)
    assert len({r[0] for r in want}) >= 3 and {len(r[2].split(" ")) for r in want} >= {2, 3, 4, 5}
    assert found(spark, rows, least=8) == want
    # Few ranked ids, small tiles, a crowded bitmap, cuts inside pieces: the same rows.
    assert found(spark, rows, least=8, head_bits=4, tile_bits=2, filter_bits=7, at_once=50, stretch=40) == want
    assert found(spark, rows, least=8, top=3) == brute(rows, 8, top=3)


def test_nothing_frequent_and_no_rows(spark):
    assert found(spark, [(1, "a b c", "en")]) == [] and found(spark, []) == []


def test_ties_and_cuts(spark):
    rows = [(i, "a b c", "en") for i in range(10)] + [(20, "b", "en")] * 5 + [(30, "d e", "en"), (31, "E D", "en")] * 10
    assert found(spark, rows, least=10) == brute(rows, 10)


def test_words_spelled_as_their_language(spark):
    rows = [(i, "lo que es es bueno, und so", lang) for i, lang in enumerate(["es", "en", None, "und", ""] * 10)]
    want = brute(rows, 10)
    assert any(r[0] == "es" and "es" in r[2].split(" ") for r in want)
    assert found(spark, rows, least=10) == want


def test_exact_beyond_64_bits(spark):
    big = 10 ** 13
    df = spark.createDataFrame([(big, 9 * big, [big, 2 * big], [3 * big, big])], "a bigint, n bigint, firsts array<bigint>, rests array<bigint>")
    row = co.best_cut(df).first()
    want = min((1000 * big * 9 * big // (l * r), k, l, r) for k, (l, r) in enumerate([(big, 3 * big), (2 * big, big)]))
    assert (row.score, row.l, row.r) == (want[0], want[2], want[3])


@pytest.mark.parametrize("head, tile", [(6, 2), (3, 1), (6, 5)])
def test_tiles_count_every_pair_once(head, tile):
    rng = np.random.default_rng(4)
    ids = rng.integers(1, 1 << 63, 200).astype(np.uint64)
    sequence = ids[np.minimum(rng.zipf(1.3, 30_000) - 1, 199)]
    keys = np.unique(ids)[: 1 << head]
    by_rank = rng.permutation(keys)
    order = np.argsort(by_rank)
    names = co.Known(by_rank[order], order.astype(np.int32), by_rank, np.ones(2, bool), np.uint64(63))
    p, q, n = co.count_pairs(sequence[:-1], sequence[1:], names, co.Plan(head_bits=head, tile_bits=tile))
    got = Counter()
    for a, b, c in zip(p.tolist(), q.tolist(), n.tolist()):
        got[a, b] += c
    assert got == Counter(zip(sequence[:-1].tolist(), sequence[1:].tolist()))


def test_bitmap_and_ranks(spark):
    level = spark.createDataFrame([(k, i) for i, k in enumerate([-5, 1 << 62, 7, -(1 << 63)])], "key bigint, n bigint")
    names = co.known(level.select("key", F.col("n")), co.Plan(head_bits=1, filter_bits=8))
    ids = np.array([-5, 1 << 62, 7, -(1 << 63), 123456789 << 30], np.int64).view(np.uint64)
    assert names.has(ids)[:4].all() and names.rank(ids).tolist() == [-1, -1, 1, 0, -1] and names.by_rank[0] == ids[3]
