import math
import random

import numpy as np
from sparkbars.llm import language

from .conftest import by_id

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schn", "er", "ung", "ost"], "cc": ["ção", "lhe", "nho", "éi"]}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def brute_probability(counts, word, order=language.ORDER):
    """Interpolated Kneser-Ney from its definition, with dictionaries."""
    grams = [{} for _ in range(order)]
    for w, c in counts.items():
        padded = f" {w} "
        for end in range(1, len(padded)):
            for k in range(order):
                if end - k >= 0:
                    g = padded[end - k:end + 1]
                    grams[k][g] = grams[k].get(g, 0) + c
    values = []
    for k in range(order):
        if k == order - 1:
            values.append(dict(grams[k]))
            continue
        value = {}
        for g, c in grams[k].items():
            opens = k > 0 and g[0] == " "
            value[g] = c if opens else sum(1 for wider in grams[k + 1] if wider[1:] == g)
        values.append({g: v for g, v in value.items() if v})
    discount = []
    for v in values:
        n1, n2 = sum(x == 1 for x in v.values()), sum(x == 2 for x in v.values())
        discount.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
    alphabet = len({c for w in counts for c in f" {w} "}) + 1

    def p(context, symbol):
        k = len(context)
        lower = p(context[1:], symbol) if k else 1 / alphabet
        table = {g: x for g, x in values[k].items() if g[:-1] == context}
        total = sum(table.values())
        if not total:
            return lower
        d = discount[k]
        share = sum(min(x, d) for x in table.values()) / total
        return max(table.get(context + symbol, 0) - d, 0) / total + share * lower

    padded = f" {word} "
    return sum(math.log(p(padded[max(0, i - order + 1):i], padded[i])) for i in range(1, len(padded)))


def test_scores_follow_the_definition():
    counts = {"abra": 3, "cad": 1, "abc": 2, "a": 5, "cabbac": 1}
    model = language.train({"x": counts})
    for word in ["abra", "abc", "zzz", "cabra", "a", "abracadabra"]:
        assert np.isclose(language.word_scores(model, [word])[0, 0], brute_probability(counts, word), atol=1e-4), word


def test_held_out_accuracy_and_rejection(documents):
    rows = [(i, text(lang, 5 + i % 40, i), lang) for i in range(600) for lang in [sorted(SYLLABLES)[i % 3]]]
    odd = [(9000, None), (9001, ""), (9002, "12 -- 34"), (9003, "Привет мир это совсем другой язык " * 5), (9004, text("aa", 50_000, 1), None)]
    got = by_id(language.predict_held_out(documents(rows + odd, "clash")))
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 100 and all(got[r[0]].lang_pred == r[2] for r in held)
    assert not any(got[r[0]].rejected for r in rows)
    assert [got[i].lang_pred for i in (9000, 9001, 9002, 9004)] == ["und", "und", "und", "aa"]
    assert all(got[i].rejected for i in (9000, 9001, 9002, 9003))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_labels_and_no_rows(documents):
    assert language.predict_held_out(documents([])).count() == 0
    assert [r.lang_pred for r in language.predict_held_out(documents([(1, "hello", None), (1, "hello", None)])).collect()] == ["und"] * 2


def test_words_too_short_for_long_grams(documents):
    rows = [(i, "a b " * 5, "aa") for i in range(20)] + [(50, "abcdefgh", None)]
    assert {r.lang_pred for r in language.predict_held_out(documents(rows)).collect()} == {"aa"}


def test_annotate_keeps_columns(documents):
    docs = documents([(i, text("aa", 20, i), "aa") for i in range(40)], "clash")
    out = language.annotate(docs, language.fit(docs))
    assert set(docs.columns) <= set(out.columns) and out.count() == 40
