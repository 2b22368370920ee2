import hashlib

from sparkbars.llm import fingerprints as fp

from .conftest import by_id


def brute_phrases(text):
    seen, out, start = set(), [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            out.append(text[start:end])
            start = end
    return out + ([text[start:]] if start < len(text) else [])


def test_phrases_follow_the_definition(prose):
    for text in ["", "a", "aaaaaa", "abababab", prose(1, 300), "éé漢漢漢é"]:
        ends, at = fp.phrase_ends(text), 0
        assert [text[a:b] for a, b in zip([0, *ends], ends)] == brute_phrases(text)


def test_likeness_estimates_the_phrase_sets(prose):
    a = prose(1, 3000)
    for b in (prose(2, 3000), a[:6000] + prose(3, 1500), a):
        x, y = set(brute_phrases(a)), set(brute_phrases(b))
        assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - len(x & y) / len(x | y)) < 0.15
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("")) == 1 and fp.likeness(fp.fingerprint("a"), fp.fingerprint("")) == 0
    assert (fp.read(fp.written(fp.fingerprint(a))) == fp.fingerprint(a)).all()


def test_edits_and_order(documents, prose):
    rows = [(i, prose(i % 7, 20 + i)) for i in range(60)] + [(100, None), (101, ""), (102, "x"), (103, prose(9, 30_000)), (-5, "ab")]
    got = by_id(fp.compare_with_edits(documents(rows, "clash")))
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.written(fp.fingerprint(text)), fp.written(fp.fingerprint(edited)))
        assert r.near_next == fp.likeness(fp.fingerprint(text), fp.fingerprint(after))


def test_ties_single_row_and_empty(documents):
    assert fp.compare_with_edits(documents([])).count() == 0
    assert fp.compare_with_edits(documents([(1, "abcd")])).first().near_next == 1
    rows = [(7, "same")] * 3 + [(None, "null id"), (8, "z")]
    assert sorted(str(r.doc_id) for r in fp.compare_with_edits(documents(rows)).collect()) == ["7", "7", "7", "8", "None"]
    assert {r.fingerprint for r in fp.fingerprints(documents(rows[:3])).collect()} == {fp.written(fp.fingerprint("same"))}
