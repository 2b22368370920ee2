import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sparkbars.llm import pieces

from .conftest import by_id

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODER = pieces.codec(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_like_the_library_on_any_text(text):
    ids = CODER.encode(text)
    assert ids == LIBRARY.encode(text)
    assert CODER.decode(ids) == LIBRARY.decode(ids)


def test_spaces_runs_and_every_kind_of_character():
    rng = random.Random(5)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "▁", "<s>", "<unk>", "<0x41>", "\x00", "é", "é", "漢", "\U0001f600", "ll", "1", ".", "'s"]
    for n in range(1500):
        text = "".join(rng.choice([*bits, chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800)]))]) for _ in range(rng.randrange(25)))
        assert CODER.encode(text) == LIBRARY.encode(text), text
    for n in range(0, 80):
        for text in (" " * n, " " * n + "x", "x" + " " * n, "a" * n, "the" * n, "=" * n, "漢" * n):
            assert CODER.encode(text) == LIBRARY.encode(text), text
            assert CODER.decode(CODER.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))


def test_any_ids_decode_like_the_library():
    rng = random.Random(9)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 1, 2, 28705]) for _ in range(rng.randrange(9))]
        assert CODER.decode(ids) == LIBRARY.decode(ids), ids


def test_prefix_table_against_merging():
    """Small vocabularies in which ranks fall along a merge, tie, or belong to pieces that never come about."""
    rng = random.Random(1)
    for _ in range(150):
        rank = {c: 90 for c in "ab"}
        for _ in range(rng.randrange(1, 14)):
            rank.setdefault("".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))), rng.randrange(8))
        table = pieces.PrefixTable(rank)
        for _ in range(25):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 16)))
            assert table.encode(text) == table.merged(text), (rank, text)


def test_forgetting_changes_nothing():
    small = pieces.Codec(PATH, most_units=3)
    small.table.most_pairs = 5
    text = "Some words, and some words again: internationalisation of words " * 3
    assert pieces.digests(small, text, 4) == pieces.digests(CODER, text) and small.encode(text) == LIBRARY.encode(text)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.Vocabulary(str(tmp_path / "none.model"))


def test_documents(documents, prose):
    rows = [(1, "Hello  world's\n\n 3 <s>"), (2, None), (3, ""), (4, "\U0001f600漢字 " * 5), (5, prose(1, 100_000)), (6, "x" * 50_000), (1, "again"), (None, "x")]
    got = [tuple(r) for r in pieces.encode_documents(documents(rows, "clash"), PATH).collect()]
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    ids = pieces.encode_ids(documents(rows[:4]), PATH)
    assert {i: r.text for i, r in by_id(pieces.decode_ids(ids, PATH)).items()} == {i: t or "" for i, t in rows[:4]}
    assert pieces.encode_documents(documents([]), PATH).count() == 0
