import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from sparkbars.llm import bpe

from .conftest import by_id

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


with open(PATH, "rb") as lines:
    LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def encode(text):
    return [i for ids in bpe.codec(PATH, public_tokenizers.PATTERN).encode(text) for i in ids]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_like_the_library_on_any_text(text):
    assert encode(text) == LIBRARY.encode_ordinary(text)


def test_runs_of_letters_and_every_kind_of_character(library):
    rng = random.Random(5)
    for n in range(200):
        text = rng.choice("aeo -=\nяй漢") * rng.randrange(90) + "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800)])) for _ in range(30))
        assert encode(text) == library.encode_ordinary(text)
    points = [chr(c) for c in range(0x500, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    text = "a".join(points) + "1".join(points)
    assert encode(text) == library.encode_ordinary(text)


def test_unnumbered_states_give_the_same_ids(library):
    small = bpe.Transducer(library._mergeable_ranks, most_states=3)
    for word in [b"internationalisation", "überraschenderweise".encode(), b"zzzzzzzzzzzzq", bytes(range(256))]:
        assert [library.decode_single_token_bytes(i) for i in small.encode(word)] == (
            [word] if word in library._mergeable_ranks else small.merged(word, 1))


def test_streaming_decoder_at_every_cut():
    data = "aé漢😀z".encode() + b"\xff\xe6\xbc" + "é".encode()
    for size in range(1, 6):
        stream = bpe.Utf8Stream()
        got = "".join(stream.feed(data[i:i + size]) for i in range(0, len(data), size)) + stream.close()
        assert got == data.decode("utf-8", "replace")


def test_documents(documents, library, prose):
    rows = [(1, "Hello  world's\n\n 3 <|endoftext|>"), (2, None), (3, ""), (4, "😀漢字 " * 5), (5, prose(1, 200_000)), (1, "again"), (None, "x")]
    got = [tuple(r)[:5] for r in bpe.encode_documents(documents(rows, "clash"), PATH, public_tokenizers.PATTERN).collect()]
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert sorted(got, key=str) == sorted(want, key=str)
    ids = bpe.encode_ids(documents(rows[:4]), PATH, public_tokenizers.PATTERN)
    assert {i: r.text for i, r in by_id(bpe.decode_ids(ids, PATH, public_tokenizers.PATTERN)).items()} == {i: t or "" for i, t in rows[:4]}
    assert bpe.encode_documents(documents([]), PATH, public_tokenizers.PATTERN).count() == 0
