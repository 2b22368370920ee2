import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from sparkbars.llm import packing
from tokenizers import Tokenizer

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_hilbert_neighbours():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 4)
    assert sorted(keys.tolist()) == list(range(16 ** 3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pieces_are_the_documents(documents, library, prose):
    rows = [(i, prose(i % 20, 10 + 7 * i)) for i in range(150)] + [(500, None), (501, ""), (502, " lead  and\n \n trail "), (505, "a <|endoftext|> b<|endoftext|>"), (503, "漢字 😀 ߷ it's"), (504, prose(3, 30_000)), (7, "again"), (None, "no id")]
    for size in (2048, 64):
        got = [r.asDict() for r in packing.pack(documents(rows, "clash"), PATH, RANKS, public_tokenizers.PATTERN, size=size).collect()]
        want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
        docs = {}
        for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
            assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
            docs.setdefault((str(p["doc_id"]), p["doc_tokens"]), []).append(p)
        rebuilt = []
        for (i, n), pieces in docs.items():
            pieces.sort(key=lambda p: p["start"])
            assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
            rebuilt.append((i, np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist()))
            assert len(rebuilt[-1][1]) == n
        assert sorted(rebuilt) == want
        filled = {}
        for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
            assert p["offset"] == filled.get(p["sequence_id"], 0)
            filled[p["sequence_id"]] = p["offset"] + p["length"]
        assert sorted(filled) == list(range(len(filled))) and sorted(filled.values())[1:] == [size] * (len(filled) - 1)


def test_ranks_give_the_same_ids(library):
    rng = random.Random(3)
    slow, fast = packing.Encoder(PATH), packing.Encoder(PATH, RANKS, public_tokenizers.PATTERN)
    bits = ["a", "b", " ", "\n", "  ", " \n", "'s", "'", "1", ".", "é", "\t", "\xa0", " the", "\x85", "<|endoftext|>", "߷", "漢"]
    for _ in range(3000):
        text = "".join(rng.choice([*bits, chr(rng.randrange(0x80, 0x600))]) for _ in range(rng.randrange(14)))
        assert slow.encode(text).tolist() == fast.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), RANKS, public_tokenizers.PATTERN)


def test_copies_are_neighbours_and_empty(documents, prose):
    rows = [(i, prose(i // 4, 100)) for i in range(80)]
    got = packing.pack(documents(rows), PATH, RANKS, public_tokenizers.PATTERN).where("start = 0").orderBy("sequence_id", "offset").collect()
    kin = [r.doc_id // 4 for r in got]
    assert sum(a == b for a, b in zip(kin, kin[1:])) >= 50
    assert packing.pack(documents([]), PATH, RANKS, public_tokenizers.PATTERN).count() == 0
