"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the byte-pair encoding of its bytes exactly if each token encodes to itself and each pair
of neighbours does: a merge across a border would also happen between the two neighbours alone. Hence every
prefix of a word has one encoding, and what the bytes still to come can change is bounded: a later token can
only start at a position from which the bytes read are a proper prefix of some token. The transducer's
subset state holds these live positions, each with its place in the token trie and the tokens not yet emitted
on its path; what all paths share is emitted at once. States and transitions are built when first needed.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import in_small_batches

#: Code points from here on are looked up in the class tables of the installed tokenizer library.
FIRST_DISPUTED = 0x558


@lru_cache(1)
def _class_pattern(pattern: str) -> regex.Pattern:
    """The pattern with its letter and number classes as the tokenizer library's Unicode version has them."""
    import tiktoken

    text = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for name in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        points = sorted({ord(c) for c in bytes(probe.encode_ordinary(text)).decode()})
        runs, start = [], None
        for a, b in zip(points, [*points[1:], -1]):
            start = a if start is None else start
            if b != a + 1:
                runs.append(f"\\U{start:08x}-\\U{a:08x}")
                start = None
        pattern = pattern.replace(f"[^\\s\\p{{L}}\\p{{N}}]", "[^\\s\\p{L}\\p{N}]")
        inner = "".join(runs)
        pattern = re.sub(r"\[([^\]]*)" + re.escape(name), lambda m: f"[{m[1]}{inner}", pattern).replace(name, f"[{inner}]")
    return regex.compile(pattern)


class Splitter:
    """Cuts texts into the pieces that are encoded separately."""

    def __init__(self, pattern: str):
        self.pattern, self.usual = pattern, regex.compile(pattern)
        self.disputed = re.compile(f"[\\U{FIRST_DISPUTED:08x}-\\U0010ffff]")

    def pieces(self, text: str, at_once: int = 1 << 16) -> Iterator[list[str]]:
        exact = not text.isascii() and self.disputed.search(text) is not None
        cut = _class_pattern(self.pattern) if exact else self.usual
        if len(text) <= 8 * at_once:
            yield cut.findall(text)
            return
        some = []
        for m in cut.finditer(text):
            some.append(m[0])
            if len(some) == at_once:
                yield some
                some = []
        yield some


class Transducer:
    """Bytes to token ids, for pieces of one vocabulary of mergeable ranks."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 100_000):
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        # The trie of all tokens: node << 8 | byte -> child; the token at each node; whether longer ones follow.
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for b in token:
                step = node << 8 | b
                if step not in self.child:
                    self.child[step] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner[node] = 1
                    self.inner.append(0)
                node = self.child[step]
            self.token_at[node] = rank
        self.splits: dict[int, tuple[int, int] | None | bool] = {}
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple, int] = {}
        self.entries: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.start = self._state(((0, -1, ()),))

    def _state(self, subset: tuple) -> int:
        """The number of a state. The states met first, which are the common ones, are kept; beyond
        ``most_states`` subsets stay unnumbered (-1) and their transitions are worked out each time."""
        number = self.states.get(subset, -1)
        if number < 0 and len(self.entries) < self.most_states:
            number = self.states[subset] = len(self.entries)
            self.entries.append(subset)
            self.moves.append({})
        return number

    # What two neighbours do to each other

    def merged(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Merging by definition: always the leftmost pair of lowest rank, until ``down_to`` parts are left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None | bool:
        """The last merge that makes the token; None for one byte; False if its bytes merge to something else."""
        found = self.splits.get(token, 0)
        if found == 0 and found is not False:
            data = self.bytes_of[token]
            if len(data) == 1:
                found = None
            else:
                parts = self.merged(data, 2)
                found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else False
            self.splits[token] = found
        return found

    def _spine(self, token: int, side: int, memo: dict[int, tuple]) -> tuple | None:
        """The parts at one end of the token in order of their merges; None if a later merge has a lower rank."""
        if token not in memo:
            parts = self.split(token)
            if parts is None:
                memo[token] = (token,)
            else:
                below = self._spine(parts[side], side, memo)
                single = self.split(parts[side]) is None
                other = self.split(parts[1 - side]) is None
                rising = below is not None and (single or parts[side] < token) and (other or parts[1 - side] < token)
                memo[token] = (*below, token) if rising else None
        return memo[token]

    def valid(self, first: int, second: int) -> bool:
        """Whether ``second`` encodes to itself and no merge crosses its border with ``first`` (-1: none)."""
        if self.split(second) is False:
            return False
        if first < 0:
            return True
        key = first * 1_000_003 + second
        known = self.pairs.get(key)
        if known is None:
            a, b = self._spine(first, 1, self.right), self._spine(second, 0, self.left)
            if a is None or b is None:
                known = self.merged(self.bytes_of[first] + self.bytes_of[second]) == [self.bytes_of[first], self.bytes_of[second]]
            else:
                known = self._keeps_border(a, b)
            if len(self.pairs) > 5 * self.most_states:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _keeps_border(self, a: tuple, b: tuple) -> bool:
        """Replays the merges at both sides of the border by rank; of equal ranks the left merge comes first."""
        i = j = 0
        never = 1 << 60
        while True:
            next_a = a[i + 1] if i + 1 < len(a) else never
            next_b = b[j + 1] if j + 1 < len(b) else never
            across = self.ranks.get(self.bytes_of[a[i]] + self.bytes_of[b[j]])
            if across is not None and across < next_a and across <= next_b:
                return False
            if next_a == never and next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    # The transducer

    def _step(self, entries: tuple, byte: int) -> tuple[tuple, tuple]:
        """The subset after ``byte`` and the tokens that all its paths share, which are emitted."""
        alive, end = [], None
        child, token_at, pairs, inner = self.child, self.token_at, self.pairs, self.inner
        for node, last, pending in entries:
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if end is None and (token := token_at[to]) >= 0:
                fits = pairs.get(last * 1_000_003 + token)
                if fits or fits is None and self.valid(last, token):
                    end = (0, token, (*pending, token))
            if inner[to]:
                alive.append((to, last, pending))
        if not alive:
            return ((0, end[1], ()),), end[2]
        first, most = alive[0][2], min([len(e[2]) for e in alive])
        alive.append(end)
        n = 0
        while n < most and not any([e[2][n] != first[n] for e in alive]):
            n += 1
        if not n:
            return tuple(alive), ()
        return tuple([(node, last, pending[n:]) for node, last, pending in alive]), first[:n]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        out: list[int] = []
        state, moves = self.start, self.moves
        subset = None
        for byte in piece:
            if state >= 0:
                move = moves[state].get(byte)
                if move:
                    state = move[0]
                    if move[1]:
                        out.extend(move[1])
                    continue
                subset = self.entries[state]
            subset, emitted = self._step(subset, byte)
            if emitted:
                out.extend(emitted)
            to = self._state(subset)
            if to >= 0 and state >= 0:
                moves[state][byte] = (to, emitted)
            state = to
        out.extend((self.entries[state] if state >= 0 else subset)[-1][2])
        return tuple(out)


class Utf8Stream:
    """Incremental UTF-8 decoding: a state machine over the bytes that may end inside a character.

    ``feed`` returns the characters completed so far; the state is the incomplete tail (at most three bytes).
    Malformed bytes become U+FFFD, as with ``errors="replace"``.
    """

    def __init__(self):
        self.tail = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Length of an incomplete character at the end."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if back < need and b < 0xF5 else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        cut = len(data) - self._open(data)
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.tail = self.tail.decode("utf-8", "replace"), b""
        return rest


class Codec:
    """A vocabulary file of ranks, its splitter, transducer and decoder. One per Python worker."""

    def __init__(self, path: str, pattern: str, most_pieces: int = 600_000):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.splitter, self.transducer = Splitter(pattern), Transducer(ranks)
        self.bytes_of, self.most_pieces = self.transducer.bytes_of, most_pieces
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, tuple[int, ...]] = _Pieces(self)

    def encode(self, text: str) -> Iterator[list[int]]:
        for pieces in self.splitter.pieces(text):
            yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: Iterator[list[int]]) -> Iterator[tuple[bytes, str]]:
        stream = Utf8Stream()
        for some in ids:
            data = b"".join(map(self.bytes_of.__getitem__, some))
            yield data, stream.feed(data)
        yield b"", stream.close()


class _Pieces(dict):
    """Encodings of the pieces met; forgets all of them when full."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.codec.most_pieces:
            self.clear()
        ids = self[piece] = self.codec.transducer.encode(piece.encode("utf-8"))
        return ids


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    # Its tables are large, long-lived and free of cycles: rescanning them for garbage would cost more than the work.
    gc.set_threshold(200_000, 50, 100)
    return Codec(path, pattern)


ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids_hash, bytes_hash, count, same, at = hashlib.sha256(), hashlib.sha256(), 0, True, 0

                def counted():
                    nonlocal count
                    for ids in coder.encode(text):
                        if ids:
                            ids_hash.update((("," if count else "") + ",".join(map(coder.text_of.__getitem__, ids))).encode())
                            count += len(ids)
                            yield ids

                for data, chars in coder.decode(counted()):
                    bytes_hash.update(data)
                    same = same and text.startswith(chars, at)
                    at += len(chars)
                rows.append((doc_id, count, ids_hash.hexdigest(), bytes_hash.hexdigest(), same and at == len(text)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
    return run


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both, one row per document.

    ``path`` is a rank file that every executor has, ``pattern`` the pre-tokenizer's. A null text counts as
    empty: no ids, the digests of nothing. Null and repeated doc_ids are kept as they are, extra columns are
    ignored. No exchange: each task streams its own rows; a text is handled in bounded runs of pieces.
    """
    return in_small_batches(documents).select("doc_id", "text").mapInArrow(_digests(path, pattern), ENCODED)


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            ids = [list(chain.from_iterable(coder.encode(t.as_py() or ""))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return run


def encode_ids(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of whole texts; nulls as in encode_documents."""
    return in_small_batches(documents).select("doc_id", "text").mapInArrow(_ids(path, pattern), "doc_id bigint, ids array<int>")


def _texts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            texts = ["".join(chars for _, chars in coder.decode(iter([ids.as_py() or []]))) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give an empty text."""
    return in_small_batches(encoded).select("doc_id", "ids").mapInArrow(_texts(path, pattern), "doc_id bigint, text string")
