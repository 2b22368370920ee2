"""SentencePiece encoding and decoding (merge-type models) by a prefix table.

A sequence of pieces is the encoding of its text exactly if every piece encodes to itself and every two neighbours do:
a merge across a border would also happen between the two neighbours alone, since the order of merges (score, then
position) is the same there. Hence every prefix of a text has one encoding, and this encoding is that of a shorter
prefix and one more piece. The table keeps that last piece for each prefix: an automaton reports the pieces that end at
a character, and the only one that is compatible with the last piece of the prefix it starts after is entered. The
table read backwards is the encoding.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: A unit of more characters is not remembered.
LONG = 64


class Vocabulary:
    """What a model file says: pieces that merge, their ranks by falling score, ids, and bytes for the rest."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.text_of = [model.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.text_of[i][1:-1], 16) for i in range(n) if model.is_byte(i)}
        self.byte_ids = [i for i, _ in sorted(self.byte_of.items(), key=lambda x: x[1])]
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.unknown_text = model.decode([self.unknown])
        used = [i for i in range(n) if not (i in self.byte_of or i in self.silent or i == self.unknown)]
        if any(model.is_unused(i) for i in used):
            raise ValueError("a model with unused pieces is not supported")
        self.id_of = {self.text_of[i]: i for i in used}
        order = sorted({-model.get_score(i) for i in used})
        place = {s: k for k, s in enumerate(order)}
        self.rank = {self.text_of[i]: place[-model.get_score(i)] for i in used}
        # Not read from the library's interface: the three spellings of spaces that the method relies on.
        probe = model.encode("a", out_type=str), model.encode("  a ", out_type=str), model.normalize("Å\tＡ")
        if "".join(probe[0]) != SPACE + "a" or "".join(probe[1]) != SPACE * 3 + "a" + SPACE or probe[2].lstrip(SPACE) != "Å\tＡ":
            raise ValueError("only models without normalisation, with a space in front and all spaces kept, are supported")

    def units(self) -> re.Pattern:
        """A pattern of stretches that no merge leaves, worked out from which characters stand side by side in pieces:
        a character that is in no longer piece is alone; a space opens a stretch; and a run of letters ends before
        marks that no piece has after a letter. Without cuts at spaces, a text is one stretch."""
        if any(SPACE in t.lstrip(SPACE) for t in self.id_of):
            return re.compile("(?s:.+)")
        joined = {pair for t in self.id_of for pair in zip(t, t[1:])}
        inside = {c for pair in joined for c in pair} - {SPACE}
        letters = {c for c in inside if c.isalpha()}
        sticky = {y for x, y in joined if x in letters and y not in letters} - {SPACE}

        def any_of(chars: set[str]) -> str:
            return "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else "(?!)"

        return re.compile(f"(?: +|(?={any_of(inside)})){any_of(inside - letters)}*{any_of(letters)}*(?:{any_of(sticky)}{any_of(inside)}*)?|(?s:.)")


class PrefixTable:
    """Encodes strings of characters into pieces. A character that is no piece is one of its own, which never merges
    unless a longer piece holds it."""

    def __init__(self, rank: dict[str, int], most_pairs: int = 1_000_000):
        self.rank, self.most_pairs = rank, most_pairs
        self.pieces: list[str] = []
        self.sizes: list[int] = []
        self.number: dict[str, int] = {}
        self.spines: list[dict[int, list[tuple[str, int]] | None]] = [{}, {}]
        self.pairs: dict[int, bool] = {}
        # The automaton: transitions of each node, its longest proper suffix, and the pieces that end at it.
        self.moves: list[dict[str, int]] = [{}]
        self.suffix: list[int] = [0]
        self.ending: list[tuple[int, ...]] = [()]
        self._build()

    def _new(self, piece: str) -> int:
        self.number[piece] = len(self.pieces)
        self.pieces.append(piece)
        self.sizes.append(len(piece))
        return len(self.pieces) - 1

    def _build(self) -> None:
        tree = self.moves
        for piece in self.rank:
            if len(piece) > 1 and len(self.merged(piece)) > 1:
                continue  # never the outcome of merging
            node = 0
            for c in piece:
                to = tree[node].get(c)
                if to is None:
                    to = tree[node][c] = len(tree)
                    tree.append({})
                    self.suffix.append(0)
                    self.ending.append(())
                node = to
            self.ending[node] = (self._new(piece),)
        level = list(tree[0].values())
        while level:
            below = []
            for node in level:
                self.ending[node] += self.ending[self.suffix[node]]
                for c, to in tree[node].items():
                    back = self.suffix[node]
                    while back and c not in tree[back]:
                        back = self.suffix[back]
                    self.suffix[to] = tree[back].get(c, 0)
                    below.append(to)
            level = below
        self.most_moves = 8 * sum(map(len, tree))
        self.learned = 0

    def _move(self, node: int, c: str) -> int:
        """A transition by way of the suffixes, kept for the next time while there is room."""
        back = node
        while back and c not in self.moves[back]:
            back = self.suffix[back]
        to = self.moves[back].get(c, 0)
        if self.learned < self.most_moves:
            self.learned += 1
            self.moves[node][c] = to
        return to

    def merged(self, text: str, trace: list | None = None) -> list[str]:
        """Merging by definition: the pair of best rank, of equals the leftmost, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if trace is not None:
                trace.append((best, parts[0], parts[-1]))
        return parts

    def _spine(self, number: int, side: int) -> list[tuple[str, int]] | None:
        """The parts at the left (0) or right (1) end of a piece while it is merged, with the rank that makes each; None
        if those ranks don't rise, when only merging itself tells what comes first."""
        known = self.spines[side]
        if number not in known:
            piece, trace = self.pieces[number], []
            self.merged(piece, trace)
            ends = [(piece[0] if side == 0 else piece[-1], -1)]
            rising, top = True, -1
            for step in trace:
                # Every merge of the piece must have a higher rank than all before it.
                rising, top = rising and step[0] > top, step[0]
                if step[1 + side] != ends[-1][0]:
                    ends.append((step[1 + side], step[0]))
            known[number] = ends if rising else None
        return known[number]

    def compatible(self, first: int, second: int) -> bool:
        """Whether two pieces side by side stay as they are."""
        key = first << 32 | second
        found = self.pairs.get(key)
        if found is None:
            a, b = self._spine(first, 1), self._spine(second, 0)
            if a is None or b is None:
                texts = [self.pieces[first], self.pieces[second]]
                found = self.merged("".join(texts)) == texts
            else:
                found = self._border_holds(a, b)
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _border_holds(self, a: list[tuple[str, int]], b: list[tuple[str, int]]) -> bool:
        """Replays the merges on both sides of a border in order of rank, on the left first where ranks are equal;
        a merge across comes after an equal one on its left and before one on its right."""
        i = j = 0
        while True:
            next_a = a[i + 1][1] if i + 1 < len(a) else None
            next_b = b[j + 1][1] if j + 1 < len(b) else None
            across = self.rank.get(a[i][0] + b[j][0])
            if across is not None and (next_a is None or across < next_a) and (next_b is None or across <= next_b):
                return False
            if next_a is None and next_b is None:
                return True
            if next_b is None or next_a is not None and next_a <= next_b:
                i += 1
            else:
                j += 1

    def numbers(self, text: str) -> list[int]:
        """The pieces of a text by number, from its prefix table."""
        moves, ending, sizes, pairs = self.moves, self.ending, self.sizes, self.pairs
        last: list[int] = []  # the last piece of the prefix that ends with each character
        node, end = 0, 0
        for c in text:
            to = moves[node].get(c)
            node = self._move(node, c) if to is None else to
            for piece in ending[node]:
                before = end - sizes[piece]
                if before < 0:
                    last.append(piece)
                    break
                fits = pairs.get(last[before] << 32 | piece)
                if fits or fits is None and self.compatible(last[before], piece):
                    last.append(piece)
                    break
            else:  # no piece ends here: the character is one of its own
                alone = self.number.get(c)
                last.append(self._new(c) if alone is None else alone)
            end += 1
        out, at = [], end - 1
        while at >= 0:
            out.append(last[at])
            at -= sizes[last[at]]
        out.reverse()
        return out

    def encode(self, text: str) -> list[str]:
        return [self.pieces[i] for i in self.numbers(text)]


class Codec:
    """A model file with its prefix table. One per Python worker."""

    def __init__(self, path: str, most_units: int = 400_000):
        self.vocabulary = Vocabulary(path)
        self.table = PrefixTable(self.vocabulary.rank)
        #: Per piece of the table: its id in decimal and its text.
        v, pieces = self.vocabulary, self.table.pieces
        self.shown = {k: (str(v.id_of[p]), p.replace(SPACE, " ")) for k, p in enumerate(pieces) if p in v.id_of}
        self.units = v.units()
        self.known: dict[str, tuple[str, str]] = _Units(self, most_units)

    def ids_of(self, numbers: list[int]) -> list[int]:
        out: list[int] = []
        id_of, byte_ids = self.vocabulary.id_of, self.vocabulary.byte_ids
        for piece in map(self.table.pieces.__getitem__, numbers):
            found = id_of.get(piece)
            if found is not None:
                out.append(found)
            elif byte_ids:
                out += [byte_ids[b] for b in piece.encode()]
            elif not out or out[-1] != self.vocabulary.unknown:
                out.append(self.vocabulary.unknown)
        return out

    def cut(self, text: str) -> Iterator[str]:
        """The units of a text, encoded independently of each other: the space in front, and a space's other spelling
        read as a space, as the library does."""
        if not text:
            return iter(())
        return (m[0] for m in self.units.finditer(" " + text.replace(SPACE, " ")))

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.cut(text) for i in self.ids_of(self.table.numbers(unit.replace(" ", SPACE)))]

    def spoken(self, ids: Iterable[int]) -> str:
        """The text of ids, the space in front included; bytes that make no character become U+FFFD each."""
        v, out, run = self.vocabulary, [], bytearray()
        for i in ids:
            byte = v.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(characters(bytes(run)))
                run.clear()
            if i not in v.silent:
                out.append(v.unknown_text if i == v.unknown else v.text_of[i].replace(SPACE, " "))
        if run:
            out.append(characters(bytes(run)))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """As the library does: the one space that encoding puts in front is taken away again."""
        ids = list(ids)
        text = self.spoken(ids)
        shown = next((i for i in ids if i not in self.vocabulary.silent), None)
        opens = shown is not None and shown != self.vocabulary.unknown and self.vocabulary.text_of[shown].startswith(SPACE)
        return text[1:] if opens else text


def characters(data: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that is no part of a character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at:at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class _Units(dict):
    """Per unit met: its ids in decimal, and their text; forgets all when full."""

    def __init__(self, codec: Codec, most: int):
        self.codec, self.most = codec, most

    def __missing__(self, unit: str) -> tuple[str, str]:
        numbers, shown = self.codec.table.numbers(unit.replace(" ", SPACE)), self.codec.shown
        try:
            found = [shown[k] for k in numbers]
            made = ",".join([f[0] for f in found]), "".join([f[1] for f in found])
        except KeyError:  # a character that is no piece
            ids = self.codec.ids_of(numbers)
            made = ",".join(map(str, ids)), self.codec.spoken(ids)
        if len(unit) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[unit] = made
        return made


@lru_cache(2)
def codec(path: str) -> Codec:
    # Large, long-lived tables without cycles: rescanning them for garbage would cost more than the work.
    gc.set_threshold(200_000, 50, 100)
    return Codec(path)


def digests(coder: Codec, text: str, at_once: int = 1 << 18) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids and of the text decoded from them, run by run of units."""
    ids_hash, text_hash, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
    units = coder.units.findall(" " + text.replace(SPACE, " ")) if text else []
    for start in range(0, len(units), at_once):
        shown, said = zip(*map(coder.known.__getitem__, units[start:start + at_once]))
        ids, text = ",".join(shown), "".join(said)
        ids_hash.update((ids if first else "," + ids).encode())
        # The space that encoding puts in front is the first character of the first run: no id stands before it.
        text_hash.update((text[1:] if first else text).encode())
        n += ids.count(",") + 1
        first = False
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            rows = [digests(coder, t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t.type) for c, t in zip(columns, list(ENCODED)[1:]))], schema=ENCODED)
    return run


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """Encode every whole text without begin and end ids, decode the ids again, and return digests of both:
    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per document.

    ``path`` is a model file that every executor has. A null text counts as empty: no ids. Null and repeated doc_ids
    stay as they are, extra columns are ignored, an empty table gives no rows. No exchange: every task streams its rows.
    """
    return documents.select("doc_id", "text").mapInArrow(_digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_ids(documents: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` of whole texts; nulls as in encode_documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            ids = [coder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = [coder.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
