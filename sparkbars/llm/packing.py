"""Packing along a space-filling curve: documents near in content become neighbours in a sequence."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bounds, bucket_of, in_small_batches, n_parts, stage

#: Dimensions and bits per dimension of the curve: a 24-bit key. Of 63 bits, the rest orders equal keys by id.
DIMS, BITS = 4, 6
FIRST_OTHER = 0x558


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the files of byte-level tokenizers: a printable byte of Latin-1 for itself,
    the others in turn from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of a tokenizer file, as the library gives them without settings. With a rank file of the same vocabulary and
    the pattern that splits its texts, they are worked out from the ranks, which takes half the time; but texts that hold
    a special token's literal, or characters on whose class Unicode versions differ, always go to the tokenizer itself."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.fast = None
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([f"[\\U{FIRST_OTHER:08x}-\\U0010ffff]", *special]))
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            byte_of = byte_characters()
            known = self.tokenizer.get_vocab(with_added_tokens=False)
            added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            plain = {t: i for t, i in known.items() if t not in added}
            if any(c not in byte_of for t in plain for c in t) or {bytes(byte_of[c] for c in t): i for t, i in plain.items()} != table:
                raise ValueError("the rank file has another vocabulary")
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or self.other.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, self.kind)


@lru_cache(2)
def encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    return Encoder(path, ranks, pattern)


@lru_cache(1)
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((size, DIMS)).astype(np.float32)


def project(ids: np.ndarray) -> np.ndarray:
    """A document's hashed token counts on DIMS random directions, as whole numbers below 2 ** BITS.

    Divided by the counts' length each coordinate is near standard normal, so the normal quantile fills
    the curve's cube evenly without any statistics of the corpus.
    """
    if not len(ids):
        return np.zeros(DIMS, np.uint64)
    slots, counts = np.unique(ids & np.array(0xFFFF, ids.dtype), return_counts=True)
    x = counts @ _directions(1 << 16)[slots] / np.sqrt(np.square(counts, dtype=np.float64).sum())
    uniform = 1 / (1 + np.exp(-1.702 * x.astype(np.float64)))
    return np.minimum(uniform * (1 << BITS), (1 << BITS) - 1).astype(np.uint64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of whole coordinates below 2 ** bits.

    Per bit plane from the top: Gray-decode the plane's bits, and reflect or exchange the lower bits of the
    coordinates so that the cells of the next plane are met in the curve's order.
    """
    x = points.astype(np.uint64).copy()
    n = x.shape[1]
    one = np.uint64(1)
    for plane in range(bits - 1, 0, -1):
        q = one << np.uint64(plane)
        low = q - one
        for i in range(n):
            here = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & low
            x[:, 0] = np.where(here, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] = np.where(here, x[:, i], x[:, i] ^ swap)
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint64)
    for plane in range(bits - 1, 0, -1):
        q = one << np.uint64(plane)
        flip ^= np.where((x[:, n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(len(x), np.uint64)
    for plane in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[:, i] >> np.uint64(plane)) & one)
    return key


PLACED = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _tokenise(path: str, ranks: str | None, pattern: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, ranks, pattern)
        for batch in batches:
            ids = [coder.encode(t.as_py() or "") for t in batch.column(1)]
            keys = hilbert(np.array([project(i) for i in ids])) if ids else np.empty(0, np.uint64)
            tie = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64) & np.uint64((1 << 32) - 1)
            place = ((keys << np.uint64(32)) | tie).astype(np.int64)
            packed = [np.append(i, np.array(end_id, i.dtype)).tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(place, pa.int64()), pa.array([len(i) + 1 for i in ids], pa.int64()), pa.array(packed, pa.binary())],
                schema=PLACED)
    return run


PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, ids binary")


def _cut(offsets: dict[int, int], size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0
        for batch in batches:
            rows: list[tuple] = []
            for b, doc_id, n, ids in zip(*(batch.column(i) for i in (0, 1, 3, 4))):
                if b.as_py() != bucket:
                    bucket = b.as_py()
                    at = offsets[bucket]
                doc_id, n, ids, start = doc_id.as_py(), n.as_py(), ids.as_buffer(), 0
                data = memoryview(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")).cast("B")
                while start < n:
                    length = min(n - start, size - at % size)
                    piece = data[4 * start:4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, at // size, at % size, bytes(piece) if with_ids else None))
                    start, at = start + length, at + length
            names = [c.split()[0] for c in PIECES.split(", ")]
            kinds = [pa.int64()] * 7 + [pa.binary()]
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
    return run


def pack(documents: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, size: int = 2048,
         end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pack whole documents into sequences of ``size`` tokens, in the order of their Hilbert keys.

    ``path`` is a tokenizer file, ``ranks`` and ``pattern`` optionally its vocabulary as ranks and its splitting pattern
    (see Encoder). Returns one row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids (little-endian unsigned 32-bit; null without ``with_ids``). All sequences
    but the very last are full: the documents' ids, each list closed by ``end_id``, form one stream along the
    curve that is cut every ``size`` tokens; only the last sequence needs padding.

    The tokenised table is written once. Its keys are cut into buckets by quantiles of (key, hash of the id),
    so copies, which share a key, spread over buckets; one aggregation gives each bucket's tokens, hence its
    place in the stream, and each task streams its sorted buckets. What reaches the driver is a split point
    and a sum per bucket. A null text counts as empty and has the closing id only; null and repeated doc_ids
    are documents of their own; extra columns are ignored; an empty table gives no rows.
    """
    spark = in_small_batches(documents).sparkSession
    tie = F.xxhash64(F.col("doc_id"), F.col("text"))
    tokens = stage(documents.select("doc_id", "text", tie.alias("tie")).mapInArrow(
        _tokenise(path, ranks, pattern, end_id), "doc_id bigint, place bigint, n_tokens bigint, ids binary"), "tokens")
    parts = n_parts(spark)
    bounds = bucket_bounds(tokens, "place", 4 * parts)
    dealt = tokens.withColumn("bucket", bucket_of("place", bounds).cast("int"))
    sums = sorted(dealt.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())
    offsets = dict(zip([b for b, _ in sums], accumulate([0, *(n for _, n in sums)])))
    ordered = dealt.select("bucket", "doc_id", "place", "n_tokens", "ids").repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "place", "doc_id", "n_tokens", "ids")
    return ordered.mapInArrow(_cut(offsets, size, with_ids), PIECES)
