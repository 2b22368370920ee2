"""Substring dedup by FM-indexes over shards of shared passages.

Each window of ``window`` words is sent where its smallest ``gram``-word hash says (its anchor), so equal windows
always meet. Consecutive windows with the same anchor form one stretch; stretches of anchors that only one
document has are dropped, equal stretches are kept once. A shard of anchors gets a compressed full-text index
of its stretches; every stretch is then streamed through it backwards, which yields for each of its windows
the interval of all occurrences, and so the smallest document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULTIPLIER, WordHashes, gram_hashes, in_small_batches, mixed, stage

INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
DEPTH = 64


@dataclass(frozen=True)
class Plan:
    window: int = 50  # at most DEPTH - 1
    gram: int = 10
    longest: int = 1024  # windows in a stretch
    shard_words: int = 1_000_000
    crowded: int = 20_000  # distinct stretches of an anchor from which on its windows are sent by their own hash


@lru_cache(4)
def _powers(base: int, count: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(count - 1, base, np.uint64), dtype=np.uint64)])


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run words[start:end] from prefix sums over powers of an odd base."""
    size = 1 << max(10, int(len(words)).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(int(MULTIPLIER), size)[:len(words)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * _powers(int(INVERSE), size)[starts] + (ends - starts).astype(np.uint64))


def anchors(words: np.ndarray, plan: Plan) -> np.ndarray:
    """The anchor of each window: the smallest hash of its grams. It depends on the window's words only."""
    grams = mixed(gram_hashes(words, plan.gram) ^ MULTIPLIER)
    return np.lib.stride_tricks.sliding_window_view(grams, plan.window - plan.gram + 1).min(axis=1)


def stretches(words: np.ndarray, plan: Plan, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first window and number of windows of each stretch of a text's words."""
    anchor = anchors(words, plan)
    change = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    first = np.flatnonzero(change)
    if len(anchor) > plan.longest:
        first = np.union1d(first, np.arange(0, len(anchor), plan.longest))
    if len(crowded):
        hot = np.isin(anchor, crowded)
        first = np.union1d(first, np.flatnonzero(hot | np.concatenate([[False], hot[:-1]])))
    count = np.diff(np.append(first, len(anchor)))
    content = run_hashes(words, first, first + count + plan.window - 1)
    key = anchor[first]
    if len(crowded):
        key = np.where(hot[first], mixed(key * MULTIPLIER + content), key)
    return key.view(np.int64), content.view(np.int64), first, count


def _words(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of(text.encode().split() if text else [])


STRETCH = "anchor bigint, content bigint, doc_id bigint, first int, n int"


def _stretches(plan: Plan, crowded: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _words(text.as_py(), hashes)
                if len(words) >= plan.window:
                    found.append(stretches(words, plan, crowded))
                    ids.append(np.full(len(found[-1][0]), doc_id, np.int64))
            parts = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts[0]), pa.array(parts[1]), pa.array(np.concatenate(ids) if ids else parts[0]),
                 pa.array(parts[2].astype(np.int32)), pa.array(parts[3].astype(np.int32))], ["anchor", "content", "doc_id", "first", "n"])
    return run


class WaveletMatrix:
    """Ranks of symbols below 2 ** bits in a sequence: a bit vector per level, with a count before each block of
    64, and stably the zeros before the ones on the next level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.blocks, self.before, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            blocks = np.zeros(-(-len(bit) // 64) + 1, np.uint64)
            blocks.view(np.uint8)[:len(packed)] = packed
            self.blocks.append(blocks)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(blocks[:-1]), dtype=np.int64)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place, less a start that depends on the symbol only."""
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[i][at >> 6] + np.bitwise_count(self.blocks[i][at >> 6] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over sequences of words, each a stretch, by windows of at most DEPTH - 1 words.

    The rows are the text's places in order of the DEPTH words from there: that is all a search of shorter patterns
    needs. ``group[row]`` numbers the rows by their first ``window`` words.
    """

    def __init__(self, sequences: list[np.ndarray], window: int):
        sizes = np.array([len(s) for s in sequences])
        self.ends = np.cumsum(sizes + 1) - 1  # the separator after each sequence
        text = np.zeros(int(self.ends[-1]) + 1, np.int64)
        known, ids = np.unique(np.concatenate(sequences), return_inverse=True)
        inside = np.ones(len(text), bool)
        inside[self.ends] = False
        text[inside] = ids + 1
        self.text, n = text, len(text)
        rank, width, by_half = text, 1, None
        while width < DEPTH:
            if width * 2 > window and by_half is None:
                # windows are equal if their first and their last ``width`` words are
                by_half = rank[:, None] if width == window else np.stack([rank, _shifted(rank, window - width)], axis=1)
            _, rank = np.unique(rank * (n + 1) + _shifted(rank, width) + 1, return_inverse=True)
            width *= 2
        self.rows = np.argsort(rank, kind="stable")
        new = np.any(by_half[self.rows[1:]] != by_half[self.rows[:-1]], axis=1)
        self.group = np.concatenate([[0], np.cumsum(new)])
        self.group_start = np.concatenate([[0], np.flatnonzero(new) + 1, [n]])
        self.matrix = WaveletMatrix(text[self.rows - 1], max(1, int(len(known)).bit_length()))
        counts = np.bincount(text, minlength=len(known) + 1)
        symbols = np.arange(len(counts))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.base = starts - self.matrix.rank(symbols, np.zeros(len(counts), np.int64))

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of pattern."""
        both = self.base[symbol] + self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])).reshape(2, -1)
        return both[0], both[1]


def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([rank[by:], np.full(min(by, len(rank)), -1, rank.dtype)])


def smallest_owners(sequences: list[np.ndarray], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each sequence, the smallest owner of a sequence that holds it, by matching statistics
    at the length of a window: the interval of all its occurrences in the shard's index."""
    index = FMIndex(sequences, window)
    sizes = np.array([len(s) for s in sequences])
    owner_at = np.repeat(owners, sizes + 1)
    smallest = np.minimum.reduceat(owner_at[index.rows], index.group_start[:-1])
    out = [np.empty(size - window + 1, np.int64) for size in sizes]
    flat = np.concatenate([[0], np.cumsum(sizes - window + 1)])
    answers = np.empty(flat[-1], np.int64)
    live = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(index.text), np.int64)
    for step in range(1, int(sizes.max()) + 1):
        live = live[:np.searchsorted(-sizes[live], -step, side="right")]
        low, high = index.back(index.text[index.ends[live] - step], low[:len(live)], high[:len(live)])
        if step >= window:
            group = index.group[low]
            low, high = index.group_start[group], index.group_start[group + 1]
            answers[flat[live] + sizes[live] - step] = smallest[group]
    for i in range(len(out)):
        out[i] = answers[flat[i]:flat[i + 1]]
    return out


OWNED = "anchor bigint, content bigint, runs array<struct<first:int,last:int,owner:bigint>>"


def _search(plan: Plan):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("owner", pa.int64())]))

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        owners = smallest_owners([r[3] for r in rows], np.array([r[2] for r in rows], np.int64), plan.window)
        runs = []
        for found in owners:
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            last = np.append(first[1:], len(found)) - 1
            runs.append([{"first": a, "last": b, "owner": c} for a, b, c in zip(first.tolist(), last.tolist(), found[first].tolist())])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, kind)],
            ["anchor", "content", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for anchor, content, owner, words in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                if size >= plan.shard_words and rows[-1][0] != anchor:
                    yield answer(rows)
                    rows, size = [], 0
                words = np.frombuffer(words.as_py(), np.uint64)
                rows.append((anchor, content, owner, words))
                size += len(words) + 1
        if rows:
            yield answer(rows)
    return run


def _fetch(plan: Plan):
    """Words of the stretches that a document stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = _words(text.as_py(), hashes)
                for s in own.as_py():
                    part = words[s["first"]:s["first"] + s["n"] + plan.window - 1]
                    if len(part) == s["n"] + plan.window - 1:
                        rows.append((s["anchor"], s["content"], doc_id, part.tobytes()))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["anchor", "content", "owner", "words"])
    return run


def shared_stretches(documents: DataFrame, plan: Plan) -> DataFrame:
    """Stretches whose anchor more than one document has. An anchor with very many different stretches, as at the
    borders of a passage that many documents share, would fill one shard: the windows of such anchors are sent
    by their own hash instead. There are at most a million of them, which bounds what is shipped to the tasks."""
    rows = in_small_batches(documents).where("doc_id is not null and text is not null").select("doc_id", "text")
    crowded = np.empty(0, np.uint64)
    while True:
        every = stage(rows.mapInArrow(_stretches(plan, crowded), STRETCH), "stretches")
        groups = every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        shared = stage(every.join(groups.select("anchor"), "anchor"), "shared")
        if len(crowded):
            return shared
        most = F.greatest(F.lit(plan.crowded), F.lit(every.count() // 1_000_000))
        hot = shared.select("anchor", "content").distinct().groupBy("anchor").count().where(F.col("count") > most).select("anchor").toPandas()
        if not len(hot):
            return shared
        crowded = np.sort(hot["anchor"].to_numpy(np.int64).view(np.uint64))


def repeated_windows(documents: DataFrame, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, spans)``: per document the runs of words to go, [first, last) pairs that may touch or overlap; and
    ``(doc_id, text)`` of all documents that may have any."""
    shared = shared_stretches(documents, plan)
    one = shared.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "first", "n")).alias("one"))
    owned = one.select(F.col("one.doc_id").alias("doc_id"), F.struct(
        "anchor", "content", F.col("one.first").alias("first"), F.col("one.n").alias("n")).alias("s")).groupBy("doc_id").agg(
        F.collect_list("s").alias("own"))
    ids = shared.select("doc_id").distinct().join(owned, "doc_id", "left")
    held = stage(documents.select("doc_id", "text").join(ids, "doc_id"), "held")
    words = held.where("own is not null").mapInArrow(_fetch(plan), "anchor bigint, content bigint, owner bigint, words binary")
    total = shared.agg(F.sum(F.col("n") + plan.window)).first()[0] or 0
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // plan.shard_words))
    owners = words.repartition(parts, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(_search(plan), OWNED)
    found = shared.join(owners, ["anchor", "content"]).select("doc_id", "first", F.explode(F.filter(
        "runs", lambda r: r["owner"] < F.col("doc_id"))).alias("run"))
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct(
        (F.col("first") + F.col("run.first")).alias("first"),
        (F.col("first") + F.col("run.last") + plan.window).alias("last"))).alias("spans"))
    return stage(spans, "spans"), held.select("doc_id", "text")


def kept_mask(count: int, spans: list[dict] | None) -> np.ndarray:
    gone = np.zeros(count + 1, np.int64)
    for s in spans or ():
        gone[min(s["first"], count)] += 1
        gone[min(s["last"], count)] -= 1
    return np.cumsum(gone[:-1]) == 0


DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode().split()
            if spans.is_valid:
                keep = kept_mask(len(words), spans.as_py())
                kept = [w for w, k in zip(words, keep.tolist()) if k]
            else:
                kept = words
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])


def removal_digests(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row per row of ``documents(doc_id, text)``.

    A word goes if a window of ``plan.window`` words that covers it also starts in a document with a smaller
    doc_id; windows are those of the input. Words are cut at ASCII white space, and compared by 64-bit hashes.
    Null and short texts have no window; a null doc_id neither loses words nor takes any. doc_id is taken to
    name one text: repeated rows lose the same words. Extra columns are ignored; an empty table gives no rows.
    """
    spans, held = repeated_windows(documents, plan)
    no_spans = F.lit(None).cast("array<struct<first:int,last:int>>").alias("spans")
    whole = documents.select("doc_id", "text", no_spans).mapInArrow(_digests, DIGEST).join(spans.select("doc_id"), "doc_id", "left_anti")
    return whole.unionByName(held.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(_digests, DIGEST))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if not spans.is_valid or text is None:
                texts.append(text)
                continue
            data = text.encode()
            words, places, at = data.split(), [], 0
            for w in words:
                at = data.index(w, at)
                places.append(at)
                at += len(w)
            keep = kept_mask(len(words), spans.as_py()).tolist()
            bounds = [0, *places[1:], len(data)] if words else [0, len(data)]
            texts.append(b"".join(data[bounds[i]:bounds[i + 1]] for i, k in enumerate(keep) if k).decode())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def remove_repeats(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``documents`` with the repeated words cut out of ``text``, each with the white space after it, and n_chars, if
    there is such a column, counted anew. Other texts stay as they are to the byte; all rows and columns stay."""
    spans, _ = repeated_windows(documents, plan)
    columns = documents.columns
    at = columns.index("text")
    # Numbered names: the columns of the input may be called anything.
    plain = documents.toDF(*[f"_{i}" for i in range(len(columns))])
    by_id = spans.select(F.col("doc_id").alias("span_doc_id"), F.col("spans").alias("gone_spans"))
    rest = [c for i, c in enumerate(plain.columns) if i != at]
    joined = plain.join(by_id, F.col(f"_{columns.index('doc_id')}") == F.col("span_doc_id"), "left").select(F.col(f"_{at}").alias("text"), "gone_spans", *rest)
    schema = T.StructType([T.StructField("text", T.StringType()), *[plain.schema[c] for c in rest]])
    cut = joined.mapInArrow(_cut, schema).withColumnRenamed("text", f"_{at}").select(*plain.columns)
    if "n_chars" in columns:
        k = columns.index("n_chars")
        cut = cut.withColumn(f"_{k}", F.length(f"_{at}").cast(plain.schema[f"_{k}"].dataType))
    return cut.toDF(*columns)
