"""Lempel-Ziv phrase fingerprints: texts that would help to compress each other have similar phrase sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bounds, bucket_of, in_small_batches, mixed, n_parts

#: Values in a signature, and hexadecimal digits of each.
KEPT, DIGITS = 128, 12
STEP = np.uint64(0x9E3779B97F4A7C15)


def phrase_ends(text: str) -> list[int]:
    """End of each phrase of the LZ78 parse: the shortest stretch that isn't in the dictionary yet. The last
    phrase may repeat an earlier one."""
    root: dict = {}
    node, ends = root, []
    at = 0
    for c in text:
        at += 1
        below = node.get(c)
        if below is None:
            node[c] = {}
            ends.append(at)
            node = root
        else:
            node = below
    if node is not root:
        ends.append(at)
    return ends


def fingerprint(text: str) -> np.ndarray:
    """The KEPT smallest distinct 48-bit hashes of the phrases, ascending: a minimum-hash signature of the set.

    A phrase's hash is that of its code points alone: differences of prefix sums over powers of an odd base
    give all phrases at once.
    """
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.array(phrase_ends(text), np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(points)) - np.repeat(starts, ends - starts)
    longest = int(place.max()) + 1
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(longest, STEP), dtype=np.uint64)])
    sums = np.add.reduceat(mixed(points + np.uint64(1)) * powers[place], starts)
    names = mixed(sums + (ends - starts).astype(np.uint64)) >> np.uint64(64 - 4 * DIGITS)
    if len(names) > 4 * KEPT:
        few = np.unique(np.partition(names, 2 * KEPT)[:2 * KEPT])
        if len(few) >= KEPT:
            return few[:KEPT]
    return np.unique(names)[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets: of the KEPT smallest values of both together, the share
    that both have. Two empty texts are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:KEPT]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(common, union[-1], side="right") / len(union))


def written(values: np.ndarray) -> str:
    return "".join([f"{v:0{DIGITS}x}" for v in values.tolist()])


def read(text: str) -> np.ndarray:
    """The values of a written fingerprint."""
    return np.array([int(text[i:i + DIGITS], 16) for i in range(0, len(text), DIGITS)], np.uint64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([written(fingerprint(t.as_py() or "")) for t in batch.column(1)], pa.string())],
            ["doc_id", "fingerprint"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of every whole text: up to KEPT values of DIGITS hexadecimal digits, ascending.

    Null and empty texts have an empty fingerprint; equal texts have equal ones. Rows are independent, so there
    is no exchange; null and repeated doc_ids are kept, extra columns ignored.
    """
    return in_small_batches(documents).select("doc_id", "text").mapInArrow(_prints, "doc_id bigint, fingerprint string")


COMPARED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(this: tuple, after: tuple) -> tuple:
    (doc_id, text, own), (_, next_text, next_own) = this, after
    half = len(text) // 2
    edited = text[:len(text) - half] + next_text[:half]
    changed = fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed),
            likeness(own, changed), likeness(own, next_own))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one after it in its bucket; rows sent ahead are only looked at."""
    held, held_at = None, None
    for batch in batches:
        rows = []
        for bucket, ahead, doc_id, text in zip(*(batch.column(i) for i in range(4))):
            text, bucket, ahead = text.as_py(), bucket.as_py(), ahead.as_py()
            here = (doc_id.as_py(), text, fingerprint(text))
            if held is not None and held_at == bucket:
                rows.append(_compared(held, here))
            held, held_at = (None, None) if ahead else (here, bucket)
        columns = list(zip(*rows)) if rows else [()] * len(COMPARED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COMPARED)], schema=COMPARED)


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Each whole text against its edited text and against the next document, by descending doc_id.

    Edited: the last half of its code points, rounded down, gives way to the first as many (or all) of the next
    document's; after the last document comes the first. Null texts are empty. Rows of equal doc_id follow
    each other by text, a null doc_id comes last. A single row is its own successor; an empty table gives no
    rows. Extra columns are ignored.

    One exchange of the texts: split points of the ids cut the descending order into buckets, and the first row
    of every bucket also goes, as a look-ahead, to the end of the bucket before it. Only ids of first rows, one
    per bucket, reach the driver.
    """
    spark = in_small_batches(documents).sparkSession
    parts = n_parts(spark)
    texts = F.coalesce("text", F.lit(""))
    bounds = bucket_bounds(documents, "doc_id", 2 * parts)
    # Descending: the highest ids are bucket 0, the null id is the end of the last one.
    ranked = documents.select("doc_id", texts.alias("text")).withColumn("bucket", F.lit(len(bounds)) - bucket_of("doc_id", bounds))
    key = F.struct(F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")).alias("down"), F.xxhash64("text").alias("h"))
    firsts = {bucket: first for bucket, first in ranked.groupBy("bucket").agg(F.min(key).alias("first")).collect()}
    order = sorted(firsts)
    target = {bucket: order[i - 1] for i, bucket in enumerate(order)}  # where the bucket's first row is looked at
    at = F.col("bucket")
    down = F.array(*[F.lit(str(firsts[b].down) if b in firsts else None).cast("decimal(20,0)") for b in range(len(bounds) + 1)])
    low = F.array(*[F.lit(firsts[b].h if b in firsts else None).cast("bigint") for b in range(len(bounds) + 1)])
    before = F.array(*[F.lit(target.get(b)).cast("int") for b in range(len(bounds) + 1)])
    is_first = (key["down"] == F.element_at(down, at + 1)) & (key["h"] == F.element_at(low, at + 1))
    here = F.struct(at.alias("bucket"), F.lit(0).alias("ahead"))
    there = F.struct(F.element_at(before, at + 1).alias("bucket"), F.lit(1).alias("ahead"))
    sent = ranked.withColumn("to", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here)))).select(
        "to.bucket", "to.ahead", "doc_id", "text").repartition(parts, "bucket")
    return sent.sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text").mapInArrow(
        _walk, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")
