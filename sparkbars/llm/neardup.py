"""MinHash near-dedup with circulant signatures, banding and exact verification.

A first permutation sends a shingle to a place on a circle, a second one labels the places; coordinate k of
the signature is the smallest label found k places further on. All coordinates of one shingle are therefore
one stretch of one table, and a signature is the minimum over such stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, WordHashes, gram_hashes, in_small_batches, mixed, stage
from .graph import components

CIRCLE = 1 << 20


@dataclass(frozen=True)
class Plan:
    """Shingles of ``words`` words; documents with 100 * intersection >= ``percent`` * union are linked. At 80 per
    cent, 32 bands of 5 coordinates miss a pair with probability (1 - 0.8 ** 5) ** 32 = 3e-6."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    pairs_up_to: int = 64  # members of a bucket within which pairs are listed; larger ones are compared in blocks
    slice_rows: int = 256  # a block holds two slices


@lru_cache(2)
def _labels(width: int) -> np.ndarray:
    """Row p: the labels of the places p, p + 1, ... p + width - 1 on the circle (a view, not a copy)."""
    second = np.random.default_rng(29).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:width]]), width)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    places = (mixed(shingles * MULTIPLIER) >> np.uint64(44)).astype(np.int64)
    table, low = _labels(width), np.full(width, CIRCLE, np.uint32)
    for start in range(0, len(places), 2048):
        np.minimum(low, table[places[start:start + 2048]].min(axis=0), out=low)
    return low


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of the whole sequence if there are fewer words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes.of(words), min(size, len(words))))


def band_keys(low: np.ndarray, plan: Plan) -> np.ndarray:
    key = np.arange(plan.bands, dtype=np.uint64) * MULTIPLIER
    for column in low.reshape(plan.bands, plan.rows).astype(np.uint64).T:
        key = mixed((key + column + np.uint64(1)) * MULTIPLIER)
    return key.view(np.int64)


def _sketches(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, width = WordHashes(), plan.bands * plan.rows
        for batch in batches:
            sizes, names, keys = [], [], []
            for text in batch.column(1):
                grams = shingle_set(text.as_py(), plan.words, hashes)
                sizes.append(len(grams))
                names.append(xxhash.xxh3_128_digest(grams) if len(grams) else None)
                keys.append(band_keys(signature(grams, width), plan) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_name", "bands"])
    return run


def _sets(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [shingle_set(t.as_py(), plan.words, hashes).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "grams"])
    return run


def _compare(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) < plan.percent * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked[i] = 100 * both >= plan.percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["u", "v", "linked"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are alike enough. v is the one that many pairs may share: it is
    joined last, by a join whose crowded partitions adaptive execution can split."""
    with_u = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("grams").alias("a")), "u")
    both = with_u.join(sets.select(F.col("doc_id").alias("v"), F.col("grams").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(_compare(plan), "u bigint, v bigint, linked boolean").where("linked").select("u", "v")


def _unsettled(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Memberships of the buckets that still hold more than one component, with the bucket's size and smallest member."""
    placed = members.join(classes, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed_up = placed.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.min("doc_id").alias("first"), F.count("*").alias("size")).where("a <> b")
    return placed.join(mixed_up.select("key", "first", "size"), "key")


def _block(plan: Plan):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Each document with the smallest one it hangs together with inside the block."""
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        ids, sets = pdf["doc_id"].to_numpy(), [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        sizes = np.array([len(g) for g in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int((times > 1).sum()), 4096):
            here = slice(*np.searchsorted(column, [start, start + 4096]))
            has = np.zeros((len(sets), 4096), np.float32)
            has[owner[here], column[here] - start] = 1
            both += has @ has.T
        both = both.astype(np.int64)
        linked = 100 * both >= plan.percent * (sizes[:, None] + sizes - both)
        low = np.arange(len(sets))
        for i in range(len(sets)):
            if low[i] == i:
                reach, edge = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
                reach[i] = edge[i] = True
                while edge.any():
                    edge = linked[edge].any(axis=0) & ~reach
                    reach |= edge
                low[reach] = i
        return pd.DataFrame({"u": ids, "v": ids[low]})[low != np.arange(len(sets))]
    return run


def links(sketches: DataFrame, documents: DataFrame, plan: Plan) -> DataFrame:
    """``(doc_id, component)`` over verified links of ``sketches(doc_id, bands)``, one row per distinct shingle set.

    Every bucket is first compared with its smallest member only: a bucket of near copies is settled by as many
    comparisons as it has members. Then only buckets with more than one component are left to look at. Up to
    ``pairs_up_to`` members, those of different components are compared one by one. Larger buckets, which hold
    families of texts somewhat below the bound, are put together by the documents they share, cut into
    slices, and compared slice against slice inside tasks, which return no more than one link per document.
    So no large group is listed as pairs, and nothing is left uncompared.
    """
    banded = sketches.select("doc_id", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stage(banded.join(crowded, "key"), "members")
    wanted = members.select("doc_id").distinct()
    sets = stage(documents.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(
        _sets(plan), "doc_id bigint, grams binary"), "sets")
    centres = members.groupBy("key").agg(F.min("doc_id").alias("v"))
    pairs = members.join(centres, "key").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()
    found = stage(_verified(pairs, sets, plan), "links")
    classes = components(found).select(F.col("node").alias("doc_id"), "component")
    open_ = stage(_unsettled(members, classes), "unsettled")
    few, many = open_.where(F.col("size") <= plan.pairs_up_to), open_.where(F.col("size") > plan.pairs_up_to)
    other = few.select("key", F.col("doc_id").alias("v"), F.col("component").alias("other"))
    # every key has at most pairs_up_to rows on either side
    pairs = few.join(other, "key").where((F.col("component") < F.col("other"))).select(
        F.greatest("doc_id", "v").alias("u"), F.least("doc_id", "v").alias("v")).distinct()
    more = found.union(_verified(pairs, sets, plan))
    if not many.isEmpty():
        families = components(many.select(F.col("doc_id").alias("u"), F.col("first").alias("v"))).select(
            F.col("node").alias("doc_id"), F.col("component").alias("family"))
        sizes = families.groupBy("family").agg(F.ceil(F.count("*") / plan.slice_rows).cast("int").alias("slices"))
        sliced = families.join(sizes, "family").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
        blocks = sliced.join(sets, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
            "family", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "doc_id", "grams")
        more = more.union(blocks.groupBy("family", "i", "j").applyInPandas(_block(plan), "u bigint, v bigint"))
    return components(stage(more, "links")).select(F.col("node").alias("doc_id"), "component")


def near_duplicates(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``documents(doc_id, text)``.

    A text's shingles are the distinct runs of ``plan.words`` of its words (A-Z lower-cased, cut at ASCII white
    space), the whole sequence if it has fewer words. component_id is the smallest doc_id reachable over
    links, kept says that it is the document's own. Links are confirmed on full sets (64-bit hashes of
    shingles, 128-bit names of sets). A null, empty or blank text has no shingle and no link. doc_id is
    taken to name one text; repeated rows get equal answers. A null doc_id takes part in nothing and is kept,
    with a null component_id. Extra columns are ignored; an empty table gives no rows.

    Equal sets collapse to their smallest doc_id by one aggregation before any banding, so copies cost one
    row each, however many there are.
    """
    sketches = stage(in_small_batches(documents).select("doc_id", "text").mapInArrow(
        _sketches(plan), "doc_id bigint, n_shingles bigint, set_name binary, bands array<bigint>"), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    sets = stage(full.groupBy("set_name").agg(F.min(F.struct("doc_id", "bands")).alias("one")).select(
        "set_name", F.col("one.doc_id").alias("doc_id"), F.col("one.bands").alias("bands")), "distinct-sets")
    classes = links(sets.select("doc_id", "bands"), documents, plan)
    names = sets.select("set_name", F.col("doc_id").alias("rep")).join(
        classes.select(F.col("doc_id").alias("rep"), "component"), "rep", "left").select(
        "set_name", F.coalesce("component", "rep").alias("component_id"))
    linked = full.select("doc_id", "n_shingles", "set_name").join(names, "set_name").select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of ``documents``, all columns, whose document is kept; one row of those that share a doc_id and text stays per row given."""
    gone = near_duplicates(documents, plan).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["gone_id"], "left_anti")
