"""Hard-negative mining: exact integer inner products by Strassen's recursion, and heaps that merge.

Anchors and candidates meet in cells of bounded size. Inside a cell their vectors form square int64 tiles that are
multiplied by Strassen's seven-product recursion; the scores of a tile are offered to one bounded heap per anchor, and
heaps of different cells merge by keeping the first of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, stage

#: Below this side a tile is multiplied directly: its operands then stay in the first-level cache.
LEAF = 32


@dataclass(frozen=True)
class Plan:
    """Per anchor the first ``positives`` rows of its label, and per positive the first ``negatives`` rows of another
    label with ``low`` * positive <= 10 * negative <= ``high`` * positive. A cell holds about ``anchors`` x ``candidates``
    vectors at most; ``panel`` is how many candidates are multiplied at once."""

    positives: int = 5
    negatives: int = 10
    low: int = 3
    high: int = 9
    anchors: int = 1024
    candidates: int = 8192
    panel: int = 1024


def quantise(column: pd.Series, dim: int) -> np.ndarray:
    """floor(256 x) of each component, in int64, or as Python integers where one doesn't fit."""
    rows = np.stack(column.to_numpy()).astype(np.float64) if dim else np.zeros((len(column), 0))
    scaled = np.floor(256 * rows)
    if scaled.size and np.abs(scaled).max() >= 2.0 ** 62:
        return np.array([[int(np.floor(256 * float(x))) if abs(x) < 2.0 ** 900 else int(x) * 256 for x in r] for r in rows], object)
    return scaled.astype(np.int64)


def tile_side(dim: int) -> tuple[int, int]:
    """Side of the square tiles for vectors of ``dim`` components, and the depth of the recursion: the side is the
    least multiple of 2 ** depth that holds them, with leaves of at most LEAF."""
    depth = 0
    while dim > LEAF << depth:
        depth += 1
    leaf = max(-(-dim // (1 << depth)), 1)
    return leaf << depth, depth


def strassen(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Products of stacks of square matrices (the last two axes; the others broadcast). Integer additions are exact,
    and what leaves 64 bits on the way comes back, since the ring of int64 wraps around."""
    if not depth:
        return a @ b
    h = a.shape[-1] // 2
    a11, a12, a21, a22 = a[..., :h, :h], a[..., :h, h:], a[..., h:, :h], a[..., h:, h:]
    b11, b12, b21, b22 = b[..., :h, :h], b[..., :h, h:], b[..., h:, :h], b[..., h:, h:]
    m1 = strassen(a11 + a22, b11 + b22, depth - 1)
    m2 = strassen(a21 + a22, b11, depth - 1)
    m3 = strassen(a11, b12 - b22, depth - 1)
    m4 = strassen(a22, b21 - b11, depth - 1)
    m5 = strassen(a11 + a12, b22, depth - 1)
    m6 = strassen(a21 - a11, b11 + b12, depth - 1)
    m7 = strassen(a12 - a22, b21 + b22, depth - 1)
    out = np.empty((*m1.shape[:-2], 2 * h, 2 * h), m1.dtype)
    out[..., :h, :h] = m1 + m4 - m5 + m7
    out[..., :h, h:] = m3 + m5
    out[..., h:, :h] = m2 + m4
    out[..., h:, h:] = m1 - m2 + m3 + m6
    return out


def _tiles(x: np.ndarray, side: int) -> np.ndarray:
    """Rows as a stack of ``side`` x ``side`` tiles, padded with zeros."""
    n = max(-(-len(x) // side), 1)
    out = np.zeros((n * side, side), x.dtype)
    out[:len(x), :x.shape[1]] = x
    return out.reshape(n, side, side)


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products, exact. Raises OverflowError if one does not fit 64 bits."""
    m, n, dim = len(anchors), len(candidates), anchors.shape[1]
    if not m or not n or not dim:
        return np.zeros((m, n), np.int64)
    bound = float(np.abs(anchors).max()) * float(np.abs(candidates).max()) * dim
    if bound >= 2.0 ** 62:
        anchors, candidates = anchors.astype(object), candidates.astype(object)
    side, depth = tile_side(dim)
    a = _tiles(anchors, side)[:, None]
    b = np.swapaxes(_tiles(candidates, side), -1, -2)[None]
    if a.dtype != object:
        b = np.ascontiguousarray(b)
    c = strassen(a, b, depth)
    whole = c.transpose(0, 2, 1, 3).reshape(a.shape[0] * side, b.shape[1] * side)[:m, :n]
    return whole.astype(np.int64)


class Heaps:
    """For each row the first ``k`` offers by (score descending, id ascending).

    Offers to a row must come in ascending order of id: then only a score above the row's last kept one can enter a
    full heap, and a panel of scores is filtered by one comparison.
    """

    def __init__(self, rows: int, k: int):
        self.k = k
        self.row = self.score = self.id = np.empty(0, np.int64)
        self.floor = np.full(rows, np.iinfo(np.int64).min)
        self.full = np.zeros(rows, bool)

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = (np.concatenate(pair) for pair in ((self.row, row), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, row))  # ~x falls as x rises and cannot overflow
        row, score, ids = row[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        kept = place < self.k
        self.row, self.score, self.id = row[kept], score[kept], ids[kept]
        last = place == self.k - 1
        self.full[row[last]] = True
        self.floor[row[last]] = score[last]

    def wanted(self, values: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which of the values (one line a row) could enter."""
        return (values > self.floor[rows, None]) | ~self.full[rows, None]


def _panels(right: pd.DataFrame, dim: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    right = right.sort_values("vec_id", kind="stable", ignore_index=True)
    x, ids = quantise(right["embedding"], dim), right["vec_id"].to_numpy()
    for start in range(0, len(right), size):
        yield x[start:start + size], ids[start:start + size], right.iloc[start:start + size]


POSITIVES = "key bigint, anchor_id bigint, positive_id bigint, positive_score bigint"


def _positives(plan: Plan):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        heaps = Heaps(len(left), plan.positives)
        keys, own = left["key"].to_numpy(), left["vec_id"].to_numpy()
        if len(left) and len(right):
            dim = int(left["dim"].iloc[0])
            anchors = quantise(left["embedding"], dim)
            for x, ids, _ in _panels(right, dim, plan.panel):
                s = scores(anchors, x)
                r, c = np.nonzero(heaps.wanted(s) & (own[:, None] != ids))
                heaps.offer(r, s[r, c], ids[c])
        return pd.DataFrame({"key": keys[heaps.row], "anchor_id": own[heaps.row], "positive_id": heaps.id, "positive_score": heaps.score})
    return run


def window(positive: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole negative score of each positive score's window, without leaving 64 bits."""
    tens, rest = np.divmod(positive, 10)
    return plan.low * tens - (-plan.low * rest) // 10, plan.high * tens + plan.high * rest // 10


NEGATIVES = "key bigint, nth int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _negatives(plan: Plan):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sizes = left["positive_ids"].map(len).to_numpy(np.int64)
        owner = np.repeat(np.arange(len(left)), sizes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        positive_ids = np.concatenate([np.empty(0, np.int64), *left["positive_ids"]]).astype(np.int64)
        positive = np.concatenate([np.empty(0, np.int64), *left["positive_scores"]]).astype(np.int64)
        heaps = Heaps(len(owner), plan.negatives)
        if len(left) and len(right):
            dim = int(left["dim"].iloc[0])
            anchors, labels = quantise(left["embedding"], dim), left["label"].to_numpy()
            low, high = window(positive, plan)
            for x, ids, rows in _panels(right, dim, plan.panel):
                s = scores(anchors, x)
                other = labels[:, None] != rows["label"].to_numpy()
                for k in range(plan.positives):  # the anchors' k-th positives, each against its own window
                    at = np.flatnonzero(nth == k)
                    mine = s[owner[at]]
                    hit = (mine >= low[at, None]) & (mine <= high[at, None]) & other[owner[at]]
                    r, c = np.nonzero(hit & heaps.wanted(mine, at))
                    heaps.offer(at[r], mine[r, c], ids[c])
        own = owner[heaps.row]
        return pd.DataFrame({
            "key": left["key"].to_numpy()[own], "nth": nth[heaps.row].astype(np.int32), "anchor_id": left["vec_id"].to_numpy()[own],
            "positive_id": positive_ids[heaps.row], "positive_score": positive[heaps.row], "negative_id": heaps.id, "negative_score": heaps.score})
    return run


def _meet(anchors: DataFrame, candidates: DataFrame, by: list[str], plan: Plan):
    """Cells in which every anchor meets every candidate that agrees with it in ``by``, each pair once.

    Both sides of a group are dealt over blocks by hash, as many as its counts ask for, so the size of a cell is
    bounded whatever the group holds; an anchor is sent to each of its group's candidate blocks and the other way round.
    """
    n_anchors = anchors.groupBy(*by).agg(F.count("*").alias("n_anchors"))
    n_rows = candidates.groupBy(*by).agg(F.count("*").alias("n_rows"))
    sizes = stage(n_anchors.join(n_rows, by).select(
        *by, F.ceil(F.col("n_anchors") / plan.anchors).cast("int").alias("a_blocks"),
        F.ceil(F.col("n_rows") / plan.candidates).cast("int").alias("c_blocks")), "sizes")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = anchors.join(sizes, by).withColumn("a_block", F.pmod(F.xxhash64("key"), F.col("a_blocks")).cast("int")).withColumn(
        "c_block", every("c_blocks")).drop("a_blocks", "c_blocks")
    right = candidates.join(sizes, by).withColumn("c_block", F.pmod(F.xxhash64("row"), F.col("c_blocks")).cast("int")).withColumn(
        "a_block", every("a_blocks")).drop("a_blocks", "c_blocks", "row")
    cell, parts = [*by, "a_block", "c_block"], n_parts(anchors.sparkSession)
    # The number of partitions is given: cells are small in bytes and long in work, and would be coalesced.
    return left.repartition(parts, *cell).groupBy(*cell).cogroup(right.repartition(parts, *cell).groupBy(*cell))


def _first(df: DataFrame, k: int, by: list[str], score: str, ids: str, name: str) -> DataFrame:
    """Merges the heaps of all cells: the first ``k`` per group, cut in every task before the exchange too."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), ids)
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def usable() -> Column:
    """Whether a row takes part: an id, a label, and a vector of finite components (which may be empty)."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))


def prepared(embeddings: DataFrame, shifted: int = 7) -> DataFrame:
    """``(row, vec_id, label, dim, embedding)`` of the usable rows; every ``shifted``-th id has its label moved on by
    one, modulo ten. ``row`` tells repeated rows apart."""
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % shifted == 0, (label + 1) % 10).otherwise(label)
    return stage(embeddings.where(usable()).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", moved.alias("label"), F.size("embedding").alias("dim"), "embedding"), "vectors")


def mine(vectors: DataFrame, anchors: Column, plan: Plan = Plan()) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows of ``prepared``
    that ``anchors`` selects, against all rows.

    Scores are inner products of the components floor(256 x); vectors of different length don't meet. Other rows are
    rows of another vec_id. Anchors of equal id, label and vector count once, repeated candidates each; ties go to the
    smaller vec_id. A positive without a negative in its window gives no row, nor does an anchor without a positive;
    an empty table gives none. Extra columns are ignored. A score of more than 64 bits raises OverflowError.

    Two passes over cells of bounded size: same-label cells for the positives, then all for the windows. Candidates
    are sent once per block of ``plan.anchors`` anchors, and a cell returns no more than its heaps.
    """
    rows = vectors.select("row", "vec_id", "label", "dim", "embedding")
    chosen = stage(vectors.where(anchors).select("vec_id", "label", "dim", "embedding").distinct().withColumn(
        "key", F.monotonically_increasing_id()), "anchors")
    near = _meet(chosen, rows, ["dim", "label"], plan).applyInPandas(_positives(plan), POSITIVES)
    first = _first(near, plan.positives, ["key"], "positive_score", "positive_id", "nth")
    ordered = F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score")))
    asked = stage(chosen.join(first.groupBy("key").agg(ordered.alias("p")), "key").select(
        "key", "vec_id", "label", "dim", "embedding", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores")), "asked")
    far = _meet(asked, rows, ["dim"], plan).applyInPandas(_negatives(plan), NEGATIVES)
    return _first(far, plan.negatives, ["key", "nth"], "negative_score", "negative_id", "rank").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, every: int = 100, plan: Plan = Plan()) -> DataFrame:
    """``mine`` with the ids divisible by ``every`` as anchors. Rows with a null id, label or vector, or with a null
    or non-finite component, take no part."""
    return mine(prepared(embeddings), F.col("vec_id") % every == 0, plan)
