"""Phrase collocations by direct-address tiling of word pairs, applied to its own outcome again.

A phrase of k words that occurs often consists of two often occurring phrases of k - 1 words that overlap in all but one
word. So each level counts pairs only: at level 2 the ids at neighbouring places are words, from level 3 on they are the
frequent phrases of the level before, ranked anew by their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MULTIPLIER, WordHashes, mixed, stage

#: Everything that ends a piece becomes a full stop; what bytes.split() then cuts at is space and tab alone.
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
STOP = b"."


@dataclass(frozen=True)
class Plan:
    """Phrases of 2 to ``longest`` words that occur ``least`` times and more; the first ``top`` of each language.

    The ``1 << head_bits`` most frequent ids of a level are ranked; their pairs fall into tiles of ``1 << tile_bits``
    ids a side. ``filter_bits`` is the size of the bitmap that tells other frequent ids (as a power of two): a
    fuller bitmap lets more rare pairs pass to the exact counts, and loses nothing.
    """

    longest: int = 5
    least: int = 100
    top: int = 2000
    head_bits: int = 15
    tile_bits: int = 10
    filter_bits: int = 23
    at_once: int = 1 << 21
    stretch: int = 1 << 24


def stretches(text: str, size: int) -> Iterator[list[bytes]]:
    """The words of a text and STOP between its pieces, in lists of about ``size`` bytes; a word is never cut."""
    data = text.encode().lower().translate(ENDS)
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            gaps = [g for g in (data.find(c, end) for c in (b" ", b"\t", STOP)) if g >= 0]
            end = min(gaps) if gaps else len(data)
        yield data[start:end].replace(STOP, b" . ").split()
        start = end


def seed(lang: str) -> np.uint64:
    """A language's own bits, from another hash than that of the words: a word that is spelled as its language would
    else get the id 0 of a gap."""
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=1))


def together(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The id of the phrase whose first words are ``p`` and whose last are ``q``."""
    return mixed(p * MULTIPLIER + q)


class Words(WordHashes):
    """Hashes of words; long ones are worked out each time."""

    def __missing__(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word) if len(word) > 64 else super().__missing__(word)


def _word_counts(plan: Plan):
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        found = [(lang, word, n) for lang, words in counts.items() for word, n in words.items()]
        # A row without a word is the language's total.
        found += [(lang, None, sum(words.values())) for lang, words in counts.items()]
        columns = list(zip(*found)) if found else [()] * 3
        return pa.RecordBatch.from_arrays([
            pa.array(columns[0], pa.string()), pa.array([w if w is None else w.decode() for w in columns[1]], pa.string()),
            pa.array(columns[2], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = counts.setdefault(lang, Counter())
                for some in stretches(text.as_py(), plan.stretch):
                    before = len(words)
                    words.update(some)
                    if some.count(STOP):
                        del words[STOP]
                    held += len(words) - before
                    if held > 300_000:
                        yield rows(counts)
                        counts, held = {}, 0
                        words = counts.setdefault(lang, Counter())
        yield rows(counts)
    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, word, n = batch.columns
        hashes = np.array([xxhash.xxh3_64_intdigest(w.as_py().encode()) for w in word], np.uint64)
        seeds = np.array([seed(x.as_py()) for x in lang], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(mixed(hashes ^ seeds).view(np.int64)), lang, word, n], ["key", "lang", "word", "n"])


@dataclass
class Known:
    """What is known of the frequent ids of a level, of a size that does not depend on the data: the ids ranked
    first (``keys`` ascending, ``ranks`` their ranks, ``by_rank`` the way back), and a bitmap of all."""

    keys: np.ndarray
    ranks: np.ndarray
    by_rank: np.ndarray
    bits: np.ndarray
    shift: np.uint64

    def has(self, ids: np.ndarray) -> np.ndarray:
        return self.bits[(ids >> self.shift).astype(np.int64)]

    def rank(self, ids: np.ndarray) -> np.ndarray:
        """Ranks of ids, -1 where unranked."""
        if not len(self.keys):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.keys, ids), len(self.keys) - 1)
        return np.where(self.keys[at] == ids, self.ranks[at], -1)


def known(level: DataFrame, plan: Plan) -> Known:
    """The ranks and the bitmap of a table ``(key, n)``: at most ``1 << head_bits`` rows and ``1 << filter_bits`` bits
    reach the driver."""
    head = level.orderBy(F.desc("n"), "key").limit(1 << plan.head_bits).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    slot = F.shiftrightunsigned("key", 64 - plan.filter_bits)
    words = level.groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - plan.filter_bits}) & 63 as int))")).alias("bits")).toPandas()
    packed = np.zeros(max((1 << plan.filter_bits) // 64, 1), np.int64)
    packed[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    bits = np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)
    order = np.argsort(head)
    return Known(head[order], order.astype(np.int32), head, bits, np.uint64(64 - plan.filter_bits))


def _runs(sorted_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal codes."""
    starts = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]]) if len(sorted_codes) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(sorted_codes)])


def count_pairs(p: np.ndarray, q: np.ndarray, names: Known, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids and their counts. Pairs of ranked ids are dealt to tiles: a tile that many pairs meet is
    counted by direct addresses, one dense counter per cell; the pairs of all other tiles, and those with an
    unranked id, are sorted as coordinates."""
    rp, rq = names.rank(p), names.rank(q)
    ranked = (rp >= 0) & (rq >= 0)
    hp, hq = rp[ranked], rq[ranked]
    side = plan.head_bits - plan.tile_bits
    tile = (hp >> plan.tile_bits << side) | hq >> plan.tile_bits
    order = np.argsort(tile.astype(np.int32), kind="stable")
    hp, hq = hp[order].astype(np.int64), hq[order].astype(np.int64)
    starts, sizes = _runs(tile[order])
    cell, mask = 1 << 2 * plan.tile_bits, (1 << plan.tile_bits) - 1
    found, sparse = [], []
    for start, size in zip(starts.tolist(), sizes.tolist()):
        tp, tq = hp[start:start + size], hq[start:start + size]
        if size >= cell >> 6:
            table = np.bincount((tp & mask) << plan.tile_bits | tq & mask, minlength=cell)
            at = np.flatnonzero(table)
            found.append(((tp[0] & ~mask) | at >> plan.tile_bits, (tq[0] & ~mask) | at & mask, table[at]))
        else:
            sparse.append(tp << plan.head_bits | tq)
    if sparse:
        codes = np.sort(np.concatenate(sparse))
        starts, sizes = _runs(codes)
        found.append((codes[starts] >> plan.head_bits, codes[starts] & ((1 << plan.head_bits) - 1), sizes))
    tp, tq = p[~ranked], q[~ranked]
    order = np.argsort(together(tp, tq))
    tp, tq = tp[order], tq[order]
    changed = np.flatnonzero(np.r_[True, (tp[1:] != tp[:-1]) | (tq[1:] != tq[:-1])]) if len(tp) else np.empty(0, np.int64)
    parts = [(names.by_rank[a], names.by_rank[b], n) for a, b, n in found]
    parts.append((tp[changed], tq[changed], np.diff(np.r_[changed, len(tp)])))
    a, b, n = (np.concatenate(column) for column in zip(*parts))
    return a, b, n.astype(np.int64)


PAIRS = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("n", pa.int64())])


def _pair_counts(shipped, words_in_phrase: int, plan: Plan):
    """Partial counts of the phrases of that many words, as pairs of phrases of one word less."""
    stop = xxhash.xxh3_64_intdigest(STOP)

    def count(ids: np.ndarray, names: Known) -> pa.RecordBatch:
        broken = ids == 0
        for _ in range(words_in_phrase - 2):
            broken = broken[:-1] | broken[1:]
            ids = together(ids[:-1], ids[1:])
        fine = names.has(ids) & ~broken
        at = np.flatnonzero(fine[:-1] & fine[1:])
        p, q, n = count_pairs(ids[at], ids[at + 1], names, plan)
        return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(q.view(np.int64)), pa.array(n)], schema=PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes = shipped.value, Words()
        parts: list[np.ndarray] = []
        held, gap = 0, np.zeros(1, np.uint64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = seed(lang)
                for some in stretches(text.as_py(), plan.stretch):
                    raw = hashes.of(some)
                    ids = mixed(raw ^ own)
                    ids[raw == stop] = 0
                    parts.append(ids)
                    held += len(ids)
                    if held >= plan.at_once:
                        ids = np.concatenate(parts)
                        yield count(ids, names)
                        # The last words go before those to come: phrases over the border count once.
                        parts = [ids[-(words_in_phrase - 1):]]
                        held = len(parts[0])
                parts.append(gap)
        if parts and sum(map(len, parts)) >= words_in_phrase:
            yield count(np.concatenate(parts), names)
    return run


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p, q = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(together(p, q).view(np.int64)), *batch.columns], ["key", "p", "q", "n"])


def best_cut(df: DataFrame) -> DataFrame:
    """Adds l, r and score: of the cuts after ``firsts[k]`` | ``rests[k]``, the lowest floor(1000 a n / (l r)), the smallest
    k of equals. Products are decimals of 38 digits, so nothing is rounded."""
    cut = F.expr("""array_min(transform(sequence(1, size(firsts)), k -> named_struct(
        'score', (cast(1000 as decimal(4, 0)) * cast(a as decimal(18, 0)) * cast(n as decimal(16, 0)))
                 div (cast(firsts[k - 1] as decimal(18, 0)) * cast(rests[k - 1] as decimal(18, 0))),
        'k', k, 'l', firsts[k - 1], 'r', rests[k - 1])))""")
    return df.withColumn("cut", cut).select("*", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")).drop("cut")


def candidates(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``(lang, phrase, a, n, firsts, rests, covered)``: all phrases that occur often enough, the counts of their first
    and last words for each cut, and the highest count of a longer candidate that contains them (null: none).

    Words and phrases are known by 64-bit hashes of their language and words; counts are exact up to collisions of these.
    Each level reads the texts once; a task sends on the distinct pairs of a run of words, and only those whose parts
    may both be frequent. Null and empty texts hold no words; a null lang counts as ``und``; repeated rows count each.
    """
    spark = documents.sparkSession
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = stage(texts.mapInArrow(_word_counts(plan), "lang string, word string, n bigint").groupBy("lang", "word").agg(
        F.sum("n").alias("n")).where((F.col("n") >= plan.least) | F.col("word").isNull()), "words")
    totals = counted.where("word is null").select("lang", "n")
    frequent = counted.where("word is not null").select("lang", "word", "n")
    empty = F.array().cast("array<bigint>")
    level = stage(frequent.mapInArrow(_keyed, "key bigint, lang string, word string, n bigint").select(
        "key", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("a"), empty.alias("firsts"), empty.alias("rests")), "level")
    levels, covers = [], []
    for size in range(2, plan.longest + 1):
        shipped = spark.sparkContext.broadcast(known(level.select("key", F.col("a").alias("n")), plan))  # of fixed size
        pairs = texts.mapInArrow(_pair_counts(shipped, size, plan), "p bigint, q bigint, n bigint").groupBy("p", "q").agg(
            F.sum("n").alias("n")).where(F.col("n") >= plan.least)
        pairs = stage(pairs.mapInArrow(_with_key, "key bigint, p bigint, q bigint, n bigint"), "pairs")
        first = level.select(F.col("key").alias("p"), "lang", F.col("phrase").alias("p_phrase"), F.col("a").alias("p_a"), F.col("firsts").alias("p_firsts"))
        rest = level.select(F.col("key").alias("q"), "last", F.col("a").alias("q_a"), F.col("rests").alias("q_rests"))
        level = stage(pairs.join(first, "p").join(rest, "q").select(
            "key", "lang", F.concat_ws(" ", "p_phrase", "last").alias("phrase"), "last", F.col("n").alias("a"),
            F.concat("p_firsts", F.array("p_a")).alias("firsts"), F.concat(F.array("q_a"), "q_rests").alias("rests")), "level")
        levels.append(level)
        covers.append(pairs.select(F.explode(F.array("p", "q")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("covered")))
        if level.isEmpty():
            break
    out = None
    for level, cover in zip(levels, [*covers[1:], None]):
        # Whatever a longer phrase covers with the same count, a phrase of one word more covers too.
        rows = level.join(cover, "key", "left") if cover is not None else level.withColumn("covered", F.lit(None).cast("bigint"))
        rows = rows.select("lang", "phrase", "a", "firsts", "rests", "covered")
        out = rows if out is None else out.unionByName(rows)
    return out.join(totals, "lang")


def phrases(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: per language the first ``plan.top`` phrases by score, count and
    words. A phrase goes if a longer one contains it wherever it occurs. Texts are cut into pieces at ``.,;:!?`` and line
    ends, and these at spaces and tabs; A-Z count as a-z. Nulls as in ``candidates``; extra columns are ignored; an empty
    table gives no rows."""
    kept = best_cut(candidates(documents, plan).where("covered is null or covered < a"))
    # A language may hold most phrases: its first ones are among the first of each of many parts.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    kept = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= plan.top)
    whole = Window.partitionBy("lang").orderBy(*order)
    return kept.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= plan.top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
