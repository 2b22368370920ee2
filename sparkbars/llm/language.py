"""Language identification by interpolated Kneser-Ney character models.

A word is read as its lower-cased letters between two word borders; a model predicts every letter and the
closing border from up to ORDER - 1 symbols before it inside the word. A text's cross-entropy is then the sum
over its words, so a word is scored once per worker and looked up afterwards.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, mixed

ORDER = 5
LETTERS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"
#: The same runs in texts below U+0250, for which the standard library is faster.
LATIN = re.compile("[" + "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L") + "]+")
BEYOND, SPACES = re.compile("[\u0250-\U0010ffff]"), re.compile(r"\s")
#: Texts are cut at white space into stretches of this many characters, and words longer than LONG aren't remembered.
STRETCH, LONG = 1 << 20, 48
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """``grams[k]``: sorted hashes of all (k + 1)-grams of any language; ``own[k]``, ``weight[k]``: per gram and
    language the discounted probability of its last symbol, and the weight its own continuations leave to
    the shorter context."""

    languages: list[str]
    grams: list[np.ndarray]
    own: list[np.ndarray]
    weight: list[np.ndarray]
    uniform: float
    root: np.ndarray | None = None  # what the shortest grams leave to the uniform distribution
    limits: np.ndarray | None = None  # per language: usual cross-entropy, its spread, and how far from it is too far


def _keys(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order the hash of the gram that ends at each symbol (0: the word is too short for it), the symbol's
    place in its word, and its word. Every word has an opening border, place 0, and a closing one."""
    text = "".join(f" {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(word)) - (np.cumsum(sizes) - sizes)[word]
    hashed = mixed(points + np.uint64(1))
    keys = [hashed]
    for k in range(1, ORDER):
        longer = np.zeros(len(points), np.uint64)
        longer[1:] = mixed(keys[-1][:-1] * MULTIPLIER + hashed[1:])
        longer[place < k] = 0
        keys.append(longer)
    return keys, place, word


def train(counts: dict[str, dict[str, int]]) -> Model:
    """Interpolated Kneser-Ney from word counts per language.

    The longest grams, and those that open a word and so have no symbol before them, keep their counts; all
    others count the distinct symbols before them. The discount of an order is n1 / (n1 + 2 n2).
    """
    languages = sorted(counts)
    tables: list[list[tuple]] = []
    alphabet: set[int] = set()
    for language in languages:
        words = list(counts[language])
        keys, place, word = _keys(words)
        times = np.fromiter(counts[language].values(), np.float64, len(words))[word]
        alphabet.update(np.unique(keys[0]).tolist())
        per_order: list[tuple] = []
        for k in range(ORDER):
            opens = place == k  # the gram starts with the opening border
            use = (place >= max(k, 1)) if k else (place >= 1)
            counted = use & ((k == ORDER - 1) | opens)
            parts = [(keys[k][counted], times[counted])]
            if k < ORDER - 1:
                inner = use & ~opens
                wider, first = np.unique(keys[k + 1][inner], return_index=True)
                parts.append((keys[k][inner][first], np.ones(len(wider))))
            gram = np.concatenate([p[0] for p in parts])
            value = np.concatenate([p[1] for p in parts])
            # the context of each gram is the gram one shorter that ends just before
            before = np.concatenate([[np.uint64(0)], keys[k - 1][:-1]]) if k else np.zeros(len(place), np.uint64)
            context = np.concatenate([before[counted], before[inner][first] if k < ORDER - 1 else before[:0]])
            gram, at, back = np.unique(gram, return_index=True, return_inverse=True)
            per_order.append((gram, np.bincount(back, value, len(gram)), context[at]))
        tables.append(per_order)
    uniform = 1.0 / (len(alphabet) + 1)
    grams, own, weight = [], [], []
    for k in range(ORDER):
        # An opening border is never predicted, but is a context: it belongs to the shortest grams.
        every = [t[k][0] for t in tables]
        if k == 0:
            every.append(mixed(np.array([0x20], np.uint64) + np.uint64(1)))
        union = np.unique(np.concatenate(every))
        grams.append(union)
        own.append(np.zeros((len(union), len(languages)), np.float32))
        weight.append(np.ones((len(union), len(languages)), np.float32))
    root = np.ones(len(languages))
    for j, per_order in enumerate(tables):
        for k, (gram, value, context) in enumerate(per_order):
            n1, n2 = (value == 1).sum(), (value == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            known, group = np.unique(context, return_inverse=True)
            total = np.bincount(group, value)
            share = np.bincount(group, np.minimum(value, discount)) / total
            own[k][np.searchsorted(grams[k], gram), j] = np.maximum(value - discount, 0) / total[group]
            if k == 0:
                root[j] = share[0]
            else:
                weight[k - 1][np.searchsorted(grams[k - 1], known), j] = share
    return Model(languages, grams, own, weight, uniform, root.astype(np.float32))


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Per word: the log-probability under each language, and last the number of symbols predicted."""
    width = len(model.languages)
    if not words:
        return np.zeros((0, width + 1))
    keys, place, word = _keys(words)
    p = np.broadcast_to(np.float32(model.uniform), (len(place), width)) * model.root
    context = None
    for k in range(ORDER):
        table = model.grams[k]
        at = np.minimum(np.searchsorted(table, keys[k]), max(len(table) - 1, 0))
        found = (table[at] == keys[k]) & (place >= k) if len(table) else np.zeros(len(place), bool)
        if k:
            inside = np.zeros(len(place), bool)
            inside[1:] = context[1][:-1]
            inside &= place >= k
            rows = np.flatnonzero(inside)
            p[rows] *= model.weight[k - 1][context[0][rows - 1]]
        hit = np.flatnonzero(found)
        p[hit] += model.own[k][at[hit]]
        context = (at, found)
    logs = np.log(p, dtype=np.float32)
    logs[place == 0] = 0
    out = np.zeros((len(words), width + 1))
    starts = np.flatnonzero(place == 0)
    out[:, :width] = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
    out[:, width] = np.diff(np.append(starts, len(place))) - 1
    return out


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    text = text.lower()
    return (LETTERS if not text.isascii() and BEYOND.search(text) else LATIN).findall(text)


class Scorer:
    """Scores of the words met, in one table that starts anew when it is full."""

    def __init__(self, model: Model, most: int = 250_000):
        self.model, self.most = model, most
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages) + 1), np.float32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        end = self.used + len(words)
        if end > len(self.table):
            grown = np.zeros((max(2 * len(self.table), end), self.table.shape[1]), np.float32)
            grown[:self.used] = self.table[:self.used]
            self.table = grown
        for start in range(0, len(words), 50_000):
            some = words[start:start + 50_000]
            self.table[self.used:self.used + len(some)] = word_scores(self.model, some)
            self.row.update(zip(some, range(self.used, self.used + len(some))))
            self.used += len(some)

    def _add(self, out: np.ndarray, owners: list[int], lists: list[list[str]]) -> None:
        """Adds the scores of lists of words to their owners' rows; what is new in all of them is scored at once."""
        distinct = set().union(*lists)
        long = [w for w in distinct if len(w) > LONG]  # never remembered
        if long:
            alone = dict(zip(long, word_scores(self.model, long)))
            for owner, words in zip(owners, lists):
                for word in words:
                    if len(word) > LONG:
                        out[owner] += alone[word]
            lists = [[w for w in words if len(w) <= LONG] for words in lists]
            distinct.difference_update(long)
        fresh = distinct.difference(self.row)
        if len(self.row) + len(fresh) > self.most:
            self.row, self.used, fresh = {}, 0, distinct
        self._learn(list(fresh))
        for start in range(0, len(lists), 4096):
            some = [(o, words) for o, words in zip(owners[start:start + 4096], lists[start:start + 4096]) if words]
            if some:
                sizes = np.array([len(words) for _, words in some])
                at = np.fromiter(map(self.row.__getitem__, chain.from_iterable(words for _, words in some)), np.int64, int(sizes.sum()))
                sums = np.add.reduceat(self.table[at], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
                np.add.at(out, [o for o, _ in some], sums)

    def score_all(self, texts: Iterable[str], n: int, at_once: int = 300_000) -> np.ndarray:
        """For each of ``n`` texts the sum over the whole text of ``word_scores``."""
        out = np.zeros((n, self.table.shape[1]))
        owners: list[int] = []
        lists: list[list[str]] = []
        held = 0
        for i, text in enumerate(texts):
            start = 0
            while start < len(text):
                end = start + STRETCH
                if end < len(text):
                    gap = SPACES.search(text, end)
                    end = gap.start() if gap else len(text)
                owners.append(i)
                lists.append(words_of(text[start:end]))
                held += len(lists[-1])
                start = end
                if held >= at_once:
                    self._add(out, owners, lists)
                    owners, lists, held = [], [], 0
        if lists:
            self._add(out, owners, lists)
        return out

    def score(self, text: str) -> np.ndarray:
        return self.score_all([text], 1)[0]


def judged(model: Model, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Language number, confidence, cross-entropy and rejection of rows of ``Scorer.score``; -1: no letter."""
    n = sums[:, -1:]
    usable = n[:, 0] > 0
    entropy = -sums[:, :-1] / np.maximum(n, 1)
    best = entropy.argmin(axis=1)
    low = entropy[np.arange(len(sums)), best]
    # Symbols depend on each other, so evidence is taken to grow with the first 50 symbols only.
    odds = np.exp((low[:, None] - entropy) * np.minimum(n, 50))
    score = np.where(usable, 1 / odds.sum(axis=1), 0.0)
    if model.limits is None:
        rejected = ~usable
    else:
        usual, spread, far = model.limits[best].T
        rejected = ~usable | (low > usual + far * spread / np.sqrt(np.clip(n[:, 0], 1, 64)))
    return np.where(usable, best, -1), score, np.where(usable, low, np.nan), rejected


def _labelled_sample(documents: DataFrame, max_rows: int, max_chars: int, max_languages: int) -> DataFrame:
    """Per language the distinct texts first by hash: up to ``max_rows`` of them and ``max_chars`` characters in total,
    of up to ``max_chars`` / 10 each. Rates come from estimated numbers of distinct texts of all rows, so copies count
    once, and no task sorts a language's every text."""
    labelled = documents.where("text is not null and lang is not null").select("text", "lang")
    rows = labelled.withColumn("n", F.length("text")).where(F.col("n") <= max_chars // 10).withColumn(
        "draw", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)))
    totals = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).limit(max_languages + 1).collect()
    if len(totals) > max_languages:
        raise ValueError(f"more than {max_languages} languages are labelled")
    keep = F.lit(False)
    for lang, count in totals:
        keep = keep | ((F.col("lang") == lang) & (F.col("draw") < int(min(1.0, 2.0 * max_rows / count) * (1 << 30))))
    order = Window.partitionBy("lang").orderBy("draw", "text")
    return rows.where(keep).distinct().withColumn("k", F.row_number().over(order)).withColumn("chars", F.sum("n").over(
        order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("k") <= max_rows) & (F.col("chars") <= max_chars))


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            words = pd.Series([w for t in group["text"] for w in words_of(t)], dtype=object)
            found = words.value_counts()
            yield pd.DataFrame({"lang": lang, "word": found.index.astype(object), "n": found.to_numpy()})


def _shuffled(text: str) -> str:
    """The text with the letters of each word in another order: no language, but its letters."""
    rng = random.Random(len(text))
    return " ".join("".join(rng.sample(w, len(w))) for w in words_of(text))


def _distances(shipped):
    """How far calibration texts are from languages: their own, others (up to 8, in turn), and, shuffled, their own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        scorer, number = Scorer(model), {language: j for j, language in enumerate(model.languages)}
        for pdf in batches:
            pdf = pdf[pdf["lang"].isin(number)]
            plain = scorer.score_all(pdf["text"], len(pdf))
            mixed_up = scorer.score_all(map(_shuffled, pdf["text"]), len(pdf))
            rows = []
            for language, sums, other in zip(pdf["lang"], plain, mixed_up):
                n, own = sums[-1], number[language]
                if not n:
                    continue
                rows.append((own, "own" if sums[:-1].argmax() == own else "missed", n, -sums[own] / n))
                rows.append((own, "shuffled", n, -other[own] / max(other[-1], 1)))
                for step in range(min(8, len(number) - 1)):
                    j = (own + 1 + (int(n) + step) % (len(number) - 1)) % len(number)
                    rows.append((j, "foreign", n, -sums[j] / n))
            yield pd.DataFrame(rows, columns=["language", "kind", "n", "entropy"])
    return run


def fit(documents: DataFrame, max_rows: int = 1500, max_chars: int = 2_000_000, max_languages: int = 256,
        usual_share: float = 0.999, room: float = 1.25) -> Model:
    """Learn from the ``text`` and ``lang`` of labelled rows (nulls in either are skipped).

    The models are fitted on a bounded sample: per language at most ``max_rows`` distinct texts of at most ``max_chars``
    characters together (the bound of everything that reaches the driver); four fifths of it train, one fifth
    calibrates the rejection. A text goes if its cross-entropy is farther from the language's usual one than halfway from
    that of ``usual_share`` of the language's own texts to that of the middle text of other languages or of shuffled
    letters, whichever is nearer; but never within ``room`` times the former. No labelled row with a letter: no
    languages, and every text is undetermined.
    """
    sample = _labelled_sample(documents, max_rows, max_chars, max_languages).withColumn("calibrates", F.col("k") % 5 == 0).select(
        "text", "lang", "calibrates")
    words = sample.where("not calibrates or lang is null").select("text", "lang").mapInPandas(
        _word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    counts = {lang: dict(zip(g["word"], g["n"])) for lang, g in words.sort_values(["lang", "word"]).groupby("lang")}
    if not counts:
        return Model([], [], [], [], 1.0)
    model = train(counts)
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    measured = sample.where("calibrates").select("text", "lang").mapInPandas(
        _distances(shipped), "language int, kind string, n double, entropy double").toPandas()
    limits = np.zeros((len(model.languages), 3))
    for j in range(len(model.languages)):
        mine = measured[measured["language"] == j]
        weight = np.sqrt(np.minimum(mine["n"].to_numpy(float), 64))
        entropy, kind = mine["entropy"].to_numpy(float), mine["kind"].to_numpy()
        own = kind == "own"
        if own.sum() < 20:
            limits[j] = np.log(1 / model.uniform), 1, 3  # too few to say what is usual: only what no letter of it fits goes
            continue
        usual = np.average(entropy[own], weights=weight[own] ** 2)
        apart = (entropy - usual) * weight
        spread = max(float(np.sqrt(np.mean(apart[own] ** 2))), 0.2)
        apart /= spread
        far = max(float(np.quantile(apart[own], usual_share)), 2.0)
        strange = min((float(np.median(apart[kind == k])) for k in ("foreign", "shuffled") if (kind == k).any()), default=far)
        limits[j] = usual, spread, max((far + strange) / 2, room * far)
    model.limits = limits
    return model


NEW = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("rejected", T.BooleanType())])


def annotate(documents: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``documents`` with lang_pred, score, cross_entropy, n_symbols and rejected.

    lang_pred is the language of lowest length-normalised cross-entropy over the whole text, ``und`` if the
    text is null or has no letter (score 0, cross_entropy null, rejected); of equal ones, the first by name.
    ``rejected`` says that even the best language lies beyond its calibrated limit. Columns of the same names
    in the input are replaced; other extra columns stay. Order and repeats of rows don't matter.
    """
    rows = in_small_batches(documents).drop(*NEW.names)
    schema = T.StructType(rows.schema.fields + NEW.fields)
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    column, names_out = rows.columns.index("text"), [*rows.columns, *NEW.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        scorer, names = Scorer(model), [*model.languages, UNDETERMINED]
        for batch in batches:
            if model.languages:
                sums = scorer.score_all((t.as_py() or "" for t in batch.column(column)), batch.num_rows)
            else:
                sums = np.zeros((batch.num_rows, 2))
            best, score, entropy, rejected = judged(model, sums) if model.languages and len(sums) else (
                np.full(len(sums), -1), np.zeros(len(sums)), np.full(len(sums), np.nan), np.ones(len(sums), bool))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[i] for i in best], pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)),
                 pa.array(sums[:, -1].astype(np.int64)), pa.array(rejected, pa.bool_())], names=names_out)

    return rows.mapInArrow(run, schema)


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that the model doesn't reject, with all their columns as they are, whatever those are called.
    Rejected are null texts, texts without a letter, and those beyond their language's limit; repeated rows are judged alike."""
    names = documents.columns
    plain = documents.toDF(*["text" if c == "text" else f"_{i}" for i, c in enumerate(names)])
    return annotate(plain, model).where("not rejected").select(*plain.columns).toDF(*names)


def predict_held_out(documents: DataFrame, **bounds) -> DataFrame:
    """Fit on the rows whose crc32(doc_id as text) mod 4 is not 2 and predict all rows:
    ``(doc_id, held_out, lang_pred, score, cross_entropy, rejected)``. A null doc_id is neither held out nor learned from."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = fit(documents.where(fold != 2), **bounds)
    return annotate(documents.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
