"""Chat formatting by cumulative-snapshot collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE = "<|end|>\n"


def _content() -> Column:
    """A turn's identity; the role's length keeps role and text apart."""
    return F.sha2(F.concat_ws("\x1f", F.length("role").cast("string"), "role", "text"), 256)


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """One row per turn: its rank, the length of its conversation and the rolling hash of the turns up to it.

    The hash of a prefix is the running sum of place-bound turn digests (2 x 60 bits), so a turn extends it
    in constant time and memory, however long the conversation is. Texts don't travel: only digests are sorted.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "key")
    ranked = turns_of(conversations).select("conv_id", "turn", _content().alias("key")).select(
        "conv_id", "turn", "key", F.row_number().over(order).alias("rank"))
    for part in (0, 1):
        text = F.concat_ws("\x1f", F.col("rank").cast("string"), "key")
        digest = F.conv(F.substring(F.sha2(text, 256), 1 + 15 * part, 15), 16, 10).cast("decimal(20,0)")
        ranked = ranked.withColumn(f"d{part}", digest)
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.select(
        "conv_id", "rank", F.sum("d0").over(rolling).alias("h0"), F.sum("d1").over(rolling).alias("h1"),
        F.lead("rank").over(order).isNull().alias("whole"))


def maximal(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_snapshots)`` of the conversations that are no proper prefix of another one.

    Equal conversations are one snapshot class, named by its smallest conv_id; the class is found by an
    aggregation before the anti-join, so a conversation logged a million times is one row on both sides.
    """
    rows = prefixes(conversations)
    key = ["rank", "h0", "h1"]
    whole = rows.where("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots"))
    longer = rows.where("not whole").select(*key).distinct()
    return whole.join(longer, key, "left_anti").select("conv_id", F.col("rank").cast("bigint").alias("n_turns"), "n_snapshots")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations rendered as training text: ``(conv_id, n_turns, n_snapshots, rendered)``.

    Turns are ordered by turn, equal or null turns by content (nulls first); repeated rows are turns of their
    own. A null role reads ``unknown``, a null text is empty; rows with a null conv_id form one conversation,
    which ranks before all others. Other columns are ignored; an empty table gives an empty result. A rendered
    conversation is one value, so its length is bounded by Spark's row size, the number of conversations by nothing.
    """
    turns = turns_of(conversations)
    keep = maximal(conversations).select(F.col("conv_id").alias("keep_id"), "n_turns", "n_snapshots")
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit(CLOSE))
    rendered = turns.join(keep, F.col("conv_id").eqNullSafe(F.col("keep_id"))).groupBy("conv_id").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_snapshots").alias("n_snapshots"),
        F.sort_array(F.collect_list(F.struct("turn", _content().alias("key"), line.alias("line")))).alias("turns"))
    return rendered.select("conv_id", "n_turns", "n_snapshots", F.concat_ws("", F.col("turns.line")).alias("rendered"))
