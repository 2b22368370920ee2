"""Canonical schemas. One bar is one (sym, d): that key is unique.

Uniqueness is what bounds every per-symbol window in this package: a symbol's group holds
at most one row per trading session (about 250 a year), whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType([
    T.StructField("d", T.DateType(), False),
    T.StructField("sym", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("prev", T.DoubleType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("first", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("change", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("freq", T.LongType()),
    T.StructField("offer", T.DoubleType()),
    T.StructField("offer_vol", T.LongType()),
    T.StructField("bid", T.DoubleType()),
    T.StructField("bid_vol", T.LongType()),
    T.StructField("shares", T.LongType()),
    T.StructField("tradable", T.LongType()),
    T.StructField("index_indiv", T.DoubleType()),
    T.StructField("index_weight", T.DoubleType()),
    T.StructField("fsell", T.DoubleType()),
    T.StructField("fbuy", T.DoubleType()),
    T.StructField("delisted", T.DateType()),
    T.StructField("nr_volume", T.LongType()),
    T.StructField("nr_value", T.DoubleType()),
    T.StructField("nr_freq", T.LongType()),
    T.StructField("remarks", T.StringType()),
    T.StructField("ext_id", T.LongType()),
    T.StructField("src", T.StringType()),
    T.StructField("loaded_at", T.TimestampType()),
])

INDEX_BARS = T.StructType([
    T.StructField("d", T.DateType(), False),
    T.StructField("index_code", T.StringType(), False),
    T.StructField("prev", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("change", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("freq", T.LongType()),
    T.StructField("stocks", T.LongType()),
    T.StructField("market_cap", T.DoubleType()),
])

# One broker's activity in one security on one day; declared for landing data, no operator reads it.
BROKER_SYMBOL_DAILY = T.StructType([
    T.StructField("d", T.DateType(), False),
    T.StructField("broker", T.StringType(), False),
    T.StructField("sym", T.StringType(), False),
    T.StructField("volume", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("freq", T.LongType()),
])
