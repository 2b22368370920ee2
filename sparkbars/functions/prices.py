"""Price projections: exchange ticks, Fibonacci levels, quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, num

# Exchange tick per price band (upper price bound, tick); above the last bound the tick is 50.
TICK_BANDS = ((200, 1), (500, 2), (2000, 5), (5000, 25))
TOP_TICK = 50


def tick_round(x: Column | str) -> Column:
    """Nearest valid price; halves go to the even multiple."""
    p = col(x)
    tick = F.lit(TOP_TICK)
    for bound, size in reversed(TICK_BANDS):
        tick = F.when(p < bound, F.lit(size)).otherwise(tick)
    return F.bround(p / tick) * tick


# Fibonacci retracement and extension ratios, measured down from the high.
FIB_RATIOS = {
    "r0": 0.0, "r236": 0.236, "r382": 0.382, "r500": 0.5, "r618": 0.618, "r786": 0.786, "r1000": 1.0,
    "x1272": -0.272, "x1618": -0.618,
}


def fib(low: Column | str, high: Column | str) -> Column:
    """Struct of retracements below the high and extensions above it."""
    lo, hi = col(low), col(high)
    return F.struct(*[(hi - (hi - lo) * r).alias(k) for k, r in FIB_RATIOS.items()])


def spread_pct(bid: Column | str, offer: Column | str) -> Column:
    b, o = num(bid), num(offer)
    return F.when((b != 0) & (o != 0) & (b + o > 0), (o - b) / ((o + b) / 2) * 100)


def depth_imbalance(bid_vol: Column | str, offer_vol: Column | str) -> Column:
    b, o = num(bid_vol), num(offer_vol)
    return F.when(b + o != 0, (b - o) / (b + o) * 100)
