"""Keyed state that tolerates disorder: running indicators and signal maturity.

Bars of a symbol may arrive in any order inside the horizon, and more than once: they are held in the symbol's state until
the watermark has passed their date, the newest version of a date wins, and only then is the state moved on, in
order of dates. So a late or corrected bar never meets a state that is already past it. The state of a symbol is a
handful of numbers (or the last h bars) and the bars of one horizon; a symbol without bars for ``idle_days`` leaves it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)


def _ms(d: dt.date) -> int:
    return (d - EPOCH).days * DAY_MS


def _in_order(pending: pd.DataFrame, watermark_ms: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The held bars whose date the watermark has passed, in order of dates and each in its newest version; and the rest."""
    newest = pending.sort_values(["d", "version"], kind="stable").drop_duplicates("d", keep="last")
    past = newest["d"].map(_ms).to_numpy(np.int64) <= watermark_ms
    return newest[past].reset_index(drop=True), newest[~past].reset_index(drop=True)


def _keyed(bars: DataFrame, columns: list[str], own: str, output: str, names: list[str], fresh: tuple, advance: Callable, horizon_days: int,
           idle_days: int) -> DataFrame:
    """Runs ``advance(key, own state, settled bars) -> (rows, own state)`` over the settled bars of each symbol.

    The state is ``own`` (its numbers), the last settled date, and the held bars as parallel arrays."""
    kinds = {"d": "date", "version": "long"}
    held = ["d", *columns, "version"]
    schema = f"{own}, settled date, " + ", ".join(f"held_{c} array<{kinds.get(c, 'double')}>" for c in held)
    width = len(fresh)
    if "version" not in bars.columns:
        bars = bars.withColumn("version", F.lit(0).cast("long"))
    rows = bars.where("sym is not null and d is not null").select(
        "sym", "d", *[F.col(c).cast("double").alias(c) for c in columns], F.col("version").cast("long").alias("version"), F.col("d").cast("timestamp").alias("_at"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = state.get if state.exists else (*fresh, None, *([] for _ in held))
        mine, settled = known[:width], known[width]
        pending = pd.DataFrame(dict(zip(held, map(list, known[width + 1:]))), columns=held)
        new = [pending] if len(pending) else []
        if not state.hasTimedOut:
            new += [p[held] for p in parts if len(p)]
        pending = pd.concat(new, ignore_index=True) if new else pending
        if settled is not None and len(pending):
            pending = pending[pending["d"] > settled]  # that date is done with
        ready, pending = _in_order(pending, now)
        out = pd.DataFrame({c: [] for c in names})
        if len(ready):
            out, mine = advance(key, mine, ready)
            settled = ready["d"].iloc[-1]
        if not len(pending) and settled is not None and _ms(settled) + idle_days * DAY_MS <= now:
            state.remove()
        else:
            state.update((*mine, settled, *(pending[c].tolist() for c in held)))
            # Called again when the watermark has passed the first held bar, or when the symbol has been idle.
            due = _ms(pending["d"].iloc[0]) if len(pending) else _ms(settled) + idle_days * DAY_MS
            state.setTimeoutTimestamp(max(due, now + 1))
        yield out[names]

    # The date is the event time; a session's zone must not move it, so streams of dates run in UTC sessions.
    return rows.withWatermark("_at", f"{horizon_days} days").groupBy("sym").applyInPandasWithState(
        step, output, schema, "append", GroupStateTimeout.EventTimeTimeout)


def _smooth(values: np.ndarray, before: float | None, alpha: float) -> np.ndarray:
    """y = alpha x + (1 - alpha) y, going on from a value or starting with the first x."""
    given = values if before is None else np.r_[before, values]
    out = pd.Series(given).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out if before is None else out[1:]


def advance_indicators(n: int) -> Callable:
    """Moves EMA, RSI and ATR on over settled bars; the batch twin is ``recurrences`` with ema, rsi_ewm and atr_ewm."""
    alpha, k = 1.0 / n, 2.0 / (n + 1)

    def advance(key: tuple, state: tuple, bars: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        count, last, ema, gain, loss, atr = state
        close, high, low = (bars[c].to_numpy(float) for c in ("close", "high", "low"))
        prev = np.r_[np.nan if count == 0 else last, close[:-1]]
        tr = np.fmax(high - low, np.fmax(np.abs(high - prev), np.abs(low - prev)))
        seq = count + 1 + np.arange(len(close))
        emas, atrs = _smooth(close, ema if count else None, k), _smooth(tr, atr if count else None, alpha)
        moves = (close - prev)[seq > 1]  # the first bar has no move
        up, down = np.maximum(moves, 0.0), np.maximum(-moves, 0.0)
        gains = losses = np.empty(0)
        if len(moves):
            gains, losses = _smooth(up, gain if count > 1 else None, alpha), _smooth(down, loss if count > 1 else None, alpha)
        rsi = np.full(len(close), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi[seq > 1] = np.where(losses > 0, 100 - 100 / (1 + gains / losses), np.nan)
        rsi[seq <= n] = np.nan
        out = pd.DataFrame({"sym": key[0], "d": bars["d"], "close": close, "ema": np.where(seq >= n, emas, np.nan), "rsi": rsi,
                            "atr": np.where(seq >= n, atrs, np.nan)})
        state = (int(seq[-1]), float(close[-1]), float(emas[-1]), float(gains[-1]) if len(gains) else float(gain),
                 float(losses[-1]) if len(losses) else float(loss), float(atrs[-1]))
        return out, state
    return advance


def running_indicators(bars: DataFrame, n: int = 14, horizon_days: int = 14, idle_days: int = 400) -> DataFrame:
    """EMA, RSI and ATR of every settled bar of ``sym, d, high, low, close`` and optionally ``version``, first-value seeded.

    A bar is emitted once the watermark (the newest date less ``horizon_days``) has passed its date; whatever the order of
    arrival up to then, the rows are those of the batch twin. Bars later than that are dropped."""
    out = _keyed(bars, ["high", "low", "close"], "n long, close double, ema double, gain double, loss double, atr double",
                 "sym string, d date, close double, ema double, rsi double, atr double", ["sym", "d", "close", "ema", "rsi", "atr"],
                 (0, 0.0, 0.0, 0.0, 0.0, 0.0), advance_indicators(n), horizon_days, idle_days)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ema", "rsi", "atr")})


OUTCOMES = ["sym", "d", "exit_date", "entry_price", "realized_return", "outcome"]


def advance_signals(h: int, target: float) -> Callable:
    """Decides signals over settled bars. A signal with an entry zone is EXPIRED if the next bar opens outside of it; any
    other is a HIT or a MISS by the close of the h-th bar after it. The state is the last h bars."""
    names = ["open", "close", "entry", "zone_low", "zone_high"]

    def advance(key: tuple, state: tuple, bars: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        before = pd.DataFrame({"d": list(state[0]), **{c: list(v) for c, v in zip(names, state[1:])}}, columns=["d", *names])
        line = pd.concat([before, bars[["d", *names]]], ignore_index=True) if len(before) else bars[["d", *names]]
        new = np.arange(len(line)) >= len(before)
        opens = line["open"].to_numpy(float)
        # Per bar: whether its open leaves the zone of the signal before it. A missing bound or open does not.
        outside = np.zeros(len(line), bool)
        low, high = line["zone_low"].to_numpy(float), line["zone_high"].to_numpy(float)
        outside[1:] = (opens[1:] < low[:-1]) | (opens[1:] > high[:-1])
        issued = line["entry"].to_numpy(float) > 0
        at = np.flatnonzero(new[1:] & outside[1:] & issued[:-1]) + 1
        parts = [(at - 1, at, None)]
        at = np.flatnonzero(new[h:]) + h
        at = at[issued[at - h] & ~outside[at - h + 1]]
        parts.append((at - h, at, line["close"].to_numpy(float)[at] / line["entry"].to_numpy(float)[at - h] - 1))
        rows = []
        days, entry = line["d"].tolist(), line["entry"].tolist()
        for since, until, returns in parts:
            for k, (i, j) in enumerate(zip(since.tolist(), until.tolist())):
                ret = None if returns is None else float(returns[k])
                rows.append((key[0], days[i], days[j], entry[i], ret, "EXPIRED" if ret is None else "HIT" if ret >= target else "MISS"))
        tail = line.tail(h)
        return pd.DataFrame(rows, columns=OUTCOMES), (tail["d"].tolist(), *(tail[c].tolist() for c in names))
    return advance


def maturing_signals(bars: DataFrame, h: int = 5, target: float = 0.02, horizon_days: int = 14, idle_days: int = 400) -> DataFrame:
    """Stream of traded bars with ``entry`` (a price where a signal is issued at the close, else NULL) to outcomes, which
    are emitted once the deciding bar is settled. Optional columns: ``open``, ``zone_low`` and ``zone_high`` (the band in
    which the next open must lie), ``version``. The batch twins are ``evaluation.mature`` and ``evaluation.zone_outcomes``."""
    columns = ["open", "close", "entry", "zone_low", "zone_high"]
    full = bars.withColumns({c: F.lit(None).cast("double") for c in columns if c not in bars.columns})
    own = "dates array<date>, " + ", ".join(f"last_{c} array<double>" for c in columns)
    out = _keyed(full, columns, own, "sym string, d date, exit_date date, entry_price double, realized_return double, outcome string", OUTCOMES,
                 ([], [], [], [], [], []), advance_signals(h, target), horizon_days, idle_days)
    return out.withColumn("realized_return", F.when(~F.isnan("realized_return"), F.col("realized_return")))
