"""Recursive smoothings: one Arrow grouped map computes every recurrence of a symbol in one pass.

Spark has no built-in carry between rows, so this is the one place where per-symbol Python runs.
A group is one symbol's sessions (bounded, see ``windows``). Apply it after the window operators:
they already partition by symbol, so the grouped map adds no exchange.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ewm(x: pd.Series, alpha: float, min_periods: int) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False, min_periods=min_periods).mean()


def _seeded(x: pd.Series, n: int, alpha: float) -> pd.Series:
    """Exponential mean whose first value is the plain mean of the first n defined values."""
    defined = x.dropna()
    if len(defined) < n:
        return pd.Series(np.nan, index=x.index)
    seeded = defined.copy()
    seeded.iloc[: n - 1] = np.nan
    seeded.iloc[n - 1] = defined.iloc[:n].mean()
    return seeded.ewm(alpha=alpha, adjust=False).mean().reindex(x.index)


def _true_range(b: pd.DataFrame) -> pd.Series:
    prev = b["close"].shift(1)
    parts = [b["high"] - b["low"], (b["high"] - prev).abs(), (b["low"] - prev).abs()]
    return pd.concat(parts, axis=1).max(axis=1)


def _gains(b: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
    delta = b["close"].diff()
    return delta.clip(lower=0), (-delta).clip(lower=0)


def ema(b: pd.DataFrame, n: int) -> pd.Series:
    """First-value seed, alpha 2 / (n + 1), NULL before n rows."""
    return _ewm(b["close"], 2.0 / (n + 1), n)


def ema_sma(b: pd.DataFrame, n: int) -> pd.Series:
    """Mean seed at row n."""
    return _seeded(b["close"], n, 2.0 / (n + 1))


def rsi_ewm(b: pd.DataFrame, n: int) -> pd.Series:
    """Exponential gains over losses; no loss at all is NULL."""
    gain, loss = _gains(b)
    rs = _ewm(gain, 1.0 / n, n) / _ewm(loss, 1.0 / n, n).replace(0, np.nan)
    return 100 - 100 / (1 + rs)


def rsi_wilder(b: pd.DataFrame, n: int) -> pd.Series:
    """Mean-seeded gains over losses; no loss at all is 100."""
    gain, loss = _gains(b)
    g, l = _seeded(gain, n, 1.0 / n), _seeded(loss, n, 1.0 / n)
    value = 100 - 100 / (1 + g / l.where(l > 0))
    return value.where(~(l <= 0), 100.0).where(g.notna())


def atr_ewm(b: pd.DataFrame, n: int) -> pd.Series:
    return _ewm(_true_range(b), 1.0 / n, n)


def atr_wilder(b: pd.DataFrame, n: int) -> pd.Series:
    """Mean-seeded; the first bar has no true range."""
    return _seeded(_true_range(b).where(b["close"].shift(1).notna()), n, 1.0 / n)


def macd(b: pd.DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, seed: str = "sma") -> pd.DataFrame:
    """Line, signal and histogram, with mean-seeded or first-value-seeded averages."""
    if seed == "sma":
        line = ema_sma(b, fast) - ema_sma(b, slow)
        sig = _seeded(line, signal, 2.0 / (signal + 1))
    else:
        line = ema(b, fast) - ema(b, slow)
        sig = _ewm(line, 2.0 / (signal + 1), signal)
    return pd.DataFrame({"line": line, "signal": sig, "hist": line - sig})


def adx(b: pd.DataFrame, n: int = 14) -> pd.Series:
    """Directional index: running sums that lose 1/n per row, then a mean-seeded smoothing.
    The first value sits one row after the first n index values (row 2n, counting from 0)."""
    up, down = b["high"].diff(), -b["low"].diff()
    plus = up.clip(lower=0).where(up > down, 0.0)
    minus = down.clip(lower=0).where(down > up, 0.0)
    moves = pd.DataFrame({"tr": _true_range(b), "plus": plus, "minus": minus}).iloc[1:]
    if len(b) < 2 * n or len(moves) < n:
        return pd.Series(np.nan, index=b.index)
    # s_i = s_{i-1} (1 - 1/n) + x_i with s_{n-1} the sum of the first n is n times a seeded mean.
    sums = moves.apply(lambda x: _seeded(x, n, 1.0 / n))
    base = sums["tr"].where(sums["tr"] != 0)
    pdi = (100 * sums["plus"] / base).fillna(0.0).where(sums["tr"].notna())
    mdi = (100 * sums["minus"] / base).fillna(0.0).where(sums["tr"].notna())
    total = pdi + mdi
    dx = ((pdi - mdi).abs() / total.where(total > 0) * 100).fillna(0.0).where(total.notna()).dropna()
    out = pd.Series(np.nan, index=b.index)
    if len(dx) <= n:
        if len(dx) == n and 2 * n < len(b):
            out.iloc[2 * n] = dx.mean()
        return out
    smooth = _seeded(dx, n, 1.0 / n)
    # Value number n of dx (counting from 0) belongs to row 2n; the seed itself, value n - 1, is
    # overwritten by the first smoothed one.
    values = smooth.to_numpy()[n:]
    out.iloc[2 * n: 2 * n + len(values)] = values
    return out


def sar(b: pd.DataFrame, start: float = 0.02, step: float = 0.02, top: float = 0.2, rule: str = "close") -> pd.DataFrame:
    """Parabolic stop and reverse: ``sar`` and ``trend`` (1 long, -1 short), from the second bar on.

    The state is a mode (direction), its extreme and its acceleration. A bar that reaches the stop flips the direction: the
    stop becomes the extreme of the closed trade, moved out of the last two bars, and the acceleration starts anew; a new
    extreme raises it by ``step`` up to ``top``. A stop never enters the two bars before. The first direction is long if the
    second close is not below the first (``rule="close"``), or unless the second bar's low moved further down than its high
    moved up (``rule="moves"``). A bar without high or low is passed over: it has the values of the bar before.
    """
    if rule not in ("close", "moves"):
        raise ValueError(f"no start rule {rule!r}")
    high, low, close = (b[c].to_numpy(float) for c in ("high", "low", "close"))
    stop, trend = np.full(len(b), np.nan), np.full(len(b), np.nan)
    usable = np.flatnonzero(~(np.isnan(high) | np.isnan(low) | np.isnan(close)))
    if len(usable) >= 2:
        h, l, c = (x[usable].tolist() for x in (high, low, close))
        up = c[1] >= c[0] if rule == "close" else not (l[0] - l[1] > max(h[1] - h[0], 0.0))
        s, extreme, speed = (l[0], max(h[0], h[1]), start) if up else (h[0], min(l[0], l[1]), start)
        stop[usable[1]], trend[usable[1]] = s, 1.0 if up else -1.0
        for i in range(2, len(h)):
            s = s + speed * (extreme - s)
            s = min(s, l[i - 1], l[i - 2]) if up else max(s, h[i - 1], h[i - 2])
            if l[i] < s if up else h[i] > s:
                s = max(extreme, h[i], h[i - 1]) if up else min(extreme, l[i], l[i - 1])
                up, extreme, speed = not up, l[i] if up else h[i], start
            elif h[i] > extreme if up else l[i] < extreme:
                extreme, speed = h[i] if up else l[i], min(speed + step, top)
            stop[usable[i]], trend[usable[i]] = s, 1.0 if up else -1.0
        out = pd.DataFrame({"sar": stop, "trend": trend}, index=b.index)
        return out.ffill()
    return pd.DataFrame({"sar": stop, "trend": trend}, index=b.index)


#: Kinds of several columns: name_part for each part.
PARTS = {"macd": ("line", "signal", "hist"), "sar": ("sar", "trend")}
KINDS = {
    "ema": ema, "ema_sma": ema_sma, "rsi_ewm": rsi_ewm, "rsi_wilder": rsi_wilder,
    "atr_ewm": atr_ewm, "atr_wilder": atr_wilder, "adx": adx,
}

# A requested column: (name, kind, arguments). MACD gives name_line, name_signal and name_hist, SAR name_sar and name_trend.
Request = tuple[str, str, dict]


def with_recurrences(df: DataFrame, wanted: Sequence[Request], price: str = "close",
                     high: str = "high", low: str = "low") -> DataFrame:
    """The frame with all requested recurrences, computed in one grouped map. The other columns stay Arrow arrays: only
    three prices are looked at."""
    names: list[str] = []
    for name, kind, _ in wanted:
        names += [f"{name}_{part}" for part in PARTS[kind]] if kind in PARTS else [name]
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])

    def per_symbol(table: pa.Table) -> pa.Table:
        d = table.column("d").to_numpy()
        if (d[1:] < d[:-1]).any():
            table = table.take(np.argsort(d, kind="stable"))
        bars = pd.DataFrame({name: table.column(x).cast(pa.float64()).to_numpy() for name, x in (("close", price), ("high", high), ("low", low))})
        new: dict[str, pd.Series] = {}
        for name, kind, args in wanted:
            if kind in PARTS:
                for part, values in {"macd": macd, "sar": sar}[kind](bars, **args).items():
                    new[f"{name}_{part}"] = values
            else:
                new[name] = KINDS[kind](bars, **args)
        # pandas marks missing numbers as NaN; SQL wants NULL.
        added = [pa.array(new[n].to_numpy(float), pa.float64(), from_pandas=True) for n in names]
        return pa.Table.from_arrays([*table.columns, *added], names=schema.names)

    return df.groupBy("sym").applyInArrow(per_symbol, schema)


def ema_latest(values: Column, n: int) -> Column:
    """The newest mean-seeded average from an ordered array, without Python: for jobs that need
    one number per symbol."""
    k = 2.0 / (n + 1)
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, v: a + v) / n
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(rest, seed, lambda a, v: v * k + a * (1 - k)))
