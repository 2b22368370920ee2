"""All 129 features at once, for many symbols at a time, as array operations.

More than a hundred window columns are too many for Spark's window operator: it reads every frame anew for every row and column. Here
the bars of a few dozen symbols lie side by side - a row for the n-th bar, a column for the symbol - so a lag is a shift of rows, a
frame a sum of shifted rows, and a recurrence one step for all symbols. Missing values are NaN. The definitions are those of
``features``, whose native columns serve where only a few are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

YEAR = 252 ** 0.5
ROWS = 16_384  # bars worked on at once, besides those of one symbol; some tens of MB
SHORT = 20


def shift(x: np.ndarray, k: int) -> np.ndarray:
    """The value k rows before."""
    out = np.full_like(x, np.nan)
    if k < len(x):
        out[k:] = x[:len(x) - k]
    return out


def full(x: np.ndarray, n: int) -> np.ndarray:
    out = x.copy()
    out[:n - 1] = np.nan
    return out


def sums(x: np.ndarray, ns: Sequence[int]) -> dict[int, np.ndarray]:
    """Sums of the last n rows, for several n in one pass; missing values are passed over."""
    x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
    total, out = np.zeros_like(x), {}
    for k in range(max(ns)):
        if k < len(x):
            total[k:] += x[:len(x) - k]
        if k + 1 in ns:
            out[k + 1] = total.copy()
    return out


def counts(x: np.ndarray, n: int) -> np.ndarray:
    """Known values of the last n rows."""
    so_far = np.cumsum(~np.isnan(x), axis=0)
    out = so_far.copy()
    out[n:] -= so_far[:-n]
    return out


def means(x: np.ndarray, ns: Sequence[int]) -> dict[int, np.ndarray]:
    return {n: over(total, counts(x, n)) for n, total in sums(x, ns).items()}


def over(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """a / b, missing where b is zero."""
    return np.where(b != 0, a / b, np.nan)


def extreme(x: np.ndarray, n: int, pick) -> np.ndarray:
    """Greatest (``np.fmax``) or least (``np.fmin``) known value of the last n rows, by frames of twice the size."""
    size, out = 1, x
    while 2 * size <= n:
        out = pick(out, shift(out, size))
        size *= 2
    return pick(out, shift(out, n - size)) if size < n else out


def filled(x: np.ndarray) -> np.ndarray:
    """The last known value."""
    known = ~np.isnan(x)
    if known.all():
        return x
    at = np.maximum.accumulate(np.where(known, np.arange(len(x))[:, None], 0), axis=0)
    return np.take_along_axis(x, at, axis=0)


def deviations(x: np.ndarray, ns: Sequence[int]) -> dict[int, np.ndarray]:
    """Sample deviations of the last n rows, from the distances to the newest value: equal values give exactly zero."""
    anchor, known = filled(x), ~np.isnan(x)
    plain = np.where(known, x, 0.0)
    first, second, out = np.zeros_like(x), np.zeros_like(x), {}
    for k in range(max(ns)):
        if k < len(x):
            apart = (plain[:len(x) - k] - anchor[k:]) * known[:len(x) - k]
            first[k:] += apart
            second[k:] += apart * apart
        if k + 1 in ns:
            n = counts(x, k + 1)
            spread = np.maximum(second - first * first / np.maximum(n, 1), 0.0)
            out[k + 1] = np.where(n > 1, np.sqrt(spread / np.maximum(n - 1, 1)), np.nan)
    return out


def correlation(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Of the last n rows; missing where either side does not move."""
    both = ~np.isnan(x) & ~np.isnan(y)
    at = {"x": filled(x), "y": filled(y)}
    a, b = np.where(both, x, np.nan), np.where(both, y, np.nan)
    sx, sy, sxy, m = (np.zeros_like(x) for _ in range(4))
    for k in range(min(n, len(x))):
        end = len(x) - k
        dx, dy, on = np.nan_to_num(a[:end] - at["x"][k:]), np.nan_to_num(b[:end] - at["y"][k:]), both[:end]
        sx[k:] += dx
        sy[k:] += dy
        sxy[k:] += dx * dy
        m[k:] += on
    covariance = over(sxy - over(sx * sy, m), m)
    kx, ky = counts(x, n), counts(y, n)
    population = lambda sd, k: np.where(k == 1, 0.0, sd * np.sqrt(over(k - 1.0, k)))
    return over(covariance, population(deviations(x, [n])[n], kx) * population(deviations(y, [n])[n], ky))


def smoothed(xs: list[np.ndarray], alphas: Sequence[float], least: Sequence[int]) -> list[np.ndarray]:
    """Exponential means, each seeded by its first known value and NaN before ``least`` of them; a missing value lets the weight of
    what came before fall, as pandas does. One step for all series and symbols."""
    x = np.stack(xs, axis=1)
    a = np.array(alphas)[:, None]
    out, mean, weight = np.empty_like(x), x[0].copy(), np.ones_like(x[0])
    out[0] = mean
    for t in range(1, len(x)):
        now = x[t]
        known, begun = now == now, mean == mean
        weight *= 1.0 - a
        step = (weight * mean + a * now) / (weight + a)
        mean = np.where(begun, np.where(known & (mean != now), step, mean), now)
        weight[known | ~begun] = 1.0
        out[t] = mean
    seen = np.cumsum(x == x, axis=0)
    return [np.where(seen[:, i] >= n, out[:, i], np.nan) for i, n in enumerate(least)]


def all_features(b: dict[str, np.ndarray], names: Sequence[str], shape: dict[str, Sequence[int]], blocked: Sequence[str]) -> list[np.ndarray]:
    """The features by name from open, high, low, close, volume, value, freq, fbuy, fsell. ``shape`` has the lengths of each family;
    ``blocked`` names those that need a day that traded."""
    c, h, low, v, value = (b[x] for x in ("close", "high", "low", "volume", "value"))
    rn = np.arange(1, len(c) + 1)[:, None] + np.zeros_like(c)
    out: dict[str, np.ndarray] = {}

    # Lags and the day's candle.
    c1 = shift(c, 1)
    for n in shape["returns"]:
        ratio = over(c, shift(c, n))
        out[f"return_{n}d"] = ratio - 1
        out[f"log_return_{n}d"] = np.where((shift(c, n) > 0) & (ratio > 0), np.log(ratio), np.nan)
    out["roc10"] = out["return_10d"]
    pc, diff = out["return_1d"], c - c1
    sign = np.sign(diff)
    has_open, rng = b["open"] > 0, h - low
    o, some = np.where(has_open, b["open"], c), h - low > 0
    gap = has_open & (c1 > 0)
    only = lambda cond, x: np.where(cond, x, np.nan)
    out |= {
        "gap_open": only(gap, b["open"] / c1 - 1), "open_to_close": only(gap, c / b["open"] - 1), "daily_range": only(some & (c > 0), rng / c),
        "body_pct": only(some, np.abs(c - o) / rng), "upper_wick_pct": only(some, (h - np.fmax(c, o)) / rng),
        "lower_wick_pct": only(some, (np.fmin(c, o) - low) / rng), "close_location": np.where(some, (c - low) / rng, 0.5),
        "bullish_candle": np.where(c >= o, 1.0, 0.0)}
    turned = np.where(sign == shift(sign, 1), 0.0, rn)
    run = rn - np.maximum.accumulate(turned, axis=0) + 1
    out |= {"up_streak": np.where(sign > 0, run, 0.0), "dn_streak": np.where(sign < 0, run, 0.0)}

    # Averages, bands and ranges of the close.
    mean = means(c, [n for n in shape["sma"] if n <= SHORT])
    ten = np.where(counts(c, 10) > 0, sums(c, [10])[10], np.nan)
    for n in shape["sma"]:
        if n > SHORT:
            mean[n] = sum((shift(ten, k) for k in range(10, n, 10)), ten) / n
        out[f"sma{n}"] = full(mean[n], n)
        out[f"close_vs_sma{n}"] = only(out[f"sma{n}"] > 0, c / out[f"sma{n}"] - 1)
    s20, s50, s200 = out["sma20"], out["sma50"], out["sma200"]
    before = shift(s20, 5)
    out["sma20_slope"] = only(before > 0, s20 / before - 1)
    crossed = ~np.isnan(s50) & (s200 > 0)
    out |= {"golden_cross": only(crossed, (s50 > s200) * 1.0), "sma50_vs_sma200": only(crossed, s50 / s200 - 1)}
    sd = full(deviations(c, [20])[20], 20)
    upper, lower = s20 + 2 * sd, s20 - 2 * sd
    width = over(upper - lower, s20)
    squeezed = (rn >= 39) & (width <= extreme(width, 20, np.fmin) * 1.1)
    out |= {"bb_width": width, "bb_position": (c - lower) / (upper - lower + 1e-10), "bb_squeeze": full(squeezed * 1.0, 25)}
    top20, bottom20 = extreme(c, SHORT, np.fmax), extreme(c, SHORT, np.fmin)
    for n in shape["ranges"]:
        steps = [*range(SHORT, n - SHORT, SHORT), n - SHORT] if n > SHORT else []
        top, bottom = top20, bottom20
        for k in steps:
            top, bottom = np.fmax(top, shift(top20, k)), np.fmin(bottom, shift(bottom20, k))
        out |= {f"close_vs_high_{n}d": full(np.where(top > 0, (c - top) / top, 0.0), n + 1),
                f"close_vs_low_{n}d": full(np.where(bottom > 0, (c - bottom) / bottom, 0.0), n + 1),
                f"range_pct_{n}d": full(np.where(bottom > 0, (top - bottom) / bottom, 0.0), n + 1)}
    path = sums(np.abs(diff), [20])[20]
    out["efficiency_ratio_20d"] = full(np.where(path > 0, np.abs(c - shift(c, 20)) / path, 0.0), 21)

    # Oscillators over high and low.
    hi, lo = extreme(h, 14, np.fmax), extreme(low, 14, np.fmin)
    k = full(100 * (c - lo) / (hi - lo + 1e-10), 14)
    out |= {"stoch_k": k, "stoch_d": only(counts(k, 3) == 3, means(k, [3])[3]), "williams_r": full(-100 * (hi - c) / (hi - lo + 1e-10), 14)}
    typical = (h + low + c) / 3
    flows = [sums(np.where(cond, typical * v, 0.0), [14])[14] for cond in (typical > shift(typical, 1), typical < shift(typical, 1))]
    out["mfi14"] = full(100 - 100 / (1 + flows[0] / (flows[1] + 1e-10)), 14)

    # Volatility.
    ups, downs = deviations(pc, shape["vols"]), deviations(np.where(pc < 0, pc, 0.0), shape["vols"])
    for n in shape["vols"]:
        out |= {f"hvol{n}": full(ups[n] * YEAR, n + 1), f"downside_vol{n}": full(downs[n] * YEAR, n + 1)}
    now = out["hvol20"]
    below, seen = np.zeros_like(c), counts(now, 60)
    for i in range(min(60, len(c))):
        below[i:] += now[:len(c) - i] <= now[i:]
    out["hvol_percentile_60d"] = only((rn >= 60) & (seen >= 10) & ~np.isnan(now), below / np.maximum(seen, 1))

    # Activity and flow.
    volumes, values = means(v, shape["vols"]), means(value, shape["vols"])
    for n in shape["vols"]:
        out |= {f"rel_volume_{n}d": full(v / (volumes[n] + 1e-10), n + 1), f"rel_value_{n}d": full(value / (values[n] + 1e-10), n + 1),
                f"avg_value_{n}d": full(values[n], n + 1)}
    balance = np.cumsum(np.nan_to_num(sign * v), axis=0)
    middle = means(balance, [20])[20]
    out["obv_vs_ma20"] = full((balance - middle) / (np.abs(middle) + 1e-10), 21)
    out |= {"vol_price_corr_5d": full(correlation(v, c, 5), 5), "zero_vol_pct_20d": full(means((v == 0) * 1.0, [20])[20], 20),
            "amihud_20d": full(means(np.abs(pc) / (value + 1), [20])[20], 20), "volume_today": v, "value_today": value, "freq_today": b["freq"]}
    ever, base = np.cumsum(b["fbuy"], axis=0) > 0, sums(value, shape["flows"])
    for name, x in (("net", b["fbuy"] - b["fsell"]), ("buy", b["fbuy"]), ("sell", b["fsell"])):
        for n, total in sums(x, shape["flows"]).items():
            out[f"foreign_{name}_{n}d"] = np.where(ever & (rn >= n), total / (base[n] + 1), 0.0)

    # Recurrences.
    gain, loss = np.maximum(diff, 0.0), np.maximum(-diff, 0.0)
    true_range = np.fmax(np.fmax(h - low, np.abs(h - c1)), np.abs(low - c1))
    series = ([(f"ema{n}", c, 2.0 / (n + 1), n) for n in (*shape["ema"], 12, 26)] + [(f"gain{n}", gain, 1.0 / n, n) for n in shape["rsi"]]
              + [(f"loss{n}", loss, 1.0 / n, n) for n in shape["rsi"]] + [(f"atr{n}", true_range, 1.0 / n, n) for n in shape["atr"]])
    e = dict(zip([s[0] for s in series], smoothed([s[1] for s in series], [s[2] for s in series], [s[3] for s in series])))
    for n in shape["ema"]:
        out |= {f"ema{n}": e[f"ema{n}"], f"close_vs_ema{n}": only(e[f"ema{n}"] > 0, c / e[f"ema{n}"] - 1)}
    e20, e50, e100 = e["ema20"], e["ema50"], e["ema100"]
    known = ~np.isnan(e20) & ~np.isnan(e50) & ~np.isnan(e100)
    rising, falling = (e20 > e50) & (e50 > e100), (e20 < e50) & (e50 < e100)
    # Without a close the averages alone decide, if they can.
    out |= {"ma_aligned_bull": only(known & ~(rising & np.isnan(c)), ((c > e20) & rising) * 1.0),
            "ma_aligned_bear": only(known & ~(falling & np.isnan(c)), ((c < e20) & falling) * 1.0)}
    for n in shape["rsi"]:
        out[f"rsi{n}"] = 100 - 100 / (1 + over(e[f"gain{n}"], e[f"loss{n}"]))
    for n in shape["atr"]:
        out |= {f"atr{n}": e[f"atr{n}"], f"atr{n}_pct": only(c > 0, e[f"atr{n}"] / c)}
    line = e["ema12"] - e["ema26"]
    signal = smoothed([line], [2.0 / 10], [9])[0]
    late = (rn >= 26) & (c != 0)
    out |= {"macd_line": only(late, line / c), "macd_signal": only(late, signal / c), "macd_hist": only(late, (line - signal) / c),
            "macd_bullish": only(rn >= 26, np.where(line - signal > 0, 1.0, 0.0))}

    traded = (rn >= 2) & (v > 0)
    return [only(traded, out[n]) if n in blocked else out[n] for n in names]


INPUTS = ("open", "high", "low", "close", "volume", "value", "freq", "fbuy", "fsell")


def by_symbols(table: pa.Table, names: Sequence[str], shape: dict[str, Sequence[int]], blocked: Sequence[str], least: int,
               ids: Sequence[str] = ("sym", "d", "close", "rn")) -> Iterator[pa.RecordBatch]:
    """The columns ``ids`` as they are and the features of whole symbols, whose rows follow each other in date order, numbered from 1 by ``rn``. Symbols of like length are put
    side by side, so at most half of the cells are empty. The first ``least`` - 1 rows of a symbol are left out."""
    table = table.combine_chunks()
    rn = table.column("rn").to_numpy()
    starts = np.flatnonzero(rn == 1)
    sizes = np.diff(np.append(starts, len(rn)))
    which = np.repeat(np.arange(len(starts)), sizes)
    x = {n: table.column(n).to_numpy() for n in INPUTS}
    alike = np.zeros(len(sizes), int) if sizes.max() * len(sizes) <= 2 * len(rn) else np.floor(np.log2(sizes)).astype(int)
    for length in np.unique(alike):
        some = np.flatnonzero(alike == length)
        column = np.full(len(starts), -1)
        column[some] = np.arange(len(some))
        rows = np.flatnonzero(column[which] >= 0)
        cells = (rn[rows] - 1) * len(some) + column[which[rows]]
        bars = {n: np.full((sizes[some].max(), len(some)), np.nan) for n in INPUTS}
        for n in INPUTS:
            bars[n].ravel()[cells] = x[n][rows]
        for n in ("volume", "value", "freq", "fbuy", "fsell"):
            bars[n][np.isnan(bars[n])] = 0.0  # cells after a symbol's last bar
        kept = rn[rows] >= least
        if not kept.any():
            continue
        rows, cells = rows[kept], cells[kept]
        with np.errstate(all="ignore"):
            flat = np.concatenate([f.ravel()[cells] for f in all_features(bars, names, shape, blocked)])
        values = pa.array(flat, pa.float64(), from_pandas=True)
        columns = [c.chunk(0) for c in table.select(list(ids)).take(pa.array(rows)).combine_chunks().columns] + [values.slice(i * len(rows), len(rows)) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays(columns, names=[*ids, *names])


def whole_symbols(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Batches put together to tables of whole symbols: a symbol that may go on in the next batch waits for it."""
    waiting: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(waiting)
        last = np.flatnonzero(table.column("rn").to_numpy() == 1)[-1]
        if last:
            yield table.slice(0, last)
        waiting = table.slice(last).combine_chunks().to_batches()
        count = table.num_rows - last
    if waiting:
        yield pa.Table.from_batches(waiting)
