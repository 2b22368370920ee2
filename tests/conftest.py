import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkbars.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk():
    """Three seeded random walks of daily bars as one pandas frame."""
    frames = []
    for k, sym in enumerate(("AAAA", "BBBB", "CCCC")):
        rng = np.random.default_rng(7 + k)
        n = 320 - 40 * k
        close = 1000 * np.exp(np.cumsum(rng.normal(0.0006, 0.015, n)))
        high, low = close * (1 + rng.uniform(0, 0.02, n)), close * (1 - rng.uniform(0, 0.02, n))
        frames.append(pd.DataFrame({
            "sym": sym, "d": [x.date() for x in pd.bdate_range("2024-01-02", periods=n)], "open": low + (high - low) * rng.uniform(0, 1, n),
            "high": high, "low": low, "close": close, "volume": rng.integers(1, 10_000, n), "value": rng.uniform(1e8, 1e10, n),
            "freq": rng.integers(1, 900, n), "fbuy": rng.uniform(0, 1000, n).round(), "fsell": rng.uniform(0, 1000, n).round(), "shares": 1_000_000,
        }))
    out = pd.concat(frames, ignore_index=True)
    out["prev"] = out.groupby("sym")["close"].shift(1)
    out["change"] = out["close"] - out["prev"]
    return out


@pytest.fixture(scope="session")
def bars(spark, walk):
    return spark.createDataFrame(walk)


def day(text):
    return dt.date.fromisoformat(text)
