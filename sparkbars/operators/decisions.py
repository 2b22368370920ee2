"""Reason codes, risk flags, costs and the decision gate of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import BUY_FEE, SELL_FEE, SLIPPAGE
from .snapshot import keep


# Per code: the stored text (fixed values), and what it means in plain words; $1 stands for the figure.
FINDINGS = {
    "momentum_5d": ("Strong 5-day momentum (+$1%)", "Five sessions have added $1% to the price."),
    "trend_20d": ("Strong 20-day trend (+$1%)", "The price stands $1% above its level of a month ago."),
    "rsi_low": ("RSI14 oversold ($1)", "An RSI of $1 says that sellers have dominated lately."),
    "rsi_middle": ("RSI14 balanced ($1)", "An RSI of $1 favours neither buyers nor sellers."),
    "above_averages": ("Price above all key moving averages", "Short, medium and long averages all lie below the price."),
    "high_20d": ("Near 20-day high (breakout zone)", "The monthly high is within one per cent."),
    "high_60d": ("Near 60-day high (breakout zone)", "The quarterly high is within two per cent."),
    "volume": ("Volume expansion $1x vs 5-day avg", "Turnover in shares is $1 times that of an average day of the week."),
    "squeeze": ("Bollinger Band squeeze (pre-breakout signal)", "The bands have narrowed; a wider range tends to follow."),
    "upper_band": ("Price in upper Bollinger range ($1%)", "Measured between the bands, the price is at $1%."),
    "macd": ("MACD histogram positive (bullish momentum)", "The fast average is gaining on the slow one."),
    "market_up": ("Supportive market regime ($1)", "Most of the market is rising with it (state $1)."),
    "foreign_buying": ("Foreign net buying 5-day ($1% of turnover)", "Over a week foreigners took a net $1% of the turnover."),
    "efficiency": ("Strong trend efficiency ($1)", "Little back and forth: $1 of the path led somewhere."),
    "strong_close": ("Closed near daily high (strength)", "Buyers still paid top prices at the close."),
    "illiquid": ("Low liquidity (avg value $1M IDR)", "With about $1 million traded a day, leaving may move the price."),
    "volatile": ("High volatility (annualized: $1%)", "Yearly swings of $1% widen every stop."),
    "rsi_high": ("RSI14 overbought ($1)", "An RSI of $1 leaves little room before a pause."),
    "market_down": ("Bearish market regime ($1)", "Most of the market is falling (state $1)."),
    "market_wild": ("High volatility market regime", "The market as a whole moves abruptly."),
    "downtrend": ("Stock in 20-day downtrend ($1%)", "A month has cost the price $1%."),
    "low_120d": ("Price near 120-day low", "The half-year low is less than five per cent away."),
    "idle_days": ("Recent inactive trading days", "There were sessions without a trade of late."),
    "event": ("Corporate action warning (extreme past returns)", "A past move is too large for trading alone; check for a corporate action."),
}


def _found(code: str, figure: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit("") if figure is None else figure).alias("figure"))


def _shown(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", x)


def reason_codes(limit: int = 6) -> Column:
    """The first six reasons that hold, in order, as (code, figure). Reads feature columns and ``market_regime``."""
    c = F.col
    rsi, h20, h60 = c("rsi14"), c("close_vs_high_20d"), c("close_vs_high_60d")
    near20 = F.coalesce(h20 >= -0.01, F.lit(False))
    return F.slice(keep(
        (c("return_5d") > 0.03, _found("momentum_5d", _shown(c("return_5d") * 100))),
        (c("return_20d") > 0.05, _found("trend_20d", _shown(c("return_20d") * 100))),
        (rsi < 40, _found("rsi_low", _shown(rsi, 0))),
        (rsi.between(45, 60), _found("rsi_middle", _shown(rsi, 0))),
        (c("ma_aligned_bull") == 1, _found("above_averages")),
        (near20, _found("high_20d")),
        (~near20 & (h60 >= -0.02), _found("high_60d")),
        (c("rel_volume_5d") > 1.5, _found("volume", _shown(c("rel_volume_5d")))),
        (c("bb_squeeze") == 1, _found("squeeze")),
        (c("bb_position") > 0.7, _found("upper_band", _shown(c("bb_position") * 100, 0))),
        (c("macd_bullish") == 1, _found("macd")),
        (c("market_regime").isin("BULL_TREND", "BULL_RANGE"), _found("market_up", c("market_regime"))),
        (c("foreign_net_5d") > 0.01, _found("foreign_buying", _shown(c("foreign_net_5d") * 100))),
        (c("efficiency_ratio_20d") > 0.6, _found("efficiency", _shown(c("efficiency_ratio_20d"), 2))),
        (c("close_location") > 0.7, _found("strong_close")),
    ), 1, limit)


def risk_codes() -> Column:
    """All risk flags that hold, as (code, figure). Also reads ``has_action_warning``."""
    c = F.col
    return keep(
        (c("avg_value_20d") < 1e9, _found("illiquid", _shown(c("avg_value_20d") / 1e6, 0))),
        (c("hvol20") > 0.40, _found("volatile", _shown(c("hvol20") * 100, 0))),
        (c("rsi14") > 70, _found("rsi_high", _shown(c("rsi14"), 0))),
        (c("market_regime").isin("BEAR_TREND", "BEAR_RANGE"), _found("market_down", c("market_regime"))),
        (c("market_regime") == "HIGH_VOL", _found("market_wild")),
        (c("return_20d") < -0.10, _found("downtrend", _shown(c("return_20d") * 100))),
        (c("close_vs_low_120d") < 0.05, _found("low_120d")),
        (c("zero_vol_pct_20d") > 0.1, _found("idle_days")),
        (c("has_action_warning"), _found("event")),
    )


def wording(codes: Column, plain: bool = False) -> Column:
    """Stored texts, or plain sentences, of (code, figure) pairs."""
    table = F.create_map(*[F.lit(x) for code, pair in FINDINGS.items() for x in (code, pair[plain])])
    return F.transform(codes, lambda x: F.replace(F.element_at(table, x["code"]), F.lit("$1"), x["figure"]))


def reasons(limit: int = 6) -> Column:
    return wording(reason_codes(limit))


def risks() -> Column:
    return wording(risk_codes())


def with_economics(df: DataFrame, buy_fee: float = BUY_FEE, sell_fee: float = SELL_FEE, slippage: float = SLIPPAGE) -> DataFrame:
    """Net reward, risk, their ratio and expected value after a round trip; from ``entry_price``,
    ``target_price``, ``stop_price`` and ``p``."""
    cost = buy_fee + sell_fee + 2 * slippage
    entry = F.when(F.col("entry_price") > 0, F.col("entry_price"))
    reward, risk = (F.col("target_price") - entry) / entry - cost, (entry - F.col("stop_price")) / entry + cost
    df = df.withColumns({"net_reward": reward, "net_risk": risk})
    return df.withColumns({
        "net_risk_reward": F.when(F.col("net_risk") > 0, F.col("net_reward") / F.col("net_risk")),
        "expected_value": F.col("p") * F.col("net_reward") - (1 - F.col("p")) * F.col("net_risk")})


VERIFIED = ("VERIFIED_ABOVE_90", "PROVISIONAL_ABOVE_90")
MIN_REWARD_RISK = 1.0
MIN_MODEL_COVERAGE = 0.5
MIN_FEATURE_COVERAGE = 0.5


def decide(df: DataFrame) -> DataFrame:
    """Decision and confidence tier, first rule that applies. Reads ``p``, ``models_expected``,
    ``models``, ``holdout_status``, ``feature_coverage``, ``has_action_warning`` and the economics."""
    p, rr, ev = F.col("p"), F.col("net_risk_reward"), F.col("expected_value")
    covered = F.coalesce((F.col("models_expected") > 0) & (F.col("models") / F.nullif(F.col("models_expected"), F.lit(0)) >= MIN_MODEL_COVERAGE), F.lit(False))
    valid = F.coalesce(F.col("holdout_status").isin(*VERIFIED), F.lit(False))
    proven = covered & valid
    # Without evidence no probability counts for more than "CUKUP".
    tier = (F.when(~proven, F.when(p >= 0.55, "CUKUP").otherwise("LEMAH"))
            .when(p >= 0.65, "SANGAT_KUAT").when(p >= 0.55, "KUAT").when(p >= 0.45, "CUKUP").otherwise("LEMAH"))
    none, thin = F.col("models") <= 0, F.col("feature_coverage") < MIN_FEATURE_COVERAGE
    event = F.coalesce(F.col("has_action_warning"), F.lit(False))
    poor = ev.isNull() | rr.isNull() | (ev <= 0) | (rr < MIN_REWARD_RISK)
    status = (F.when(none, "MODEL_UNAVAILABLE").when(thin, "DATA_INVALID").when(event | poor, "NO_TRADE")
              .when(p < 0.50, "ABSTAIN").when(proven, "QUALIFIED").otherwise("WATCHLIST"))
    final_tier = F.when(none | thin | event, "LEMAH").when(poor, tier).when(p < 0.50, "LEMAH").otherwise(tier)
    return df.withColumns({"decision_status": status, "confidence_tier": final_tier})


def assemble_predictions(features: DataFrame, probabilities: DataFrame, feature_columns: list[str], threshold: float,
                         models_expected: int, holdout: str | None, take_profit: float = 0.05, stop_loss: float = -0.02,
                         target: float = 0.02, h: int = 5) -> DataFrame:
    """Prediction rows: features and probabilities meet by (sym, d), never by position. A model's
    score cannot land on another symbol, and symbols without a probability have no row."""
    df = features.join(probabilities, ["sym", "d"]).filter(F.col("close") > 0)
    present = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in feature_columns), F.lit(0))
    p, close = F.col("p"), F.col("close")
    df = df.withColumns({
        "entry_price": close, "target_price": F.bround(close * (1 + take_profit)), "stop_price": F.bround(close * (1 + stop_loss)),
        "signal_status": F.when(p >= threshold, "HIGH_CONFIDENCE").when(p >= threshold * 0.85, "WATCHLIST").otherwise("NO_SIGNAL"),
        "feature_coverage": present / len(feature_columns), "predicted_return": p * take_profit + (1 - p) * stop_loss,
        "expected_upside": F.lit(target), "horizon_days": F.lit(h), "entry_zone_low": F.bround(close * 0.98), "entry_zone_high": F.bround(close * 1.03),
        "models_expected": F.lit(models_expected), "holdout_status": F.lit(holdout).cast("string"), "outcome_status": F.lit("PENDING"),
    })
    return decide(with_economics(df))


def identical_breakdowns(predictions: DataFrame) -> DataFrame:
    """Alarm: per date, breakdowns that several symbols share to the last digit."""
    text = F.to_json(F.map_filter("breakdown", lambda k, v: v.isNotNull() & ~F.isnan(v)))
    return predictions.groupBy("d", text.alias("breakdown")).agg(F.count_distinct("sym").alias("symbols"), F.min("sym").alias("first_sym")).filter("symbols > 1")


def feature_values_json(columns: list[str]) -> Column:
    """Feature values as JSON text, six digits, non-finite ones as NULL; for the sink only."""
    return F.to_json(F.struct(*[F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c) for c in columns]))

