"""Engineered features: column expressions over bars and indicators. What NULL inputs give is part of each definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def _known(*names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & c(name).isNotNull()
    return out


def _relative(top: Column, bottom: str) -> Column:
    """top / bottom; NULL where the bottom is NULL or 0."""
    return F.when(c(bottom).isNotNull() & (c(bottom) != 0), top / c(bottom))


def _sign(condition: Column, known: Column, yes: int = 1, no: int = -1) -> Column:
    return F.when(known, F.when(condition, yes).otherwise(no))


def trend_features() -> dict[str, Column]:
    return {
        "dist_sma20": 100 * _relative(c("close") - c("sma20"), "sma20"),
        "dist_sma_diff": 100 * _relative(c("sma20") - c("sma10"), "sma10"),
        "trend_ema_cross": _sign(c("ema5") > c("ema20"), _known("ema5", "ema20")),
        "trend_strength_adx": _sign(c("ADX10") > 25, _known("ADX10"), 1, 0),
    }


def momentum_features() -> dict[str, Column]:
    high, low, known = c("RSI14") > 70, c("RSI14") < 30, _known("RSI14")
    return {
        "rsi_status": F.when(known, F.when(high, "Overbought").when(low, "Oversold").otherwise("Neutral")),
        "rsi_status_num": F.when(known, F.when(high, 1).when(low, -1).otherwise(0)),
        "macd_hist_norm": c("macd1226") - c("macd510"),
        "stoch_k_d_cross": _sign(c("slowk") > c("slowd"), _known("slowk", "slowd"), 1, 0),
        "roc_trend": _sign(c("ROC10") > 0, _known("ROC10")),
    }


def volatility_features() -> dict[str, Column]:
    width = c("upperband") - c("lowerband")
    return {
        "bb_width": F.when(_known("upperband", "lowerband"), _relative(width, "middleband")),
        "pct_b": F.when(width != 0, F.try_divide(c("close") - c("lowerband"), width)),
        "volatility_atr_pct": F.when(c("ATR").isNotNull(), 100 * _relative(c("ATR"), "close")),
    }


def label_features() -> dict[str, Column]:
    """Labels whose NULL inputs fall to the last case, by contract."""
    middle = c("middleband")
    return {
        "bb_position_label": F.when(c("close") > c("upperband"), "ABOVE_UPPER").when(c("close") > middle, "UPPER_ZONE").when(c("close") == middle, "AT_MIDDLE").when(c("close") > c("lowerband"), "LOWER_ZONE").otherwise("BELOW_LOWER"),
        "adx_strength_label": F.when(c("ADX20") >= 25, "STRONG_TREND").when(c("ADX20") >= 15, "WEAK_TREND").otherwise("NO_TREND"),
        "daily_range_pct": F.when(c("close") > 0, 100 * F.try_divide(c("high") - c("low"), c("close"))),
    }


def _in_order(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def log_return(close: Column, before: Column) -> Column:
    """ln(close / before); NULL unless both are known and positive."""
    return F.when((before > 0) & (close > 0), F.ln(F.try_divide(close, before)))


def next_label(close: Column, after: Column, margin: float = 0.01) -> Column:
    """UP or DOWN by more than ``margin``, else FLAT; NULL where the later close isn't known."""
    return F.when(after.isNotNull() & close.isNotNull(), F.when(after > (1 + margin) * close, "UP").when(after < (1 - margin) * close, "DOWN").otherwise("FLAT"))


def macd_cross(now: Column, before: Column) -> Column:
    """NONE, not NULL, where either is unknown."""
    return F.when((before < 0) & (now >= 0), "BULLISH_CROSS").when((before > 0) & (now <= 0), "BEARISH_CROSS").otherwise("NONE")


def sequence_features(key: str = "symbol", order: str = "trade_date", horizon: int = 3) -> dict[str, Column]:
    """Features that look at earlier or later rows of the symbol; one window for all."""
    w = _in_order(key, order)
    return {
        "log_return": log_return(c("close"), F.lag("close").over(w)),
        f"next_{horizon}d_label": next_label(c("close"), F.lead("close", horizon).over(w)),
        "macd_cross_signal": macd_cross(c("macd1226"), F.lag("macd1226").over(w)),
    }


def symbol_features(df: DataFrame, key: str = "symbol") -> DataFrame:
    """``close_zscore`` (0 where the deviation is unknown or 0) and ``is_high_volatility`` (wider than 1.5 times the symbol's mean)."""
    whole = Window.partitionBy(key)  # not a join: windows by symbol share one shuffle, and columns that nobody reads cost nothing
    stats = df.withColumns({"_mean": F.avg("close").over(whole), "_sd": F.stddev_samp("close").over(whole), "_width": F.avg("bb_width").over(whole)})
    z = F.when(c("_sd").isNull() | (c("_sd") == 0), 0.0).otherwise(F.try_divide(c("close") - c("_mean"), c("_sd")))
    wide = F.when(_known("bb_width", "_width"), F.when(c("bb_width") > 1.5 * c("_width"), 1).otherwise(0))
    return stats.withColumns({"close_zscore": z, "is_high_volatility": wide}).drop("_mean", "_sd", "_width")


def add_features(df: DataFrame, key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """All engineered features of bars with their indicators."""
    plain = df.withColumns(trend_features() | momentum_features() | volatility_features() | label_features())
    return symbol_features(plain.withColumns(sequence_features(key, order)), key)


TREND_COLUMNS = ("dist_sma20", "dist_sma_diff", "trend_ema_cross", "trend_strength_adx")
MOMENTUM_COLUMNS = ("rsi_status", "rsi_status_num", "macd_hist_norm", "stoch_k_d_cross", "roc_trend")
VOLATILITY_COLUMNS = ("bb_width", "pct_b", "volatility_atr_pct", "is_high_volatility")
LABEL_COLUMNS = ("log_return", "next_3d_label", "macd_cross_signal", "close_zscore", "bb_position_label", "adx_strength_label", "daily_range_pct")
