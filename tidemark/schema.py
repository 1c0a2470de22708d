"""Declared schemas and column lists."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of a tick file, by group and in order.
PRICES = ("close", "high", "low", "open")
MOVING_AVERAGES = ("sma5", "sma10", "sma15", "sma20", "ema5", "ema10", "ema15", "ema20")
BANDS = ("upperband", "middleband", "lowerband")
TREND = (
    "HT_TRENDLINE", "KAMA10", "KAMA20", "KAMA30", "SAR", "TRIMA5", "TRIMA10", "TRIMA20",
    "ADX5", "ADX10", "ADX20", "APO", "CCI5", "CCI10", "CCI15",
)
MACD = ("macd510", "macd520", "macd1020", "macd1520", "macd1226")
MOMENTUM = ("MFI", "MOM10", "MOM15", "MOM20")
RATE_OF_CHANGE = ("ROC5", "ROC10", "ROC20", "PPO")
RSI = ("RSI14", "RSI8")
STOCHASTIC = ("slowk", "slowd", "fastk", "fastd", "fastksr", "fastdsr")
OSCILLATORS = ("ULTOSC", "WILLR")
VOLATILITY = ("ATR", "Trange", "TYPPRICE")
OTHER = ("HT_DCPERIOD", "BETA")
INDICATORS = MOVING_AVERAGES + BANDS + TREND + MACD + MOMENTUM + RATE_OF_CHANGE + RSI + STOCHASTIC + OSCILLATORS + VOLATILITY + OTHER

FILE_SUFFIX = "_minute_data_with_indicators.csv"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ssXXX"
PARTITIONS = ("year", "month", "stock_symbol")

# Inputs of the principal components beside the indicators without MFI, of LSH and of item sets.
ENGINEERED_FOR_PCA = ("dist_sma20", "dist_sma_diff", "bb_width", "pct_b", "volatility_atr_pct", "daily_range_pct", "log_return")
PCA_INPUT = tuple(c for c in INDICATORS if c != "MFI") + ENGINEERED_FOR_PCA
LSH_FINGERPRINT = (
    "rsi_status_num", "trend_ema_cross", "stoch_k_d_cross", "roc_trend", "is_high_volatility",
    "macd_cross_signal", "bb_position_label", "adx_strength_label",
)
ASSOCIATION_ITEMS = ("rsi_status", "bb_position_label", "macd_cross_signal", "trend_ema_cross", "adx_strength_label", "is_high_volatility")
#: The six signals whose daily states are shingled.
SIGNALS = ("rsi_status", "macd_cross_signal", "bb_position_label", "adx_strength_label", "trend_ema_cross", "is_high_volatility")


def tick_schema() -> T.StructType:
    """The schema of a tick CSV file, read without inference."""
    doubles = lambda names: [T.StructField(n, T.DoubleType()) for n in names]
    return T.StructType([T.StructField("date", T.StringType()), *doubles(PRICES), T.StructField("volume", T.LongType()), *doubles(INDICATORS)])


def documented_schema() -> T.StructType:
    """The stored table: lower-cased tick columns without the date text, then keys."""
    keys = [("stock_symbol", T.StringType()), ("timestamp", T.TimestampType()), ("year", T.IntegerType()), ("month", T.IntegerType())]
    return T.StructType([*[T.StructField(f.name.lower(), f.dataType) for f in tick_schema()[1:]], *[T.StructField(n, t) for n, t in keys]])
