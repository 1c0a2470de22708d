"""Queries of bars, indicators and engineered features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, recursive, rolling
from ..sources import adapters
from . import sql
from .kit import add, tidy

KEYS = ["symbol", "trade_date"]


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(adapters.bars(spark, sf_dir))


add("bars_daily", bars_daily, f"WITH {sql.BARS} SELECT symbol, trade_date, {sql.tidy(['open', 'high', 'low', 'close', 'volume'])} FROM bars")


def eod_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last known value and volume of each symbol's day; later ticks win, ties go by id."""
    ticks = adapters.ticks(spark, sf_dir)
    at = F.when(F.col("price").isNotNull(), F.struct("timestamp", "event_id"))
    return tidy(ticks.groupBy("symbol", F.to_date("timestamp").alias("trade_date")).agg(F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")))


add("eod_last", eod_last, """SELECT event_type AS symbol, ts::DATE AS trade_date, floor(arg_max(value, {'a': ts, 'b': event_id}) * 1e4 + 0.5) / 1e4 + 0 AS close, count(*) AS volume
FROM events GROUP BY ALL""")

ROLLING_GROUPS = {
    "ind_sma": ["sma5", "sma10", "sma15", "sma20"],
    "ind_bbands": ["upperband", "middleband", "lowerband"],
    "ind_trima": ["TRIMA5", "TRIMA10", "TRIMA20"],
    "ind_apo_ppo": ["APO", "PPO"],
    "ind_cci": ["CCI5", "CCI10", "CCI15"],
    "ind_mfi": ["MFI"],
    "ind_mom_roc": ["MOM10", "MOM15", "MOM20", "ROC5", "ROC10", "ROC20"],
    "ind_stoch": ["slowk", "slowd"],
    "ind_stochf": ["fastk", "fastd"],
    "ind_ultosc": ["ULTOSC"],
    "ind_willr": ["WILLR"],
    "ind_trange_typprice": ["Trange", "TYPPRICE"],
    "ind_beta": ["BETA"],
}


def _rolling_query(columns: list[str]):
    return lambda spark, sf_dir: tidy(rolling.rolling_indicators(adapters.bars(spark, sf_dir)).select(*KEYS, *columns))


for _name, _columns in ROLLING_GROUPS.items():
    add(_name, _rolling_query(_columns), f"WITH {sql.ROLLING} SELECT symbol, trade_date, {sql.tidy(_columns)} FROM r3")

#: columns, and the table of what SQL after the shared recursion; None where only plain loops can tell
RECURSIVE_GROUPS = {
    "ind_ema": (["ema5", "ema10", "ema15", "ema20"], "x", ""),
    "ind_macd": (["macd510", "macd520", "macd1020", "macd1520", "macd1226"], "x", ""),
    "ind_rsi": (["RSI14", "RSI8"], "x", ""),
    "ind_atr": (["ATR"], "x", ""),
    "ind_adx": (["ADX5", "ADX10", "ADX20"], "adx", ", " + sql.ADX),
    "ind_kama": (["KAMA10", "KAMA20", "KAMA30"], "kama", ", " + sql.KAMA),
    "ind_stochrsi": (["fastksr", "fastdsr"], "stochrsi", ", " + sql.STOCH_RSI),
    "ind_sar": (["SAR"], "sar", ", " + sql.SAR),
    "ind_ht": (["HT_TRENDLINE", "HT_DCPERIOD"], None, ""),
}


def _recursive_query(columns: list[str]):
    return lambda spark, sf_dir: tidy(recursive.recursive_indicators(adapters.bars(spark, sf_dir), columns))


for _name, (_columns, _table, _more) in RECURSIVE_GROUPS.items():
    add(_name, _recursive_query(_columns), f"WITH RECURSIVE {sql.RECURSIVE}{_more} SELECT symbol, trade_date, {sql.tidy(_columns)} FROM {_table}" if _table else None)


def with_indicators(bars: DataFrame) -> DataFrame:
    """Bars with all indicators. The recursive ones come first and are carried, so nothing is joined and no wide row is shuffled."""
    return rolling.rolling_indicators(recursive.with_recursive(bars), recursive.RECURSIVE)


def featured_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_features(with_indicators(adapters.bars(spark, sf_dir)))


def log_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(adapters.bars(spark, sf_dir).withColumn("log_return", features.sequence_features()["log_return"]).select(*KEYS, "log_return"), 6)


_NEXT = f"lead(close, 3) OVER {sql.BY_DATE}"
add("log_return", log_return, f"""WITH {sql.BARS} SELECT symbol, trade_date, {sql.rounded('CASE WHEN p > 0 AND close > 0 THEN ln(close / p) END', 6)} AS log_return
FROM (SELECT *, lag(close) OVER {sql.BY_DATE} AS p FROM bars)""")


def next_h_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.bars(spark, sf_dir).withColumn("next_3d_label", features.sequence_features()["next_3d_label"]).select(*KEYS, "next_3d_label")


add("next_h_label", next_h_label, f"""WITH {sql.BARS} SELECT symbol, trade_date,
  CASE WHEN n IS NOT NULL THEN CASE WHEN n > 1.01::DOUBLE * close THEN 'UP' WHEN n < 0.99::DOUBLE * close THEN 'DOWN' ELSE 'FLAT' END END AS next_3d_label
FROM (SELECT *, {_NEXT} AS n FROM bars)""")


def fwd_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.patterns import outcomes

    return tidy(outcomes(adapters.bars(spark, sf_dir)).select(*KEYS, "daily_return", "fwd_return", "fwd_down"), 6)


add("fwd_outcome", fwd_outcome, f"""WITH {sql.BARS}, d AS (SELECT *, lag(close) OVER {sql.BY_DATE} AS p, {_NEXT} AS n FROM bars WHERE close > 0)
SELECT symbol, trade_date, {sql.rounded('close / p - 1', 6)} AS daily_return, {sql.rounded('n / close - 1', 6)} AS fwd_return, CASE WHEN n / close - 1 < 0 THEN 1 WHEN n IS NOT NULL THEN 0 END::INT AS fwd_down FROM d""")


def macd_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = recursive.recursive_indicators(adapters.bars(spark, sf_dir), ["macd1226"]).select(*KEYS, F.lit(1.0).alias("close"), "macd1226")
    return lines.withColumn("macd_cross_signal", features.sequence_features()["macd_cross_signal"]).select(*KEYS, "macd_cross_signal")


_CROSS = f"""CASE WHEN lag(macd1226) OVER {sql.BY_DATE} < 0 AND macd1226 >= 0 THEN 'BULLISH_CROSS' WHEN lag(macd1226) OVER {sql.BY_DATE} > 0 AND macd1226 <= 0 THEN 'BEARISH_CROSS' ELSE 'NONE' END"""
add("macd_cross", macd_cross, f"WITH RECURSIVE {sql.RECURSIVE} SELECT symbol, trade_date, {_CROSS} AS macd_cross_signal FROM x")


def _feature_query(columns: list[str]):
    return lambda spark, sf_dir: tidy(featured_bars(spark, sf_dir).select(*KEYS, *columns))


_BOTH = f"{sql.RECURSIVE}, {sql.ROLLING[len(sql.BARS) + 2 :]}, f AS (SELECT * FROM r3 JOIN (SELECT * EXCLUDE (rn, close, high, low) FROM x) USING (symbol, trade_date))"


def _rel(top: str, bottom: str) -> str:
    return f"(CASE WHEN {bottom} <> 0 THEN ({top}) / {bottom} END)"


FEATURE_SQL = {
    "feat_trend": {
        "dist_sma20": f"100 * {_rel('close - sma20', 'sma20')}", "dist_sma_diff": f"100 * {_rel('sma20 - sma10', 'sma10')}",
        "trend_ema_cross": "CASE WHEN ema5 > ema20 THEN 1 WHEN ema5 <= ema20 THEN -1 END::INT",
    },
    "feat_momentum": {
        "rsi_status": "CASE WHEN RSI14 > 70 THEN 'Overbought' WHEN RSI14 < 30 THEN 'Oversold' WHEN RSI14 IS NOT NULL THEN 'Neutral' END",
        "rsi_status_num": "CASE WHEN RSI14 > 70 THEN 1 WHEN RSI14 < 30 THEN -1 WHEN RSI14 IS NOT NULL THEN 0 END::INT",
        "macd_hist_norm": "macd1226 - macd510",
        "stoch_k_d_cross": "CASE WHEN slowk > slowd THEN 1 WHEN slowk <= slowd THEN 0 END::INT",
        "roc_trend": "CASE WHEN ROC10 > 0 THEN 1 WHEN ROC10 <= 0 THEN -1 END::INT",
    },
    "feat_volatility": {
        "bb_width": _rel("upperband - lowerband", "middleband"), "pct_b": _rel("close - lowerband", "(upperband - lowerband)"),
        "volatility_atr_pct": f"100 * {_rel('ATR', 'close')}",
        "is_high_volatility": f"CASE WHEN {_rel('upperband - lowerband', 'middleband')} > 1.5::DOUBLE * avg({_rel('upperband - lowerband', 'middleband')}) OVER (PARTITION BY symbol) THEN 1 WHEN {_rel('upperband - lowerband', 'middleband')} IS NOT NULL THEN 0 END::INT",
    },
    "feat_labels": {
        "bb_position_label": "CASE WHEN close > upperband THEN 'ABOVE_UPPER' WHEN close > middleband THEN 'UPPER_ZONE' WHEN close = middleband THEN 'AT_MIDDLE' WHEN close > lowerband THEN 'LOWER_ZONE' ELSE 'BELOW_LOWER' END",
        "macd_cross_signal": _CROSS, "daily_range_pct": "CASE WHEN close > 0 THEN 100 * (high - low) / close END",
    },
    "close_zscore": {"close_zscore": "coalesce((close - avg(close) OVER (PARTITION BY symbol)) / nullif(stddev_samp(close) OVER (PARTITION BY symbol), 0), 0)"},
}
_TEXT = {"rsi_status", "bb_position_label", "macd_cross_signal", "trend_ema_cross", "rsi_status_num", "stoch_k_d_cross", "roc_trend", "is_high_volatility"}
for _name, _parts in FEATURE_SQL.items():
    add(_name, _feature_query(list(_parts)), f"WITH RECURSIVE {_BOTH}, g AS (SELECT symbol, trade_date, {', '.join(f'{e} AS {c}' for c, e in _parts.items())} FROM f) SELECT symbol, trade_date, {', '.join(c if c in _TEXT else sql.tidy([c]) for c in _parts)} FROM g")
add("feat_adx", _feature_query(["trend_strength_adx", "adx_strength_label"]), f"""WITH RECURSIVE {sql.RECURSIVE}, {sql.ADX} SELECT symbol, trade_date,
CASE WHEN ADX10 > 25 THEN 1 WHEN ADX10 <= 25 THEN 0 END::INT AS trend_strength_adx, CASE WHEN ADX20 >= 25 THEN 'STRONG_TREND' WHEN ADX20 >= 15 THEN 'WEAK_TREND' ELSE 'NO_TREND' END AS adx_strength_label FROM adx""")
_ADX_SQL = {
    "trend_strength_adx": "CASE WHEN ADX10 > 25 THEN 1 WHEN ADX10 <= 25 THEN 0 END::INT",
    "adx_strength_label": "CASE WHEN ADX20 >= 25 THEN 'STRONG_TREND' WHEN ADX20 >= 15 THEN 'WEAK_TREND' ELSE 'NO_TREND' END",
    "log_return": f"CASE WHEN lag(close) OVER {sql.BY_DATE} > 0 AND close > 0 THEN ln(close / lag(close) OVER {sql.BY_DATE}) END",
    "next_3d_label": f"CASE WHEN {_NEXT} > 1.01::DOUBLE * close THEN 'UP' WHEN {_NEXT} < 0.99::DOUBLE * close THEN 'DOWN' WHEN {_NEXT} IS NOT NULL THEN 'FLAT' END",
}
_ALL = [*features.TREND_COLUMNS, *features.MOMENTUM_COLUMNS, *features.VOLATILITY_COLUMNS, *features.LABEL_COLUMNS]
_ALL_SQL = {c: e for parts in FEATURE_SQL.values() for c, e in parts.items()} | _ADX_SQL
_PLAIN = _TEXT | {"trend_strength_adx", "adx_strength_label", "next_3d_label"}
add("feat_all", _feature_query(_ALL), f"""WITH RECURSIVE {_BOTH}, {sql.ADX}, fa AS (SELECT * FROM f JOIN adx USING (symbol, trade_date)), g AS (SELECT symbol, trade_date, {', '.join(f'{_ALL_SQL[c]} AS {c}' for c in _ALL)} FROM fa)
SELECT symbol, trade_date, {', '.join(c if c in _PLAIN else sql.tidy([c]) for c in _ALL)} FROM g""")
