"""What NULL inputs give, and the windows' plans."""

import datetime as dt
import re

from tidemark.functions import features, rolling
from tidemark.plans.indicators import with_indicators
from tidemark.sources import adapters

NAMES = ("close", "high", "low", "sma10", "sma20", "ema5", "ema20", "ADX10", "ADX20", "RSI14", "macd1226", "macd510", "slowk", "slowd", "ROC10", "upperband", "middleband", "lowerband", "ATR")


def frame(spark, *rows):
    days = [dt.date(2020, 1, k + 1) for k in range(len(rows))]
    data = [("a", d, *[None if r.get(n) is None else float(r[n]) for n in NAMES]) for d, r in zip(days, rows, strict=True)]
    return spark.createDataFrame(data, "symbol string, trade_date date, " + ", ".join(f"{n} double" for n in NAMES))


def test_unknown_inputs(spark):
    r = features.add_features(frame(spark, {})).first()
    for name in ("dist_sma20", "dist_sma_diff", "trend_ema_cross", "trend_strength_adx", "rsi_status", "rsi_status_num", "macd_hist_norm", "stoch_k_d_cross", "roc_trend", "bb_width", "pct_b", "volatility_atr_pct", "is_high_volatility", "log_return", "next_3d_label", "daily_range_pct"):
        assert r[name] is None, name
    assert (r.macd_cross_signal, r.bb_position_label, r.adx_strength_label, r.close_zscore) == ("NONE", "BELOW_LOWER", "NO_TREND", 0.0)


def test_zero_denominators(spark):
    r = features.add_features(frame(spark, {"close": 0, "high": 1, "low": 0, "sma20": 0, "sma10": 0, "upperband": 1, "lowerband": 1, "middleband": 0, "ATR": 1})).first()
    assert all(r[n] is None for n in ("dist_sma20", "dist_sma_diff", "bb_width", "pct_b", "volatility_atr_pct", "daily_range_pct"))


def test_thresholds(spark):
    day = lambda **k: {"close": 100, "high": 101, "low": 99} | k
    rows = features.add_features(frame(
        spark, day(RSI14=70, macd1226=-1, ADX20=15, ADX10=25, upperband=100, middleband=99, lowerband=98), day(RSI14=70.1, macd1226=0, ADX20=25, ADX10=25.1, upperband=99, middleband=98, lowerband=97),
        day(RSI14=29.9, macd1226=1, ADX20=14.9, upperband=102, middleband=100, lowerband=98), day(close=101, RSI14=30, macd1226=-1, upperband=110, middleband=105, lowerband=100),
        day(close=102), day(close=98.9),
    )).orderBy("trade_date").collect()
    assert [r.rsi_status for r in rows[:4]] == ["Neutral", "Overbought", "Oversold", "Neutral"] and [r.rsi_status_num for r in rows[:4]] == [0, 1, -1, 0]
    assert [r.macd_cross_signal for r in rows[:4]] == ["NONE", "BULLISH_CROSS", "NONE", "BEARISH_CROSS"]
    assert [r.adx_strength_label for r in rows[:3]] == ["WEAK_TREND", "STRONG_TREND", "NO_TREND"] and [r.trend_strength_adx for r in rows[:2]] == [0, 1]
    assert [r.bb_position_label for r in rows[:4]] == ["UPPER_ZONE", "ABOVE_UPPER", "AT_MIDDLE", "LOWER_ZONE"]
    assert [r.next_3d_label for r in rows] == ["FLAT", "UP", "DOWN", None, None, None]


def test_flat_and_short_series(spark):
    bars = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(k), 5.0, 5.0, 5.0, 5.0, 0.0) for k in range(40)] + [("b", dt.date(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 3.0)], "symbol string, trade_date date, open double, high double, low double, close double, volume double")
    last = rolling.rolling_indicators(bars).filter("symbol = 'a'").orderBy("trade_date").collect()[-1]
    assert (last.fastk, last.slowd, last.WILLR, last.ULTOSC, last.CCI10, last.BETA, last.MFI, last.MOM10, last.ROC5) == (0, 0, 0, 0, 0, 0, 0, 0, 0)
    alone = with_indicators(bars).filter("symbol = 'b'").first()
    assert alone.TYPPRICE == (2.0 + 0.5 + 1.5) / 3 and alone.Trange is None and alone.sma5 is None and alone.ema5 is None
    assert with_indicators(bars.limit(0)).count() == 0


def test_one_shuffle_and_no_python(spark, small):
    plan = rolling.rolling_indicators(adapters.bars(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning(symbol") <= 2  # one for the bars, one for all windows


def test_columns_are_pruned(spark, small):
    plan = adapters.bars(spark, small).select("symbol", "volume")._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "l_discount" not in read and "l_returnflag" not in read
