"""Anomalies of daily returns: rolling z-scores and two-sided CUSUM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, AnomalyConfig
from ..functions.features import log_return


def rolling_z(bars: DataFrame, config: AnomalyConfig = DEFAULT.anomaly) -> DataFrame:
    """``symbol, trade_date, close, log_return, zscore, is_anomaly``.

    The window includes the present return; at least half of it, and five, must be known; a flat window has no score.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    last = w.rowsBetween(1 - config.window, 0)
    least = max(5, config.window // 2)
    returns = bars.select("symbol", "trade_date", "close", log_return(F.col("close"), F.lag("close").over(w)).alias("log_return"))
    r = F.col("log_return")
    stats = returns.select("*", F.avg(r).over(last).alias("_mean"), F.stddev_samp(r).over(last).alias("_sd"), F.count(r).over(last).alias("_n"))
    z = F.when((F.col("_n") >= least) & (F.col("_sd") > 0), F.try_divide(r - F.col("_mean"), F.col("_sd")))
    return stats.withColumn("zscore", z).withColumn("is_anomaly", F.coalesce(F.abs("zscore") > config.z_threshold, F.lit(False))).drop("_mean", "_sd", "_n")


def cusum_fold(x: np.ndarray, k: float, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of upward and downward drift of a standardised series, each reset when it passes ``h``; up goes before down."""
    up, down, change = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int32)
    a = b = 0.0
    for i, v in enumerate(np.where(np.isfinite(x), x, 0.0)):
        a, b = max(0.0, a + v - k), max(0.0, b - v - k)
        if a > h:
            change[i], a = 1, 0.0
        elif b > h:
            change[i], b = -1, 0.0
        up[i], down[i] = a, b
    return up, down, change


def cusum(returns: DataFrame, config: AnomalyConfig = DEFAULT.anomaly) -> DataFrame:
    """``symbol, trade_date, cusum_pos, cusum_neg, regime_change`` of ``log_return``, standardised over the whole series.

    The fold is sequential, so a symbol's series is the unit of work; the statistics are ordinary aggregates.
    """
    k, h = config.cusum_k, config.cusum_h
    stats = returns.groupBy("symbol").agg(F.avg("log_return").alias("_mean"), F.stddev_pop("log_return").alias("_sd"))
    x = F.when(F.col("_sd") > 0, (F.col("log_return") - F.col("_mean")) / F.col("_sd"))
    standard = returns.join(stats, "symbol").select("symbol", "trade_date", F.coalesce(x, F.lit(0.0)).alias("x"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("trade_date")
        up, down, change = cusum_fold(frame["x"].to_numpy(), k, h)
        return pd.DataFrame({"symbol": frame["symbol"], "trade_date": frame["trade_date"], "cusum_pos": up, "cusum_neg": down, "regime_change": change})

    return standard.groupBy("symbol").applyInPandas(fold, f"symbol {dict(returns.dtypes)['symbol']}, trade_date date, cusum_pos double, cusum_neg double, regime_change int")


def anomalies(bars: DataFrame, config: AnomalyConfig = DEFAULT.anomaly) -> DataFrame:
    scored = rolling_z(bars, config)
    return scored.join(cusum(scored, config), ["symbol", "trade_date"])


def summary(found: DataFrame) -> DataFrame:
    """By symbol: days, anomalies and their share, changes of regime, and the day of the largest score."""
    strength = F.when(F.col("zscore").isNotNull(), F.struct(F.abs("zscore"), "trade_date"))
    return found.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if("is_anomaly").alias("n_anomalies"), F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate"),
        F.count_if(F.col("regime_change") != 0).alias("n_regime_changes"), F.max_by("trade_date", strength).alias("extreme_date"), F.max(F.abs("zscore")).alias("extreme_z"),
    )
