"""Patterns: the last days of a symbol as a unit vector, and what came after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, SUMMARY_FEATURES, PatternConfig
from ..functions import vectors


def outcomes(bars: DataFrame, config: PatternConfig = DEFAULT.pattern) -> DataFrame:
    """Bars of a positive close with ``daily_return``, ``fwd_return`` over the horizon and ``fwd_down``, NULL where unknown."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    close, later = F.col("close"), F.lead("close", config.horizon).over(w)
    out = bars.filter("close > 0").withColumns({
        "daily_return": F.try_divide(close, F.lag("close").over(w)) - 1,
        "fwd_return": F.try_divide(later, close) - 1,
    })
    return out.withColumn("fwd_down", (F.col("fwd_return") < config.down_threshold).cast("int"))


def raw_patterns(daily: DataFrame, config: PatternConfig = DEFAULT.pattern) -> DataFrame:
    """Every full window of known returns with its shape and summary features.

    ``daily`` has ``symbol, market, trade_date, close, volume, sma20, rsi, macd`` and the outcomes. A window counts
    known returns, so a symbol's first pattern comes a day after its first full window.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(1 - config.window, 0)
    windows = daily.withColumns({
        "returns": F.collect_list("daily_return").over(w), "volatility": F.stddev_samp("daily_return").over(w),
        "mean_volume": F.avg("volume").over(w), "cum_return": F.sum("daily_return").over(w),
    }).filter(F.size("returns") == config.window)
    return windows.withColumns({
        "volume_ratio": F.when(F.col("mean_volume") > 0, F.try_divide("volume", "mean_volume")).otherwise(1.0),
        "sma_gap": F.when(F.col("sma20") > 0, F.try_divide(F.col("close") - F.col("sma20"), F.col("sma20"))).otherwise(0.0),
        "shape": vectors.z_scores(F.col("returns")),
    }).drop("returns", "mean_volume")


def feature_stats(patterns: DataFrame, *others: Column) -> DataFrame:
    """By market mean and deviation of every summary feature, 0 and 1 where unknown or flat, and the aggregates ``others``."""
    stats = patterns.groupBy("market").agg(
        *[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"{f}_mean") for f in SUMMARY_FEATURES],
        *[F.stddev_samp(f).alias(f"{f}_sd") for f in SUMMARY_FEATURES], *others,
    )
    return stats.withColumns({f"{f}_sd": F.when(F.col(f"{f}_sd") > vectors.TINY, F.col(f"{f}_sd")).otherwise(1.0) for f in SUMMARY_FEATURES})


def market_stats(patterns: DataFrame) -> DataFrame:
    """Mean and deviation of every summary feature by market; 0 and 1 where unknown or flat."""
    return feature_stats(patterns)


def summary_z(feature: str) -> Column:
    return F.coalesce((F.col(feature) - F.col(f"{feature}_mean")) / F.col(f"{feature}_sd"), F.lit(0.0))


def pattern_vectors(patterns: DataFrame) -> DataFrame:
    """``symbol, market, trade_date, close, fwd_return, fwd_down, vector``: shape and standardised summary, of length 1.

    Unknown summary features count as average. The statistics have one row a market, so they are broadcast.
    """
    joined = patterns.join(F.broadcast(market_stats(patterns)), "market")
    vector = vectors.unit(F.concat(F.col("shape"), F.array(*[summary_z(f) for f in SUMMARY_FEATURES])))
    return joined.select("symbol", "market", "trade_date", "close", "fwd_return", "fwd_down", vector.alias("vector"))


def latest_pattern(patterns: DataFrame, wanted: DataFrame) -> DataFrame:
    """As-of: for each ``symbol, query_date`` of ``wanted`` the latest pattern at or before it; NULL where there is none.

    One window over both sides carries the last pattern forward, so nothing is joined by a range.
    """
    known = patterns.select("symbol", F.col("trade_date").alias("day"), F.lit(0).alias("asks"), "trade_date")
    asked = wanted.select("symbol", F.col("query_date").alias("day"), F.lit(1).alias("asks"), F.lit(None).cast("date").alias("trade_date"))
    w = Window.partitionBy("symbol").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    carried = known.unionByName(asked).withColumn("pattern_date", F.last("trade_date", ignorenulls=True).over(w))
    return carried.filter("asks = 1").select("symbol", F.col("day").alias("query_date"), "pattern_date")
