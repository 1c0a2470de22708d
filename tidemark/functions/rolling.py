"""Indicators over a bounded number of past bars, as window expressions.

All of them share one partitioning and ordering, so Spark sorts each symbol once, and a query that selects a few
prunes the rest. An indicator is NULL until it has seen enough bars. Divisions by zero follow the conventions of
the technical analysis libraries: the value is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("symbol", "trade_date")


def by_date():
    return Window.partitionBy("symbol").orderBy("trade_date")


def last(n: int):
    """The present row and the n - 1 before it."""
    return by_date().rowsBetween(1 - n, 0)


def gated(fn: Callable[[Column], Column], value: Column | str, n: int, first: int | None = None) -> Column:
    """``fn`` over the last ``n`` rows, from row ``first`` (default n) on."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("rn") >= (first or n), fn(value).over(last(n)))


def ratio(top: Column, bottom: Column, zero: float = 0.0) -> Column:
    """top / bottom; ``zero`` where the bottom is 0, NULL where either is NULL."""
    return F.when(bottom == 0, F.when(top.isNotNull(), F.lit(zero))).otherwise(F.try_divide(top, bottom))


def base(bars: DataFrame, carried: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Bars with row numbers, previous values, typical price, true range and flows."""
    c = F.col
    numbered = bars.select(
        *KEYS, *carried, "open", "high", "low", "close", "volume", F.row_number().over(by_date()).alias("rn"),
        F.lag("close").over(by_date()).alias("prev_close"), F.lag("high").over(by_date()).alias("prev_high"), F.lag("low").over(by_date()).alias("prev_low"),
        ((c("high") + c("low") + c("close")) / 3).alias("TYPPRICE"),
    ).withColumn("prev_typical", F.lag("TYPPRICE").over(by_date()))
    later = c("rn") > 1
    return numbered.select(
        "*",
        F.when(later, F.greatest(c("high") - c("low"), F.abs(c("high") - c("prev_close")), F.abs(c("low") - c("prev_close")))).alias("Trange"),
        F.when(later, c("close") - F.least("low", "prev_close")).alias("buying"),
        F.when(later, F.greatest("high", "prev_close") - F.least("low", "prev_close")).alias("span"),
        F.when(later, F.when(c("TYPPRICE") > c("prev_typical"), c("TYPPRICE") * c("volume")).otherwise(0.0)).alias("inflow"),
        F.when(later, F.when(c("TYPPRICE") < c("prev_typical"), c("TYPPRICE") * c("volume")).otherwise(0.0)).alias("outflow"),
        F.when(later, ratio(c("high") - c("prev_high"), c("prev_high"))).alias("rx"),
        F.when(later, ratio(c("low") - c("prev_low"), c("prev_low"))).alias("ry"),
    )


def trima_spans(n: int) -> tuple[int, int]:
    """The two averages whose composition is triangular over n bars."""
    return ((n + 1) // 2, (n + 1) // 2) if n % 2 else (n // 2, n // 2 + 1)


def rolling_indicators(bars: DataFrame, carried: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``bars`` with every indicator of bounded look-back, and the columns ``carried`` as they are."""
    c = F.col
    first = base(bars, carried)
    spread5 = F.max("high").over(last(5)) - F.min("low").over(last(5))
    spread14 = F.max("high").over(last(14)) - F.min("low").over(last(14))
    first = first.select(
        "*",
        *[gated(F.avg, "close", n).alias(f"sma{n}") for n in (5, 10, 12, 15, 20, 26)],
        gated(F.stddev_pop, "close", 20).alias("sd20"),
        *[gated(F.avg, "close", trima_spans(n)[0]).alias(f"half{n}") for n in (5, 10, 20)],
        *[gated(F.avg, "TYPPRICE", n).alias(f"tp_mean{n}") for n in (5, 10, 15)],
        *[F.when(c("rn") >= n, F.collect_list("TYPPRICE").over(last(n))).alias(f"tp_list{n}") for n in (5, 10, 15)],
        gated(F.sum, "inflow", 14, 15).alias("in14"), gated(F.sum, "outflow", 14, 15).alias("out14"),
        *[F.when(c("rn") > n, c("close") - F.lag("close", n).over(by_date())).alias(f"MOM{n}") for n in (10, 15, 20)],
        *[F.when(c("rn") > n, 100 * ratio(c("close") - F.lag("close", n).over(by_date()), F.lag("close", n).over(by_date()))).alias(f"ROC{n}") for n in (5, 10, 20)],
        F.when(c("rn") >= 5, 100 * ratio(c("close") - F.min("low").over(last(5)), spread5)).alias("raw_k"),
        F.when(c("rn") >= 14, -100 * ratio(F.max("high").over(last(14)) - c("close"), spread14)).alias("WILLR"),
        *[gated(F.sum, "buying", n, 29).alias(f"buying{n}") for n in (7, 14, 28)],
        *[gated(F.sum, "span", n, 29).alias(f"span{n}") for n in (7, 14, 28)],
        gated(F.sum, c("rx") * c("ry"), 5, 6).alias("sxy"), gated(F.sum, c("rx") * c("rx"), 5, 6).alias("sxx"),
        gated(F.sum, "rx", 5, 6).alias("sx"), gated(F.sum, "ry", 5, 6).alias("sy"),
    )

    def deviation(n: int) -> Column:
        apart = F.aggregate(c(f"tp_list{n}"), F.lit(0.0), lambda total, x: total + F.abs(x - c(f"tp_mean{n}"))) / n
        return ratio(c("TYPPRICE") - c(f"tp_mean{n}"), 0.015 * apart)

    second = first.select(
        *KEYS, *carried, "rn", "open", "high", "low", "close", "volume", "TYPPRICE", "Trange", "sma5", "sma10", "sma15", "sma20",
        (c("sma20") + 2 * c("sd20")).alias("upperband"), c("sma20").alias("middleband"), (c("sma20") - 2 * c("sd20")).alias("lowerband"),
        *[gated(F.avg, f"half{n}", trima_spans(n)[1], n).alias(f"TRIMA{n}") for n in (5, 10, 20)],
        (c("sma12") - c("sma26")).alias("APO"), (100 * ratio(c("sma12") - c("sma26"), c("sma26"))).alias("PPO"),
        *[deviation(n).alias(f"CCI{n}") for n in (5, 10, 15)],
        F.when(c("in14") + c("out14") < 1, 0.0).otherwise(100 * ratio(c("in14"), c("in14") + c("out14"))).alias("MFI"),
        "MOM10", "MOM15", "MOM20", "ROC5", "ROC10", "ROC20", "WILLR",
        F.when(c("rn") >= 7, c("raw_k")).alias("fastk"), gated(F.avg, "raw_k", 3, 7).alias("smooth_k"),
        (100 * (4 * ratio(c("buying7"), c("span7")) + 2 * ratio(c("buying14"), c("span14")) + ratio(c("buying28"), c("span28"))) / 7).alias("ULTOSC"),
        ratio(5 * c("sxy") - c("sx") * c("sy"), 5 * c("sxx") - c("sx") * c("sx")).alias("BETA"),
    )
    return second.select(
        "*", c("smooth_k").alias("fastd"), F.when(c("rn") >= 9, c("smooth_k")).alias("slowk"), gated(F.avg, "smooth_k", 3, 9).alias("slowd")
    ).drop("smooth_k")


ROLLING = (
    "sma5", "sma10", "sma15", "sma20", "upperband", "middleband", "lowerband", "TRIMA5", "TRIMA10", "TRIMA20", "APO", "PPO",
    "CCI5", "CCI10", "CCI15", "MFI", "MOM10", "MOM15", "MOM20", "ROC5", "ROC10", "ROC20", "fastk", "fastd", "slowk", "slowd",
    "ULTOSC", "WILLR", "Trange", "TYPPRICE", "BETA",
)
