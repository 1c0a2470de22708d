"""Equal-weight portfolios of clustered symbols, over a common calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT

PCS = ("pc1", "pc2", "pc3", "pc4", "pc5")


def is_index(symbol: Column) -> Column:
    return F.upper(symbol.cast("string")).contains("NIFTY")


def calendar(closes: DataFrame) -> DataFrame:
    """Every date of any symbol with its number: one row a day, so numbering them is a small sort."""
    return closes.select("trade_date").distinct().withColumn("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("trade_date")))


def grid_returns(closes: DataFrame) -> DataFrame:
    """``symbol, trade_date, ret``: change from the day before in the common calendar; no row where either day has no close."""
    w = Window.partitionBy("symbol").orderBy("day")
    dated = closes.filter("close IS NOT NULL").join(F.broadcast(calendar(closes)), "trade_date")  # a row a calendar day
    before = F.when(F.lag("day").over(w) == F.col("day") - 1, F.lag("close").over(w))
    return dated.select("symbol", "trade_date", (F.try_divide("close", before) - 1).alias("ret")).filter("ret IS NOT NULL")


def representatives(clustered: DataFrame, priced: DataFrame) -> DataFrame:
    """``cluster_id, symbol``: of each cluster the priced symbol nearest to its centroid in the first components; ties by symbol."""
    eligible = clustered.filter(~is_index(F.col("symbol"))).join(priced.select("symbol").distinct(), "symbol", "left_semi")
    centre = eligible.groupBy(F.col("cluster_id").alias("_c")).agg(*[F.avg(p).alias(f"_{p}") for p in PCS])
    apart = sum(((F.col(p) - F.col(f"_{p}")) * (F.col(p) - F.col(f"_{p}")) for p in PCS), F.lit(0.0))
    near = eligible.join(centre, F.col("cluster_id") == F.col("_c"))
    return near.groupBy("cluster_id").agg(F.min_by("symbol", F.struct(apart, F.col("symbol"))).alias("symbol"))


def largest_cluster(clustered: DataFrame, priced: DataFrame, n: int) -> DataFrame:
    """``symbol``: the ``n`` longest-traded members of the largest cluster; ties by cluster and symbol."""
    eligible = clustered.filter(~is_index(F.col("symbol"))).join(priced.select("symbol").distinct(), "symbol", "left_semi")
    top = eligible.groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").limit(1).select("cluster_id")
    return eligible.join(F.broadcast(top), "cluster_id").orderBy(F.desc("trading_days"), "symbol").limit(n).select("symbol")


def portfolios(returns: DataFrame, clustered: DataFrame) -> DataFrame:
    """``portfolio, trade_date, ret``: daily means over the members that have a return."""
    reps = representatives(clustered, returns).select("symbol")
    n = clustered.select("cluster_id").distinct().count()
    everyone = returns.filter(~is_index(F.col("symbol"))).select("symbol").distinct()
    members = (
        reps.select(F.lit("diversified").alias("portfolio"), "symbol")
        .unionByName(largest_cluster(clustered, returns, n).select(F.lit("concentrated").alias("portfolio"), "symbol"))
        .unionByName(everyone.select(F.lit("market").alias("portfolio"), "symbol"))
    )
    return returns.join(members, "symbol").groupBy("portfolio", "trade_date").agg(F.avg("ret").alias("ret"))


def equity(series: DataFrame) -> DataFrame:
    """``portfolio, trade_date, ret, equity, drawdown`` of a unit invested before the first day."""
    w = Window.partitionBy("portfolio").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    grown = series.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(w)))
    return grown.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(w)) - 1)


def metrics(series: DataFrame, days: int = DEFAULT.trading_days) -> DataFrame:
    """By portfolio; all 0 with fewer than two returns, no ratio without volatility."""
    stats = equity(series).groupBy("portfolio").agg(
        F.count("ret").alias("n"), F.max_by("equity", "trade_date").alias("_last"), F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"), F.min("drawdown").alias("_down"),
    )
    enough = F.col("n") >= 2
    annual, risk = F.col("_mean") * days, F.col("_sd") * F.sqrt(F.lit(float(days)))
    known = lambda value: F.when(enough, value).otherwise(0.0)
    return stats.select(
        "portfolio", "n", known(F.col("_last") - 1).alias("cum_return"), known(annual).alias("ann_return"), known(risk).alias("ann_vol"),
        known(F.when(risk > 1e-9, F.try_divide(annual, risk)).otherwise(0.0)).alias("sharpe"), known(F.col("_down")).alias("max_drawdown"),
    )
