"""Data quality: missing values, statistics, outliers, completeness, advice; metadata and verification of a load."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, QualityConfig
from ..sources.scratch import materialize


def unknown(df: DataFrame, column: str) -> Column:
    """NULL, or NaN in a floating column."""
    value = F.col(column)
    return (value.isNull() | F.isnan(value)) if dict(df.dtypes)[column] in ("double", "float") else value.isNull()


def _long(wide: DataFrame, columns: list[str], figures: list[str]) -> DataFrame:
    """One row of aggregates named ``figure|column`` as a row a column."""
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{f}|{c}`").alias(f) for f in figures]) for c in columns]
    return wide.select(F.inline(F.array(*structs)))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, missing_count, missing_percentage``: all columns in one pass."""
    parts = [e for c in columns for e in (F.count_if(unknown(df, c)).alias(f"missing_count|{c}"), (100 * F.try_divide(F.count_if(unknown(df, c)), F.count(F.lit(1)))).alias(f"missing_percentage|{c}"))]
    return _long(df.agg(*parts), columns, ["missing_count", "missing_percentage"])


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, mean, std, min, max``: all columns in one pass; NaN counts as unknown."""
    known = lambda c: F.when(~unknown(df, c), F.col(c).cast("double"))
    parts = [fn(known(c)).alias(f"{name}|{c}") for c in columns for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return _long(df.agg(*parts), columns, ["mean", "std", "min", "max"])


def outliers(df: DataFrame, columns: list[str], config: QualityConfig = DEFAULT.quality, exact: bool = False) -> DataFrame:
    """``column, q1, q3, lower, upper, n_outliers, outlier_percentage`` beyond the whiskers: two passes for all columns.

    Quartiles are sketched with a bounded error unless ``exact``, which writes the columns once and ranks what lies near them.
    """
    known = lambda c: F.when(~unknown(df, c), F.col(c).cast("double"))
    if exact:
        df = materialize(df.select(*columns), "measured")
        found = quantiles(df, {c: known(c) for c in columns}, [0.25, 0.75])
        edges = found.agg(*[F.max(F.when(F.col("name") == c, F.col("q"))).alias(f"q|{c}") for c in columns])
    else:
        edges = df.agg(*[F.percentile_approx(known(c), [0.25, 0.75], 10_000).alias(f"q|{c}") for c in columns])
    q = lambda c, k: F.get(F.col(f"`q|{c}`"), F.lit(k))
    span = lambda c: config.iqr_factor * (q(c, 1) - q(c, 0))
    beyond = lambda c: (known(c) < q(c, 0) - span(c)) | (known(c) > q(c, 1) + span(c))
    counted = df.crossJoin(F.broadcast(edges)).agg(  # one row
        *[F.first(q(c, k)).alias(f"{name}|{c}") for c in columns for k, name in ((0, "q1"), (1, "q3"))],
        *[F.first(e).alias(f"{name}|{c}") for c in columns for name, e in (("lower", q(c, 0) - span(c)), ("upper", q(c, 1) + span(c)))],
        *[F.count_if(beyond(c)).alias(f"n_outliers|{c}") for c in columns],
        *[(100 * F.try_divide(F.count_if(beyond(c)), F.count(known(c)))).alias(f"outlier_percentage|{c}") for c in columns],
    )
    return _long(counted, columns, ["q1", "q3", "lower", "upper", "n_outliers", "outlier_percentage"])


def completeness(df: DataFrame, columns: list[str], config: QualityConfig = DEFAULT.quality) -> DataFrame:
    """One row: rows, those with more unknown columns than allowed, and the percentage of the others; 0 without rows."""
    lacking = reduce(add, [unknown(df, c).cast("int") for c in columns])
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(lacking > config.max_missing_in_row).alias("incomplete_rows"))
    score = F.coalesce(100 * F.try_divide(F.col("total_rows") - F.col("incomplete_rows"), F.col("total_rows")), F.lit(0.0))
    return counted.withColumn("completeness_score", score)


def recommendations(lacks: DataFrame, strays: DataFrame, whole: DataFrame, config: QualityConfig = DEFAULT.quality) -> DataFrame:
    """``type, severity, n_columns``: what deserves a look; OK where nothing does."""
    found = (
        lacks.filter(F.col("missing_percentage") > config.max_missing_percent).agg(F.count(F.lit(1)).alias("n_columns")).select(F.lit("MISSING_DATA").alias("type"), F.lit("HIGH").alias("severity"), "n_columns")
        .unionByName(strays.filter(F.col("outlier_percentage") > config.max_outlier_percent).agg(F.count(F.lit(1)).alias("n_columns")).select(F.lit("OUTLIERS").alias("type"), F.lit("MEDIUM").alias("severity"), "n_columns"))
        .unionByName(whole.select(F.lit("COMPLETENESS").alias("type"), F.lit("HIGH").alias("severity"), (F.col("completeness_score") < config.min_completeness).cast("long").alias("n_columns")))
    ).filter("n_columns > 0")
    none = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("OK").alias("type"), F.lit("INFO").alias("severity"), F.lit(0).cast("long").alias("n_columns"))
    return found.unionByName(none)


def metadata(df: DataFrame, symbol: str = "symbol", day: str = "trade_date") -> DataFrame:
    """One row: rows, symbols, first and last year, and the partitions that a layout by year, month and symbol has."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(symbol).alias("n_symbols"), F.min(F.year(day)).alias("min_year"), F.max(F.year(day)).alias("max_year"),
        F.countDistinct(F.year(day), F.month(day), F.col(symbol)).alias("n_partitions"),
    )


def clean(ticks: DataFrame, symbol: str = "symbol", at: str = "timestamp", price: str = "price") -> DataFrame:
    """Ticks of a known time, a named symbol and a positive price."""
    return ticks.filter(F.col(price).isNotNull() & ~F.isnan(price) & (F.col(price) > 0) & F.col(at).isNotNull() & F.col(symbol).isNotNull() & (F.col(symbol).cast("string") != ""))


def verify(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n_known`` of a loaded table, in one pass."""
    return _long(df.agg(*[F.count(c).alias(f"n_known|{c}") for c in columns]), columns, ["n_known"])


def conversion(source: DataFrame, stored: DataFrame, source_bytes: int, stored_bytes: int) -> DataFrame:
    """One row: both counts, really counted, whether they agree, and how much smaller the stored table is."""
    a, b = source.agg(F.count(F.lit(1)).alias("source_rows")), stored.agg(F.count(F.lit(1)).alias("stored_rows"))
    return a.crossJoin(b).select("source_rows", "stored_rows", (F.col("source_rows") == F.col("stored_rows")).alias("intact"), F.lit(source_bytes / max(1, stored_bytes)).alias("compression"))


def spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """By key: rows, mean, median and 95th percentile, interpolated."""
    q = F.percentile(value, [0.5, 0.95])
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("_q")).select(key, "n", "mean", F.get("_q", F.lit(0)).alias("median"), F.get("_q", F.lit(1)).alias("p95"))


def binned_means(df: DataFrame, by: str, value: str, bins: int = 8) -> DataFrame:
    """``bin, n, mean_by, mean_value`` in bins between the quantiles of ``by``; bins with equal edges are one.

    Edges are exact; only the rows near them are ranked.
    """
    df = materialize(df.select(by, value), "binned")
    found = quantiles(df, {by: F.col(by)}, [k / bins for k in range(1, bins)])
    edges = F.broadcast(found.agg(F.array_distinct(F.max("q")).alias("_edges")))  # one row
    number = F.aggregate("_edges", F.lit(1), lambda n, e: n + (F.col(by) > e).cast("int"))
    return df.crossJoin(edges).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(by).alias("mean_by"), F.avg(value).alias("mean_value"))


def plot_sample(df: DataFrame, key: str, n: int = 50_000) -> DataFrame:
    """At most ``n`` rows for a chart, the same each time: those whose key has the smallest hash."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


#: Relative error of the sketch that brackets a quantile, and how far the bracket reaches beyond it at first.
SKETCH, MARGIN = 10_000, 0.001


def quantiles(df: DataFrame, values: dict[str, Column], shares: list[float], by: tuple[str, ...] = (), margin: float = MARGIN) -> DataFrame:
    """``*by, name, q``: exact quantiles of each value at ``shares``, interpolated as ``percentile`` does it; no row where no value is known.

    A sketch brackets every quantile; then rows below the brackets are counted and those inside, by value, are ranked. So
    only some thousandths of the rows are shuffled and no buffer holds a column. A bracket that misses is widened, up to all rows.
    Groups of ``by`` should be few, and ``df``, which is read twice, should be written already.
    """
    keys = [*by, "name"]
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, v in values.items()])).alias("_s")).select(*by, "_s.*").filter("v IS NOT NULL")
    while True:
        ends = [e for s in shares for e in (max(0.0, s - margin), min(1.0, s + margin))]
        sketched = long.groupBy(*keys).agg(F.count("v").alias("n"), F.percentile_approx("v", ends, SKETCH).alias("_e"))
        places = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("k", "share")
        at = lambda j: F.get("_e", 2 * F.col("k") + j)
        open_below, open_above = F.col("share") <= margin, F.col("share") >= 1 - margin
        brackets = sketched.select(*keys, "n", "_e", places).select(*keys, "n", "k", "share", F.when(~open_below, at(0)).alias("low"), F.when(~open_above, at(1)).alias("high"))
        brackets = materialize(brackets, "quantile-brackets")
        same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        near = long.alias("a").join(F.broadcast(brackets.alias("b")), reduce(lambda x, y: x & y, map(same, keys))).filter(F.col("high").isNull() | (F.col("v") <= F.col("high")))
        below = F.col("low").isNotNull() & (F.col("v") < F.col("low"))
        counted = near.groupBy(*[F.col(f"b.{c}") for c in keys], "k", "n", "share", F.when(~below, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("rows"))
        upto = F.sum("rows").over(Window.partitionBy(*keys, "k").orderBy(F.asc_nulls_first("v")))
        place = F.col("share") * (F.col("n") - 1)
        ranked = counted.withColumn("upto", upto).groupBy(*keys, "k", "n", "share").agg(
            *[F.min_by("v", F.when(F.col("upto") > rank(place), F.col("upto"))).alias(end) for end, rank in (("x", F.floor), ("y", F.ceil))],
        )
        ranked = materialize(ranked, "quantile-ranks")
        if margin >= 1 or ranked.filter("x IS NULL OR y IS NULL").isEmpty():
            break
        margin *= 10
    part = F.col("share") * (F.col("n") - 1) - F.floor(F.col("share") * (F.col("n") - 1))
    value = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise((1 - part) * F.col("x") + part * F.col("y"))
    found = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))).alias("_q"))  # a row a quantile
    return found.select(*keys, F.transform("_q", lambda e: e["v"]).alias("q"))
