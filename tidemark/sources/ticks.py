"""Tick files and stored tables: declared-schema CSV in, partitioned Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILE_SUFFIX, INDICATORS, PARTITIONS, PRICES, TIMESTAMP_FORMAT, tick_schema


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tick files ``{SYMBOL}_minute_data_with_indicators.csv`` with the declared schema; NaN becomes NULL."""
    raw = spark.read.schema(tick_schema()).option("header", True).option("mode", "PERMISSIVE").csv(path)
    named = raw.withColumn("_file", F.col("_metadata.file_name"))
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in (*PRICES, *INDICATORS)}
    return named.withColumns(clean)


def enrich(ticks: DataFrame) -> DataFrame:
    """Symbol from the file name ('' where it doesn't follow the contract), timestamp (NULL where malformed) and partition keys in the session's time zone."""
    symbol = F.regexp_extract(F.url_decode("_file"), rf"^(.+){FILE_SUFFIX.replace('.', chr(92) + '.')}$", 1)
    timed = ticks.withColumns({"stock_symbol": symbol, "timestamp": F.try_to_timestamp("date", F.lit(TIMESTAMP_FORMAT))}).drop("_file")
    return timed.withColumns({"year": F.year("timestamp"), "month": F.month("timestamp"), "day": F.dayofmonth("timestamp")})


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = PARTITIONS) -> None:
    """Snappy Parquet by partition; rows are clustered by partition first, so each has few files."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).option("compression", "snappy").parquet(path)


def stored_size(spark: SparkSession, path: str) -> DataFrame:
    """``n_files, n_bytes`` below a path, of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
