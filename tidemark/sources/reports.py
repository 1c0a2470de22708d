"""Reports and models that outlive a session: tables as CSV, JSON or Parquet, texts, fitted models, built tables.

Everything is written by Spark to a path of any store it knows, so driver and executors need no common folder of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "parquet")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """``df`` below ``path``; columns of a report that CSV has no form for are written as JSON."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {FORMATS}")
    writer = df
    if kind == "csv":
        nested = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
        writer = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])
    writer.write.mode("overwrite").option("header", True).format(kind).save(path)


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    """A short text, a line a row, as one file below ``path``."""
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_schema(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """A schema as JSON and as a text to read: ``path/json`` and ``path/text``."""
    write_text(spark, [json.dumps(schema.jsonValue())], f"{path}/json")
    write_text(spark, [f"{k:>3}  {f.name:<24} {f.dataType.simpleString():<12} {'nullable' if f.nullable else 'required'}" for k, f in enumerate(schema)], f"{path}/text")


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(spark.read.text(f"{path}/json").first().value))


def save_model(model, path: str) -> None:
    """A fitted K-means or pipeline model."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """What ``save_model`` wrote."""
    try:
        return PipelineModel.load(path)
    except Exception:  # Spark tells another kind of model only by failing
        return KMeansModel.load(path)


def kept(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is built and written where there is none yet, and stays there when the session ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
