"""Shared plumbing: text classes, label access and joins that no hot key can stall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let
from ..sources.scratch import materialize, scratch_path

__all__ = ["BLANKS", "BLANK_RUN", "all_of", "appended", "bounded_batches", "NO_ID", "bounded_labels", "id_key", "join_by_group", "let", "materialize", "nothing", "read_table", "scratch_path", "spare", "text_key"]

#: Regex class of the blanks that separate words, as `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Keep Arrow batches of very long texts small, unless the session already says how small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_labels(labels: DataFrame, value: Column, limit: int) -> DataFrame:
    """``(doc_id, target)`` of at most ``limit`` labelled documents, a hash-ordered sample.

    Rows without id or value are left out; of several values for an id the smallest counts. The sample is at most
    ``limit`` rows, so it may be broadcast.
    """
    clean = labels.select("doc_id", value.alias("target")).dropna().groupBy("doc_id").agg(F.min("target").alias("target"))
    total = clean.count()
    if total > limit:
        share = int((limit * 0.95 / total) * 2**31)
        clean = clean.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share)
    return clean.limit(limit)


#: Stands for a null ``doc_id`` where ids are compared; larger than any other.
NO_ID = (1 << 63) - 1


def id_key(column: str = "doc_id") -> Column:
    """A document's id as a join key that is never null: null ids are one document."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


#: Entries that a fold appends one by one before it lays them aside: appending copies.
LAID_ASIDE = 256


def nothing(kind: str) -> Column:
    """What ``appended`` begins with, for entries of the SQL type ``kind``."""
    return F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("open"))


def appended(held: Column, entry: Column) -> Column:
    """``held`` and an entry more, within a fold: no step copies more than ``LAID_ASIDE`` entries, or a list of such lists."""
    full = F.size(held["open"]) >= LAID_ASIDE
    done = F.when(full, F.array_append(held["done"], held["open"])).otherwise(held["done"])
    return F.struct(done.alias("done"), F.when(full, F.array(entry)).otherwise(F.array_append(held["open"], entry)).alias("open"))


def all_of(held: Column) -> Column:
    """The entries that ``held`` has, in order."""
    return F.concat(F.flatten(held["done"]), held["open"])


def text_key(column: str = "text") -> Column:
    """A text's 64-bit hash: with the id it names a row, also where ids are null or repeat. A null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def spare(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``docs`` has as columns."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: A group that holds at least 1 / HEAVY_SHARE of all rows is joined by broadcast: there are at most that many.
HEAVY_SHARE = 1000


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row per ``key``, of which ``rows`` has ``size``), whatever the skew.

    Groups that hold at least a thousandth of the rows are broadcast, the others are joined by a shuffle in which no
    key is hot. ``groups`` should be materialised.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_heavy = F.col(size) >= max(2.0, total / HEAVY_SHARE)
    heavy = groups.filter(is_heavy).limit(HEAVY_SHARE)  # the condition leaves no more than that
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(groups.filter(~is_heavy), key))
