"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table of ``(digest, owner_id)``, one row per distinct normalised text ever ingested, bucketed and sorted
by ``digest``. A batch is deduplicated in three steps: its digests are pre-aggregated, a sort-merge anti-join finds the
ones the index lacks, and those are appended. A document is kept when the index names it as owner, so ingesting the
same batch again after a failure gives the same decisions.

Contract: null texts count as empty; texts are equal when identical after each run of blanks becomes one space; of
equal texts the smallest ``doc_id`` stays (a null id is larger than any other); rows that repeat a ``doc_id`` with an
equal text are one document, whose repeats count in ``group_size``; an empty batch gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RUN, id_key, join_by_group, materialize, scratch_path, spare


def text_digest(text: Column) -> Column:
    """SHA-256 of the blank-normalised text in UTF-8, lowercase hex."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " "), 256)


class DigestIndex:
    """A bucketed table ``name`` at ``path``; it is created when missing and attached when its files exist."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} (digest STRING, owner_id BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame) -> None:
        """Append the ``(digest, owner_id)`` rows whose digest the index lacks."""
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").select("digest", "owner_id")
        # one writer task per bucket, so a batch adds one sorted file to each bucket
        (
            new.repartition(self.buckets, "digest")
            .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).mode("append").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _ranges(members: DataFrame, n: int) -> list[DataFrame]:
    """``members`` cut into ``n`` ascending ranges of ids of about the same size; null ids belong to the last."""
    cuts = sorted(set(members.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.01))) if n > 1 else []
    key, parts, low = id_key(), [], None
    for cut in [*map(int, cuts), None]:
        inside = F.lit(True) if low is None else key > low
        parts.append(members.filter(inside if cut is None else inside & (key <= cut)))
        low = cut
    return parts


def deduplicate(docs: DataFrame, index: DigestIndex, n_batches: int = 1) -> DataFrame:
    """Ingest ``docs`` into ``index`` and report every document.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``: ``keep_id`` is the owner in the index, ``group_size``
    the rows of ``docs`` with the digest. Ingested are ``n_batches`` ascending ranges of ids, one after the other, each
    of them against what the index has by then; null ids come last. Rows of one document are collapsed before the
    join, heavy digests (at most 1000 by construction) are joined by broadcast, so no task gets a whole hot group.
    The result no longer reads the index.
    """
    members = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
        .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")),
        "digests",
    )
    groups = members.groupBy("digest").agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("n_docs"))
    for batch in _ranges(members, n_batches):
        index.append_new(batch.groupBy("digest").agg(F.min("doc_id").alias("owner_id")))
    owned = materialize(groups.join(index.rows().hint("merge"), "digest"), "owned-digests")
    both = join_by_group(members, owned, "digest", "n_docs")
    return both.select(
        "doc_id", F.col("owner_id").alias("keep_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("owner_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def fresh_index(spark: SparkSession, label: str = "digest_index") -> DigestIndex:
    """An empty index in the shared scratch folder, with as many buckets as the session has shuffle partitions.

    So a batch that is dealt to the buckets is written by one task for each, and buckets grow in number with the data.
    """
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"{label}_{uuid.uuid4().hex}", scratch_path(spark, label), buckets)


def drop_duplicates(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns; of a repeated row one stays.

    Rows are told apart by id and digest, so unlike texts under a null or repeated id all stay.
    """
    keys = spare(docs, "key", "digest")
    kept = deduplicate(docs, index).filter("kept").select(id_key().alias(keys[0]), F.col("text_sha256").alias(keys[1]))
    marked = docs.withColumns({keys[0]: id_key(), keys[1]: text_digest(F.col("text"))})
    # one shuffle of the texts: what the join is dealt by serves the removal of repeated rows, too
    return marked.join(kept.hint("merge"), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
