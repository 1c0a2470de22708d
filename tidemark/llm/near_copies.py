"""Near copies by SimHash: documents whose five-word shingle sets have a Jaccard similarity of at least 0.8.

The same fingerprints and the same bit-sliced comparison as in ``simhash``, at a radius for this similarity and with an
exact check behind it. Sets of similarity 0.8 differ in 9.7 of 64 fingerprint bits on average, so the buckets of fewer
than four bits can't find them; here a bucket is a band of ``ROWS`` MinHash values, which two such sets share with a
chance of 0.41, so ``BANDS`` bands lose 3 in 100,000 of them, and fewer of closer ones. Then

1. documents of equal sets are merged, and the rest is compared within its buckets, bit planes against fingerprints:
   what differs in more than ``RADIUS`` bits (3 in 1,000,000 of the pairs at the threshold, 97 of 100 unlike pairs) is
   abandoned. Small sets, whose fingerprints tell less, all pass. Spanning links are kept: the loose components;
2. the sets of a loose component meet once, whatever number of buckets they share, and are told apart by exact
   similarities. From a document on, what is linked to it leaves the rest, so a component of near copies is passed a
   few times, not once for each pair.

A loose component of many documents or many shingles is cut into chunks: the chunks first by themselves, then their
representatives, and only what these do not bring together is compared chunk by chunk with all the others. So no task
ever holds a whole hot group, and a large group of near copies costs in proportion to its members.

Contract: null texts count as empty and texts without words are copies of one another; of fewer than five words the
whole sequence is the one shingle; a null ``doc_id`` is larger than any other; rows are told apart by id and text, so
unlike texts under a null or repeated id are documents of their own; rows that repeat both are one document; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import NO_ID, bounded_batches, id_key, join_by_group, materialize, spare, text_key
from .simhash import HOT, by_majority, cut_hot, linked, shingle_hashes, whole_runs

SHINGLE = 5
#: The least similarity of near copies, 4 / 5, as integers: no rounding decides.
ENOUGH, OF = 4, 5
BANDS, ROWS = 20, 4
#: Fingerprint bits in which near copies differ at most, and the size of the sets from which on that holds.
RADIUS, SMALL_SET = 24, 64
#: Documents and shingles of a chunk.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
#: Shingles that are hashed at once: bounds the memory that a very long text takes.
WIDTH = 1 << 12
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    return np.unique(shingle_hashes(text, SHINGLE))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def bands(shingles: np.ndarray) -> np.ndarray:
    """A bucket for each band; none for an empty set, of which there is but one."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), WIDTH):
        least = np.minimum(least, ((shingles[k : k + WIDTH] ^ _XOR) * _TIMES).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def with_sketches(docs: DataFrame) -> DataFrame:
    """``key, text_hash, set_key, size, fp, bands`` of every row of ``docs``: its id and text hash, then of its shingle set."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("text_hash"), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([by_majority(s) for s in sets], np.uint64).view(np.int64)), _lists([bands(s) for s in sets]),
                ],
                ["key", "text_hash", "set_key", "size", "fp", "bands"],
            )

    slim = docs.select(id_key().alias("key"), text_key().alias("text_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "key long, text_hash long, set_key binary, size long, fp long, bands array<long>")


def loose_links(groups: DataFrame) -> DataFrame:
    """Spanning links ``(a, b)`` between the nodes of ``groups(node, size, fp, bands)`` that may be near copies."""
    keyed = groups.select(F.explode("bands").alias("key"), "fp", F.col("node").alias("id"), "size")
    hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key", F.ceil(F.col("n") / (HOT // 2)).alias("chunks")), "hot-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, ids, sizes in whole_runs(batches, ("key", "fp", "id", "size")):
            told = sizes >= SMALL_SET  # others can only be like sets of at most 5/4 the size
            a, b = linked(keys[told], fps[told].view(np.uint64), ids[told], RADIUS)
            small = sizes * ENOUGH < SMALL_SET * OF
            k, i = keys[small], ids[small]
            first = np.searchsorted(k, k)  # keys are sorted: the first of each bucket
            far = i[first] != i
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, i[far]])), pa.array(np.concatenate([b, i[first][far]]))], ["a", "b"])

    return cut_hot(keyed, hot, "id").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Of each of some sets the smallest place that it is linked to, directly or not, by similarities that are enough."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    label = np.full(n, -1)
    left, owner = codes, np.repeat(np.arange(n), sizes)
    mark = np.zeros(len(codes), bool)
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first] = first
        open_ = [first]
        while open_:
            rest = label[owner] < 0
            left, owner = left[rest], owner[rest]
            if not len(left):
                break
            k = open_.pop()
            own = codes[starts[k] : starts[k + 1]]
            mark[own] = True
            common = np.bincount(owner[mark[left]], minlength=n)
            mark[own] = False
            near = np.flatnonzero((label < 0) & (OF * common >= ENOUGH * (sizes + sizes[k] - common)))
            label[near] = first
            open_ += near.tolist()
    return label


def _told_apart(ids: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of some sets, as two arrays of ids."""
    label, named = similar(sets), np.array(ids, np.int64)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, named)
    root = least[label]
    differ = root != named
    return named[differ], root[differ]


def exact_links(items: DataFrame, sets: DataFrame) -> DataFrame:
    """Spanning links ``(a, b)`` by exact similarity of the nodes that share a key in ``items(key, node)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def emitted() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                a, b = _told_apart(ids, sets)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column("shingles")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for k, (name, i) in enumerate(zip(batch.column("key").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                if name != key:
                    yield from emitted()
                    key, ids, sets = name, [], []
                ids.append(i)
                sets.append(values[offsets[k] : offsets[k + 1]])
        yield from emitted()

    carried = items.join(sets, "node").select("key", "node", "shingles")
    return carried.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles`` of the nodes of ``wanted(node, key, text_hash)``, whose texts ``docs`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists([shingle_set(t) for t in batch.column("text").to_pylist()])], ["node", "shingles"])

    texts = docs.select(id_key().alias("key"), text_key().alias("text_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = texts.join(wanted.hint("merge"), ["key", "text_hash"]).dropDuplicates(["node"])
    return found.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _chunk(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), chunks)


def _large_links(members: DataFrame, chunked: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the loose components that are cut into chunks, beside those within a chunk.

    ``members(comp, node, chunks)``; ``chunked`` has the links within chunks.
    """
    within = connected(chunked)
    placed = materialize(members.join(within, "node", "left").select("comp", "node", "chunks", F.coalesce("root", "node").alias("root")), "large-components")
    heads = placed.select("comp", F.col("root").alias("node")).distinct()
    n_heads = heads.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    dealt = heads.join(n_heads, "comp").select(F.xxhash64("comp", _chunk(F.col("parts"))).alias("key"), "node")
    between = materialize(exact_links(dealt, sets), "links-of-heads")
    joined = connected(between)
    named = placed.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    named = materialize(named.select("comp", "node", "chunks", F.coalesce("top", "root").alias("root")), "large-components")
    # what is not in the largest part of its component is compared with all of the component
    parts = named.groupBy("comp", "root").agg(F.count(F.lit(1)).alias("n"), F.max("chunks").alias("chunks"))
    main = parts.groupBy("comp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("n_other"), F.max("chunks").alias("chunks"), F.sum("n").alias("n_all"))
    open_ = main.filter("n_other > 0").select("comp", "main", F.ceil(F.col("n_other") * F.col("chunks") / F.col("n_all")).alias("other_chunks"))
    rest = named.join(open_, "comp").withColumn("is_other", F.col("root") != F.col("main"))
    own = F.when(F.col("is_other"), _chunk(F.col("other_chunks"))).otherwise(_chunk(F.col("chunks")) + F.col("other_chunks"))
    last = F.when(F.col("is_other"), F.col("other_chunks") + F.col("chunks")).otherwise(F.col("other_chunks")) - 1
    paired = rest.select("comp", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    items = paired.select(F.xxhash64("comp", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node")
    return between.unionByName(exact_links(items, sets))


def links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Spanning links ``(a, b)`` between the nodes of ``groups(node, least, size, fp, bands)`` whose sets are similar; ``least`` names a row of each in ``docs``."""
    loose = connected(loose_links(groups))
    members = loose.select("node", F.col("root").alias("comp")).unionByName(loose.select(F.col("root").alias("node"), F.col("root").alias("comp")).distinct())
    held = materialize(groups.select("node", "size", "least.*").join(members, "node"), "loose-components")
    sets = materialize(_sets_of(docs, held.select("node", "key", "text_hash")), "shingle-sets")
    load = held.groupBy("comp").agg(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("size") / CHUNK_SHINGLES).alias("load"))
    large = materialize(load.filter("load > 1").select("comp", F.ceil("load").alias("chunks")), "large")
    if large.isEmpty():
        return exact_links(held.select(F.col("comp").alias("key"), "node"), sets)
    dealt = materialize(held.select("comp", "node").join(large, "comp", "left"), "chunked-components")
    key = F.when(F.col("chunks").isNull(), F.col("comp")).otherwise(F.xxhash64("comp", _chunk(F.col("chunks"))))
    first = materialize(exact_links(dealt.select(key.alias("key"), "node"), sets), "links-of-chunks")
    in_large = dealt.filter("chunks IS NOT NULL")
    chunked = first.join(in_large.select(F.col("node").alias("a")), "a", "left_semi")
    return first.unionByName(_large_links(in_large, chunked, sets))


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows ``key, text_hash, set_key`` of ``docs``, and ``set_key, n, least, root`` of the distinct sets: rows, smallest row, component."""
    members = materialize(with_sketches(docs), "sketches")
    merged = members.groupBy("set_key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "text_hash")).alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")
    )
    groups = materialize(merged.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")  # written, so the numbers stay
    roots = connected(links(docs, groups))
    named = groups.join(roots, "node", "left").select("set_key", "n", "least", F.coalesce("root", "node").alias("root"))
    return members.select("key", "text_hash", "set_key"), materialize(named, "named-sets")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` of every row of ``docs``: the smallest ``doc_id`` among its near copies, their near copies and so on, its own included."""
    members, named = _rooted(docs)
    least = materialize(named.groupBy("root").agg(F.min("least.key").alias("component"), F.count(F.lit(1)).alias("n_sets")), "components")
    sets = materialize(join_by_group(named, least, "root", "n_sets").select("set_key", "n", "component"), "set-components")
    rows = join_by_group(members, sets, "set_key", "n")
    return rows.select(F.nullif(F.col("key"), F.lit(NO_ID)).alias("doc_id"), F.nullif(F.col("component"), F.lit(NO_ID)).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component of near copies the row with the smallest id (of equal ones, the smallest text hash), with all its columns."""
    _, named = _rooted(docs)
    keys = spare(docs, "key", "text_hash")
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias(keys[0]), F.col("least.text_hash").alias(keys[1]))
    marked = docs.withColumns({keys[0]: id_key(), keys[1]: text_key()})
    # one shuffle of the texts: what the join is dealt by serves the removal of repeated rows, too
    return marked.join(kept.hint("merge"), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
