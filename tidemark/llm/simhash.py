"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: one pass over the texts. Candidates: equal fingerprints are merged first; the 64 bits are cut into five
blocks, and fingerprints that differ in at most three bits agree in at least two of the five, so each fingerprint goes
to ten buckets by two of its blocks. That loses no link. Comparison: within a partition sorted by bucket, fingerprints
are stored as 64 bit planes, 64 fingerprints to a machine word; the distances of a query to a whole word of them are
counted together with carry-save bitwise counters, and a word is abandoned once all its distances exceed the radius.
Of the links of a bucket a spanning forest is emitted, so the output grows with the members, not their pairs.

A bucket of more than ``HOT`` fingerprints is cut into chunks, every two of which are compared by a work item of their
own, so no task ever holds a whole hot bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, bounded_batches, join_by_group, materialize
from ..operators.components import connected

SEED, SHINGLE, RADIUS = 42, 3, 3
#: (lowest bit, number of bits) of the blocks, one or two more than the radius
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
HOT, CHUNK = 4096, 2048
#: Words of 64 fingerprints that are compared at once: bounds the memory of a task.
BLOCKS_AT_ONCE = 1 << 13


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles of a text, repeats included; of fewer words the whole sequence."""
    words = text.encode().lower().split()  # on bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return np.empty(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), SEED)], "<u8")
    return np.fromiter((digest(b" ".join(s), SEED) for s in zip(*[words[k:] for k in range(size)], strict=False)), "<u8", len(words) - size + 1)


def by_majority(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The fingerprint of a text's shingles; 0 without words."""
    return by_majority(shingle_hashes(text, size))


def with_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


class BitPlanes:
    """Fingerprints stored vertically: plane b holds bit b of all of them, 64 to a word."""

    def __init__(self, fps: np.ndarray):
        self.fps = np.ascontiguousarray(fps, "<u8")
        padded = np.zeros(-(-len(fps) // 64) * 64, "<u8")
        padded[: len(fps)] = self.fps
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")

    def within(self, query: np.ndarray, word: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Of queries (by place) against words (by place), lanes set in ``wanted``: all pairs of places within ``radius``."""
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        n_counters = max(1, int(radius).bit_length())
        start = (1 << n_counters) - 1 - radius  # so that a counter overflows just above the radius
        counters = [np.full(len(query), full if start >> k & 1 else 0, np.uint64) for k in range(n_counters)]
        over = ~wanted
        sought = self.fps[query]
        for b in range(64):
            carry = self.planes[b, word] ^ (np.uint64(0) - ((sought >> np.uint64(b)) & np.uint64(1)))
            for k in range(n_counters):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 4 == 3:
                alive = over != full
                if not alive.all():  # abandon the blocks all of whose distances exceed the radius
                    query, word, over, sought = query[alive], word[alive], over[alive], sought[alive]
                    counters = [c[alive] for c in counters]
                    if not len(query):
                        break
        lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, lane = np.nonzero(lanes)
        return query[k], word[k].astype(np.int64) * 64 + lane


def _comparisons(run_ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, word, wanted lanes): every place against the later places of its run, ``BLOCKS_AT_ONCE`` at a time."""
    place = np.arange(len(run_ends), dtype=np.int64)
    first, last = (place + 1) >> 6, (run_ends - 1) >> 6
    count = np.where(run_ends - place > 1, last - first + 1, 0)
    upto = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(place):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BLOCKS_AT_ONCE, "right")) - 1)
        n = count[lo:hi]
        if n.sum():
            query = np.repeat(place[lo:hi], n)
            word = np.repeat(first[lo:hi], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            low = np.clip(query + 1 - word * 64, 0, 63).astype(np.uint64)
            high = np.clip(run_ends[query] - word * 64, 1, 64).astype(np.uint64)
            full = np.uint64(0xFFFFFFFFFFFFFFFF)
            yield query, word, (full << low) & (full >> (np.uint64(64) - high))
        lo = hi


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each of n places is linked to, directly or not."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            low = np.minimum(label[a], label[b])
            high = np.maximum(label[a], label[b])
            if (low == high).all():
                break
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def linked(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, as two arrays of ids, of fingerprints within ``radius`` of one another and of equal key; keys are sorted."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    shared = np.repeat(sizes > 1, sizes)
    if not shared.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fps, ids, sizes = fps[shared], ids[shared], sizes[sizes > 1]
    run_ends = np.repeat(np.cumsum(sizes), sizes)
    planes = BitPlanes(fps)
    label = _forest(len(fps), (planes.within(q, w, lanes, radius) for q, w, lanes in _comparisons(run_ends)))
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    differ = root != ids
    return ids[differ], root[differ]


def whole_runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("key", "fp", "id"), at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of batches that are sorted by the first of them, cut only between its values."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]))
        if sum(h.shape[1] for h in held) < at_once:
            continue
        rows = np.concatenate(held, axis=1)
        cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on
        held = [rows[:, cut:]]
        if cut:
            yield tuple(rows[:, :cut])
    if held:
        yield tuple(np.concatenate(held, axis=1))


def cut_hot(keyed: DataFrame, hot: DataFrame, by: str) -> DataFrame:
    """``keyed`` with the buckets of ``hot(key, chunks)`` cut into chunks by a hash of the column ``by``.

    Every two chunks of a bucket meet under a key of their own. Keys are hashes: where two coincide more is compared.
    """
    if hot.isEmpty():
        return keyed
    own = F.pmod(F.xxhash64(by), F.col("chunks"))
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = keyed.join(hot, "key", "left").select(*keyed.columns, "chunks", own.alias("own"), other.alias("other"))
    item = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.withColumn("key", F.when(F.col("chunks").isNull(), F.col("key")).otherwise(item)).select(*keyed.columns)


def _buckets(fp: Column) -> Column:
    """The ten bucket numbers of a fingerprint: which two blocks, and their bits."""
    blocks = [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1)) for low, bits in BLOCKS]
    pairs = [(i, j) for j in range(len(BLOCKS)) for i in range(j)]
    return F.array(*[F.lit(k << 26).bitwiseOR(F.shiftleft(blocks[i], 13)).bitwiseOR(blocks[j]).cast("long") for k, (i, j) in enumerate(pairs)])


def links(groups: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links ``(a, b)`` between the ids of ``groups(fp, id)``, one row per distinct fingerprint."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("the blocks find links of at most three differing bits")
    keyed = groups.select(F.explode(_buckets(F.col("fp"))).alias("key"), "fp", "id")
    hot = materialize(keyed.groupBy("key").count().filter(F.col("count") > HOT).select("key", F.ceil(F.col("count") / CHUNK).alias("chunks")), "hot-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, ids in whole_runs(batches):
            a, b = linked(keys, fps.view(np.uint64), ids, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut_hot(keyed, hot, "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest
    ``doc_id`` reachable, the own one included. Rows that share an id are documents of their own. Null texts count as empty; texts without words have fingerprint zero
    and are linked like others; a null ``doc_id`` is larger than any other; rows may repeat; an empty table gives an
    empty result; other columns are ignored.
    """
    members = materialize(with_fingerprints(docs, size), "fingerprints")
    groups = materialize(members.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    # components of fingerprints, not of ids, which may repeat
    roots = connected(links(groups.select("fp", F.col("fp").alias("id")), radius))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "n", "id", F.coalesce("root", "fp").alias("root"))
    least = materialize(rooted.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n_fps")), "components")
    named = materialize(join_by_group(rooted, least, "root", "n_fps").select("fp", "n", "component"), "named-fingerprints")
    rows = join_by_group(members, named, "fp", "n")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.nullif(F.col("component"), F.lit(NO_ID)).alias("component_id"))
