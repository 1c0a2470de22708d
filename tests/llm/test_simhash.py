import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash as S
from tidemark.operators import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    """rows: (doc_id, fingerprint); the smallest id reachable of each place."""
    fps = np.array([f for _, f in rows], np.uint64)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [least[root(i)] for i in range(len(rows))]


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    texts = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(texts, brute_components(texts), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_odd_rows(spark):
    rows = [(5, None), (9, ""), (9, "\n "), (3, "One TWO"), (4, "one two"), (None, "one two"), (7, "É é x y"), (8, "a b c " * 20000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = S.near_duplicates(df).collect()
    assert sorted(r.fingerprint for r in got) == sorted(f"{brute_fingerprint(t):016x}" for _, t in rows)
    by_fp = {}
    for r in got:
        by_fp.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(v) == 1 for v in by_fp.values()) and by_fp["0" * 16] == {5}
    assert by_fp[f"{brute_fingerprint('one two'):016x}"] == {3}
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_unlike_texts_of_one_id_are_not_linked(spark):
    texts = ["alpha beta gamma delta epsilon", "one two three four five six", "red green blue white"]
    got = S.near_duplicates(spark.createDataFrame([(4, texts[0]), (4, texts[1]), (2, texts[1]), (None, texts[2])], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == [(2, 2), (4, 2), (4, 4), (None, None)]


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    for radius in (0, 1, 2, 3, 5, 7):
        fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        for k in range(1, 200):  # near ones
            fps[k] = fps[k - 1] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 6), dtype=np.uint64)) if k % 7 else fps[k]
        keys = np.sort(rng.integers(0, 4, 300))
        pairs = set()
        ends = np.searchsorted(keys, keys, "right")
        planes = S.BitPlanes(fps)
        for q, w, lanes in S._comparisons(ends):
            a, b = planes.within(q, w, lanes, radius)
            pairs |= set(zip(a.tolist(), b.tolist(), strict=True))
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if keys[i] == keys[j] and int(np.bitwise_count(fps[i] ^ fps[j])) <= radius}
        assert pairs == want


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 40)
    monkeypatch.setattr(S, "CHUNK", 16)
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = list({base ^ sum(1 << int(b) for b in rng.integers(0, 60, rng.integers(0, 5))) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 100)})
    rows = [(k, f) for k, f in enumerate(fps)]
    groups = spark.createDataFrame([(f, k) for k, f in rows], "fp long, id long")
    roots = {r.node: r.root for r in components.connected(S.links(groups)).collect()}
    assert [roots.get(k, k) for k, _ in rows] == brute_components(rows)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(200)]
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in label} == label
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_explodes_ten_buckets(spark):
    assert spark.range(1).select(F.size(S._buckets(F.lit(-1).cast("long")))).first()[0] == 10
