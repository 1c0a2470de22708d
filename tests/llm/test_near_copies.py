import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_copies as N
from tidemark.llm import simhash as S


def words(text):
    return (text or "").lower().encode().split()


def brute_set(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """The smallest id of each component of similarity 0.8 or more, over all pairs."""
    sets = [(i, brute_set(t)) for i, t in rows]
    label = list(range(len(sets)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    pairs = 0
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                label[max(root(a), root(b))] = min(root(a), root(b))
                pairs += 1
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return set(least.values()), pairs


def test_stage_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, pairs = brute_kept(rows)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS) and pairs > 0
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("chunk", [N.CHUNK, 16])
def test_planted_near_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "HOT", 4 * chunk)
    rng = np.random.default_rng(7)
    rows = []
    for k in range(60):
        text = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((10 * k, " ".join(text)))
        for c in range(1, 1 + k % 4):  # c words are replaced: at most 15 of 196 shingles
            near = text[:]
            for at in rng.choice(200, c, replace=False):
                near[at] = "other"
            rows.append((10 * k + c, " ".join(near)))
    base = [f"v{x}" for x in range(120)]
    rows += [(5000 + k, " ".join([*base[:-1], f"last{k}"])) for k in range(80)]  # one large group
    rows += [(9000, None), (9001, " "), (9002, "One two"), (9003, "one TWO"), (9004, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in N.one_of_each(df).collect()} == brute_kept(rows)[0]
    assert {r.component_id for r in N.near_copies(df).collect()} == brute_kept(rows)[0]
    assert N.one_of_each(df.limit(0)).count() == 0


def test_a_large_loose_component_of_several_groups(spark, monkeypatch):
    """Chunks, their representatives and what those leave open: a chain whose links only meet across chunks."""
    monkeypatch.setattr(N, "CHUNK", 8)
    monkeypatch.setattr(N, "loose_links", lambda groups: groups.select(F.col("node").alias("a")).crossJoin(groups.agg(F.min("node").alias("b"))).filter("a > b"))
    rows = [(k, " ".join(f"w{x}" for x in range(6 * k, 6 * k + 100))) for k in range(40)]  # each like the next alone
    rows += [(100 + k, " ".join(f"v{k}x{x}" for x in range(50 + k))) for k in range(12)]  # unlike all
    base = [f"u{x}" for x in range(90)]
    rows += [(200 + k, " ".join([*base, f"end{k}"])) for k in range(50)]
    kept = {r.doc_id for r in N.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_kept(rows)[0] == {0, 200, *range(100, 112)}


def test_radius_loses_next_to_nothing():
    rng, far = np.random.default_rng(5), []
    for size in (64, 100, 400):
        for _ in range(400):
            shared = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            own = rng.integers(0, 1 << 63, (2, size // 8), dtype=np.uint64)  # similarity 0.8
            a, b = (S.by_majority(np.concatenate([shared, o])) for o in own)
            far.append(bin(a ^ b).count("1"))
    assert max(far) <= N.RADIUS and np.mean(far) > 8
