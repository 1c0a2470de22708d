import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lm_scoring as L

DOCS = [(1, "The cat sat on the mat, the cat."), (2, "the dog sat; THE dog ran é"), (3, None), (4, ""), (5, "cat dog"), (5, "cat dog"), (None, "zzz the"), (6, "!!"), (7, "the cat ran " * 400), (None, "the the the")]
LABELS = [(1, 1), (2, 0), (5, 1), (None, 1), (9, 1), (1, 1)]


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


class Brute:
    """One of the two models, over all words and bigrams."""

    def __init__(self, every, own):
        self.pairs, self.words, self.contexts = Counter(), Counter(), Counter()
        for s in own:
            self.pairs.update(zip(["<s>", *s], s, strict=False))
            self.words.update(s)
            self.contexts.update(["<s>", *s][:-1] if s else [])
        self.shares, self.total = Counter(w for s in every for w in s), sum(map(len, every))

    def p(self, h, w):
        prior = (self.words[w] + L.STRENGTH * self.shares[w] / self.total) / (sum(self.words.values()) + L.STRENGTH)
        return (self.pairs[h, w] + L.STRENGTH * prior) / (self.contexts[h] + L.STRENGTH)

    def loss(self, s):
        return -sum(math.log(self.p(h, w)) for h, w in zip(["<s>", *s], s, strict=False))


def brute_models(docs, labels):
    good = {i for i, q in labels if q == 1 and i is not None}
    every = [words(t) for _, t in docs]
    return Brute(every, [words(t) for i, t in docs if i in good]), Brute(every, every)


def brute(docs, labels):
    models = brute_models(docs, labels)
    return [(i, len(s := words(t)), *[m.loss(s) / len(s) if s else None for m in models]) for i, t in docs]


def assert_same(got, want):
    order = lambda r: (repr(r[:2]), r[2] or 0)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:2] == b[:2] and all(x == y or x == pytest.approx(y, abs=1e-6) for x, y in zip(a[2:], b[2:], strict=True))


@pytest.mark.parametrize("partitions", ["1", "4", "1000"])  # from a few frequent words to none that is not
@pytest.mark.parametrize("broadcast", [0, 10])
def test_against_brute_force(spark, partitions, broadcast):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame([(*d, 0, "r") for d in DOCS], "doc_id long, text string, score int, row string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions if partitions != "1000" else "20")
    try:
        got = [(r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in L.cross_entropy_difference(df, labels, broadcast).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert_same(got, brute(DOCS, LABELS))


def test_models_are_distributions():
    for model in brute_models(DOCS, LABELS):
        for h in ["<s>", "the", "cat", "zzz", "never"]:
            assert sum(model.p(h, w) for w in model.shares) == pytest.approx(1)


@pytest.mark.parametrize(("n_bytes", "n_block"), [(6 << 20, 1 << 20), (50, 16), (7, 3), (1, 1)])
@pytest.mark.parametrize("n_frequent", [0, 3, 1000])
def test_chunks_of_any_size_give_the_same(monkeypatch, n_bytes, n_block, n_frequent):
    """Mapper and reducer in one process, with texts cut anywhere and any words dealt apart."""
    monkeypatch.setattr(L, "CHUNK_BYTES", n_bytes)
    monkeypatch.setattr(L, "BLOCK_BYTES", n_block)
    rng = np.random.default_rng(3)
    docs = [*DOCS, *[(100 + k, " ".join(f"w{x}" for x in rng.zipf(1.4, 60) if x < 500)) for k in range(30)]]
    labels = [*LABELS, *[(100 + k, k % 2) for k in range(30)]]
    good = {i for i, q in labels if q == 1 and i is not None}
    batch = pa.RecordBatch.from_arrays([pa.array([(1 << 33) * (k % 2) + k for k in range(len(docs))]), pa.array([d[0] for d in docs]), pa.array([d[0] in good for d in docs]), pa.array([d[1] or "" for d in docs])], ["row", "doc_id", "is_target", "text"])
    background = brute_models(docs, labels)[1]
    common = [w for w, _ in background.words.most_common(n_frequent)]
    pairs = [(w, h) for (h, w), _ in background.pairs.most_common(n_frequent // 3) if w in common and h != "<s>"]
    hashed = lambda ws: np.array([h for w in ws for h in L.word_hashes(w.encode())[0]], np.uint64)
    names = np.array(sorted(hashed(common).tolist()), np.uint64)
    coded = np.stack([hashed([p[0] for p in pairs]), hashed([p[1] for p in pairs])], axis=1).reshape(-1, 2)
    coded = coded[np.argsort(L.pair_codes(coded[:, 0], coded[:, 1]))]
    asked = L.Frequent(names, np.zeros((len(names), 4), np.int64), coded, np.zeros((len(coded), 2), np.int64))
    totals = L.Totals()
    for chunk in L.chunks(iter([batch])):
        for r in L._tally(chunk, None, asked).to_pylist():
            told = np.array([r["n"], r["n_target"], r["n_last"], r["n_last_target"]])
            w, h = (np.array([r[c]], np.int64).view(np.uint64) for c in ("word", "context"))
            if r["kind"] == L.TOTAL:
                totals = L.Totals(*(np.array([totals.tokens, totals.target_tokens, totals.texts, totals.target_texts]) + told).tolist())
            elif r["kind"] == L.WORD:
                asked.counts[asked.places(w)[0]] += told
            else:
                asked.pair_counts[asked.pair_places(w, h)[0]] += told[:2]
    models, told, buckets = L.Models(totals, asked), {}, {}
    for chunk in L.chunks(iter([batch])):
        for p in zip(*[c.to_pylist() for c in L.parcels(chunk, models, 5).columns], strict=True):
            if p[1] == L.TEXTS:
                told.setdefault(p[2], []).append((p[1], *p[3:]))
            else:
                buckets.setdefault(p[0], []).append(L.Opened.of(p))
    for opened in buckets.values():
        for p in zip(*[c.to_pylist() for c in L.scored(opened, models).columns], strict=True):
            told.setdefault(p[2], []).append((p[1], *p[3:]))
    ids, n, sums = {}, Counter(), Counter()
    for base, parts in told.items():
        for r in L.added_up(base, parts).to_pylist():
            ids[r["row"]] = r["doc_id"]
            n[r["row"]] += r["n_words"]
            sums[r["row"], 0] += r["target"]
            sums[r["row"], 1] += r["background"]
    got = [(ids[row], n[row], *[sums[row, k] / L.UNIT / n[row] if n[row] else None for k in range(2)]) for row in ids]
    assert_same(got, brute(docs, labels))


def test_hashes_are_those_of_the_words(spark, small):
    seen = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect():
        raw = r.text.lower().encode()
        hashes, places = L.word_hashes(raw)
        assert [w for w in words(r.text)] == [raw[p:].split(b" ")[0].decode(errors="replace")[: len(w)] for p, w in zip(places, words(r.text), strict=True)]
        for w, h in zip(words(r.text), hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 1000


def test_very_frequent_bigrams_are_counted_apart(spark):
    docs = [(k, "again and again") for k in range(50)] + [(100 + k, f"a{k} b{k} c{k} d{k}") for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", L.F.monotonically_increasing_id()).withColumn("is_target", L.F.lit(False))
    totals, found = L.count_frequent(df.select("row", "doc_id", "is_target", "text"), 1)
    assert totals == L.Totals(350, 0, 100, 0) and len(found.words) <= 16 and len(found.pairs) <= 16
    again, both = L.word_hashes(b"again and")[0]
    assert found.counts[found.places(np.array([again]))[0]].tolist() == [100, 0, 50, 0]
    assert found.pair_counts[found.pair_places(np.array([again]), np.array([both]))[0]].tolist() == [50, 0]


def test_good_text_scores_lower(spark, small):
    sf = small.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    means = {r.quality: r.m for r in L.cross_entropy_difference(docs, labels).join(labels, "doc_id").groupBy("quality").agg({"score": "avg"}).withColumnRenamed("avg(score)", "m").collect()}
    assert means[1] < means[0]


def test_empty_tables(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int")
    assert L.cross_entropy_difference(df.limit(0), labels).count() == 0
    got = L.cross_entropy_difference(df, labels.limit(0)).collect()
    assert_same([(r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in got], brute(DOCS, []))
