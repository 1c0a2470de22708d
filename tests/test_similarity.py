"""MinHash, patterns, precedents and fusion: definitions in plain Python, and invariants."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import FusionConfig
from tidemark.functions import vectors
from tidemark.operators import minhash, patterns, precedents


def md32(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


DOCS = [(1, "a b c d e f"), (2, "A b  c d e\nf"), (3, "a b c d e g"), (4, None), (5, "x y"), (6, "a b c d e f " * 300)]


def test_signatures_in_plain_python(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    signed = minhash.with_signatures(minhash.text_shingles(df))
    rows = {r.doc_id: r for r in signed.select("*", minhash.bands(F.col("signature")).alias("bands"), minhash.signature(F.col("shingles")).alias("again")).collect()}
    a, b = minhash.coefficients()
    for doc_id, text in DOCS:
        words = (text or "").lower().split()
        shingles = sorted({md32(" ".join(words[i : i + 5])) for i in range(len(words) - 4)})
        sign = [min((x * s + y) % minhash.PRIME for s in shingles) if shingles else 0 for x, y in zip(a, b, strict=True)]
        assert rows[doc_id].shingles == shingles and rows[doc_id].signature == rows[doc_id].again == sign
        assert rows[doc_id].bands == [md32("|".join(map(str, sign[k * 5 : k * 5 + 5]))) for k in range(20)]
    assert {r.doc_id: r.class_id for r in minhash.classes(signed).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    pairs = minhash.candidate_pairs(signed).collect()
    assert all(r.a < r.b for r in pairs) and 2 not in {x for r in pairs for x in (r.a, r.b)}  # copies stay within their class


def test_exact_and_lsh_neighbours(spark, small):
    items = minhash.with_signatures(minhash.text_shingles(spark.read.parquet(f"{small}/documents.parquet"))).cache()
    asked = items.filter("doc_id % 20 = 0")
    sets = {r.doc_id: set(r.shingles) for r in items.collect()}
    exact = {(r.query, r.item): r.similarity for r in minhash.exact_top_k(items, asked, 10_000).collect()}
    want = {(q, i): len(sets[q] & sets[i]) / len(sets[q] | sets[i]) for q in sets if q % 20 == 0 for i in sets if i != q and sets[q] & sets[i]}
    assert exact == pytest.approx(want)
    found = {(r.query, r.item): r.similarity for r in minhash.lsh_top_k(items, asked, 10_000).collect() if sets[r.query] or sets[r.item]}
    assert all(want.get(k, 0) == pytest.approx(v) for k, v in found.items())
    near = {k for k, v in want.items() if v >= 0.8}
    assert len(near & found.keys()) >= 0.9 * len(near)


def test_states_keep_unknown_signals(spark):
    days = [("s", dt.date(2020, 1, 1) + dt.timedelta(k), "up" if k % 2 else None, k % 3) for k in range(25)]
    out = minhash.state_shingles(spark.createDataFrame(days, "symbol string, trade_date date, x string, y int"), ["x", "y"]).collect()
    assert len(out) == 6 and all(1 <= len(r.shingles) <= 19 for r in out)
    states = [f"{'NULL' if x is None else x}|{y}" for _, _, x, y in days[:20]]
    assert out[0].shingles == sorted({md32(f"{p} -> {q}") for p, q in zip(states, states[1:], strict=False)})


def test_empty_similar_has_the_schema(spark):
    signed = minhash.with_signatures(minhash.state_shingles(spark.createDataFrame([], "symbol string, trade_date date, x string"), ["x"]))
    out = minhash.similar_symbols(signed, F.lit("s"), F.lit("2020-01-01").cast("date"))
    assert out.count() == 0 and out.columns == ["query_date", "symbol", "trade_date", "bands_matched"]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), ([5.0, 5.0],)], "v array<double>")
    rows = df.select(vectors.unit(F.col("v")).alias("u"), vectors.z_scores(F.col("v")).alias("z"), vectors.dot(F.col("v"), F.array(F.lit(1.0), F.lit(2.0))).alias("d")).collect()
    assert [r.u for r in rows] == [[0.6, 0.8], [0.0, 0.0], [], pytest.approx([math.sqrt(0.5)] * 2)]
    assert [r.z for r in rows] == [[-1.0, 1.0], [0.0, 0.0], [], [0.0, 0.0]] and [r.d for r in rows] == [11.0, 0.0, None, 15.0]


def test_both_ways_of_bucketing_agree(spark):
    rng = np.random.default_rng(1)
    planes = vectors.hyperplanes(6, 20, 42)
    df = spark.createDataFrame([(rng.normal(size=6).tolist(),) for _ in range(30)], "v array<double>")
    for r in vectors.with_bit_buckets(df, planes, 5, "v").withColumnRenamed("band_buckets", "b").withColumn("a", vectors.bit_buckets(F.col("v"), planes, 5)).collect():
        bits = "".join("1" if x >= 0 else "0" for x in planes @ np.array(r.v))
        assert r.a == r.b == [f"{k}:{bits[5 * k : 5 * k + 5]}" for k in range(4)]


def test_exact_top_k_is_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.item_id for r in precedents.exact_top_k(df.filter("id % 20 = 0"), df, 4, block=17).collect()}
    for q in range(0, 90, 20):
        order = [i for i in np.argsort(-(x @ x[q])) if i != q][:4]
        assert [got[q, k + 1] for k in range(4)] == order


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("earlier", [False, True])
def test_bucket_top_k_is_brute_force(spark, monkeypatch, block, earlier):
    """One hot bucket, small ones and a vector that many items share, in blocks of any size."""
    monkeypatch.setattr(precedents, "BLOCK", block)
    rng = np.random.default_rng(4)
    vectors_ = [rng.normal(size=4).tolist() for _ in range(40)] + [[0.5, 0.5, 0.5, 0.5]] * 6
    rows = [(f"i{k:02}", dt.date(2020, 1, 1 + k % 9), v, ["hot", *([f"b{k % 5}"] if k % 2 else [])] if k % 7 else [f"b{k % 5}"], float(k), k % 2) for k, v in enumerate(vectors_)]
    df = spark.createDataFrame(rows, "id string, trade_date date, vector array<double>, band_buckets array<string>, fwd_return double, fwd_down int")
    got = {(r.query_id, r["rank"]): (r.item_id, r.fwd_return) for r in precedents.bucket_top_k(df.filter("fwd_down = 1"), df, 5, earlier=earlier, not_itself=True).collect()}
    want = {}
    for q in rows:
        if q[5] == 1:
            near = [(-sum(a * b for a, b in zip(q[2], x[2], strict=True)), x[0], x[4]) for x in rows if x[0] != q[0] and set(x[3]) & set(q[3]) and (not earlier or x[1] < q[1])]
            want |= {(q[0], k): (i, f) for k, (_, i, f) in enumerate(sorted(near)[:5], 1)}
    assert got == want


def test_top_k_of_sets_with_copies_and_empty_ones(spark):
    texts = {0: None, 1: "", 2: "too few", 20: "", 40: "a b c d e f", 3: "a b c d e f", 5: "a b c d e f g", 60: "a b c d e f g", 7: "h i j k l m n", 80: "x y z u v w"}
    items = minhash.with_signatures(minhash.text_shingles(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).cache()
    words = {k: (t or "").split() for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in words.items()}
    sim = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for found in (minhash.exact_top_k(items, items.filter("doc_id % 20 = 0"), 3), minhash.lsh_top_k(items, items.filter("doc_id % 20 = 0"), 3)):
        got = {(r.query, r["rank"]): (r.item, pytest.approx(r.similarity)) for r in found.collect()}
        want = {}
        for q in (0, 20, 40, 60, 80):
            near = sorted((-sim(sets[q], sets[i]), i) for i in texts if i != q and sim(sets[q], sets[i]) > 0)[:3]
            want |= {(q, k): (i, -s) for k, (s, i) in enumerate(near, 1)}
        assert got == want


def wilson(k, n, z=1.96):
    if not n:
        return 0.0, 0.0
    p = k / n
    mid, half, scale = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return max(0.0, (mid - half) / scale), min(1.0, (mid + half) / scale)


def test_wilson(spark):
    rows = [(0, 0), (0, 5), (5, 5), (3, 10), (1, 1)]
    df = spark.createDataFrame(rows, "k long, n long")
    low, high = precedents.wilson(F.col("k"), F.nullif(F.col("n"), F.lit(0)))
    got = df.select("k", "n", F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(high, F.lit(0.0)).alias("high")).collect()
    for r in got:
        assert (r.low, r.high) == pytest.approx(wilson(r.k, r.n))
        assert r.n == 0 or r.low <= r.k / r.n <= r.high + 1e-12


@pytest.mark.parametrize(
    ("lib", "tgt", "label", "agreement"),
    [((50, 0.5), (50, 0.4), "STRONG", "ALIGNED"), ((50, -0.3), (50, -0.2), "SAFE", "ALIGNED"), ((0, 0.0), (0, 0.0), "CAUTION", "NEUTRAL"), ((10, 0.1), (10, -0.1), "CAUTION", "CONFLICT"), ((0, 0.0), (40, 0.3), "STRONG", "NEUTRAL")],
)
def test_fusion(spark, lib, tgt, label, agreement):
    row = {}
    for side, (n, excess) in (("lib", lib), ("tgt", tgt)):
        low, high = wilson(round(n * 0.5), n)
        row |= {f"{side}_n": n, f"{side}_excess": excess, f"{side}_ci_low": low, f"{side}_ci_high": high, f"{side}_p_down": 0.5}
    r = precedents.fuse(spark.createDataFrame([row])).withColumn("reason", precedents.reason(None)).first()
    c = FusionConfig()
    risk = {s: min(100, max(0, 50 + 100 * row[f"{s}_excess"])) for s in ("lib", "tgt")}
    trust = {s: row[f"{s}_n"] / (row[f"{s}_n"] + 10) * (1 - (row[f"{s}_ci_high"] - row[f"{s}_ci_low"])) for s in ("lib", "tgt")}
    weight = trust["lib"] + c.target_priority * trust["tgt"]
    want = (trust["lib"] * risk["lib"] + c.target_priority * trust["tgt"] * risk["tgt"]) / weight if weight else 50
    assert r.risk_score == pytest.approx(want) and (r.label, r.agreement) == (label, agreement) and 0 <= r.confidence <= 1 and r.label in r.reason


def test_latest_pattern_is_as_of(spark):
    d = lambda k: dt.date(2020, 1, k)
    known = spark.createDataFrame([("a", d(3)), ("a", d(9)), ("b", d(5))], "symbol string, trade_date date")
    asked = spark.createDataFrame([("a", d(1)), ("a", d(3)), ("a", d(8)), ("a", d(20)), ("b", d(4)), ("c", d(9))], "symbol string, query_date date")
    got = {(r.symbol, r.query_date.day): r.pattern_date and r.pattern_date.day for r in patterns.latest_pattern(known, asked).collect()}
    assert got == {("a", 1): None, ("a", 3): 3, ("a", 8): 3, ("a", 20): 9, ("b", 4): None, ("c", 9): None}


def test_walk_forward_never_looks_ahead(spark, small):
    from tidemark.plans import similarity

    known = similarity.all_patterns(spark, small)
    index = precedents.simhash_index(known.filter("fwd_down IS NOT NULL AND market = 'tgt'"), similarity.PLANES)
    pairs = precedents.bucket_top_k(index, index, 5, earlier=True)
    assert pairs.count() and pairs.filter(F.substring_index("item_id", "|", -1) >= F.substring_index("query_id", "|", -1)).count() == 0
    norms = known.select(vectors.dot(F.col("vector"), F.col("vector")).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert norms[0] == pytest.approx(1) and norms[1] == pytest.approx(1)
