import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tidemark.llm import gam
from tidemark.llm.text_features import FEATURES, with_counts, with_features

from .test_digest_index import brute as brute_digests
from .test_near_copies import brute_kept


@pytest.fixture(scope="module")
def stages(spark, small):
    """The rows that enter and leave each stage."""
    sf = small.replace("0.001", "0.01")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES:
        found = stage(spark, docs, sf).cache()
        out.append((name, docs.collect(), found.columns, found.collect()))
        docs = found
    return sf, out


def test_columns(stages):
    for _, _, columns, _ in stages[1][:-1]:
        assert columns == list(P.COLUMNS)


def test_quality_stage(spark, stages):
    sf, ((_, rows, _, kept), *_) = stages
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = gam.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    features = {r.doc_id: [r[f] for f in FEATURES] for r in with_features(with_counts(docs)).collect()}
    good = {r.doc_id for r in rows if model.score(np.array([features[r.doc_id]]))[0] >= 0.5}
    assert {r.doc_id for r in kept} == good and set(kept) <= set(rows)


def test_exact_stage(stages):
    _, rows, _, kept = stages[1][1]
    want = {i for i, _, _, stays, _ in brute_digests([(r.doc_id, r.text) for r in rows]) if stays}
    assert {r.doc_id for r in kept} == want and set(kept) <= set(rows) and len(kept) == len(want)


def test_near_stage(stages):
    _, rows, _, kept = stages[1][2]
    want, _ = brute_kept([(r.doc_id, r.text) for r in rows])
    assert {r.doc_id for r in kept} == want and set(kept) <= set(rows) and len(kept) == len(want)


def test_mixing_stage(spark, stages):
    sf, out = stages
    _, rows, _, kept = out[3]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept}
    assert set(kept) <= set(rows) and len(ids) == len(kept)
    share = lambda toxic: np.mean([r.doc_id in ids for r in rows if r.doc_id in labels and labels[r.doc_id].toxic == toxic and labels[r.doc_id].quality == 1])
    assert share(0) > 0.97 and share(1) < 0.5


def test_packing_stage(stages):
    _, rows, _, pieces = stages[1][4]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {r.doc_id for r in rows}
    for r in rows:
        ids = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_run(spark, stages):
    sf, out = stages
    assert P.run(spark, sf).count() > 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 40000, "xx", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            before = docs
            docs = stage(spark, docs, sf)
            if stage is not P.pack:
                assert set(docs.collect()) <= set(before.collect()) and docs.columns == list(P.COLUMNS)
        assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in P.exact_dedup(spark, odd, sf).collect()} == {1, 2}  # a null text is empty
    assert {r.doc_id for r in P.simhash_near_dedup(spark, odd, sf).collect()} == {1, 2}
