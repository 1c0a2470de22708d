"""Rows are told apart by id and text: unlike texts under a null or repeated id are documents of their own."""

import pytest

import corpus_pipeline
from tidemark.llm import digest_index, near_copies, soft_mixing

TEXTS = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey", "north south east west up down", "do re mi fa sol la si"]
IDS = [None, None, 1, 1, 2]
NONE = "doc_id long, quality int, toxic int"


def frame(spark, repeat=False):
    rows = [(i, t, "en", "s", len(t), 7, "x", 1) for i, t in zip(IDS, TEXTS, strict=True)]
    return spark.createDataFrame(rows * (2 if repeat else 1), "doc_id long, text string, lang string, source string, n_chars long, key int, text_hash string, digest int")


@pytest.mark.parametrize(
    "keep",
    [
        lambda spark, docs: digest_index.drop_duplicates(docs, digest_index.fresh_index(spark)),
        lambda spark, docs: near_copies.one_of_each(docs),
        lambda spark, docs: soft_mixing.resample(docs, spark.createDataFrame([], NONE), budget=None, max_rate=1.0, target_weights={"clean": 1, "low_quality": 1, "toxic": 1}),
    ],
)
def test_unlike_texts_all_stay_with_their_columns(spark, keep):
    docs = frame(spark)
    kept = keep(spark, docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


@pytest.mark.parametrize("keep", [lambda spark, docs: digest_index.drop_duplicates(docs, digest_index.fresh_index(spark)), lambda spark, docs: near_copies.one_of_each(docs)])
def test_of_repeated_rows_one_stays(spark, keep):
    assert sorted(r.text for r in keep(spark, frame(spark, repeat=True)).collect()) == sorted(TEXTS)


def test_stages_keep_them(spark, small):
    docs = frame(spark).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert sorted(r.text for r in stage(spark, docs, small).collect()) == sorted(TEXTS), name


def test_near_copies_of_one_id(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(3, " ".join(base)), (3, " ".join([*base[:-1], "x"])), (None, " ".join([*base[:-1], "y"])), (None, "another text of its own words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.one_of_each(df).collect()
    assert sorted((r.doc_id is None, r.text in (rows[0][1], rows[1][1])) for r in kept) == [(False, True), (True, False)]
    assert sorted(map(tuple, near_copies.near_copies(df).collect()), key=repr) == [(3, 3), (3, 3), (None, 3), (None, None)]
