import numpy as np
import pytest

from tidemark.llm import gam, text_features

PLAIN = "some words of a plain text in which there is little to see"


def test_shares_of_capitals_and_digits(spark):
    df = spark.createDataFrame([(1, "AB c1 É\n99"), (2, None), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: (r.upper_share, r.digit_share) for r in text_features.with_features(text_features.with_counts(df)).collect()}
    assert got == {1: (pytest.approx(2 / 7), pytest.approx(3 / 7)), 2: (0, 0), 3: (0, 0)}


@pytest.mark.parametrize("spoil", [str.upper, lambda t: "".join(c if c == " " else str(ord(c) % 10) for c in t)])
def test_bad_by_capitals_or_digits_alone(spark, spoil):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        text = " ".join(rng.choice(PLAIN.split(), 30, replace=True))
        rows.append((k, spoil(text) if k % 2 else text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(300)], "doc_id long, quality int")
    kept = {r.doc_id for r in gam.keep_good(docs, labels).collect()}
    assert kept == {k for k in range(400) if k % 2 == 0}
