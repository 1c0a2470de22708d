"""Windows that stream past give what stored signatures give."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import minhash
from tidemark.plans import similarity
from tidemark.plans.indicators import KEYS, featured_bars
from tidemark.plans.kit import tidy
from tidemark.schema import SIGNALS
from tidemark.sources import scratch


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_streamed_windows_are_the_stored_ones_and_no_window_is_written(spark, scale, monkeypatch):
    path, written = f"/root/testdata/{scale}", []
    daily = scratch.materialize(featured_bars(spark, path).select(*KEYS, "close", "next_3d_label", *SIGNALS), "daily")
    signed = scratch.materialize(minhash.with_signatures(minhash.state_shingles(daily, list(SIGNALS))), "signed")
    asked = signed.filter("symbol % 4 = 0").groupBy("symbol").agg(F.max("trade_date").alias("query_date"))
    asked = asked.unionByName(asked.withColumn("query_date", F.date_sub("query_date", 300)))
    want = sorted(map(tuple, tidy(minhash.similar_windows(signed, asked, daily, 4)).collect()))

    def spy(df, label):
        written.append(df.columns)
        return scratch.materialize(df, label)

    monkeypatch.setattr(minhash, "materialize", spy)
    monkeypatch.setattr(similarity, "materialize", spy)
    for at_once, waiting in ((1 << 16, 1 << 20), (2, 3)):
        monkeypatch.setattr(minhash, "AT_ONCE", at_once)
        monkeypatch.setattr(minhash, "WAITING", waiting)
        found = minhash.streamed_windows(minhash.state_histories(daily, list(SIGNALS)), asked, daily, 4)
        assert sorted(map(tuple, tidy(found).collect())) == want and len(want) > 10
    assert similarity.query_similar(spark, path).count()
    assert not any({"signature", "shingles"} & set(c) for c in written)
