"""Exact quantiles by brackets against ``percentile``, and that no buffer holds a column."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import precedents, quality

SHARES = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("margin", [quality.MARGIN, 1e-9, 1.0])
def test_quantiles_are_exact(spark, margin, monkeypatch):
    df = spark.range(30_000).select(
        (F.col("id") % 3).alias("g"), F.rand(1).alias("x"), F.floor(F.rand(2) * 4).alias("ties"), F.when(F.col("id") % 7 > 0, F.randn(3)).alias("gaps"), F.lit(None).cast("double").alias("none"),
    ).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS g, CAST(7 AS DOUBLE) AS x, CAST(1 AS BIGINT) AS ties, CAST(NULL AS DOUBLE) AS gaps, CAST(NULL AS DOUBLE) AS none"))
    monkeypatch.setattr(quality, "SKETCH", 100)  # coarse, so that narrow brackets miss
    names = ["x", "ties", "gaps"]
    found = {(r.g, r.name): r.q for r in quality.quantiles(df, {c: F.col(c) for c in [*names, "none"]}, SHARES, ("g",), margin).collect()}
    want = {(r.g, c): r[c] for r in df.groupBy("g").agg(*[F.percentile(c, SHARES).alias(c) for c in names]).collect() for c in names if r[c]}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-15) for k in want)


def test_no_column_is_held_in_a_buffer(spark):
    df = spark.range(1000).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.lit("lib").alias("market"), F.rand(3).alias("fwd_return"), F.lit(1).alias("fwd_down"))
    for made in (quality.outliers(df, ["a"], exact=True), quality.binned_means(df, "a", "b"), precedents.distribution(df)):
        assert "percentile(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert quality.binned_means(df.filter("a > 2"), "a", "b").collect() == []
