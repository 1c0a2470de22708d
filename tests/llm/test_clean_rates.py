import pytest

from tidemark.llm import soft_mixing as M


@pytest.mark.parametrize("clean", [50, 94, 99, 100])
def test_clean_documents_keep_rate_one_whatever_their_share(spark, clean):
    rows = [(k, 10, *((1.0, 0.0, 0.0) if k < clean else (0.0, 0.5, 0.5))) for k in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_clean double, p_low_quality double, p_toxic double")
    names = [f"p_{d}" for d in M.DOMAINS]
    found = table.withColumn("r", M.fit_rates(table, M.TARGETS, budget=None, max_rate=1.0).column(names)).collect()
    assert all(r.r == pytest.approx(1) for r in found if r.p_clean)
    rest = sum(r.r for r in found if not r.p_clean)
    assert rest == pytest.approx(min(100 - clean, clean * 0.06 / 0.94), abs=0.05)
