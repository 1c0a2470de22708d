"""Equal histories are one in a search, and count as often as there are copies of them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import histories, precedents, streamed
from tidemark.plans import similarity
from tidemark.sources import scratch


def test_copies_of_items_count_as_items_of_their_own():
    rng = np.random.default_rng(4)
    names = {b"1": [b"1", b"11", b"4"], b"2": [b"2", b"3"], b"5": [b"5"], b"6": [b"6", b"7", b"8"]}
    v = np.repeat(rng.integers(-1, 2, (12, 3)).astype(float), 2, axis=0)  # many equal cosines
    asked, days = rng.integers(-1, 2, (30, 3)).astype(float), np.arange(30, dtype=np.int32) % 9

    def batch(expand):
        rows = []
        for i in range(24):
            s = [*names][i % 4]
            rows += [(f"{n.decode()}|{i:02}", i % 7, v[i].tolist(), float(i % 5), i % 2) for n in (names[s] if expand else [s])]
        ids, day, vector, ret, down = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(day, pa.int32()).cast(pa.date32()), pa.array(vector), pa.array(ret), pa.array(down, pa.int32())], ["id", "trade_date", "vector", "fwd_return", "fwd_down"])

    for earlier in (False, True):
        got = []
        for expand in (False, True):
            search = streamed.Search(asked, days, 5, None, 10, earlier)
            search.start()
            search.add(batch(expand))
            search.finish()
            got.append(search.summary({} if expand else names))
        assert (got[0][0] == got[1][0]).all() and got[0][0].max() == 5
        assert all(np.allclose(a, b, equal_nan=True) for a, b in zip(*got, strict=True))


@pytest.fixture(scope="module")
def copied(spark, small, tmp_path_factory):
    """The line items of the small scale three times, in suppliers of their own."""
    path = tmp_path_factory.mktemp("copied")
    items = spark.read.parquet(f"{small}/lineitem.parquet")
    copies = items.crossJoin(spark.range(3)).withColumns({"l_suppkey": F.col("l_suppkey") + 100 * F.col("id"), "l_orderkey": F.col("l_orderkey") + 10**6 * F.col("id")}).drop("id")
    copies.write.parquet(f"file://{path}/lineitem.parquet")
    return f"file://{path}"


def test_a_walk_reads_copies_once_and_answers_for_all(spark, copied, monkeypatch):
    written = {}

    def spy(df, label):
        out = scratch.materialize(df, label)
        written[label] = out.count()
        return out

    for module in (histories, similarity, streamed):
        monkeypatch.setattr(module, "materialize", spy)
    got = similarity.verdicts_walk_forward(spark, copied)
    assert 3 * written["distinct-histories"] == written["histories"] and 3 * written["summaries"] == got.count()
    known = similarity._Histories(spark, copied)
    want = precedents.backtest(known.patterns("tgt").filter("symbol % 100 < 4"), known.library(), known.figures, similarity.PLANES)
    want = {r.query_id: r for r in similarity.tidy(want, 6).collect()}
    got = {r.query_id: r for r in similarity.tidy(got, 6).filter("symbol % 100 < 4").collect()}
    assert set(got) == set(want) and len(got) > 100
    for key, r in got.items():
        assert all(r[c] == want[key][c] or r[c] == pytest.approx(want[key][c], abs=2e-6) for c in want[key].asDict())


def test_a_store_answers_questions_on_copies_once(spark, copied, tmp_path, monkeypatch):
    from tidemark.operators import serving

    store = similarity.build_store(spark, copied, f"file://{tmp_path}/store")
    questions = similarity._quarter_ends(spark, store.symbols().filter("symbol % 100 < 4"))
    written = {}

    def spy(df, label):
        out = scratch.materialize(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(serving, "materialize", spy)
    got = {(r.symbol, r.query_date): r for r in similarity.tidy(store.ask(questions)).collect()}
    assert written["named-questions"] == questions.count() == 3 * written["questions"] == len(got)
    plain = serving.PrecedentStore.open(spark, store.path)
    plain.once[plain.simhash.top_k] = (plain._stored(), None)
    want = {(r.symbol, r.query_date): r for r in similarity.tidy(plain.ask(questions)).collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        assert all(r[c] == want[key][c] or r[c] == pytest.approx(want[key][c], abs=2e-4) for c in want[key].asDict())
