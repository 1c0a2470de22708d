"""The stored index, the command line, and reports and models that outlive a session."""

import datetime as dt
import json

import numpy as np
import pytest

import tidemark
from tidemark import __main__ as cli
from tidemark.functions import vectors
from tidemark.operators import clustering
from tidemark.operators.serving import PrecedentStore
from tidemark.sources import remote, reports

PLANES = vectors.hyperplanes(4, 120, 42)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(120):
        v = rng.normal(size=4)
        market, day = ("lib", dt.date(1998, 1, 1)) if k < 60 else ("tgt", dt.date(2000, 1, 1))
        at = day + dt.timedelta(k % 30)
        ret = float(rng.normal()) if k % 9 else None
        rows.append((f"{k % 3}|{market}|{at}|{k}", k % 3, market, at, 10.0 + k, ret, None if ret is None else int(ret < 0), (v / np.linalg.norm(v)).tolist()))
    rows = list({(r[1], r[2], r[3]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "id string, symbol long, market string, trade_date date, close double, fwd_return double, fwd_down int, vector array<double>")
    path = f"file://{tmp_path_factory.mktemp('store')}/index"
    PrecedentStore.build(df, PLANES, path)
    return rows, PrecedentStore.open(spark, path)


def test_answers_are_those_of_a_plain_search(spark, store):
    rows, found = store
    assert np.array_equal(found.planes, PLANES) and {r.symbol for r in found.symbols().collect()} == {0, 1, 2}
    assert found.dates(1).count() == sum(r[1] == 1 and r[2] == "tgt" for r in rows) and found.base_rates().count() == 2
    asked = [(0, dt.date(2000, 1, 20)), (1, dt.date(2010, 1, 1)), (2, dt.date(1990, 1, 1)), (9, dt.date(2010, 1, 1))]
    questions = spark.createDataFrame(asked, "symbol long, query_date date")
    got = {r.symbol: r for r in found.ask(questions, 5).collect()}
    near = {side: found.neighbours(questions, side, 5).collect() for side in ("lib", "tgt")}
    assert set(got) == {0, 1}  # no pattern before that day, no such symbol
    for symbol, day in asked[:2]:
        mine = max((r for r in rows if r[1] == symbol and r[2] == "tgt" and r[3] <= day), key=lambda r: r[3])
        r = got[symbol]
        assert (r.pattern_date, r.close) == (mine[3], mine[4]) and r.label in r.reason
        for side in ("lib", "tgt"):
            bits = lambda v: [tuple(b) for b in (PLANES @ np.array(v) >= 0).reshape(12, 10)]
            meets = lambda x: side == "tgt" or any(a == b for a, b in zip(bits(x[7]), bits(mine[7]), strict=True))
            known = [x for x in rows if x[2] == side and x[5] is not None and (side == "lib" or x[3] < mine[3]) and meets(x)]
            best = sorted(known, key=lambda x: (-float(np.dot(x[7], mine[7])), x[0]))[:5]
            assert [n.item_id for n in sorted((n for n in near[side] if n.symbol == symbol), key=lambda n: n["rank"])] == [x[0] for x in best]
            assert r[f"{side}_n"] == len(best) and (not best or r[f"{side}_mean_return"] == pytest.approx(np.mean([x[5] for x in best])))
    shape = {r.symbol: r.shape for r in found.shapes(questions, 3).collect()}
    assert all(len(s) == 3 for s in shape.values())


def test_command_line(spark, small, store, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "risk_fusion" in capsys.readouterr().out
    out = f"file://{tmp_path}/out"
    assert cli.main(["run", "bars_daily", "--data", small, "--out", out, "--format", "json"]) == 0
    assert spark.read.json(out).count() == tidemark.QUERIES["bars_daily"](spark, small).count()
    assert cli.main(["time", "bars_daily", "metadata", "--data", small, "--runs", "2"]) == 0
    rows = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [r["query"] for r in rows] == ["bars_daily", "metadata"] and rows[0]["speedup"] == 1.0 and all(0 < r["median_s"] <= r["p95_s"] for r in rows)
    assert cli.main(["ask", store[1].path, "0", "2000-01-20", "--neighbours", "3"]) == 0 and "risk" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query", "--data", small])


def test_reports_schemas_models_and_kept_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a,b"), (2, None, None)], "id long, v array<double>, t string")
    reports.write_report(df, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/csv").orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", "[1.0,2.0]", "a,b"), ("2", None, None)]
    with pytest.raises(ValueError):
        reports.write_report(df, f"file://{tmp_path}/x", "xml")
    reports.write_schema(spark, df.schema, f"file://{tmp_path}/schema")
    assert reports.read_schema(spark, f"file://{tmp_path}/schema") == df.schema and spark.read.text(f"file://{tmp_path}/schema/text").count() == 3
    points = clustering.from_array(spark.createDataFrame([(k, [float(k % 2), float(k % 2)]) for k in range(10)], "id long, v array<double>"), "v")
    for model in (clustering.kmeans(points, 2), clustering.pca_pipeline(1).fit(points)):
        reports.save_model(model, f"file://{tmp_path}/model")
        again = reports.load_model(f"file://{tmp_path}/model")
        column = "cluster_id" if "cluster_id" in model.transform(points).columns else "pcs"
        assert [r[0] for r in again.transform(points).orderBy("id").select(column).collect()] == [r[0] for r in model.transform(points).orderBy("id").select(column).collect()]
    built = []
    for _ in range(2):
        assert reports.kept(spark, f"file://{tmp_path}/kept", lambda: built.append(1) or spark.range(3).toDF("x")).count() == 3
    assert built == [1]


def test_top_loadings_are_a_text(spark):
    found = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", -0.25, 2), (1, "c", 0.1, 3)], "pc int, feature string, loading double, rank int")
    assert clustering.top_loadings(found, 2).first().features == "a (+0.500), b (-0.250)"


def test_a_crawl_goes_on_after_a_symbol_that_fails():
    waits, calls = [], {}

    def fetch(symbol):
        calls[symbol] = calls.get(symbol, 0) + 1
        if symbol == "BAD" or symbol == "SLOW" and calls[symbol] < 3:
            raise OSError("no answer")
        return [(symbol, 1)]

    rows, failed = remote.crawl(["A", "BAD", "SLOW", "A"], fetch, attempts=3, sleep=waits.append)
    assert rows == {"A": [("A", 1)], "SLOW": [("SLOW", 1)]} and failed == {"BAD": "OSError: no answer"} and calls["BAD"] == 3


def test_similar_windows_for_many_questions(spark):
    from tidemark.operators import minhash

    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(25)]
    daily = spark.createDataFrame([(s, d, f"s{(k + (0 if s < 3 else k * s)) % 4}", float(s)) for s in range(5) for k, d in enumerate(days)], "symbol long, trade_date date, x string, close double")
    signed = minhash.with_signatures(minhash.state_shingles(daily, ["x"]))
    questions = spark.createDataFrame([(0, days[-1]), (4, days[-2]), (0, days[0])], "symbol long, query_date date")
    got = minhash.similar_windows(signed, questions, daily, 2).collect()
    assert {(r.query_symbol, r.query_date) for r in got} >= {(0, days[-1])} and all(r.query_symbol != r.symbol and r.close == float(r.symbol) for r in got)
    first = {(r.query_symbol, r["rank"]): (r.symbol, r.bands_matched) for r in got if r.query_symbol == 0}
    assert first[0, 1] == (1, 20) and first[0, 2] == (2, 20)  # the same states
    assert got and "x" in got[0].asDict()


def test_a_store_of_histories_writes_no_pattern_and_answers_as_one_of_patterns(spark, small, tmp_path):
    from tidemark.plans import similarity

    kept = similarity.build_store(spark, small, f"file://{tmp_path}/histories")
    full = PrecedentStore.build(similarity.all_patterns(spark, small), similarity.PLANES, f"file://{tmp_path}/patterns")
    written = {p.name for p in (tmp_path / "histories").iterdir()}
    assert "histories" in written and "patterns" not in written
    assert not {"vector", "band_buckets"} & set(spark.read.parquet(f"file://{tmp_path}/histories/histories").columns)
    days = [dt.date(1990, 1, 1), dt.date(1999, 3, 31), dt.date(2000, 6, 30), dt.date(2010, 1, 1), None]
    symbols = [r.symbol for r in full.symbols().collect()]
    assert {r.symbol for r in kept.symbols().collect()} == set(symbols)
    assert sorted(map(tuple, kept.dates().collect())) == sorted(map(tuple, full.dates().collect()))
    questions = spark.createDataFrame([(s, d) for s in [*symbols, -1] for d in days], "symbol long, query_date date")
    shapes = [{(r.symbol, r.query_date): (r.pattern_date, r.shape) for r in x.shapes(questions).collect()} for x in (kept, full)]
    assert set(shapes[0]) == set(shapes[1]) and len(shapes[0]) >= 2 * len(symbols)
    assert all(shapes[0][k][0] == d and np.allclose(shapes[0][k][1], v, rtol=0, atol=1e-12) for k, (d, v) in shapes[1].items())
    answers = [{(r.symbol, r.query_date): r for r in similarity.tidy(x.ask(questions)).collect()} for x in (kept, full)]
    assert set(answers[0]) == set(answers[1]) == set(shapes[1])
    for key, r in answers[0].items():
        assert all(r[c] == x or r[c] == pytest.approx(x, abs=2e-4) for c, x in answers[1][key].asDict().items())


@pytest.mark.parametrize("name", ["served_dates", "served_shapes", "served_alerts"])
def test_served_queries_store_no_pattern(spark, small, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("patterns are stored")

    monkeypatch.setattr(PrecedentStore, "build", refuse)
    df = tidemark.QUERIES[name](spark, small)
    assert df.count() and "band_buckets" not in df._jdf.queryExecution().toString()


def test_a_store_holds_closes_and_volumes_only(spark, small, tmp_path):
    from tidemark.plans import similarity

    similarity.build_store(spark, small, f"file://{tmp_path}/lean")
    assert spark.read.parquet(f"file://{tmp_path}/lean/histories").columns == ["symbol", "trade_date", "close", "volume"]
