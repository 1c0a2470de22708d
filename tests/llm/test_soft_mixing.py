import numpy as np
import pytest

from tidemark.llm import soft_mixing as M


def plain_rates(p, tokens, targets, max_rate, penalty, steps):
    w = tokens / tokens.sum()
    r = np.ones(len(p))
    present = np.maximum(w @ p, 1e-6)
    for g in steps:
        slope = p @ np.array(g) + penalty * (r - 1)
        r = np.clip(r - slope / (1 + penalty), 0, np.inf if max_rate is None else max_rate)
    return r, present


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet((0.6, 0.2, 0.2), 500)
    tokens = rng.integers(0, 900, 500)
    return p, tokens, spark.createDataFrame([(k, int(t), *map(float, q)) for k, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n_tokens long, p_clean double, p_low_quality double, p_toxic double").cache()


def test_totals_match_targets(table):
    p, tokens, df = table
    names = [f"p_{d}" for d in M.DOMAINS]
    target = {"clean": 0.9, "low_quality": 0.07, "toxic": 0.03}
    rates = M.fit_rates(df, target, budget=1.2, iterations=200)
    r = np.array([x.r for x in df.withColumn("r", rates.column(names)).orderBy("doc_id").collect()])
    totals = (tokens * r) @ p / tokens.sum()
    assert r.min() >= 0 and np.abs(totals - 1.2 * np.array(list(target.values()))).max() < 2e-3
    again, _ = plain_rates(p, tokens, target, None, 1e-3, rates.steps)
    assert np.allclose(again, r)


def test_capped_rates(table):
    p, tokens, df = table
    rates = M.fit_rates(df, {"clean": 0.95, "low_quality": 0.04, "toxic": 0.01}, max_rate=1.0)
    rows = df.withColumn("r", rates.column([f"p_{d}" for d in M.DOMAINS])).collect()
    assert all(0 <= x.r <= 1 for x in rows)
    assert min(x.r for x in rows if x.p_clean > 0.97) == 1.0


def test_mix_on_documents(spark, small):
    sf = small.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in M.mix(docs, labels).collect()}
    assert len(rows) == docs.count()
    right = [(M.DOMAINS[int(np.argmax([rows[x.doc_id][f"p_{d}"] for d in M.DOMAINS]))]) == ("toxic" if x.toxic else "clean" if x.quality else "low_quality") for x in labels.collect()]
    assert np.mean(right) > 0.97
    total = sum(r.n_tokens for r in rows.values())
    for d, share in M.TARGETS.items():
        assert abs(sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rows.values()) / total - share) < 2e-3
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows.values())


def test_posteriors_are_brute_force(spark, small):
    """Every document's posterior from the weights, word by word."""
    import math
    import re

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = M.learn_domains(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in M.posterior_table(docs, model).collect():
        text = texts[r.doc_id]
        size, tokens = max(1, len(text.encode())), len(re.findall(r"[^\x20\x09-\x0D]+", text))
        distinct = {w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w}
        share = lambda kind, text=text, size=size: len(re.findall(kind, text)) / size
        shapes = [math.log1p(tokens), size / max(1, tokens), share("[#*$%&|<>]"), share("[A-Z]"), share("!"), share("[0-9]"), len(distinct) / max(1, tokens), len(distinct) / max(1, tokens**0.8)]
        z = []
        for d in range(3):
            total = model.weights[0, d] + sum(model.weights[1 + k, d] * (s - model.mean[k]) / model.scale[k] for k, s in enumerate(shapes))
            z.append(total + sum(model.weights[1 + M.N_SHAPES + model.lexicon[w.encode()], d] for w in distinct if w.encode() in model.lexicon))
        p = [math.exp(x - max(z)) for x in z]
        assert [r[f"p_{d}"] for d in M.DOMAINS] == pytest.approx([x / sum(p) for x in p], abs=1e-9) and r.n_tokens == tokens


def test_regression_is_where_its_gradient_vanishes():
    rng = np.random.default_rng(12)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 3))])
    y = (x[:, 1] > 0.3).astype(int) + (x[:, 2] > 1)
    w = M._softmax_regression(x, y, 3, steps=4000)
    p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.abs(x.T @ (p - np.eye(3)[y]) / len(x) + 1e-3 * w).max() < 1e-3


def test_rates_that_do_not_come_to_rest_raise(table):
    _, _, df = table
    with pytest.raises(RuntimeError):
        M.fit_rates(df, {"clean": 0.9, "low_quality": 0.07, "toxic": 0.03}, budget=1.2, iterations=3)
    found = M.fit_rates(df, {"clean": 0.98, "low_quality": 0.01, "toxic": 0.01}, max_rate=1.0)
    assert found.residuals[0] < -1e-3 and max(map(abs, found.residuals)) < 1  # there is not that much clean text


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0.0), (1, "", 0.0), (None, "x", 0.0), (2, "word " * 30000, 0.0)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = M.mix(df, none).collect()
    assert len(got) == 4 and all(abs(r.p_toxic - 1 / 3) < 1e-9 for r in got)
    assert M.mix(df.limit(0), none).count() == 0
    some = spark.createDataFrame([(2, 1, None), (1, None, 1), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert M.mix(df, some).count() == 4
    assert M.resample(df, some, max_rate=1.0).columns == df.columns
    assert M.resample(df, some, budget=3.0).count() >= 1
    with pytest.raises(ValueError):
        M.fit_rates(df, {"clean": 1.0})


def test_arrays_fold_as_the_column_and_iterations_plan_no_growing_expression(table, monkeypatch):
    """A fit of hundreds of steps used to analyse and compile a longer expression at each of them."""
    p, tokens, df = table
    names = [f"p_{d}" for d in M.DOMAINS]
    column, asked = M.Rates.column, []
    monkeypatch.setattr(M.Rates, "column", lambda self, names: asked.append(len(self.steps)) or column(self, names))
    for max_rate in (None, 1.0):
        rates = M.fit_rates(df, {"clean": 0.9, "low_quality": 0.07, "toxic": 0.03}, budget=None, max_rate=max_rate)
        assert len(rates.steps) > 5 and not asked
        rows = rates.rated(df, names).withColumn("r", column(rates, names)).collect()
        assert len(rows) == len(p) and all(x.rate == x.r for x in rows)
        plain = (tokens * rates.of(list(p.T))) @ p
        assert np.allclose(rates.totals(df, names), plain, rtol=1e-12)
    unfitted = M.Rates((), 1.0, 1e-3, None)
    assert {x.rate for x in unfitted.rated(df, names).collect()} == {1.0}
