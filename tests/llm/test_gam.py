import zlib

import numpy as np
import pytest

from tidemark.llm import gam as G


def test_learns_steps_and_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair tells
    model = G.fit(x[:4000], y[:4000])
    assert any({a, b} == {0, 1} for a, b, *_ in model.pairs)
    assert ((model.score(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.95
    y = (x[:, 2] > 0.3).astype(float)
    assert ((G.fit(x[:4000], y[:4000]).score(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.98


def plain_tree(g, h, leaves, ridge):
    """All cuts of all parts tried, one after the other."""
    worth = lambda lo, hi: sum(g[lo:hi]) ** 2 / (sum(h[lo:hi]) + ridge)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(worth(lo, c) + worth(c, hi) - worth(lo, hi), lo, hi, c) for lo, hi in parts for c in range(lo + 1, hi)]
        if not options or max(options)[0] <= 1e-12:
            break
        _, lo, hi, c = max(options, key=lambda o: o[0])
        parts.remove((lo, hi))
        parts += [(lo, c), (c, hi)]
    out = [0.0] * len(g)
    for lo, hi in parts:
        out[lo:hi] = [sum(g[lo:hi]) / (sum(h[lo:hi]) + ridge)] * (hi - lo)
    return out


def plain_fit(x, y, bins, rounds, rate, leaves, pair_bins, pair_rounds, n_pairs, ridge=1.0):
    """The raw scores of the rows, boosted row by row and cut by cut."""
    n, m = x.shape
    at = lambda j, b: [sum(v >= e for e in sorted(set(np.quantile(x[:, j], np.linspace(0, 1, b + 1)[1:-1]).tolist()))) for v in x[:, j]]
    share = (sum(y) + 1) / (n + 2)
    raw = [float(np.log(share / (1 - share)))] * n
    p = lambda: [1 / (1 + np.exp(-r)) for r in raw]
    fine, coarse = [at(j, bins) for j in range(m)], [at(j, pair_bins) for j in range(m)]
    for _ in range(rounds):
        for j in range(m):
            now, size = p(), max(fine[j]) + 1
            size = len(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) + 1
            g, h = [0.0] * size, [0.0] * size
            for i in range(n):
                g[fine[j][i]] += y[i] - now[i]
                h[fine[j][i]] += now[i] * (1 - now[i])
            step = plain_tree(g, h, leaves, ridge)
            raw = [raw[i] + rate * step[fine[j][i]] for i in range(n)]

    def quadrants(a, b, now):
        best = (0.0, None)
        for s in range(1, max(coarse[a]) + 1):
            for t in range(1, max(coarse[b]) + 1):
                sums = {}
                for i in range(n):
                    key = coarse[a][i] >= s, coarse[b][i] >= t
                    g, h = sums.get(key, (0.0, 0.0))
                    sums[key] = g + y[i] - now[i], h + now[i] * (1 - now[i])
                whole = sum(g for g, _ in sums.values()) ** 2 / (sum(h for _, h in sums.values()) + ridge)
                gain = sum(g**2 / (h + ridge) for g, h in sums.values()) - whole
                if best[1] is None or gain > best[0] + 1e-12:
                    best = gain, {k: g / (h + ridge) for k, (g, h) in sums.items()} | {"cut": (s, t)}
        return best

    now = p()
    every = sorted(((quadrants(a, b, now)[0], a, b) for a in range(m) for b in range(a)), key=lambda t: (-t[0], t[1:]))
    for _ in range(pair_rounds):
        for _, a, b in [e for e in every[:n_pairs] if e[0] > 1e-6]:
            _, values = quadrants(a, b, p())
            s, t = values["cut"]
            raw = [raw[i] + rate * values.get((coarse[a][i] >= s, coarse[b][i] >= t), 0.0) for i in range(n)]
    return raw


def test_fit_is_brute_force():
    rng = np.random.default_rng(6)
    x = rng.random((60, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4) ^ (rng.random(60) < 0.1)).astype(float)
    settings = {"bins": 6, "rounds": 4, "rate": 0.3, "leaves": 3, "pair_bins": 4, "pair_rounds": 3, "n_pairs": 2}
    assert G.fit(x, y, **settings).raw(x) == pytest.approx(plain_fit(x, y.tolist(), **settings))


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x, y = rng.random((500, 3)), (rng.random(500) > 0.5).astype(float)
    model = G.fit(x, y, rounds=5, pair_rounds=5)
    for row in x[:20]:
        total = model.bias + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(t[np.searchsorted(ea, row[a], "right"), np.searchsorted(eb, row[b], "right")] for a, b, ea, eb, t in model.pairs)
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_no_labels_or_one_class():
    assert G.fit(np.empty((0, 3)), np.empty(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert G.fit(np.zeros((8, 3)), np.ones(8)).score(np.zeros((1, 3)))[0] == pytest.approx(0.9)


def test_held_out_accuracy(spark, small):
    sf = small.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in G.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    judged = [(r.quality, rows[r.doc_id].score) for r in labels.collect() if rows[r.doc_id].held_out]
    accuracy = np.mean([(s >= 0.5) == q for q, s in judged])
    good, bad = [s for q, s in judged if q == 1], [s for q, s in judged if q == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert accuracy > 0.97 and auc > 0.98, (accuracy, auc)


def test_odd_rows(spark):
    rows = [(1, None, 1.0), (1, "", 1.0), (None, "x", 1.0), (2, "word " * 30000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = G.classify(df, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    labels = spark.createDataFrame([(2, 0), (2, 1), (None, 1), (1, None), (77, 1)], "doc_id long, quality int")
    assert G.classify(df, labels).count() == 4 and G.classify(df.limit(0), labels).count() == 0
