import datetime as dt
import itertools

import numpy as np
import pytest

from tidemark.operators import clustering, graph, portfolio

EDGES = [(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.7), (3, 4, 0.6), (4, 5, 0.9), (3, 5, 0.5), (2, 3, 0.1)]


@pytest.fixture(scope="module")
def small_graph(spark):
    return spark.createDataFrame([(k,) for k in range(7)], "symbol long"), spark.createDataFrame(EDGES, "src long, dst long, weight double")


def dense_pagerank(n, edges, alpha=0.85):
    a = np.zeros((n, n))
    for s, d, w in edges:
        a[s, d] += w
        a[d, s] += w
    out = a.sum(1)
    m = np.where(out[:, None] > 0, a / np.where(out > 0, out, 1)[:, None], 1 / n)
    x = np.full(n, 1 / n)
    for _ in range(500):
        x = alpha * (x @ m) + (1 - alpha) / n
    return x


def test_pagerank_in_place_and_by_joins(spark, small_graph, monkeypatch):
    nodes, links = small_graph
    want = dense_pagerank(7, EDGES)
    for limit, tolerance in ((graph.SMALL, 1e-12), (0, 1e-7)):
        monkeypatch.setattr(graph, "SMALL", limit)
        rows = graph.pagerank(nodes, links, tolerance=tolerance).collect()
        assert sum(r.pagerank_score for r in rows) == pytest.approx(1)
        assert [r.pagerank_score for r in sorted(rows, key=lambda r: r.symbol)] == pytest.approx(want, abs=1e-5)
        assert sorted(r["rank"] for r in rows) == list(range(1, 8))


def modularity(n, edges, label):
    m, strength = sum(w for *_, w in edges), [0.0] * n
    for a, b, w in edges:
        strength[a] += w
        strength[b] += w
    inside = sum(w for a, b, w in edges if label[a] == label[b]) / m
    return inside - sum((sum(strength[k] for k in range(n) if label[k] == c) / (2 * m)) ** 2 for c in set(label))


def plain_louvain(n, edges):
    """Nodes one after the other, each to its best community, while any moves; then communities as nodes."""
    member, near = list(range(n)), {}
    for a, b, w in edges:
        near[a, b] = near.get((a, b), 0.0) + w
        near[b, a] = near.get((b, a), 0.0) + w
    twice = sum(near.values())
    while True:
        ids = sorted({a for a, _ in near})
        label, k = {i: i for i in ids}, {i: sum(w for (a, _), w in near.items() if a == i) for i in ids}
        moved_ever = moving = True
        while moving:
            moving = False
            for i in ids:
                to = {label[i]: 0.0}
                for (a, b), w in near.items():
                    if a == i and b != i:
                        to[label[b]] = to.get(label[b], 0.0) + w
                gain = {c: w - k[i] * sum(k[j] for j in ids if label[j] == c and j != i) / twice for c, w in to.items()}
                best = max(gain, key=lambda c: (round(gain[c], 12), -c))
                if gain[best] > gain[label[i]] + 1e-12:
                    label[i], moving = best, True
        moved_ever = any(label[i] != i for i in ids)
        if not moved_ever:
            return member
        member = [label.get(m, m) for m in member]
        merged = {}
        for (a, b), w in near.items():
            merged[label[a], label[b]] = merged.get((label[a], label[b]), 0.0) + w
        near = merged


def test_communities_and_modularity(spark, small_graph):
    nodes, links = small_graph
    found = graph.communities(nodes, links)
    got = {r.symbol: r.community_id for r in found.collect()}
    assert got[0] == got[1] == got[2] and got[3] == got[4] == got[5] != got[0] and got[6] == 6
    assert {r.detection_method for r in found.collect()} == {"louvain"}
    assert {r.symbol: r.community_size for r in found.collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 1}
    assert graph.modularity(links, found).first().modularity == pytest.approx(modularity(7, EDGES, [got[k] for k in range(7)]))


@pytest.mark.parametrize("kind", ["planted", "star", "chain"])
def test_communities_are_as_good_as_those_of_one_node_at_a_time(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "planted":
        edges = [(a, b, 1.0) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.6 if a % 4 == b % 4 else 0.05)]
    else:
        edges = [(0, k, 1.0) for k in range(1, 40)] if kind == "star" else [(k, k + 1, 1.0) for k in range(39)]
    nodes, links = spark.range(40).withColumnRenamed("id", "symbol"), spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {r.symbol: r.community_id for r in graph.communities(nodes, links).collect()}
    label = [got[k] for k in range(40)]
    assert all(min(j for j in range(40) if label[j] == c) == c for c in label)
    assert modularity(40, edges, label) >= modularity(40, edges, plain_louvain(40, edges)) - 0.02
    if kind == "planted":
        assert len(set(label)) == 4 and all(label[k] == label[k % 4] for k in range(40))


def test_components_degrees_and_empty_graph(spark, small_graph):
    nodes, links = small_graph
    assert {r.symbol: r.component for r in graph.components(nodes, links).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6}
    assert {r.symbol: r.degree for r in graph.degrees(nodes, links).collect()}[6] == 0
    none = links.limit(0)
    assert [r.pagerank_score for r in graph.pagerank(nodes, none).collect()] == pytest.approx([1 / 7] * 7)
    assert graph.communities(nodes, none).filter("community_size = 1").count() == 7
    assert graph.modularity(none, nodes.withColumn("community_id", nodes.symbol)).first().modularity is None


def test_correlations_with_gaps_and_constants(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(60)]
    x = rng.normal(size=60)
    rows = [("a", d, float(v)) for d, v in zip(days, x, strict=True)] + [("b", d, float(-v)) for k, (d, v) in enumerate(zip(days, x, strict=True)) if k % 7] + [("c", d, 0.5) for d in days]
    got = {(r.a, r.b): r["corr"] for r in graph.correlations(spark.createDataFrame(rows, "symbol string, trade_date date, ret double"), 10).collect()}
    filled, last = [], 0.0
    for k, v in enumerate(x):
        last = -v if k % 7 else last
        filled.append(last)
    assert got["a", "b"] == pytest.approx(np.corrcoef(x, filled)[0, 1]) and got["a", "c"] is None
    assert graph.correlations(spark.createDataFrame(rows, "symbol string, trade_date date, ret double"), 100).count() == 0


def test_portfolio_calendar_and_index(spark):
    d = [dt.date(2020, 1, k + 1) for k in range(5)]
    closes = spark.createDataFrame([("a", d[0], 10.0), ("a", d[1], 11.0), ("a", d[3], 12.0), ("a", d[4], 6.0), ("b", d[2], 5.0), ("Nifty50", d[0], 1.0), ("Nifty50", d[1], 2.0)], "symbol string, trade_date date, close double")
    returns = portfolio.grid_returns(closes)
    got = {(r.symbol, r.trade_date.day): r.ret for r in returns.collect()}
    assert got == pytest.approx({("a", 2): 0.1, ("a", 5): -0.5, ("Nifty50", 2): 1.0})
    clusters = spark.createDataFrame([(s, 0, 10, *[1.0] * 5) for s in ("a", "b", "Nifty50")], "symbol string, cluster_id int, trading_days long, pc1 double, pc2 double, pc3 double, pc4 double, pc5 double")
    series = portfolio.portfolios(returns, clusters)
    assert {r.portfolio for r in series.collect()} == {"diversified", "concentrated", "market"}
    metrics = {r.portfolio: r for r in portfolio.metrics(series).collect()}
    assert metrics["market"].cum_return == pytest.approx(1.1 * 0.5 - 1) and metrics["market"].max_drawdown == pytest.approx(-0.5)
    one = portfolio.metrics(series.filter("trade_date = '2020-01-02'")).first()
    assert (one.cum_return, one.ann_vol, one.sharpe) == (0, 0, 0)


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        def cost(a, b):
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_ward():
    rng = np.random.default_rng(4)
    for k in (1, 3, 6):
        x = rng.normal(size=(40, 3))
        labels = clustering.ward(x, k)
        assert {frozenset(np.flatnonzero(labels == c)) for c in range(labels.max() + 1)} == brute_ward(x, k)


def test_cure_finds_separate_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(scale=30, size=(6, 4))
    rows = [(k, (centres[k % 6] + rng.normal(size=4)).tolist()) for k in range(300)]
    out = clustering.cure(spark.createDataFrame(rows, "id long, vector array<double>")).collect()
    assert len({(r.id % 6, r.cure_cluster) for r in out}) == 6
    assert clustering.cure(spark.createDataFrame([], "id long, vector array<double>")).count() == 0


@pytest.mark.parametrize("at_once", [1024, 64])
def test_cure_sample_grows_with_the_table(spark, at_once):
    """Half of the rows in parts of a few; small clusters keep a representative."""
    rng = np.random.default_rng(9)
    centres = rng.normal(scale=40, size=(6, 3))
    rows = [(k, (centres[0 if k % 50 else 1 + k // 50 % 5] + rng.normal(size=3)).tolist()) for k in range(1500)]
    out = clustering.cure(spark.createDataFrame(rows, "id long, vector array<double>"), at_once=at_once).collect()
    assert len({(0 if r.id % 50 else 1 + r.id // 50 % 5, r.cure_cluster) for r in out}) == 6


def test_ward_of_weighted_rows():
    """A row that stands for several is as good as the rows."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(12, 2))
    weight = rng.integers(1, 5, 12)
    labels = clustering.ward(x, 4, weight)
    every = clustering.ward(np.repeat(x, weight, axis=0), 4)
    first = np.cumsum(weight) - weight
    assert {frozenset(np.flatnonzero(labels == c)) for c in range(4)} == {frozenset(np.flatnonzero(every[first] == c)) for c in range(4)}


def test_numbered_is_a_global_order(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5)
    got = graph.numbered(df, [df["k"].desc(), df["id"].asc()], "rank").collect()
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((k % 7, k) for k in range(1000)), key=lambda t: (-t[0], t[1])) and {r["rank"] for r in got} == set(range(1, 1001))


def test_agreement(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (2, 0)], "a int, b int")
    r = clustering.agreement(df, "a", "a").first()
    assert (r.n, r.ari, r.nmi) == (5, pytest.approx(1), pytest.approx(1))
    r = clustering.agreement(df, "a", "b").first()
    pairs, pa, pb, every = 1 + 1, 1 + 1, 3 + 1, 10
    assert r.ari == pytest.approx((pairs - pa * pb / every) / ((pa + pb) / 2 - pa * pb / every))
    one = clustering.agreement(spark.createDataFrame([(0, 0), (0, 0)], "a int, b int"), "a", "b").first()
    assert (one.ari, one.nmi) == (1, 1)


def test_silhouette_edges(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [10.0], 1)], "id long, vector array<double>, cluster_id int")
    assert clustering.silhouette(df, block=1).first().silhouette == pytest.approx(((10 - 1) / 10 + (9 - 1) / 9 + 0) / 3)
    assert clustering.silhouette(df.filter("cluster_id = 0")).first().silhouette is None


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    df = clustering.from_array(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>"), "v")
    shares = [r.explained for r in clustering.explained_variance(df).orderBy("pc").collect()]
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert shares == pytest.approx((values / values.sum()).tolist(), abs=1e-8)
    k = clustering.components_for(clustering.explained_variance(df), 0.9)
    assert k == int(np.searchsorted(np.cumsum(values / values.sum()), 0.9)) + 1
    scores, load = clustering.project(df, k, "id")
    assert scores.columns == ["id", *[f"pc{i + 1}" for i in range(k)]] and load.shape == (4, k)
