"""Queries of anomalies, portfolios and the correlation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, graph, portfolio
from ..sources import adapters
from ..sources.scratch import materialize
from . import sql
from .kit import add, tidy

KEYS = ["symbol", "trade_date"]
#: Random prices correlate weakly, and their calendar has 80 months.
THRESHOLD, MIN_PERIODS = 0.2, 20


def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(anomaly.rolling_z(adapters.bars(spark, sf_dir)).select(*KEYS, "log_return", "zscore", "is_anomaly"), 6)


_Z = f"""a0 AS (SELECT *, lag(close) OVER {sql.BY_DATE} AS p FROM bars), a1 AS (SELECT symbol, trade_date, CASE WHEN p > 0 AND close > 0 THEN ln(close / p) END AS log_return FROM a0),
a2 AS (SELECT *, avg(log_return) {sql.over(20)} AS m, stddev_samp(log_return) {sql.over(20)} AS s, count(log_return) {sql.over(20)} AS n FROM a1),
a3 AS (SELECT symbol, trade_date, log_return, CASE WHEN n >= 10 AND s > 0 THEN (log_return - m) / s END AS zscore FROM a2),
a4 AS (SELECT *, coalesce(abs(zscore) > 3, false) AS is_anomaly FROM a3)"""
_C = """u0 AS MATERIALIZED (SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn,
  coalesce((log_return - avg(log_return) OVER (PARTITION BY symbol)) / nullif(stddev_pop(log_return) OVER (PARTITION BY symbol), 0), 0) AS x FROM a4),
u1 AS (SELECT symbol, 0::BIGINT AS rn, 0::DOUBLE AS a, 0::DOUBLE AS b, 0 AS g FROM u0 WHERE rn = 1
  UNION ALL SELECT symbol, rn, CASE WHEN up > 5 THEN 0 ELSE up END, CASE WHEN up <= 5 AND down > 5 THEN 0 ELSE down END, CASE WHEN up > 5 THEN 1 WHEN down > 5 THEN -1 ELSE 0 END
  FROM (SELECT t.symbol, t.rn, greatest(0, e.a + t.x - 0.5::DOUBLE) AS up, greatest(0, e.b - t.x - 0.5::DOUBLE) AS down FROM u1 e JOIN u0 t ON t.symbol = e.symbol AND t.rn = e.rn + 1)),
cusum AS (SELECT symbol, trade_date, a AS cusum_pos, b AS cusum_neg, g::INT AS regime_change FROM u1 JOIN u0 USING (symbol, rn))"""
add("rolling_zscore", rolling_zscore, f"WITH {sql.BARS}, {_Z} SELECT symbol, trade_date, {sql.tidy(['log_return', 'zscore'], 6)}, is_anomaly FROM a4")
add("cusum", lambda s, d: tidy(anomaly.cusum(anomaly.rolling_z(adapters.bars(s, d)))),
    f"WITH RECURSIVE {sql.BARS}, {_Z}, {_C} SELECT symbol, trade_date, {sql.tidy(['cusum_pos', 'cusum_neg'])}, regime_change FROM cusum")
add("anomaly_summary", lambda s, d: tidy(anomaly.summary(anomaly.anomalies(adapters.bars(s, d)))),
    f"""WITH RECURSIVE {sql.BARS}, {_Z}, {_C} SELECT symbol, count(*) AS n_days, count(*) FILTER (is_anomaly) AS n_anomalies, {sql.rounded("avg(is_anomaly::INT)")} AS anomaly_rate,
count(*) FILTER (regime_change <> 0) AS n_regime_changes, arg_max(trade_date, {{'a': abs(zscore), 'b': trade_date}}) FILTER (zscore IS NOT NULL) AS extreme_date, {sql.rounded("max(abs(zscore))")} AS extreme_z FROM a4 JOIN cusum USING (symbol, trade_date) GROUP BY symbol""")  # fmt: skip

MONTHLY = """closes AS (SELECT c_nationkey::BIGINT AS symbol, date_trunc('month', o_orderdate)::DATE AS trade_date, avg(o_totalprice) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(adapters.monthly_prices(spark, sf_dir), "monthly-prices")


def clusters(closes: DataFrame) -> DataFrame:
    """A given clustering: the symbol modulo 6, with five figures of each symbol in place of components."""
    return closes.groupBy("symbol").agg(
        F.avg("close").alias("pc1"), F.stddev_samp("close").alias("pc2"), F.min("close").alias("pc3"), F.max("close").alias("pc4"), F.count("close").cast("double").alias("pc5"), F.count(F.lit(1)).alias("trading_days"),
    ).withColumn("cluster_id", (F.col("symbol") % 6).cast("int"))


GRID = f"""{MONTHLY}, g0 AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day FROM (SELECT DISTINCT trade_date FROM closes)),
g1 AS (SELECT *, lag(day) OVER w AS pd, lag(close) OVER w AS pc FROM closes JOIN g0 USING (trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY day)),
grid AS (SELECT symbol, trade_date, close / pc - 1 AS ret FROM g1 WHERE pd = day - 1)"""
BOOKS = f"""{GRID}, h0 AS (SELECT symbol, symbol % 6 AS cluster_id, avg(close) AS pc1, stddev_samp(close) AS pc2, min(close) AS pc3, max(close) AS pc4, count(close)::DOUBLE AS pc5, count(*) AS trading_days FROM closes GROUP BY symbol),
h1 AS (SELECT h0.* FROM h0 SEMI JOIN grid USING (symbol)), h2 AS (SELECT cluster_id, {", ".join(f"avg({p}) AS m{p}" for p in portfolio.PCS)} FROM h1 GROUP BY 1),
reps AS (SELECT cluster_id::INT AS cluster_id, arg_min(symbol, {{'a': {" + ".join(f"({p} - m{p}) * ({p} - m{p})" for p in portfolio.PCS)}, 'b': symbol}}) AS symbol FROM h1 JOIN h2 USING (cluster_id) GROUP BY 1),
big AS (SELECT cluster_id FROM h1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
members AS (SELECT 'diversified' AS portfolio, symbol FROM reps UNION ALL SELECT 'market', symbol FROM (SELECT DISTINCT symbol FROM grid)
  UNION ALL SELECT 'concentrated', symbol FROM (SELECT symbol FROM h1 SEMI JOIN big USING (cluster_id) ORDER BY trading_days DESC, symbol LIMIT 6)),
series AS (SELECT portfolio, trade_date, avg(ret) AS ret FROM grid JOIN members USING (symbol) GROUP BY ALL),
eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio ORDER BY trade_date)) AS equity FROM series),
eq2 AS (SELECT *, equity / max(equity) OVER (PARTITION BY portfolio ORDER BY trade_date) - 1 AS drawdown FROM eq)"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = _closes(spark, sf_dir)
    return portfolio.portfolios(portfolio.grid_returns(closes), clusters(closes))


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = _closes(spark, sf_dir)
    return portfolio.representatives(clusters(closes), portfolio.grid_returns(closes))


add("returns_grid", lambda s, d: tidy(portfolio.grid_returns(_closes(s, d)), 6), f"WITH {GRID} SELECT symbol, trade_date, {sql.rounded('ret', 6)} AS ret FROM grid")
add("cluster_representatives", cluster_representatives, f"WITH {BOOKS} SELECT cluster_id, symbol FROM reps")
add("portfolio_equity", lambda s, d: tidy(portfolio.equity(_books(s, d)).withColumn("log_equity", F.ln("equity")).drop("equity"), 6),
    f"WITH {BOOKS} SELECT portfolio, trade_date, {sql.rounded('ret', 6)} AS ret, {sql.rounded('ln(equity)', 6)} AS log_equity, {sql.rounded('drawdown', 6)} AS drawdown FROM eq2")
add("portfolio_metrics", lambda s, d: tidy(portfolio.metrics(_books(s, d)).withColumn("log_growth", F.log1p("cum_return")).drop("cum_return")),
    f"""WITH {BOOKS} SELECT portfolio, count(ret) AS n, {sql.rounded("ln(arg_max(equity, trade_date))")} AS log_growth, {sql.rounded("avg(ret) * 252")} AS ann_return, {sql.rounded("stddev_samp(ret) * sqrt(252)")} AS ann_vol,
{sql.rounded("avg(ret) * 252 / (stddev_samp(ret) * sqrt(252))")} AS sharpe, {sql.rounded("min(drawdown)")} AS max_drawdown FROM eq2 GROUP BY portfolio""")  # fmt: skip

CORR = f"""{MONTHLY}, c0 AS (SELECT *, lag(close) OVER {sql.BY_DATE} AS p FROM closes), c1 AS (SELECT symbol, trade_date, ln(close / p) AS ret FROM c0 WHERE p > 0 AND close > 0),
c2 AS (SELECT trade_date FROM c1 GROUP BY 1 HAVING count(DISTINCT symbol) >= floor((SELECT count(DISTINCT symbol) FROM c1) * 0.5)),
rets AS (SELECT c1.* FROM c1 SEMI JOIN c2 USING (trade_date)),
c3 AS (SELECT symbol, trade_date, ret FROM (SELECT DISTINCT symbol FROM rets) CROSS JOIN (SELECT DISTINCT trade_date FROM rets) LEFT JOIN rets USING (symbol, trade_date)),
c4 AS (SELECT symbol, trade_date, coalesce(last_value(ret IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date), 0) AS x FROM c3),
pairs AS MATERIALIZED (SELECT l.symbol AS a, r.symbol AS b, corr(l.x, r.x) AS corr, count(*) AS n FROM c4 l JOIN c4 r ON l.trade_date = r.trade_date AND l.symbol < r.symbol GROUP BY ALL HAVING count(*) >= {MIN_PERIODS}),
edges AS MATERIALIZED (SELECT a AS src, b AS dst, abs(corr) AS weight FROM pairs WHERE abs(corr) >= {THRESHOLD}::DOUBLE),
nodes AS (SELECT DISTINCT symbol FROM rets), two AS MATERIALIZED (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
deg AS (SELECT symbol, count(dst) AS degree, coalesce(sum(weight), 0) AS strength FROM nodes LEFT JOIN two ON src = symbol GROUP BY symbol)"""
REACH = """reach AS (SELECT symbol AS s, symbol AS r FROM nodes UNION SELECT reach.s, two.dst FROM reach JOIN two ON two.src = reach.r),
comp AS (SELECT s AS symbol, min(r) AS component FROM reach GROUP BY s)"""


class _Graph:
    """The correlation graph of a scale, computed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        returns = graph.return_grid(_closes(spark, sf_dir))
        self.nodes = materialize(returns.select("symbol").distinct(), "nodes")
        self.pairs = materialize(graph.correlations(returns, MIN_PERIODS), "pairs")
        self.edges = graph.edges(self.pairs, THRESHOLD)


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _Graph(spark, sf_dir)
    return tidy(graph.pagerank(g.nodes, g.edges, tolerance=1e-13).select("symbol", "pagerank_score", "rank"), 6)


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the given partition of the symbols by their remainder modulo 5."""
    g = _Graph(spark, sf_dir)
    return tidy(graph.modularity(g.edges, g.nodes.withColumn("community_id", F.col("symbol") % 5)), 6)


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _Graph(spark, sf_dir)
    return tidy(graph.statistics(g.nodes, g.pairs, g.edges, graph.components(g.nodes, g.edges)), 6)


add("corr_matrix", lambda s, d: tidy(_Graph(s, d).pairs, 6), f"WITH {CORR} SELECT a, b, {sql.rounded('corr', 6)} AS corr, n FROM pairs")
add("corr_edges", lambda s, d: tidy(_Graph(s, d).edges, 6), f"WITH {CORR} SELECT src, dst, {sql.rounded('weight', 6)} AS weight FROM edges")
add("degree_strength", lambda s, d: tidy((g := _Graph(s, d)) and graph.degrees(g.nodes, g.edges)), f"WITH {CORR} SELECT symbol, degree, {sql.rounded('strength')} AS strength FROM deg")
add("components", lambda s, d: (g := _Graph(s, d)) and graph.components(g.nodes, g.edges), f"WITH RECURSIVE {CORR}, {REACH} SELECT symbol, component FROM comp")
add("graph_stats", graph_stats, f"""WITH RECURSIVE {CORR}, {REACH} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, {sql.rounded("(SELECT avg(weight) FROM edges)", 6)} AS mean_weight,
{sql.rounded("(SELECT avg((corr > 0)::INT) FROM pairs)", 6)} AS positive_share, {sql.rounded("(SELECT avg(abs(corr)) FROM pairs)", 6)} AS mean_abs_corr, (SELECT count(DISTINCT component) FROM comp) AS n_components,
(SELECT count(*) FROM deg WHERE degree = 0) AS n_isolated, {sql.rounded("2 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1))::DOUBLE", 6)} AS density""")
add("modularity", modularity, f"""WITH {CORR}, m0 AS (SELECT sum(weight) AS w FROM edges),
m1 AS (SELECT src % 5 AS c, sum(CASE WHEN src % 5 = dst % 5 THEN weight ELSE 0 END) / 2 AS inside, sum(weight) AS k FROM two GROUP BY 1)
SELECT {sql.rounded("sum(inside / w - (k / (2 * w)) ** 2)", 6)} AS modularity FROM m1 CROSS JOIN m0""")
add("pagerank", pagerank, f"""WITH RECURSIVE {CORR}, n0 AS (SELECT count(*)::DOUBLE AS n FROM nodes),
mat AS MATERIALIZED (SELECT s.symbol AS s, t.symbol AS t, CASE WHEN s.degree = 0 THEN 1 / n ELSE coalesce(two.weight, 0) / s.strength END AS v
  FROM deg s CROSS JOIN nodes t CROSS JOIN n0 LEFT JOIN two ON two.src = s.symbol AND two.dst = t.symbol),
pr AS (SELECT 0 AS step, symbol, 1 / n AS x FROM nodes CROSS JOIN n0
  UNION ALL SELECT any_value(pr.step) + 1, mat.t, 0.85::DOUBLE * sum(mat.v * pr.x) + 0.15::DOUBLE / any_value(n0.n) FROM pr JOIN mat ON mat.s = pr.symbol CROSS JOIN n0 WHERE pr.step < 150 GROUP BY mat.t)
SELECT symbol, {sql.rounded("x", 6)} AS pagerank_score, (row_number() OVER (ORDER BY x DESC, symbol))::INT AS rank FROM pr WHERE step = 150""")


def graph_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of at least 0.22 among the ten strongest nodes: what a network chart shows."""
    g = _Graph(spark, sf_dir)
    top = F.broadcast(graph.degrees(g.nodes, g.edges).orderBy(F.desc("strength"), "symbol").limit(10).select("symbol"))
    inside = g.edges.filter("weight >= 0.22").join(top.withColumnRenamed("symbol", "src"), "src").join(top.withColumnRenamed("symbol", "dst"), "dst")
    return tidy(inside.select("src", "dst", "weight"), 6)


add("graph_top", graph_top, f"""WITH {CORR}, top AS (SELECT symbol FROM deg ORDER BY strength DESC, symbol LIMIT 10)
SELECT src, dst, {sql.rounded("weight", 6)} AS weight FROM edges WHERE weight >= 0.22::DOUBLE AND src IN (SELECT symbol FROM top) AND dst IN (SELECT symbol FROM top)""")
add("communities", lambda s, d: (g := _Graph(s, d)) and graph.communities(g.nodes, g.edges))
