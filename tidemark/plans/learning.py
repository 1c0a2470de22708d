"""Queries of clustering, data quality, stored tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, recursive, rolling
from ..operators import clustering, quality
from ..schema import PCA_INPUT, documented_schema
from ..sources import adapters, ticks
from ..sources.scratch import materialize, scratch_path
from ..streaming import bars as streaming
from . import sql
from .indicators import KEYS, featured_bars
from .kit import add, tidy

ROLLED = [c for c in rolling.ROLLING if c in PCA_INPUT]


def stock_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(clustering.profiles(rolling.rolling_indicators(adapters.bars(spark, sf_dir)), ROLLED))


add("stock_profiles", stock_profiles, f"WITH {sql.ROLLING} SELECT symbol, {', '.join(f'{sql.rounded(f"avg({c})")} AS {c}' for c in ROLLED)}, count(*) AS n_rows, count(DISTINCT trade_date) AS n_days FROM r3 GROUP BY symbol")


def _profiles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(clustering.profiles(featured_bars(spark, sf_dir), list(PCA_INPUT)), "profiles")


add("stock_profiles_all", lambda s, d: tidy(_profiles_all(s, d)))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("label").alias("cluster_id")), "embedded")


def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(clustering.explained_variance(clustering.from_array(_embedded(spark, sf_dir), "vector")), 6)


def pca_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of the components that explain 90 % of the symbols' profiles."""
    df = clustering.assembled(_profiles_all(spark, sf_dir), list(PCA_INPUT))
    k = clustering.components_for(clustering.explained_variance(df))
    return tidy(clustering.loadings(spark, clustering.project(df, k, "symbol")[1], list(PCA_INPUT)), 6)


def pca_top_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.top_loadings(pca_profiles(spark, sf_dir))


def pca_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scatter chart of the symbols shows: their first two components and their cluster."""
    df = clustering.assembled(_profiles_all(spark, sf_dir), list(PCA_INPUT))
    scores = clustering.assembled(clustering.project(df, 2, "symbol")[0], ["pc1", "pc2"])
    return tidy(clustering.kmeans(scores).transform(scores).select("symbol", "pc1", "pc2", "cluster_id"), 6)


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clustering.from_array(_embedded(spark, sf_dir).drop("cluster_id"), "vector")
    return clustering.kmeans(df).transform(df).select("id", "cluster_id")


def elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(clustering.elbow(clustering.from_array(_embedded(spark, sf_dir).drop("cluster_id"), "vector")), 3)


def cure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cure(_embedded(spark, sf_dir).select("id", "vector")).select("id", "cure_cluster")


def silhouette_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared silhouettes of K-means on the raw vectors and on their first components, and the improvement."""
    raw = clustering.from_array(_embedded(spark, sf_dir).drop("cluster_id"), "vector")
    before = clustering.squared_silhouette(clustering.kmeans(raw).transform(raw))
    scores, _ = clustering.project(raw, 5, "id")
    reduced = clustering.assembled(scores, [f"pc{k}" for k in range(1, 6)])
    after = clustering.squared_silhouette(clustering.kmeans(reduced).transform(reduced))
    return tidy(spark.createDataFrame([(before, after, 100 * (after - before) / abs(before) if before else 0.0)], "baseline double, reduced double, improvement_percent double"))


add("pca_explained", pca_explained)
add("pca_profiles", pca_profiles)
add("pca_top_loadings", pca_top_loadings)
add("pca_scatter", pca_scatter)
add("kmeans", kmeans)
add("elbow", elbow)
add("cure", cure)
add("silhouette_comparison", silhouette_comparison)
add("silhouette", lambda s, d: tidy(clustering.silhouette(_embedded(s, d)), 6), f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS c FROM embeddings),
p AS (SELECT a.id, a.c AS own, b.c, sum(CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.v, b.v) END) AS total, count(*) AS size FROM e a CROSS JOIN e b GROUP BY ALL),
q AS (SELECT id, max(total / nullif(size - 1, 0)) FILTER (own = c) AS a, min(total / size) FILTER (own <> c) AS b, max(size) FILTER (own = c) AS n FROM p GROUP BY id)
SELECT count(*) AS n, (SELECT count(DISTINCT c) FROM e) AS n_clusters, {sql.rounded("avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)", 6)} AS silhouette FROM q""")


def ari_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two given labelings: the label, and the label shifted for every third row."""
    df = adapters.table(spark, sf_dir, "embeddings").select("label", F.when(F.col("vec_id") % 3 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).alias("other"))
    return tidy(clustering.agreement(df, "label", "other"), 6)


add("ari_nmi", ari_nmi, f"""WITH e AS (SELECT label AS a, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS b FROM embeddings),
c AS (SELECT a, b, count(*)::DOUBLE AS n FROM e GROUP BY ALL), x AS (SELECT a, sum(n) AS n FROM c GROUP BY a), y AS (SELECT b, sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS n FROM c),
v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM x) AS p, (SELECT sum(n * (n - 1) / 2) FROM y) AS q, n * (n - 1) / 2 AS every, n,
  (SELECT -sum(x.n / t.n * ln(x.n / t.n)) FROM x) AS hx, (SELECT -sum(y.n / t.n * ln(y.n / t.n)) FROM y) AS hy,
  (SELECT sum(c.n / t.n * ln(c.n * t.n / (x.n * y.n))) FROM c JOIN x USING (a) JOIN y USING (b)) AS mi FROM t)
SELECT n::BIGINT AS n, {sql.rounded("(s - p * q / every) / ((p + q) / 2 - p * q / every)", 6)} AS ari, {sql.rounded("mi / ((hx + hy) / 2)", 6)} AS nmi FROM v""")

_FIVE = ["close", "volume", "high", "low", "open"]
add("cluster_profiles", lambda s, d: tidy(clustering.cluster_profiles(adapters.bars(s, d).withColumn("cluster_id", (F.col("symbol") % 6).cast("int")), _FIVE)), f"""WITH {sql.BARS},
m AS (SELECT (symbol % 6)::INT AS cluster_id, {", ".join(f"avg({c}) AS {c}" for c in _FIVE)} FROM bars GROUP BY 1)
SELECT cluster_id, {sql.tidy(_FIVE)}, {", ".join(f"{sql.rounded(f'coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)')} AS {c}_z" for c in _FIVE)} FROM m""")

QUALITY = list(rolling.ROLLING)
KEY_FEATURES = ["sma20", "upperband", "CCI10", "MFI", "ROC10", "WILLR"]


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_indicators(adapters.bars(spark, sf_dir))




def _figures(figures: dict[str, str], columns: list[str], table: str) -> str:
    """A row a column of aggregates; {c} stands for the column."""
    each = ", ".join("{" + f"'column': '{c}', " + ", ".join(f"'{n}': {e.replace('{c}', c)}" for n, e in figures.items()) + "}" for c in columns)
    return f"SELECT unnest(x) FROM (SELECT unnest([{each}]) AS x FROM {table})"


add("dq_missing", lambda s, d: tidy(quality.missing(_measured(s, d), QUALITY)),
    f"WITH {sql.ROLLING} {_figures({'missing_count': 'count(*) - count({c})', 'missing_percentage': sql.rounded('100 * (count(*) - count({c})) / count(*)::DOUBLE')}, QUALITY, 'r3')}")
add("dq_stats", lambda s, d: tidy(quality.statistics(_measured(s, d), QUALITY[:20]), 3),
    f"WITH {sql.ROLLING} {_figures({n: sql.rounded(f + '({c})', 3) for n, f in (('mean', 'avg'), ('std', 'stddev_samp'), ('min', 'min'), ('max', 'max'))}, QUALITY[:20], 'r3')}")
_OUT_SQL = f"""{sql.ROLLING}, qs AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in KEY_FEATURES)} FROM r3),
o AS (SELECT r3.*, qs.* FROM r3 CROSS JOIN qs)"""
_FIG = {
    "q1": sql.rounded("any_value({c}_1)"), "q3": sql.rounded("any_value({c}_3)"), "lower": sql.rounded("any_value({c}_1 - 1.5::DOUBLE * ({c}_3 - {c}_1))"), "upper": sql.rounded("any_value({c}_3 + 1.5::DOUBLE * ({c}_3 - {c}_1))"),
    "n_outliers": "count(*) FILTER ({c} < {c}_1 - 1.5::DOUBLE * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5::DOUBLE * ({c}_3 - {c}_1))",
    "outlier_percentage": sql.rounded("100 * (count(*) FILTER ({c} < {c}_1 - 1.5::DOUBLE * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5::DOUBLE * ({c}_3 - {c}_1))) / count({c})::DOUBLE"),
}
add("dq_outliers", lambda s, d: tidy(quality.outliers(_measured(s, d), KEY_FEATURES, exact=True)), f"WITH {_OUT_SQL} {_figures(_FIG, KEY_FEATURES, 'o')}")
_LACK = " + ".join(f"({c} IS NULL)::INT" for c in QUALITY)
add("dq_completeness", lambda s, d: tidy(quality.completeness(_measured(s, d), QUALITY)),
    f"WITH {sql.ROLLING} SELECT count(*) AS total_rows, count(*) FILTER ({_LACK} > 10) AS incomplete_rows, {sql.rounded(f'100 * (count(*) - count(*) FILTER ({_LACK} > 10)) / count(*)::DOUBLE')} AS completeness_score FROM r3")


def dq_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(_measured(spark, sf_dir).select(*QUALITY), "measured")
    return quality.recommendations(quality.missing(df, QUALITY), quality.outliers(df, KEY_FEATURES), quality.completeness(df, QUALITY))


_ADVICE = ", ".join(f"(count(*) - count({c})) > 0.2::DOUBLE * count(*) AS m_{c}" for c in QUALITY)
_STRAY = ", ".join(f"(count(*) FILTER ({c} < {c}_1 - 1.5::DOUBLE * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5::DOUBLE * ({c}_3 - {c}_1))) > 0.1::DOUBLE * count({c}) AS o_{c}" for c in KEY_FEATURES)
add("dq_recommendations", dq_recommendations, f"""WITH {_OUT_SQL}, a AS (SELECT {_ADVICE}, {_STRAY}, 100 * (count(*) - count(*) FILTER ({_LACK} > 10)) < 80 * count(*) AS thin FROM o),
b AS (SELECT 'MISSING_DATA' AS type, 'HIGH' AS severity, {" + ".join(f"m_{c}::INT" for c in QUALITY)} AS n_columns FROM a UNION ALL SELECT 'OUTLIERS', 'MEDIUM', {" + ".join(f"o_{c}::INT" for c in KEY_FEATURES)} FROM a UNION ALL SELECT 'COMPLETENESS', 'HIGH', thin::INT FROM a),
c AS (SELECT type, severity, n_columns::BIGINT AS n_columns FROM b WHERE n_columns > 0) SELECT * FROM c UNION ALL SELECT 'OK', 'INFO', 0 WHERE NOT EXISTS (FROM c)""")
add("metadata", lambda s, d: quality.metadata(adapters.bars(s, d)), f"""WITH {sql.BARS} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(year(trade_date))::INT AS min_year, max(year(trade_date))::INT AS max_year,
count(DISTINCT (year(trade_date), month(trade_date), symbol)) AS n_partitions FROM bars""")
add("clean_filter", lambda s, d: quality.clean(adapters.ticks(s, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
    "SELECT event_type AS symbol, count(*) AS n FROM events WHERE value IS NOT NULL AND value > 0 AND ts IS NOT NULL AND event_type <> '' GROUP BY 1")
add("post_load_verify", lambda s, d: quality.verify(_measured(s, d), ["close", "volume", "sma20", "MFI", "WILLR"]),
    f"WITH {sql.ROLLING} {_figures({'n_known': 'count({c})'}, ['close', 'volume', 'sma20', 'MFI', 'WILLR'], 'r3')}")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with RSI and MACD, written partitioned by year, month and symbol, and read again."""
    bars = adapters.bars(spark, sf_dir)
    lines = recursive.recursive_indicators(bars, ["RSI14", "macd1226"])
    path = scratch_path(spark, "stored-bars")
    table = bars.join(lines, KEYS).select(
        F.concat(F.lit("S"), F.col("symbol").cast("string")).alias("stock_symbol"), F.col("trade_date").cast("timestamp").alias("timestamp"), F.year("trade_date").alias("year"), F.month("trade_date").alias("month"), "close", "RSI14", "macd1226",
    )
    # by year and month alone: a partition for each symbol's month would be a file of a few rows
    ticks.write_partitioned(table, path, ("year", "month"))
    return spark.read.parquet(path)


_STORED = f"{sql.RECURSIVE}, stocks AS (SELECT 'S' || symbol AS stock_symbol, trade_date::TIMESTAMP AS timestamp, year(trade_date)::INT AS year, month(trade_date)::INT AS month, close, RSI14, macd1226 FROM x)"
PROBES = {
    "sql_probe_1": "SELECT COUNT(*) AS n FROM {t} WHERE year = 1996 AND month = 1 AND stock_symbol LIKE 'S1%'",
    "sql_probe_2": "SELECT stock_symbol, COUNT(*) AS n FROM {t} WHERE year = 1996 GROUP BY stock_symbol",
    "sql_probe_3": "SELECT timestamp, stock_symbol, close, RSI14, macd1226 FROM {t} WHERE stock_symbol LIKE 'S2%' AND year = 1996 ORDER BY timestamp, stock_symbol LIMIT 1000",
}


def _probe(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(spark.sql(text.replace("{t}", "{stocks}"), stocks=stored(spark, sf_dir)))

    return run


for _name, _text in PROBES.items():
    _tail = _text.replace("{t}", "stocks")
    if _name == "sql_probe_3":
        _tail = f"SELECT timestamp, stock_symbol, {sql.tidy(['close', 'RSI14', 'macd1226'])} FROM ({_tail})"
    add(_name, _probe(_text), f"WITH RECURSIVE {_STORED} {_tail}")
add("pruned_count", lambda s, d: stored(s, d).filter("year = 1997 AND stock_symbol = 'S3'").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {sql.BARS} SELECT count(*) AS n FROM bars WHERE year(trade_date) = 1997 AND symbol = 3")
add("top_groups", lambda s, d: adapters.bars(s, d).groupBy(F.year("trade_date").alias("year"), "symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "year", "symbol").limit(5),
    f"WITH {sql.BARS} SELECT year(trade_date)::INT AS year, symbol, count(*) AS n FROM bars GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5")
add("month_counts", lambda s, d: adapters.bars(s, d).groupBy(F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("n_symbols")),
    f"WITH {sql.BARS} SELECT year(trade_date)::INT AS year, month(trade_date)::INT AS month, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM bars GROUP BY 1, 2")


def declared_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written in the declared layout by year, month and symbol, and counted from a read of it."""
    path = scratch_path(spark, "declared-layout")
    stored = adapters.ticks(spark, sf_dir).filter("timestamp IS NOT NULL").select(F.col("symbol").alias("stock_symbol"), "timestamp", "price", F.year("timestamp").alias("year"), F.month("timestamp").alias("month"))
    ticks.write_partitioned(stored, path)
    return tidy(spark.read.parquet(path).groupBy("year", "month", "stock_symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price")))


add("declared_layout", declared_layout, f"SELECT year(ts)::INT AS year, month(ts)::INT AS month, event_type AS stock_symbol, count(*) AS n, {sql.rounded('avg(value)')} AS mean_price FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3")
add("plot_sample", lambda s, d: tidy(quality.plot_sample(adapters.ticks(s, d), "event_id").select("event_id", "symbol", "price")),
    f"SELECT event_id, event_type AS symbol, {sql.rounded('value')} AS price FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 50000")
add("storage_size", lambda s, d: ticks.stored_size(s, f"{d}/lineitem.parquet"))
add("schema_document", lambda s, d: s.createDataFrame([(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(documented_schema())], "position int, name string, type string, nullable boolean"))


add("value_spread", lambda s, d: tidy(quality.spread(adapters.ticks(s, d), "symbol", "price")),
    f"SELECT event_type AS symbol, count(value) AS n, {sql.rounded('avg(value)')} AS mean, {sql.rounded('quantile_cont(value, 0.5)')} AS median, {sql.rounded('quantile_cont(value, 0.95)')} AS p95 FROM events GROUP BY 1")
add("binned_means", lambda s, d: tidy(quality.binned_means(adapters.bars(s, d), "close", "volume")), f"""WITH {sql.BARS}, e AS (SELECT list_distinct(quantile_cont(close, [{", ".join(f"{k / 8}" for k in range(1, 8))}])) AS edges FROM bars)
SELECT (1 + len(list_filter(edges, lambda x: close > x)))::INT AS bin, count(*) AS n, {sql.rounded("avg(close)")} AS mean_by, {sql.rounded("avg(volume)")} AS mean_value FROM bars CROSS JOIN e GROUP BY 1""")


def return_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily log returns in 20 bins between -5 and 5, and what lies beyond."""
    r = adapters.bars(spark, sf_dir).withColumn("r", features.sequence_features()["log_return"]).filter("r IS NOT NULL")
    return r.groupBy(F.width_bucket("r", F.lit(-5.0), F.lit(5.0), F.lit(20)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


add("return_histogram", return_histogram, f"""WITH {sql.BARS}, r AS (SELECT ln(close / lag(close) OVER {sql.BY_DATE}) AS r FROM bars)
SELECT CASE WHEN r < -5 THEN 0 WHEN r >= 5 THEN 21 ELSE floor((r + 5) * 2)::INT + 1 END AS bin, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY 1""")


def streaming_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream until none is left; bars of the windows that the watermark has closed."""
    table = adapters.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ticked = stream.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"), "event_id")
    path = scratch_path(spark, "streamed-bars")
    streaming.write_bars(streaming.windowed_bars(ticked), f"{path}/bars", f"{path}/state").awaitTermination()
    return tidy(spark.read.schema("symbol string, start timestamp, open double, high double, low double, close double, volume long").parquet(f"{path}/bars"))


add("streaming_bars", streaming_bars, f"""WITH t AS (SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS start, {{'a': ts, 'b': event_id}} AS k, value FROM events)
SELECT symbol, start, {sql.rounded("arg_min(value, k)")} AS open, {sql.rounded("max(value)")} AS high, {sql.rounded("min(value)")} AS low, {sql.rounded("arg_max(value, k)")} AS close, count(*) AS volume
FROM t GROUP BY symbol, start HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
