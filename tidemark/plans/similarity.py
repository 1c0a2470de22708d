"""Queries of the similarity operators: MinHash, patterns, precedents, fusion and backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import recursive, rolling, vectors
from ..operators import histories, minhash, parcels, patterns, precedents, serving
from ..operators.streamed import streamed_top_k
from ..schema import SIGNALS
from ..sources import adapters
from ..sources.scratch import materialize, scratch_path
from . import sql
from .indicators import KEYS, featured_bars
from .kit import add, tidy



def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.text_shingles(adapters.table(spark, sf_dir, "documents"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed documents, computed once: the similarity queries use them on both sides of their joins."""
    return materialize(minhash.with_signatures(_shingled(spark, sf_dir)), "signatures")


def _asked(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return items.filter(F.col(key) % 20 == 0)


_A, _B = minhash.coefficients()
SHINGLES = r"""w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM documents),
w1 AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: ('0x' || substr(md5(array_to_string(words[i:i + 4], ' ')), 1, 8))::BIGINT))) AS shingles FROM w0)"""
SIGNED = f"""{SHINGLES},
w2 AS MATERIALIZED (SELECT *, CASE WHEN len(shingles) > 0 THEN list_transform(range(1, 101), lambda i: list_min(list_transform(shingles, lambda x: (({_A}::BIGINT[])[i] * x + ({_B}::BIGINT[])[i]) % 2147483647))) ELSE list_transform(range(1, 101), lambda i: 0) END::BIGINT[] AS signature FROM w1)"""
BANDED = f"""{SIGNED},
w3 AS (SELECT doc_id, shingles, unnest(range(0, 20)) AS band, signature FROM w2),
w4 AS (SELECT doc_id, band, ('0x' || substr(md5(array_to_string(signature[band * 5 + 1:band * 5 + 5], '|')), 1, 8))::BIGINT AS bucket FROM w3)"""


def _digest(values: str):
    return F.md5(F.array_join(F.transform(values, lambda x: x.cast("string")), "|").cast("binary"))


add("shingles", lambda s, d: _shingled(s, d).select("doc_id", F.size("shingles").cast("long").alias("n_shingles"), _digest("shingles").alias("digest")),
    f"WITH {SHINGLES} SELECT doc_id, len(shingles) AS n_shingles, md5(coalesce(array_to_string(shingles, '|'), '')) AS digest FROM w1")
add("minhash_signature", lambda s, d: _signed(s, d).select("doc_id", _digest("signature").alias("digest")),
    f"WITH {SIGNED} SELECT doc_id, md5(array_to_string(signature, '|')) AS digest FROM w2")
add("lsh_bands", lambda s, d: _signed(s, d).select("doc_id", F.posexplode(minhash.bands(F.col("signature"))).alias("band", "bucket")).select("doc_id", F.col("band").cast("long").alias("band"), "bucket"),
    f"WITH {BANDED} SELECT doc_id, band, bucket FROM w4")
add("lsh_classes", lambda s, d: minhash.classes(_signed(s, d)), f"WITH {SIGNED} SELECT doc_id, min(doc_id) OVER (PARTITION BY signature) AS class_id FROM w2")
add("lsh_pairs", lambda s, d: minhash.candidate_pairs(_signed(s, d)),
    f"WITH {BANDED}, r AS (SELECT min(doc_id) AS doc_id FROM w2 GROUP BY signature), b AS (SELECT * FROM w4 SEMI JOIN r USING (doc_id)) "
    "SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS bands_matched FROM b x JOIN b y ON x.band = y.band AND x.bucket = y.bucket AND x.doc_id < y.doc_id GROUP BY ALL")  # fmt: skip

_JACCARD = """CASE WHEN len(list_distinct(list_concat(q.shingles, i.shingles))) = 0 THEN 1 ELSE len(list_intersect(q.shingles, i.shingles)) / len(list_distinct(list_concat(q.shingles, i.shingles)))::DOUBLE END"""
LSH_TOP = f"""{BANDED}, h AS (SELECT DISTINCT x.doc_id AS query, y.doc_id AS item FROM w4 x JOIN w4 y USING (band, bucket) WHERE x.doc_id % 20 = 0 AND x.doc_id <> y.doc_id),
l0 AS (SELECT query, item, {_JACCARD} AS similarity FROM h JOIN w2 q ON q.doc_id = query JOIN w2 i ON i.doc_id = item),
l1 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM l0 QUALIFY rank <= 10)"""
EXACT_TOP = f"""{SHINGLES}, e0 AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM w1),
e1 AS (SELECT x.doc_id AS query, y.doc_id AS item, count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE AS similarity FROM e0 x JOIN e0 y USING (s) WHERE x.doc_id % 20 = 0 AND x.doc_id <> y.doc_id GROUP BY ALL),
e3 AS (SELECT * FROM e1 UNION ALL SELECT x.doc_id, y.doc_id, 1.0 FROM w1 x JOIN w1 y ON len(x.shingles) = 0 AND len(y.shingles) = 0 WHERE x.doc_id % 20 = 0 AND x.doc_id <> y.doc_id),
e2 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM e3 QUALIFY rank <= 10)"""


def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _shingled(spark, sf_dir)
    return tidy(minhash.exact_top_k(items, _asked(items)), 6)


def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = _signed(spark, sf_dir)
    return tidy(minhash.lsh_top_k(signed, _asked(signed)), 6)


def lsh_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _shingled(spark, sf_dir)
    return tidy(minhash.precision_recall(*minhash.both_top_k(items, _asked(items))), 6)


def lsh_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = _signed(spark, sf_dir)
    n = signed.agg(F.countDistinct("signature").cast("double").alias("n"))
    pairs = minhash.candidate_pairs(signed).agg(F.count(F.lit(1)).cast("double").alias("n_pairs"))
    return tidy(n.crossJoin(pairs).select("n", "n_pairs", *[e.alias(k) for k, e in minhash.efficiency(F.col("n"), F.col("n_pairs")).items()]))


_CAST = "query, item, rank::INT AS rank"
add("jaccard_topk", jaccard_topk, f"WITH {EXACT_TOP} SELECT {_CAST}, {sql.tidy(['similarity'], 6)} FROM e2")
add("lsh_topk", lsh_topk, f"WITH {LSH_TOP} SELECT {_CAST}, {sql.tidy(['similarity'], 6)} FROM l1")
add("lsh_precision_recall", lsh_precision_recall, f"""WITH {LSH_TOP}, {EXACT_TOP[len(SHINGLES) + 2 :]},
j AS (SELECT coalesce(e2.query, l1.query) AS query, count(e2.item) AS nr, count(l1.item) AS ng, count(*) FILTER (e2.item IS NOT NULL AND l1.item IS NOT NULL) AS nb FROM e2 FULL JOIN l1 ON e2.query = l1.query AND e2.item = l1.item GROUP BY 1)
SELECT count(*) AS n_queries, {sql.rounded("avg(nb / nullif(ng, 0)::DOUBLE)", 6)} AS precision, {sql.rounded("avg(nb / nullif(nr, 0)::DOUBLE)", 6)} AS recall FROM j""")
add("lsh_efficiency", lsh_efficiency, f"""WITH {BANDED}, r AS (SELECT min(doc_id) AS doc_id FROM w2 GROUP BY signature), b AS (SELECT * FROM w4 SEMI JOIN r USING (doc_id)),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.band = y.band AND x.bucket = y.bucket AND x.doc_id < y.doc_id),
c AS (SELECT (SELECT count(*) FROM r)::DOUBLE AS n, (SELECT count(*) FROM p)::DOUBLE AS n_pairs)
SELECT n, n_pairs, {sql.rounded("n * (n - 1) / 2")} AS all_pairs, {sql.rounded("100 * n_pairs / (n * (n - 1) / 2)")} AS candidate_percent, {sql.rounded("n * (n - 1) / 2 / n_pairs")} AS reduction FROM c""")


def query_similar(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """For the last window of every symbol whose number is divisible by 20, the days of other symbols whose states resemble it, with the bars' own columns."""
    daily = materialize(featured_bars(spark, sf_dir).select(*KEYS, "close", "next_3d_label", *SIGNALS), "daily-states")
    held = materialize(minhash.state_histories(daily, list(SIGNALS)), "state-histories")
    asked = _asked(held, "symbol").select("symbol", F.array_max("trade_date").alias("query_date"))
    return tidy(minhash.streamed_windows(held, asked, daily, k))


add("query_similar", query_similar)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with the last sma20, RSI and MACD."""
    bars = adapters.bars(spark, sf_dir)
    lines = ["RSI14", "macd1226"]
    measured = rolling.rolling_indicators(recursive.with_recursive(bars, lines), lines)
    return measured.select(*KEYS, "close", "volume", "sma20", F.col("RSI14").alias("rsi"), F.col("macd1226").alias("macd"))


def _closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What histories are made of, a row a day."""
    return adapters.bars(spark, sf_dir).select(*KEYS, "close", "volume")


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, closes and volumes of each symbol: the measures of a day follow from them."""
    return parcels.histories_of_trades(adapters.trades(spark, sf_dir))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured bars with outcomes, by market."""
    return patterns.outcomes(_measured(spark, sf_dir)).withColumn("market", adapters.market(F.col("trade_date")))


class _Histories:
    """The histories of a scale, computed once, and the patterns that their readers make of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.held = materialize(_histories(spark, sf_dir), "histories")
        self.few, self.names = histories.merged(self.held, DEFAULT.simhash.top_k)
        self.figures = materialize(histories.figures(self.few, adapters.MARKET_SPLIT).coalesce(1), "figures")
        self.stats = {r.market: r.asDict() for r in self.figures.collect()}  # a row a market

    def reader(self, only: str) -> histories.Reader:
        return histories.Reader(self.stats, adapters.MARKET_SPLIT, only)

    def patterns(self, only: str) -> DataFrame:
        return self.reader(only).rows(self.held)

    def latest(self) -> DataFrame:
        """Each symbol's latest target pattern of a known outcome."""
        return materialize(self.patterns("latest"), "latest")

    def library(self, merged: bool = False) -> dict:
        return {side: (self.few if merged else self.held, self.reader(side)) for side in ("lib", "tgt")}


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``all_patterns`` before their vectors, which figures of outcomes alone don't need."""
    return patterns.raw_patterns(_daily(spark, sf_dir))


def all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = patterns.pattern_vectors(patterns.raw_patterns(_daily(spark, sf_dir)))
    return materialize(out.withColumn("id", F.concat_ws("|", "symbol", "trade_date")), "patterns")


PLANES = vectors.hyperplanes(26, DEFAULT.simhash.band_bits * DEFAULT.simhash.n_bands, DEFAULT.simhash.seed)
_P = f"{sql.RECURSIVE}, {sql.PATTERNS}"


def pattern_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda k: F.get("vector", F.lit(k))
    found = all_patterns(spark, sf_dir).select(*KEYS, "market", "fwd_return", "fwd_down", *[v(k).alias(f"v{k}") for k in (0, 10, 19, 20, 21, 22, 23, 24, 25)], vectors.dot(F.col("vector"), F.col("vector")).alias("norm"))
    return tidy(found, 6)


add("pattern_vectors", pattern_vectors, f"""WITH RECURSIVE {_P} SELECT symbol, trade_date, market, {sql.rounded("fwd_return", 6)} AS fwd_return, fwd_down,
{", ".join(f"{sql.rounded(f'vector[{k + 1}]', 6)} AS v{k}" for k in (0, 10, 19, 20, 21, 22, 23, 24, 25))}, {sql.rounded("list_dot_product(vector, vector)", 6)} AS norm FROM patterns""")

add("standardize_stats", lambda s, d: tidy(patterns.market_stats(patterns.raw_patterns(_daily(s, d)))),
    f"WITH RECURSIVE {_P} SELECT market, {sql.tidy([f'{f}_{x}' for f in sql.SUMMARY for x in ('mean', 'sd')])} FROM q3")


def asof_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each symbol and quarter's end the latest pattern at or before it."""
    daily = patterns.outcomes(adapters.bars(spark, sf_dir))
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-19, 0)
    known = daily.withColumn("n", F.count("daily_return").over(w)).filter("n = 20").select(*KEYS)
    ends = F.explode(F.sequence(F.lit("1995-03-31").cast("date"), F.lit("2001-12-31").cast("date"), F.expr("INTERVAL 3 MONTHS"))).alias("query_date")
    return patterns.latest_pattern(known, daily.select("symbol").distinct().select("symbol", ends))


add("asof_pattern", asof_pattern, f"""WITH {sql.BARS}, d AS (SELECT symbol, trade_date, row_number() OVER {sql.BY_DATE} AS rn FROM bars WHERE close > 0), k AS (SELECT * FROM d WHERE rn >= 21),
e AS (SELECT symbol, unnest(generate_series(0, 27)) AS q FROM (SELECT DISTINCT symbol FROM d)),
f AS (SELECT symbol, least(DATE '1995-03-31' + to_months(3 * q::INT), last_day(DATE '1995-03-31' + to_months(3 * q::INT)))::DATE AS query_date FROM e)
SELECT f.symbol, f.query_date, k.trade_date AS pattern_date FROM f ASOF LEFT JOIN k ON f.symbol = k.symbol AND f.query_date >= k.trade_date""")

add("base_rate", lambda s, d: tidy(precedents.base_rate(_raw(s, d)), 6),
    f"WITH RECURSIVE {_P} SELECT market, count(*) AS n, {sql.rounded('avg(fwd_down)', 6)} AS p_down, {sql.rounded('avg(fwd_return)', 6)} AS mean_return FROM patterns WHERE fwd_down IS NOT NULL GROUP BY market")


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the share of toxic documents in each source."""
    docs = adapters.table(spark, sf_dir, "documents").join(adapters.table(spark, sf_dir, "labels"), "doc_id")
    counted = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic"))
    low, high = precedents.wilson(F.col("n_toxic"), F.col("n"))
    return tidy(counted.select("source", "n", "n_toxic", low.alias("ci_low"), high.alias("ci_high")), 6)


add("wilson_ci", wilson_ci, f"""WITH c AS (SELECT source, count(*) AS n, sum(toxic)::BIGINT AS n_toxic FROM documents JOIN labels USING (doc_id) GROUP BY source),
p AS (SELECT *, n_toxic / n::DOUBLE AS p, 1.96::DOUBLE AS z FROM c)
SELECT source, n, n_toxic, {sql.rounded("greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))", 6)} AS ci_low,
{sql.rounded("least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))", 6)} AS ci_high FROM p""")

FIGURES = [f"{s}_{c}" for s in ("lib", "tgt") for c in ("p_down", "ci_low", "ci_high", "excess", "mean_return", "worst_return", "avg_cosine")]
SCORES = ["risk_score", "confidence"]
LABELS = ["agreement", "label", "confidence_label", "pred_down", "actual_down"]


def verdicts_of_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _Histories(spark, sf_dir)
    return precedents.backtest(known.latest(), known.library(), known.figures, PLANES)


def verdicts_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _Histories(spark, sf_dir)
    library = known.library(merged=True)
    return precedents.walk_forward(library["tgt"], library, known.figures, PLANES, names=known.names)


_LATEST = "market = 'tgt' AND (symbol, trade_date) IN (SELECT (symbol, max(trade_date)) FROM known WHERE market = 'tgt' GROUP BY symbol)"
_WALK = "market = 'tgt'"


def _verdict_sql(asked: str, tail: str) -> str:
    return f"WITH RECURSIVE {_P}, {sql.verdicts(PLANES, asked)} {tail}"


add("precedent_summary", lambda s, d: tidy(verdicts_of_latest(s, d).select("symbol", "trade_date", "lib_n", "tgt_n", *FIGURES), 6),
    _verdict_sql(_LATEST, f"SELECT symbol, trade_date, lib_n, tgt_n, {sql.tidy(FIGURES, 6)} FROM verdicts"))
add("risk_fusion", lambda s, d: tidy(verdicts_of_latest(s, d).select("symbol", "trade_date", *SCORES, *LABELS)),
    _verdict_sql(_LATEST, f"SELECT symbol, trade_date, {sql.tidy(SCORES)}, {', '.join(LABELS)} FROM verdicts"))
add("backtest", lambda s, d: tidy(verdicts_walk_forward(s, d).select("symbol", "trade_date", "lib_n", "tgt_n", *SCORES, *LABELS)),
    _verdict_sql(_WALK, f"SELECT symbol, trade_date, lib_n, tgt_n, {sql.tidy(SCORES)}, {', '.join(LABELS)} FROM verdicts"))
_METRICS = f"""SELECT count(*) AS n_evaluated, count(*) FILTER (pred_down = 1 AND actual_down = 1) AS tp, count(*) FILTER (pred_down = 1 AND actual_down = 0) AS fp,
count(*) FILTER (pred_down = 0 AND actual_down = 1) AS fn, count(*) FILTER (pred_down = 0 AND actual_down = 0) AS tn, {sql.rounded("avg(actual_down)", 6)} AS base_rate_down, {sql.rounded("avg(fwd_return)", 6)} AS mean_return,
{sql.rounded("coalesce(avg(CASE WHEN label = 'SAFE' THEN 1 - actual_down END), 0)", 6)} AS safe_winrate, {sql.rounded("(tp + tn) / n_evaluated::DOUBLE", 6)} AS accuracy,
{sql.rounded("coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", 6)} AS precision_down, {sql.rounded("coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", 6)} AS recall_down FROM verdicts WHERE lib_n > 0 OR tgt_n > 0"""
add("backtest_metrics", lambda s, d: tidy(precedents.backtest_metrics(verdicts_walk_forward(s, d)), 6), _verdict_sql(_WALK, _METRICS))
add("backtest_by_label", lambda s, d: tidy(precedents.by_label(verdicts_walk_forward(s, d)), 6),
    _verdict_sql(_WALK, f"SELECT label, count(*) AS n, {sql.rounded('avg(actual_down)', 6)} AS p_down, {sql.rounded('avg(fwd_return)', 6)} AS mean_return FROM verdicts WHERE lib_n > 0 OR tgt_n > 0 GROUP BY label"))



def precedent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest library precedents of each symbol's latest target pattern."""
    known = _Histories(spark, sf_dir)
    return tidy(precedents.precedent_list(known.latest(), known.held, PLANES, "lib", 10, read=known.reader("lib")), 6)


add("precedent_list", precedent_list, _verdict_sql(_LATEST, f"SELECT query_id, item_id, {sql.tidy(['cosine', 'fwd_return'], 6)}, fwd_down, r::INT AS rank FROM lib3 WHERE r <= 10"))

_SAYS = "printf('%s risk %.1f: %d library precedents fell %.1f%% of the time, %d target precedents %.1f%%; the markets are %s.', label, risk_score, lib_n, 100 * lib_p_down, tgt_n, 100 * tgt_p_down, lower(agreement))"
add("alert_reason", lambda s, d: (v := verdicts_of_latest(s, d)).select("symbol", "trade_date", "label", precedents.reason(v).alias("reason")),
    _verdict_sql(_LATEST, f"SELECT symbol, trade_date, label, {_SAYS} AS reason FROM verdicts"))


def precedent_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten patterns of the target market most like each symbol's latest one, of all that came before it."""
    known = _Histories(spark, sf_dir)
    found, named = streamed_top_k(known.held, known.latest(), 10, earlier=True, read=known.reader("tgt"))
    return tidy(named.join(found, "query").select("query_id", "item_id", "cosine", "rank"), 6)


add("precedent_exact", precedent_exact, f"""WITH RECURSIVE {_P}, k AS MATERIALIZED (SELECT * FROM patterns WHERE market = 'tgt' AND fwd_down IS NOT NULL), a AS (SELECT * FROM k WHERE (symbol, trade_date) IN (SELECT (symbol, max(trade_date)) FROM k GROUP BY symbol)),
t AS (SELECT a.id AS query_id, k.id AS item_id, list_dot_product(a.vector, k.vector) AS cosine FROM a JOIN k ON k.trade_date < a.trade_date)
SELECT query_id, item_id, {sql.rounded("cosine", 6)} AS cosine, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS r FROM t) WHERE r <= 10""")


def build_store(spark: SparkSession, sf_dir: str, path: str) -> serving.PrecedentStore:
    return serving.PrecedentStore.build_packed(_histories(spark, sf_dir), adapters.MARKET_SPLIT, PLANES, path)


def _served(spark: SparkSession, sf_dir: str) -> serving.PrecedentStore:
    return build_store(spark, sf_dir, scratch_path(spark, "precedent-store"))


def _quarter_ends(spark: SparkSession, symbols: DataFrame) -> DataFrame:
    ends = F.explode(F.sequence(F.lit("1999-03-31").cast("date"), F.lit("2001-12-31").cast("date"), F.expr("INTERVAL 3 MONTHS"))).alias("query_date")
    return symbols.select("symbol").distinct().select("symbol", ends)


def served_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardised returns behind the last pattern of each symbol up to every quarter's end, from the stored index."""
    store = _served(spark, sf_dir)
    shapes = store.shapes(_quarter_ends(spark, store.symbols()))
    return tidy(shapes.select("symbol", "query_date", "pattern_date", *[F.get("shape", F.lit(k)).alias(f"z{k}") for k in (0, 10, 19)]), 6)


_QUARTERS = """sq AS (SELECT symbol, unnest(generate_series(0, 11)) AS q FROM (SELECT DISTINCT symbol FROM patterns WHERE market = 'tgt')),
se AS (SELECT symbol, least(DATE '1999-03-31' + to_months(3 * q::INT), last_day(DATE '1999-03-31' + to_months(3 * q::INT)))::DATE AS query_date FROM sq),
sp AS (SELECT se.symbol, se.query_date, p.trade_date AS pattern_date, p.vector FROM se ASOF JOIN (SELECT * FROM patterns WHERE market = 'tgt') p ON se.symbol = p.symbol AND se.query_date >= p.trade_date)"""
add("served_shapes", served_shapes, f"""WITH RECURSIVE {_P}, {_QUARTERS} SELECT symbol, query_date, pattern_date, {", ".join(f"{sql.rounded(f'vector[{k + 1}]', 6)} AS z{k}" for k in (0, 10, 19))} FROM sp""")
add("served_dates", lambda s, d: _served(s, d).dates().groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last")),
    f"WITH RECURSIVE {_P} SELECT symbol, count(*) AS n, min(trade_date) AS first, max(trade_date) AS last FROM patterns WHERE market = 'tgt' GROUP BY symbol")


def served_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the stored index to a question for every symbol and quarter's end: the verdict and why."""
    store = _served(spark, sf_dir)
    return tidy(store.ask(_quarter_ends(spark, store.symbols())).select("symbol", "query_date", "pattern_date", "close", "lib_n", "tgt_n", "risk_score", "label", "agreement", "reason"))


add("served_alerts", served_alerts)

_FIGURES_SQL = {"n_pattern": "count(*)", "median_fwd_return": "quantile_cont(fwd_return, 0.5)", "base_rate_down": "avg(fwd_down)", "p_up": "avg((fwd_return > 0)::INT)", "mean_fwd_return": "avg(fwd_return)", "std_fwd_return": "stddev_samp(fwd_return)",
    "volatility_fwd": "avg(abs(fwd_return))", "fwd_return_p95": "quantile_cont(fwd_return, 0.95)", "fwd_return_p05": "quantile_cont(fwd_return, 0.05)"}
add("pattern_distribution", lambda s, d: tidy(precedents.distribution(_raw(s, d)), 6),
    f"WITH RECURSIVE {_P} SELECT market, {', '.join(e + ' AS ' + c if c == 'n_pattern' else sql.rounded(e, 6) + ' AS ' + c for c, e in _FIGURES_SQL.items())} FROM patterns WHERE fwd_down IS NOT NULL GROUP BY market")

_CHECKS = ", ".join(f"('{m}', {t}::DOUBLE, {str(r).lower()})" for m, t, r in precedents.SANITY_CHECKS)
_DIST = """SELECT market, avg(fwd_down) AS base_rate_down, avg((fwd_return > 0)::INT) AS p_up, avg(fwd_return) AS mean_fwd_return, stddev_samp(fwd_return) AS std_fwd_return, avg(abs(fwd_return)) AS volatility_fwd,
quantile_cont(fwd_return, 0.95) AS fwd_return_p95, quantile_cont(fwd_return, 0.05) AS fwd_return_p05 FROM patterns WHERE fwd_down IS NOT NULL GROUP BY market"""
add("sanity_check", lambda s, d: tidy(precedents.sanity_check(_raw(s, d)), 6), f"""WITH RECURSIVE {_P}, s0 AS ({_DIST}), s1 AS (UNPIVOT s0 ON * EXCLUDE (market) INTO NAME metric VALUE value),
s2 AS (SELECT metric, max(value) FILTER (market = 'lib') AS lib, max(value) FILTER (market = 'tgt') AS tgt FROM s1 GROUP BY metric),
s3 AS (SELECT s2.*, CASE WHEN rel THEN abs(lib - tgt) / (abs(lib) + 1e-9) ELSE abs(lib - tgt) END AS diff, tolerance FROM s2 JOIN (VALUES {_CHECKS}) c(metric, tolerance, rel) USING (metric)),
s4 AS (SELECT *, diff <= tolerance AS ok FROM s3)
SELECT metric, {sql.tidy(["lib", "tgt", "diff", "tolerance"], 6)}, ok, CASE WHEN sum(ok::INT) OVER () >= 6 THEN 'GOOD' WHEN sum(ok::INT) OVER () >= 5 THEN 'FAIR' ELSE 'POOR' END AS level FROM s4""")


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.table(spark, sf_dir, "embeddings")
    return items.select(F.col("vec_id").alias("id"), vectors.unit(vectors.doubles(F.col("embedding"))).alias("vector"), F.col("vec_id").alias("symbol"), F.lit(None).cast("date").alias("trade_date"),
                        F.lit(0.0).alias("fwd_return"), F.lit(0).alias("fwd_down"))


EMBEDDING_PLANES = vectors.hyperplanes(64, 120, 42)
_UNIT = "u AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS vector FROM embeddings)"
_UB = f"{_UNIT}, ub AS MATERIALIZED (SELECT id, vector, {sql.buckets('vector', EMBEDDING_PLANES, 10)} AS band_buckets FROM u), ue AS (SELECT id, unnest(band_buckets) AS bucket FROM ub)"


def simhash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precedents.simhash_index(_embedded(spark, sf_dir), EMBEDDING_PLANES).select("id", F.explode("band_buckets").alias("bucket"))


def cosine_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _embedded(spark, sf_dir)
    return tidy(precedents.exact_top_k(_asked(items, "id"), items, 10), 6)


def cosine_topk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = precedents.simhash_index(_embedded(spark, sf_dir), EMBEDDING_PLANES)
    asked = _asked(index, "id")
    return tidy(precedents.bucket_top_k(asked, index, 10, not_itself=True).select("query_id", "item_id", "cosine", "rank"), 6)


add("simhash_buckets", simhash_buckets, f"WITH {_UB} SELECT id, bucket FROM ue")
_RANKED = f"SELECT query_id, item_id, {sql.rounded('cosine', 6)} AS cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS rank FROM t) WHERE rank <= 10"
add("cosine_topk_exact", cosine_topk_exact, f"WITH {_UNIT}, t AS (SELECT a.id AS query_id, b.id AS item_id, list_dot_product(a.vector, b.vector) AS cosine FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 20 = 0) {_RANKED}")
add("cosine_topk_lsh", cosine_topk_lsh, f"""WITH {_UB}, h AS (SELECT DISTINCT a.id AS query_id, b.id AS item_id FROM ue a JOIN ue b USING (bucket) WHERE a.id % 20 = 0 AND a.id <> b.id),
t AS (SELECT query_id, item_id, list_dot_product(a.vector, b.vector) AS cosine FROM h JOIN u a ON a.id = query_id JOIN u b ON b.id = item_id) {_RANKED}""")
