"""Precedents: past patterns like a present one, what followed them, and the risk that they suggest.

Everything is a column: a query is a row, so one query and a walk-forward backtest are the same plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, FusionConfig, SimHashConfig
from ..functions import vectors
from ..sources.scratch import materialize
from . import quality
from .streamed import streamed_top_k, summarised_top_k


def simhash_index(items: DataFrame, planes: np.ndarray, config: SimHashConfig = DEFAULT.simhash) -> DataFrame:
    """``items`` with ``band_buckets``."""
    return vectors.with_bit_buckets(items, planes, config.band_bits)


#: Rows of either side that are multiplied at once; larger buckets are cut into chunks.
BLOCK = 4096


def _chunked(rows: DataFrame, other: DataFrame, name: str, block: int) -> DataFrame:
    """``rows`` with their chunk ``name`` of a bucket, and a copy of each for every chunk that the other side has of it."""
    sizes = lambda df: df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).alias("chunks")).filter("chunks > 1")
    own, others = sizes(rows).withColumnRenamed("chunks", "_own"), sizes(other).withColumnRenamed("chunks", "_others")
    placed = rows.join(own, "bucket", "left").withColumn(name, F.pmod(F.xxhash64("id"), F.coalesce("_own", F.lit(1).cast("long"))))
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_others", F.lit(1).cast("long")) - 1)
    return placed.join(others, "bucket", "left").withColumn("other", F.explode(copies)).drop("_own", "_others")


def _best_of_block(queries: pa.RecordBatch, items: pa.RecordBatch, k: int, earlier: bool, not_itself: bool) -> pa.RecordBatch | None:
    """The ``k`` most similar items of each query, and what is as similar but for rounding."""

    def matrix(side: pa.RecordBatch) -> np.ndarray:
        return side.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(side.num_rows, -1)

    a, b = matrix(queries), matrix(items)
    if not a.shape[1] or a.shape[1] != b.shape[1]:
        return None
    cosine = a @ b.T
    if earlier:
        days = [side.column("trade_date").cast(pa.int32()).to_numpy(zero_copy_only=False) for side in (queries, items)]
        cosine[days[0][:, None] <= days[1]] = -np.inf
    if not_itself:
        ids = [side.column("id").to_numpy(zero_copy_only=False) for side in (queries, items)]
        cosine[ids[0][:, None] == ids[1]] = -np.inf
    last = max(0, cosine.shape[1] - k)
    least = np.partition(cosine, last, axis=1)[:, last]
    row, place = np.nonzero((cosine >= least[:, None] - 1e-9) & np.isfinite(cosine))
    exact = np.zeros(len(row))
    for d in range(a.shape[1]):  # in the order of the dimensions, whatever the shape of the block
        exact += a[row, d] * b[place, d]
    return pa.RecordBatch.from_arrays(
        [queries.column("id").take(pa.array(row)), items.column("id").take(pa.array(place)), pa.array(exact), items.column("fwd_return").take(pa.array(place)), items.column("fwd_down").take(pa.array(place))],
        ["query_id", "item_id", "cosine", "fwd_return", "fwd_down"],
    )


def bucket_top_k(queries: DataFrame, library: DataFrame, k: int, earlier: bool = False, not_itself: bool = False, block: int | None = None) -> DataFrame:
    """``query_id, item_id, cosine, fwd_return, fwd_down, rank``: of each query the ``k`` most similar items that share a bucket.

    Both sides have ``id, trade_date, vector, band_buckets``, the library ``fwd_return`` and ``fwd_down``, too. With
    ``earlier`` only items before the query count; ties go by item. A bucket is one matrix product, cut into blocks
    where it is large, and of each block only the ``k`` best of every query leave the task: pairs are never rows.
    """
    columns = ["id", F.col("trade_date").cast("date").alias("trade_date"), F.transform("vector", lambda x: x.cast("double")).alias("vector")]
    q = queries.select(*columns, F.lit(None).cast("double").alias("fwd_return"), F.lit(None).cast("int").alias("fwd_down"), F.explode("band_buckets").alias("bucket"))
    x = library.select(*columns, F.col("fwd_return").cast("double").alias("fwd_return"), F.col("fwd_down").cast("int").alias("fwd_down"), F.explode("band_buckets").alias("bucket"))
    slim, block = [side.select("id", "bucket") for side in (q, x)], block or BLOCK
    asked = _chunked(q, slim[1], "own", block).withColumn("key", F.xxhash64("bucket", F.col("own"), F.col("other"))).withColumn("asks", F.lit(True))
    given = _chunked(x, slim[0], "own", block).withColumn("key", F.xxhash64("bucket", F.col("other"), F.col("own"))).withColumn("asks", F.lit(False))
    kept = ["key", "asks", "id", "trade_date", "vector", "fwd_return", "fwd_down"]

    def run(batches):
        key, held = None, {True: [], False: []}

        def done():
            if held[True] and held[False]:
                sides = [pa.Table.from_batches(held[side]).combine_chunks().to_batches()[0] for side in (True, False)]
                found = _best_of_block(*sides, k, earlier, not_itself)
                if found is not None and found.num_rows:
                    yield found

        for batch in batches:
            keys, asks = batch.column("key").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])])) if len(keys) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[lo] != key:
                    yield from done()
                    key, held = keys[lo], {True: [], False: []}
                held[bool(asks[lo])].append(batch.slice(lo, hi - lo))
        yield from done()

    kind = dict(library.dtypes)["id"]
    blocks = asked.select(*kept).unionByName(given.select(*kept)).repartition("key").sortWithinPartitions("key", "asks")
    found = blocks.mapInArrow(run, f"query_id {kind}, item_id {kind}, cosine double, fwd_return double, fwd_down int")
    return top_k(found.dropDuplicates(["query_id", "item_id"]), k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar of each query; ties by item."""
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact_top_k(queries: DataFrame, library: DataFrame, k: int, block: int = BLOCK, earlier: bool = False) -> DataFrame:
    """``query_id, item_id, cosine, rank`` against the whole library but the query itself, in blocks: one matrix product for each two of them.

    Both sides have ``id`` and ``vector``; with ``earlier`` also ``trade_date``, and only items before the query count.
    Queries meet every block of the library, so this is for a stated set of them; a task's memory is bounded.
    """
    plain = {"trade_date": F.col("trade_date") if earlier else F.lit(None).cast("date"), "fwd_return": F.lit(None).cast("double"), "fwd_down": F.lit(None).cast("int"), "band_buckets": F.array(F.lit("all"))}
    sides = [side.select("id", "vector", *[c.alias(n) for n, c in plain.items()]) for side in (queries, library)]
    return bucket_top_k(*sides, k, earlier=earlier, not_itself=True, block=block).select("query_id", "item_id", "cosine", "rank")


def summarise(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """What followed the precedents of each query."""
    return ranked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("fwd_down").alias("n_down"), F.avg("fwd_return").alias("mean_return"),
        F.min("fwd_return").alias("worst_return"), F.avg("cosine").alias("avg_cosine"),
    )


def base_rate(patterns: DataFrame) -> DataFrame:
    """By market: patterns of a known outcome, the share that fell and the mean return."""
    known = patterns.filter("fwd_down IS NOT NULL")
    return known.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd_down").alias("p_down"), F.avg("fwd_return").alias("mean_return"))


def wilson(n_down: Column, n: Column, z: float = DEFAULT.fusion.z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within [0, 1]; 0 and 0 without observations."""
    p = F.try_divide(n_down, n)
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (middle - half) / scale), F.least(F.lit(1.0), (middle + half) / scale)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def completed(summary: DataFrame, base: Column, prefix: str, config: FusionConfig = DEFAULT.fusion) -> list[Column]:
    """Columns ``prefix_...`` of a market's summary, zeros where there was no precedent."""
    n = F.coalesce(F.col(f"{prefix}_n"), F.lit(0))
    down = F.coalesce(F.col(f"{prefix}_n_down"), F.lit(0))
    low, high = wilson(down, F.nullif(n, F.lit(0)), config.z)
    p = F.when(n > 0, down / F.nullif(n, F.lit(0))).otherwise(0.0)
    return [
        n.alias(f"{prefix}_n"), p.alias(f"{prefix}_p_down"), F.coalesce(low, F.lit(0.0)).alias(f"{prefix}_ci_low"), F.coalesce(high, F.lit(0.0)).alias(f"{prefix}_ci_high"),
        F.when(n > 0, p - base).otherwise(0.0).alias(f"{prefix}_excess"),
        *[F.coalesce(F.col(f"{prefix}_{c}"), F.lit(0.0)).alias(f"{prefix}_{c}") for c in ("mean_return", "worst_return", "avg_cosine")],
    ]


def fuse(df: DataFrame, config: FusionConfig = DEFAULT.fusion) -> DataFrame:
    """Risk of ``lib_`` and ``tgt_`` summaries: a score of 0 to 100, its label, the confidence and whether both agree.

    The target market's weight is raised always. Labels go by the score before rounding; a side without precedents
    has no weight, and without any the score is 50.
    """
    c = F.col

    def risk(p: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 100 * c(f"{p}_excess")))

    def trust(p: str) -> Column:
        width = F.greatest(F.lit(0.0), c(f"{p}_ci_high") - c(f"{p}_ci_low"))
        return F.when(c(f"{p}_n") > 0, c(f"{p}_n") / (c(f"{p}_n") + config.saturation) * F.greatest(F.lit(0.0), 1 - width)).otherwise(0.0)

    weighed = df.withColumns({"lib_risk": risk("lib"), "tgt_risk": risk("tgt"), "lib_trust": trust("lib"), "tgt_trust": trust("tgt")})
    weight = c("lib_trust") + config.target_priority * c("tgt_trust")
    known = weight > 1e-9
    score = F.when(known, F.try_divide(c("lib_trust") * c("lib_risk") + config.target_priority * c("tgt_trust") * c("tgt_risk"), weight)).otherwise(50.0)
    both = F.when(known, (c("lib_trust") * c("lib_n") + c("tgt_trust") * c("tgt_n")) / F.greatest(F.lit(1), c("lib_n") + c("tgt_n"))).otherwise(0.0)
    weak = (F.abs("lib_excess") < 1e-9) | (F.abs("tgt_excess") < 1e-9)
    agreement = F.when(weak, "NEUTRAL").when(c("lib_excess") * c("tgt_excess") > 0, "ALIGNED").otherwise("CONFLICT")
    fused = weighed.withColumns({"risk_score": score, "_both": both, "agreement": agreement})
    confidence = F.when(c("agreement") == "ALIGNED", F.least(F.lit(1.0), c("_both") * config.aligned_factor)).when(c("agreement") == "CONFLICT", c("_both") * config.conflict_factor).otherwise(c("_both"))
    out = fused.withColumn("confidence", confidence).drop("_both")
    return out.withColumns({
        "label": F.when(c("risk_score") >= config.strong, "STRONG").when(c("risk_score") >= config.caution, "CAUTION").otherwise("SAFE"),
        "confidence_label": F.when(c("confidence") >= config.high_confidence, "HIGH").when(c("confidence") >= config.medium_confidence, "MEDIUM").otherwise("LOW"),
    })


def reason(df: DataFrame) -> Column:
    """One sentence on a verdict."""
    c = F.col
    return F.format_string(
        "%s risk %.1f: %d library precedents fell %.1f%% of the time, %d target precedents %.1f%%; the markets are %s.",
        c("label"), c("risk_score"), c("lib_n"), 100 * c("lib_p_down"), c("tgt_n"), 100 * c("tgt_p_down"), F.lower("agreement"),
    )


def precedent_list(asked: DataFrame, library: DataFrame, planes: np.ndarray, side: str, k: int, simhash: SimHashConfig = DEFAULT.simhash, read: Callable | None = None) -> DataFrame:
    """``query_id, item_id, cosine, fwd_return, fwd_down, rank`` of the ``k`` nearest precedents of one market, those of the target market earlier than the query.

    ``library`` has that market's patterns of a known outcome, or what ``read`` makes them of.
    """
    found, named = streamed_top_k(library, asked, k, planes, simhash.band_bits, side == "tgt", read)
    return named.join(found, "query").drop("query")


def backtest(asked: DataFrame, library: dict[str, tuple[DataFrame, Callable | None]], rates: DataFrame, planes: np.ndarray, simhash: SimHashConfig = DEFAULT.simhash, fusion: FusionConfig = DEFAULT.fusion) -> DataFrame:
    """Walk-forward verdicts of ``asked`` (target patterns of a known outcome), one row each.

    Library precedents may be any of the library, which lies before; target precedents must be earlier than the query.
    ``asked`` has ``id, symbol, trade_date, fwd_return, fwd_down, vector``, ``library`` by market the rows of a known outcome
    and what makes patterns of them, ``rates`` each market's ``p_down``.
    """
    out = asked.drop("vector")
    for side in ("lib", "tgt"):
        rows, read = library[side]
        found, named = streamed_top_k(rows, asked, simhash.top_k, planes, simhash.band_bits, side == "tgt", read)
        summary = named.join(summarise(found, "query"), "query").withColumnRenamed("query_id", "id")
        out = out.join(summary.select("id", *[F.col(c).alias(f"{side}_{c}") for c in summary.columns if c not in ("query", "id")]), "id", "left")
    return _verdicts(out, rates, fusion)


def walk_forward(asked: DataFrame | tuple[DataFrame, Callable | None], library: dict[str, tuple[DataFrame, Callable | None]], rates: DataFrame, planes: np.ndarray, simhash: SimHashConfig = DEFAULT.simhash, fusion: FusionConfig = DEFAULT.fusion, names: DataFrame | None = None) -> DataFrame:
    """As ``backtest``, for questions as many as the library has rows; ``asked`` are these, or rows and what makes questions of them.

    With ``names`` questions and library are ``merged`` histories, and each symbol gets the verdicts of its one.
    """
    found = _verdicts(summarised_top_k(asked if isinstance(asked, tuple) else (asked, None), library, simhash.top_k, planes, simhash.band_bits, ("tgt",)), rates, fusion)
    if names is None:
        return found
    every = found.withColumnRenamed("symbol", "one").join(names.withColumnRenamed("one", "named"), F.col("one").eqNullSafe(F.col("named")))
    return every.withColumn("query_id", F.concat_ws("|", "symbol", "trade_date")).select(found.columns)


def _verdicts(summaries: DataFrame, rates: DataFrame, fusion: FusionConfig) -> DataFrame:
    """The verdict of each query from what followed its precedents."""
    out = summaries
    for side in ("lib", "tgt"):
        out = out.crossJoin(F.broadcast(rates.filter(F.col("market") == side).select(F.col("p_down").alias(f"{side}_base"))))
    sides = [column for side in ("lib", "tgt") for column in completed(out, F.col(f"{side}_base"), side, fusion)]
    fused = fuse(out.select(F.col("id").alias("query_id"), "symbol", "trade_date", "fwd_return", F.col("fwd_down").alias("actual_down"), *sides), fusion)
    return fused.withColumn("pred_down", (F.floor(F.col("risk_score") * 10 + 0.5) / 10 >= 50).cast("int"))


def backtest_metrics(verdicts: DataFrame) -> DataFrame:
    """Confusion, accuracy, precision and recall of the verdicts that had a precedent; shares without a base are 0."""
    seen = verdicts.filter("lib_n > 0 OR tgt_n > 0")
    hit = lambda p, a: F.count_if((F.col("pred_down") == p) & (F.col("actual_down") == a))
    counted = seen.agg(
        F.count(F.lit(1)).alias("n_evaluated"), hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"),
        F.avg("actual_down").alias("base_rate_down"), F.avg("fwd_return").alias("mean_return"),
        F.avg(F.when(F.col("label") == "SAFE", 1 - F.col("actual_down"))).alias("safe_winrate"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    return counted.select(
        "n_evaluated", "tp", "fp", "fn", "tn", "base_rate_down", "mean_return", F.coalesce("safe_winrate", F.lit(0.0)).alias("safe_winrate"),
        share(c("tp") + c("tn"), c("n_evaluated")).alias("accuracy"), share(c("tp"), c("tp") + c("fp")).alias("precision_down"), share(c("tp"), c("tp") + c("fn")).alias("recall_down"),
    )


def by_label(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("lib_n > 0 OR tgt_n > 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("actual_down").alias("p_down"), F.avg("fwd_return").alias("mean_return"))


#: Metric, tolerance, and whether the difference is relative.
SANITY_CHECKS = (
    ("base_rate_down", 0.10, False), ("p_up", 0.10, False), ("mean_fwd_return", 0.01, False), ("std_fwd_return", 0.5, True),
    ("volatility_fwd", 0.5, True), ("fwd_return_p95", 0.5, True), ("fwd_return_p05", 0.5, True),
)


def distribution(patterns: DataFrame) -> DataFrame:
    """By market the figures that the sanity check compares."""
    r = F.col("fwd_return")
    known = materialize(patterns.filter("fwd_down IS NOT NULL").select("market", "fwd_return", "fwd_down"), "outcomes")
    ranked = quality.quantiles(known, {"fwd_return": r}, [0.5, 0.95, 0.05], ("market",))
    q = ranked.select("market", *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("median_fwd_return", "fwd_return_p95", "fwd_return_p05"))])
    figures = known.groupBy("market").agg(
        F.count(F.lit(1)).alias("n_pattern"),
        F.avg("fwd_down").alias("base_rate_down"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("p_up"), F.avg(r).alias("mean_fwd_return"),
        F.stddev_samp(r).alias("std_fwd_return"), F.avg(F.abs(r)).alias("volatility_fwd"),
    )
    names = ["market", "n_pattern", "median_fwd_return", "base_rate_down", "p_up", "mean_fwd_return", "std_fwd_return", "volatility_fwd", "fwd_return_p95", "fwd_return_p05"]
    return figures.join(q, "market", "left").select(*names)  # a row a market


def sanity_check(patterns: DataFrame) -> DataFrame:
    """One row for each metric: both markets, the difference, whether it is tolerated, and the overall level."""
    stats = distribution(patterns)
    rows = stats.select("market", F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m, _, _ in SANITY_CHECKS]), F.array(*[F.col(m) for m, _, _ in SANITY_CHECKS]))).alias("metric", "value"))
    wide = rows.groupBy("metric").agg(F.max(F.when(F.col("market") == "lib", F.col("value"))).alias("lib"), F.max(F.when(F.col("market") == "tgt", F.col("value"))).alias("tgt"))
    tolerance, relative = F.lit(None), F.lit(False)
    for metric, limit, is_relative in SANITY_CHECKS:
        tolerance = F.when(F.col("metric") == metric, limit).otherwise(tolerance)
        relative = F.when(F.col("metric") == metric, is_relative).otherwise(relative)
    apart = F.abs(F.col("lib") - F.col("tgt"))
    checked = wide.withColumn("diff", F.when(relative, apart / (F.abs("lib") + 1e-9)).otherwise(apart)).withColumn("tolerance", tolerance.cast("double"))
    checked = checked.withColumn("ok", F.col("diff") <= F.col("tolerance"))
    n_ok = F.sum(F.col("ok").cast("int")).over(Window.partitionBy(F.lit(0)))  # seven rows
    total = len(SANITY_CHECKS)
    return checked.withColumn("level", F.when(n_ok >= total - 1, "GOOD").when(n_ok >= total - 2, "FAIR").otherwise("POOR"))
