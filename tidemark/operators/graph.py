"""Correlation graph: returns, Pearson edges, degrees, PageRank, components and communities.

Everything is a long table, and every algorithm is the same at every size. PageRank's sums may be iterated in one place
where the graph has at most ``SMALL`` edges: the same sums, without a job for each iteration.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, GraphConfig
from ..functions.features import log_return
from ..sources.scratch import materialize
from .components import connected

SMALL = 500_000


def return_grid(closes: DataFrame, config: GraphConfig = DEFAULT.graph) -> DataFrame:
    """``symbol, trade_date, ret``: log returns by symbol, on dates on which enough symbols have one."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    returns = closes.select("symbol", "trade_date", log_return(F.col("close"), F.lag("close").over(w)).alias("ret")).filter("ret IS NOT NULL")
    by_day = returns.groupBy("trade_date").agg(F.countDistinct("symbol").alias("_n"))
    n = returns.agg(F.countDistinct("symbol").alias("_all"))
    days = by_day.crossJoin(F.broadcast(n)).filter(F.col("_n") >= F.floor(F.col("_all") * config.min_symbols_a_day)).select("trade_date")  # one row
    return returns.join(days, "trade_date").select("symbol", "trade_date", "ret")


def correlations(returns: DataFrame, min_periods: int = DEFAULT.graph.min_periods) -> DataFrame:
    """``a, b, corr, n`` with a < b: Pearson over the common calendar, gaps filled with the last return, then 0.

    Pairs of a constant series and calendars shorter than ``min_periods`` have no correlation.
    """
    days, symbols = returns.select("trade_date").distinct(), returns.select("symbol").distinct()
    grid = symbols.join(days).join(returns, ["symbol", "trade_date"], "left")  # the matrix itself, in long form
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.select("symbol", "trade_date", F.coalesce(F.last("ret", ignorenulls=True).over(w), F.lit(0.0)).alias("x"))
    left = filled.select(F.col("symbol").alias("a"), "trade_date", "x")
    right = filled.select(F.col("symbol").alias("b"), "trade_date", F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    pairs = left.join(right, "trade_date").filter("a < b").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"),
    )
    return pairs.filter(F.col("n") >= min_periods).select("a", "b", F.try_divide(F.col("_c"), F.col("_x") * F.col("_y")).alias("corr"), "n")


def edges(pairs: DataFrame, threshold: float = DEFAULT.graph.corr_threshold) -> DataFrame:
    """``src, dst, weight`` of the pairs whose correlation is at least the threshold, either sign."""
    return pairs.filter(F.abs("corr") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("corr").alias("weight"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("src", "dst", "weight").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``symbol, degree, strength`` of every node; 0 for isolated ones."""
    sums = both_ways(links).groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    return nodes.join(sums, nodes["symbol"] == sums["src"], "left").select("symbol", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def pagerank(nodes: DataFrame, links: DataFrame, config: GraphConfig = DEFAULT.graph, tolerance: float | None = None) -> DataFrame:
    """``symbol, pagerank_score, rank``: weighted, undirected; isolated nodes spread their mass evenly.

    Stops when the change over all nodes is below their number times the tolerance; raises if that doesn't happen.
    """
    tolerance = config.tolerance if tolerance is None else tolerance
    two_way = materialize(both_ways(links), "links")
    n_links = two_way.count()
    if n_links <= SMALL and nodes.count() <= SMALL:
        scores = _pagerank_in_place(nodes, two_way, config, tolerance)
    else:
        scores = _pagerank_by_joins(nodes, two_way, config, tolerance)
    return numbered(scores, [F.desc("pagerank_score"), F.asc("symbol")], "rank")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place in a global order, from 1: a range partition, and the sizes of the partitions before."""
    ordered = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    held = materialize(ordered, "ordered")
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    return held.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_place") + 1).cast("int")).drop("_part", "_place", "_before")


def _pagerank_in_place(nodes: DataFrame, two_way: DataFrame, config: GraphConfig, tolerance: float) -> DataFrame:
    spark: SparkSession = nodes.sparkSession
    names = sorted(r.symbol for r in nodes.select("symbol").distinct().collect())  # counted to be few
    place = {s: k for k, s in enumerate(names)}
    n = len(names)
    rows = two_way.collect()
    src, dst = np.array([place[r.src] for r in rows], int), np.array([place[r.dst] for r in rows], int)
    weight = np.array([r.weight for r in rows], float)
    out = np.bincount(src, weight, n) if rows else np.zeros(n)
    x = np.full(n, 1 / max(n, 1))
    for _ in range(config.max_iterations):
        given = np.bincount(dst, x[src] * weight / out[src], n) if rows else np.zeros(n)
        new = config.damping * (given + x[out == 0].sum() / n) + (1 - config.damping) / n
        done = np.abs(new - x).sum() < n * tolerance
        x = new
        if done:
            break
    else:
        if n:
            raise RuntimeError(f"no convergence in {config.max_iterations} iterations")
    return spark.createDataFrame([(s, float(v)) for s, v in zip(names, x, strict=True)], f"symbol {dict(nodes.dtypes)['symbol']}, pagerank_score double")


def _pagerank_by_joins(nodes: DataFrame, two_way: DataFrame, config: GraphConfig, tolerance: float) -> DataFrame:
    n = nodes.count()
    out = two_way.groupBy("src").agg(F.sum("weight").alias("_out"))
    shares = materialize(two_way.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share")), "shares")
    x = materialize(nodes.join(out, nodes["symbol"] == out["src"], "left").select("symbol", F.col("_out").isNull().alias("idle"), F.lit(1.0 / n).alias("score")), "scores")
    for _ in range(config.max_iterations):
        idle = x.filter("idle").agg(F.sum("score")).first()[0] or 0.0
        given = shares.join(x, shares["src"] == x["symbol"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("given"))
        moved = x.join(given, x["symbol"] == given["dst"], "left").select(
            "symbol", "idle", F.col("score").alias("before"), (config.damping * (F.coalesce("given", F.lit(0.0)) + idle / n) + (1 - config.damping) / n).alias("score")
        )
        x = materialize(moved, "scores")
        if x.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] < n * tolerance:
            return x.select("symbol", F.col("score").alias("pagerank_score"))
        x = x.drop("before")
    raise RuntimeError(f"no convergence in {config.max_iterations} iterations")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``symbol, component``: the smallest symbol reachable."""
    roots = connected(links, "src", "dst")
    return nodes.join(roots, nodes["symbol"] == roots["node"], "left").select("symbol", F.coalesce("root", "symbol").alias("component"))


def modularity(links: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: weighted modularity of ``membership(symbol, community_id)``; NULL without edges."""
    m = membership.select("symbol", "community_id")
    of = lambda side: m.select(F.col("symbol").alias(side), F.col("community_id").alias(f"{side}_c"))
    joined = links.join(of("src"), "src").join(of("dst"), "dst")
    inside = joined.groupBy(F.col("src_c").alias("c")).agg(F.sum(F.when(F.col("src_c") == F.col("dst_c"), F.col("weight")).otherwise(0.0)).alias("inside"), F.lit(0.0).alias("strength"))
    strength = both_ways(links).join(of("src"), "src").groupBy(F.col("src_c").alias("c")).agg(F.lit(0.0).alias("inside"), F.sum("weight").alias("strength"))
    by_community = inside.unionByName(strength).groupBy("c").agg(F.sum("inside").alias("inside"), F.sum("strength").alias("strength"))
    total = by_community.agg((F.sum("strength") / 2).alias("w"))  # one row
    terms = by_community.crossJoin(F.broadcast(total)).select((F.try_divide("inside", "w") - F.pow(F.try_divide(F.col("strength"), 2 * F.col("w")), F.lit(2.0))).alias("term"))
    return terms.agg(F.sum("term").alias("modularity"))


#: A round of moves must raise the modularity by so much; so many rounds in a row may fail to.
GAIN, TRIES = 1e-9, 4


def _quality(edges: DataFrame, labels: DataFrame, twice: float) -> float:
    """Modularity of ``labels(id, label)`` on two-way ``edges(src, dst, weight)`` whose weights sum to ``twice``."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
    sums = edges.join(of("src"), "src").join(of("dst"), "dst").groupBy("src_label").agg(
        F.sum(F.when(F.col("src_label") == F.col("dst_label"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("all")
    )
    return sums.agg(F.sum(F.col("inside") / twice - F.pow(F.col("all") / twice, F.lit(2.0)))).first()[0] or 0.0


def _moved(edges: DataFrame, labels: DataFrame, twice: float, turn: int) -> DataFrame:
    """``id, label`` after a round of local moves.

    A node goes to the community of its neighbours that raises the modularity most, the smallest of equals. In each round
    a half of the nodes may move, another half each time, and of two nodes alone in their communities only the larger
    joins the smaller, so that neighbours do not swap places for ever.
    """
    strength = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    placed = labels.join(strength, "id", "left").select("id", "label", F.coalesce("k", F.lit(0.0)).alias("k"))
    totals = placed.groupBy(F.col("label").alias("to")).agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
    near = edges.filter("src <> dst").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("weight").alias("w"))
    options = near.unionByName(labels.select("id", F.col("label").alias("to"), F.lit(0.0).alias("w"))).groupBy("id", "to").agg(F.sum("w").alias("w"))
    c = F.col
    gain = F.round(c("w") - c("k") * (c("total") - F.when(c("to") == c("label"), c("k")).otherwise(0.0)) / twice, 12)
    weighed = options.join(placed, "id").join(totals, "to").select("id", "label", "to", "size", gain.alias("gain"))
    best = weighed.groupBy("id", "label").agg(
        F.min_by(F.struct("to", "size", "gain"), F.struct(-c("gain"), c("to"))).alias("best"),
        F.max(F.when(c("to") == c("label"), c("gain"))).alias("stay"), F.max(F.when(c("to") == c("label"), c("size"))).alias("size"),
    )
    swaps = (c("size") == 1) & (c("best.size") == 1) & (c("best.to") > c("label"))
    may = F.crc32(F.concat_ws("|", c("id").cast("string"), F.lit(str(turn))).cast("binary")) % 2 == 0
    goes = (c("best.to") != c("label")) & (c("best.gain") > c("stay")) & ~swaps & may
    return best.select("id", F.when(goes, c("best.to")).otherwise(c("label")).alias("label"))


def communities(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``symbol, community_id, community_size, detection_method``: Louvain, by joins at every size.

    Rounds of local moves go on while they raise the modularity; then each community becomes a node, with the weight
    inside it as a loop, until a level changes nothing. The modularity rises with every round that is kept, so this
    ends; and each round is a few shuffles by node or community, whatever the graph. Communities are named by their
    smallest member.
    """
    edges = materialize(both_ways(links).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "community-links")
    member = nodes.select("symbol", F.col("symbol").alias("node")).distinct()
    twice = edges.agg(F.sum("weight")).first()[0] or 0.0
    turn = 0
    while twice:
        ids = edges.select(F.col("src").alias("id")).distinct()
        labels = materialize(ids.withColumn("label", F.col("id")), "community-labels")
        start = best = _quality(edges, labels, twice)
        tries = 0
        while tries < TRIES:
            moved = materialize(_moved(edges, labels, twice, turn), "community-labels")
            turn += 1
            now = _quality(edges, moved, twice)
            if now > best + GAIN:
                labels, best, tries = moved, now, 0
            else:
                tries += 1
        if best <= start + GAIN:
            break
        member = materialize(member.join(labels, member["node"] == labels["id"], "left").select("symbol", F.coalesce("label", "node").alias("node")), "community-members")
        of = lambda side, labels=labels: labels.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
        merged = edges.join(of("src"), "src").join(of("dst"), "dst").groupBy(F.col("src_label").alias("src"), F.col("dst_label").alias("dst"))
        edges = materialize(merged.agg(F.sum("weight").alias("weight")), "community-links")
    named = member.groupBy("node").agg(F.min("symbol").alias("community_id"), F.count(F.lit(1)).alias("community_size"))
    return member.join(named, "node").select("symbol", "community_id", "community_size", F.lit("louvain").alias("detection_method"))


def statistics(nodes: DataFrame, pairs: DataFrame, links: DataFrame, parts: DataFrame) -> DataFrame:
    """One row about the graph."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    e = links.agg(F.count(F.lit(1)).alias("n_edges"), F.avg("weight").alias("mean_weight"))
    p = pairs.agg(F.avg((F.col("corr") > 0).cast("double")).alias("positive_share"), F.avg(F.abs("corr")).alias("mean_abs_corr"))
    c = parts.agg(F.countDistinct("component").alias("n_components"))
    i = degrees(nodes, links).agg(F.count_if(F.col("degree") == 0).alias("n_isolated"))
    row = n.crossJoin(e).crossJoin(p).crossJoin(c).crossJoin(i)  # one row each
    return row.withColumn("density", F.coalesce(F.try_divide(2 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)))
