"""Profiles, principal components, K-means, CURE, silhouettes and the agreement of clusterings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ClusterConfig
from ..sources.scratch import materialize

#: Rows that CURE clusters hierarchically at once; a larger sample is clustered in parts first, each down to a tenth.
CURE_ROWS, CURE_SHRINK = 1024, 10


def profiles(df: DataFrame, columns: list[str], key: str = "symbol", day: str = "trade_date") -> DataFrame:
    """Mean of every column by symbol, with rows and distinct days: one pass.

    A day counts where it differs from the one before: a distinct count would hold all the sums once for every day.
    """
    marked = df.withColumn("_before", F.lag(day).over(Window.partitionBy(key).orderBy(day)))
    new = F.col(day).isNotNull() & ~F.col(day).eqNullSafe(F.col("_before"))
    return marked.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n_rows"), F.count_if(new).alias("n_days"))


def assembled(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """Rows with a feature vector; rows with an unknown value are left out."""
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="skip").transform(df)


def from_array(df: DataFrame, column: str, output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def pca_pipeline(k: int) -> Pipeline:
    """Standardise to mean 0 and deviation 1, then project on ``k`` components."""
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), PCA(k=k, inputCol="scaled", outputCol="pcs")])


def explained_variance(df: DataFrame, k_max: int | None = None) -> DataFrame:
    """``pc, explained, cumulative`` of at most min(dimension, rows - 1) components; the covariance is a distributed sum."""
    dim = len(df.select(vector_to_array("features")).first()[0])
    k = max(1, min(dim, df.count() - 1, k_max or dim))
    shares = pca_pipeline(k).fit(df).stages[1].explainedVariance.toArray()
    rows = [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(shares, np.cumsum(shares), strict=True))]
    return df.sparkSession.createDataFrame(rows, "pc int, explained double, cumulative double")


def components_for(explained: DataFrame, variance: float = DEFAULT.cluster.variance) -> int:
    """The fewest components that explain the wanted share, or all."""
    enough = explained.filter(F.col("cumulative") >= variance).agg(F.min("pc"), F.count(F.lit(1))).first()
    return enough[0] if enough[1] else explained.count()


def project(df: DataFrame, k: int, key: str) -> tuple[DataFrame, np.ndarray]:
    """``key, pc1 .. pck`` and the loadings (features by components)."""
    model = pca_pipeline(k).fit(df)
    pcs = vector_to_array("pcs")
    return model.transform(df).select(key, *[pcs[i].alias(f"pc{i + 1}") for i in range(k)]), model.stages[1].pc.toArray()


def loadings(spark, matrix: np.ndarray, names: list[str]) -> DataFrame:
    """``pc, feature, loading, rank`` by the size of the loading."""
    rows = [(j + 1, n, float(matrix[i, j])) for j in range(matrix.shape[1]) for i, n in enumerate(names)]
    order = Window.partitionBy("pc").orderBy(F.desc(F.abs("loading")), "feature")
    return spark.createDataFrame(rows, "pc int, feature string, loading double").withColumn("rank", F.row_number().over(order))


def top_loadings(found: DataFrame, n: int = 5) -> DataFrame:
    """``pc, features``: the features that weigh most in each component, as a text."""
    named = found.filter(F.col("rank") <= n).select("pc", F.struct("rank", F.format_string("%s (%+.3f)", "feature", "loading").alias("text")).alias("entry"))
    return named.groupBy("pc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["text"]), ", ").alias("features"))


def kmeans(df: DataFrame, k: int | None = None, column: str = "features", config: ClusterConfig = DEFAULT.cluster):
    """A fitted K-means model."""
    return KMeans(k=k or config.k, maxIter=config.max_iterations, tol=config.tolerance, seed=config.seed, featuresCol=column, predictionCol="cluster_id").fit(df)


def elbow(df: DataFrame, config: ClusterConfig = DEFAULT.cluster) -> DataFrame:
    """``k, cost`` over the range, its end excluded."""
    rows = [(k, float(kmeans(df, k, config=config).summary.trainingCost)) for k in range(*config.elbow)]
    return df.sparkSession.createDataFrame(rows, "k int, cost double")


def squared_silhouette(clustered: DataFrame) -> float:
    """Mean silhouette of squared distances: linear in the rows."""
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster_id", metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(clustered)


def silhouette(points: DataFrame, block: int = 2048) -> DataFrame:
    """``n, n_clusters, silhouette``: mean Euclidean silhouette of ``points(id, vector, cluster_id)``, exact, by blocks.

    Every two blocks of rows give one matrix of distances, of which only the sums by row and cluster leave the task. A
    point alone in its cluster counts 0; with fewer than two clusters there is no silhouette (NULL).
    """
    n_blocks = max(1, -(-points.count() // block))
    rows = points.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b"), F.struct("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.col("cluster_id").cast("int").alias("c")).alias("r"))
    packed = rows.groupBy("b").agg(F.collect_list("r").alias("rows")).drop("b")

    def sums(batches):
        for pdf in batches:
            for left, right in zip(pdf["left"], pdf["right"], strict=True):
                a, b = np.array([r["vector"] for r in left]), np.array([r["vector"] for r in right])
                c = np.array([r["c"] for r in right])
                apart = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
                ids = np.array([r["id"] for r in left])
                apart[ids[:, None] == np.array([r["id"] for r in right])[None, :]] = 0
                for label in np.unique(c):
                    yield pd.DataFrame({"id": ids, "own": [r["c"] for r in left], "cluster": int(label), "total": apart[:, c == label].sum(1)})

    pairs = packed.select(F.col("rows").alias("left")).crossJoin(packed.select(F.col("rows").alias("right")))  # of blocks
    totals = pairs.mapInPandas(sums, "id long, own int, cluster int, total double").groupBy("id", "own", "cluster").agg(F.sum("total").alias("total"))
    sizes = points.groupBy(F.col("cluster_id").cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    means = totals.join(sizes, "cluster")
    mine = F.col("own") == F.col("cluster")
    each = means.groupBy("id").agg(
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"), F.min(F.when(~mine, F.col("total") / F.col("size"))).alias("b"), F.max(F.when(mine, F.col("size"))).alias("own_size"),
    )
    score = F.when(F.col("own_size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    n_clusters = sizes.agg(F.count(F.lit(1)).alias("n_clusters"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s")).crossJoin(n_clusters).select("n", "n_clusters", F.when(F.col("n_clusters") > 1, F.col("s")).alias("silhouette"))


def ward(x: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels of ``k`` clusters by Ward's criterion, merging the two clusters whose union costs least; rows may stand for several."""
    n = len(x)
    size, alive = np.ones(n) if weight is None else weight.astype(float), np.ones(n, bool)
    cost = np.array([((x - row) ** 2).sum(1) for row in x]) * (size[:, None] * size / (size[:, None] + size))
    np.fill_diagonal(cost, np.inf)
    label = np.arange(n)
    nearest = cost.argmin(1)
    for _ in range(n - max(1, k)):
        best = np.where(alive, cost[np.arange(n), nearest], np.inf)
        i = int(best.argmin())
        j = int(nearest[i])
        i, j = min(i, j), max(i, j)
        others = alive.copy()
        others[[i, j]] = False
        s = size[others]
        cost[i, others] = ((size[i] + s) * cost[i, others] + (size[j] + s) * cost[j, others] - s * cost[i, j]) / (size[i] + size[j] + s)
        cost[others, i] = cost[i, others]
        cost[j, :], cost[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        label[label == j] = i
        stale = alive & ((nearest == i) | (nearest == j))
        stale[i] = True
        nearest[stale] = cost[stale].argmin(1)
        closer = others & (cost[:, i] < cost[np.arange(n), nearest])
        nearest[closer] = i
    return np.unique(label, return_inverse=True)[1]


def _scattered(points: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the points: the one farthest from the centre, then each time the one farthest from those chosen."""
    chosen = [int(((points - centre) ** 2).sum(1).argmax())]
    apart = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _merged(parts: pd.DataFrame, k: int, representatives: int) -> pd.DataFrame:
    """``parts(centre, weight, points)`` as at most ``k`` of them."""
    centres, weight = np.array(parts["centre"].tolist(), float), parts["weight"].to_numpy(float)
    labels = ward(centres, min(k, len(parts)), weight)
    out = []
    for c in range(labels.max() + 1):
        own = labels == c
        centre = (centres[own] * weight[own, None]).sum(0) / weight[own].sum()
        points = np.array([p for ps in parts["points"][own] for p in ps], float)
        out.append((centre.tolist(), weight[own].sum(), _scattered(points, centre, representatives).tolist()))
    return pd.DataFrame(out, columns=["centre", "weight", "points"])


def cure(points: DataFrame, config: ClusterConfig = DEFAULT.cluster, at_once: int = CURE_ROWS) -> DataFrame:
    """``points(id, vector)`` with ``cure_cluster``: that of the nearest representative.

    Half the rows, by a hash of the id, or all where that is less than five a cluster, are clustered by Ward's criterion.
    More than ``at_once`` of them are clustered in parts first, each down to a tenth, as often as need be: a partial
    cluster goes on as its centre, its size and a few scattered points. So the sample grows with the table, and no task
    holds more than ``at_once`` rows. The representatives are few (ten a cluster), the assignment is one pass.
    """
    n = points.count()
    if not n:
        return points.withColumn("cure_cluster", F.lit(None).cast("int"))
    half = F.pmod(F.xxhash64("id", F.lit(config.seed)), F.lit(2)) == 0
    vector = F.transform("vector", lambda x: x.cast("double"))
    parts = (points if n < 10 * config.k else points.filter(half)).select("id", vector.alias("centre"), F.lit(1.0).alias("weight"), F.array(vector).alias("points"))
    schema = "centre array<double>, weight double, points array<array<double>>"
    left, level = parts.count(), 0
    while left > at_once:
        groups = -(-left // at_once)
        # the parts of the first level are dealt by id, later ones by what they are
        dealt = parts.withColumn("part", F.pmod(F.xxhash64(*(["id"] if level == 0 else ["centre", "weight"])), F.lit(groups)))

        def shrunk(pdf: pd.DataFrame) -> pd.DataFrame:
            return _merged(pdf.reset_index(drop=True), max(config.k, len(pdf) // CURE_SHRINK), config.representatives)

        parts = materialize(dealt.groupBy("part").applyInPandas(shrunk, schema), "partial-clusters")
        before, left, level = left, parts.count(), level + 1
        if left >= before:  # fewer rows than clusters in each part
            break
    few = parts.select("centre", "weight", "points").toPandas()  # at most at_once rows, or a few clusters for each part
    few = few.iloc[np.lexsort(np.array(few["centre"].tolist(), float).T[::-1])].reset_index(drop=True)  # in an order that no task decides
    found = _merged(few, config.k, config.representatives)
    reps = np.vstack([np.array(c) + config.shrink * (np.array(p, float) - np.array(c)) for c, p in zip(found["centre"], found["points"], strict=True)])
    owners = np.repeat(np.arange(len(found)), found["points"].map(len))

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), float).reshape(-1, reps.shape[1])
        apart = (x * x).sum(1)[:, None] + (reps * reps).sum(1) - 2 * x @ reps.T
        return pd.Series(owners[apart.argmin(1)])

    return points.withColumn("cure_cluster", nearest("vector"))


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, ari, nmi`` of two labelings of the same rows, from their contingency table; 1 where both have one class."""
    c = F.col
    cells = df.groupBy(c(a).alias("a"), c(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = (cells.groupBy(s).agg(F.sum("n").alias("n")) for s in "ab")
    total = F.broadcast(cells.agg(F.sum("n").alias("every")))  # one row
    share = c("n") / c("every")
    entropy = lambda part: part.crossJoin(total).agg(F.sum(-share * F.ln(share)).alias("h"), F.sum(_choose2(c("n"))).alias("pairs"))
    joint = cells.join(rows.select("a", c("n").alias("na")), "a").join(cols.select("b", c("n").alias("nb")), "b").crossJoin(total)
    shared = joint.agg(F.sum(share * F.ln(c("n") * c("every") / (c("na") * c("nb")))).alias("mi"), F.sum(_choose2(c("n"))).alias("both"), F.max("every").alias("every"))
    ha, hb = (entropy(part).select(c("h").alias(f"h{s}"), c("pairs").alias(f"p{s}")) for part, s in ((rows, "a"), (cols, "b")))
    one = shared.crossJoin(ha).crossJoin(hb)  # one row each
    chance = F.try_divide(c("pa") * c("pb"), _choose2(c("every")))
    ari = F.try_divide(c("both") - chance, (c("pa") + c("pb")) / 2 - chance)
    nmi = F.try_divide(c("mi"), (c("ha") + c("hb")) / 2)
    return one.select(c("every").cast("long").alias("n"), F.coalesce(ari, F.lit(1.0)).alias("ari"), F.coalesce(nmi, F.lit(1.0)).alias("nmi"))


def cluster_profiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of every column by cluster, and its z-score across the clusters; a column without spread has 0."""
    means = df.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in columns])
    every = Window.partitionBy(F.lit(0))  # a row a cluster
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(every), F.nullif(F.stddev_samp(c).over(every), F.lit(0.0))), F.lit(0.0))
    return means.select("cluster_id", *columns, *[z(c).alias(f"{c}_z") for c in columns])
