"""A stored index of patterns that answers questions: what was this day like, what followed, how risky is it.

The artefacts are Parquet below one path of any store that Spark reads: the patterns by market, or the histories that they
are made of and the statistics that standardise them, the hyperplanes, the base rates and the parameters. Buckets follow
from the vectors, so they are not stored. Questions are rows, so one question and a thousand are the same plan.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, FusionConfig, SimHashConfig
from ..sources.scratch import materialize
from . import precedents
from .histories import Reader, figures, histories, merged
from .patterns import latest_pattern
from .streamed import streamed_top_k, summarised_top_k

#: Questions that meet histories by a broadcast; more of them by a shuffle.
FEW = 1 << 20


@dataclass(frozen=True)
class PrecedentStore:
    """The stored patterns of a library market (``lib``) and a target market (``tgt``)."""

    spark: SparkSession
    path: str
    planes: np.ndarray
    simhash: SimHashConfig
    split: str | None = None
    stats: dict | None = None
    #: The ``merged`` histories for so many names.
    once: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def build(cls, patterns: DataFrame, planes: np.ndarray, path: str, simhash: SimHashConfig = DEFAULT.simhash) -> PrecedentStore:
        """Write the artefacts of ``patterns(id, symbol, market, trade_date, close, fwd_return, fwd_down, vector)`` below ``path``."""
        patterns.withColumn("id", F.col("id").cast("string")).write.mode("overwrite").partitionBy("market").parquet(f"{path}/patterns")
        precedents.base_rate(patterns).coalesce(1).write.mode("overwrite").parquet(f"{path}/base_rates")
        return cls._finish(patterns.sparkSession, planes, path, simhash, None)

    @classmethod
    def build_histories(cls, days: DataFrame, split: str, planes: np.ndarray, path: str, simhash: SimHashConfig = DEFAULT.simhash) -> PrecedentStore:
        """Write the artefacts of ``days`` with ``symbol, trade_date, close, volume``: a row a symbol, of which the patterns are made where they are read; the target market starts at ``split``."""
        return cls.build_packed(histories(days), split, planes, path, simhash)

    @classmethod
    def build_packed(cls, packed: DataFrame, split: str, planes: np.ndarray, path: str, simhash: SimHashConfig = DEFAULT.simhash) -> PrecedentStore:
        """As ``build_histories``, of histories."""
        spark = packed.sparkSession
        packed.write.mode("overwrite").parquet(f"{path}/histories")
        held = spark.read.schema(packed.schema).parquet(f"{path}/histories")
        few = merged(held, simhash.top_k)
        figures(few[0], split).coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")
        known = spark.read.parquet(f"{path}/figures").filter("n > 0").select("market", "n", "p_down", "mean_return")
        known.coalesce(1).write.mode("overwrite").parquet(f"{path}/base_rates")
        store = cls._finish(spark, planes, path, simhash, split)
        store.once[simhash.top_k] = few
        return store

    @classmethod
    def _finish(cls, spark: SparkSession, planes: np.ndarray, path: str, simhash: SimHashConfig, split: str | None) -> PrecedentStore:
        spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(planes)], "bit int, normal array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/planes")
        spark.createDataFrame([(json.dumps(asdict(simhash) | {"split": split}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PrecedentStore:
        """Attach to artefacts that an earlier session wrote."""
        planes = [r.normal for r in spark.read.parquet(f"{path}/planes").orderBy("bit").collect()]  # a row a bit
        parameters = json.loads(spark.read.text(f"{path}/parameters").first().value)
        split = parameters.pop("split", None)
        stats = None if split is None else {r.market: r.asDict() for r in spark.read.parquet(f"{path}/figures").collect()}  # a row a market
        return cls(spark, path, np.array(planes), SimHashConfig(**parameters), split, stats)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{'patterns' if self.split is None else 'histories'}")

    def patterns(self, market: str | None = None, shaped: bool = True) -> DataFrame:
        """The patterns of one market or of both, without ``shaped`` but for their vectors."""
        found = self._stored()
        if self.split is not None:
            found = Reader(self.stats, self.split, shaped=shaped).rows(found)
        elif not shaped:
            found = found.drop("vector")
        return found if market is None else found.filter(F.col("market") == market)

    def _library(self, side: str, held: DataFrame | None = None) -> tuple:
        """The patterns of a market with a known outcome: stored rows, or ``held`` ones, and what makes patterns of them."""
        if self.split is None:
            return self.patterns(side).filter("fwd_down IS NOT NULL"), None
        return self._stored() if held is None else held, Reader(self.stats, self.split, side)

    def base_rates(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/base_rates")

    def symbols(self) -> DataFrame:
        """The symbols of the target market."""
        if self.split is not None:  # the last day with a price has a pattern where any has
            priced = F.filter(F.arrays_zip("trade_date", "close"), lambda x: x["close"] > 0)
            known = self._stored().select("symbol", priced.alias("days")).filter(F.size("days") > DEFAULT.pattern.window)
            return known.filter(F.array_max("days.trade_date") >= F.lit(self.split).cast("date")).select("symbol").distinct()
        return self.patterns("tgt", shaped=False).select("symbol").distinct()

    def dates(self, symbol=None) -> DataFrame:
        """``symbol, trade_date`` of the target market's patterns, of one symbol or of all."""
        found = self.patterns("tgt", shaped=False).select("symbol", "trade_date")
        return found if symbol is None else found.filter(F.col("symbol") == F.lit(symbol))

    def _asked(self, questions: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """The target pattern at or before each of ``questions(symbol, query_date)``; questions without one are left out."""
        if self.split is not None:
            asked = questions.groupBy("symbol").agg(F.collect_set("query_date").alias("asked"))
            few = questions.limit(FEW + 1).count() <= FEW
            held = (self._stored() if held is None else held).join(F.broadcast(asked) if few else asked, "symbol")
            return Reader(self.stats, self.split, "asof").rows(held).withColumnRenamed("trade_date", "pattern_date")
        known = self.patterns("tgt")
        dated = latest_pattern(known.select("symbol", "trade_date"), questions.select("symbol", "query_date").distinct()).filter("pattern_date IS NOT NULL")
        return dated.join(known.withColumnRenamed("trade_date", "pattern_date"), ["symbol", "pattern_date"])

    def shapes(self, questions: DataFrame, window: int = DEFAULT.pattern.window) -> DataFrame:
        """``symbol, query_date, pattern_date, shape``: the standardised returns of the pattern's window."""
        return self._asked(questions).select("symbol", "query_date", "pattern_date", F.slice("vector", F.lit(1), F.lit(window)).alias("shape"))

    def neighbours(self, questions: DataFrame, side: str, k: int | None = None) -> DataFrame:
        """``symbol, query_date, item_id, cosine, fwd_return, fwd_down, rank``: the ``k`` nearest patterns of a known outcome.

        Of the library those that share a bucket; of the target market all that came before the pattern, exactly.
        """
        asked = materialize(self._asked(questions), "questions")
        key = F.concat_ws("|", "symbol", "query_date")
        queries = asked.select(key.alias("id"), F.col("pattern_date").alias("trade_date"), "vector")
        rows, read = self._library(side)
        exact = side == "tgt"
        found, named = streamed_top_k(rows, queries, k or self.simhash.top_k, None if exact else self.planes, self.simhash.band_bits, exact, read)
        found = named.join(found, "query").drop("query")
        return asked.select("symbol", "query_date", key.alias("query_id")).join(found, "query_id").drop("query_id")

    def ask(self, questions: DataFrame, k: int | None = None, fusion: FusionConfig = DEFAULT.fusion) -> DataFrame:
        """One row for each of ``questions(symbol, query_date)`` that has a pattern: both summaries, the fused risk and a reason."""
        k, held, names = k or self.simhash.top_k, None, None
        if self.split is not None:
            if k not in self.once:
                self.once[k] = merged(self._stored(), k)
            held, names = self.once[k]
        if names is not None:  # equal histories have equal answers
            named = materialize(questions.select("symbol", "query_date").distinct().join(names, "symbol"), "named-questions")
            questions = named.select(F.col("one").alias("symbol"), "query_date").distinct()
        asked = materialize(self._asked(questions, held).select("symbol", "query_date", "pattern_date", "close", "fwd_return", "fwd_down", "vector"), "questions")
        library = {side: self._library(side, held) for side in ("lib", "tgt")}
        out = summarised_top_k((asked.withColumnRenamed("pattern_date", "trade_date"), None), library, k, self.planes, self.simhash.band_bits, ("tgt",), ("tgt",))
        for side in library:
            out = out.crossJoin(F.broadcast(self.base_rates().filter(F.col("market") == side).select(F.col("p_down").alias(f"{side}_base"))))  # one row
        sides = [c for side in library for c in precedents.completed(out, F.col(f"{side}_base"), side, fusion)]
        fused = precedents.fuse(out.select("symbol", "query_date", F.col("trade_date").alias("pattern_date"), "close", "fwd_return", F.col("fwd_down").alias("actual_down"), *sides), fusion)
        fused = fused.withColumn("reason", precedents.reason(fused))
        return fused if names is None else fused.withColumnRenamed("symbol", "one").join(named, ["one", "query_date"]).select(fused.columns)
