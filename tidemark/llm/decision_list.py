"""Learned decision lists: ordered threshold rules that separate bad documents, as one Spark conditional expression.

Sequential covering. Each rule is a conjunction of ``feature >= t`` and ``feature < t`` conditions. It is grown on two
thirds of the labelled rows by the condition of highest FOIL gain, then pruned on the last third to the prefix with
the best ``(p - n) / (p + n)``; the rows it covers are left out and the next rule is learned, until a rule is no longer
precise or covers too little. All statistics are aggregates of DataFrames: a step of growth is one job whose result has
a row for each feature, bin and class.

Main path native: only DataFrame and SQL functions.

Contract: see ``judge``; an empty label table gives a list without rules, which keeps everything.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, materialize
from .text_features import FEATURES, with_counts, with_features


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered_bad: int
    covered_good: int

    def column(self) -> Column:
        out = F.lit(True)
        for condition in self.conditions:
            out = out & condition.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def rule_number(self) -> Column:
        """The first rule that fires, from 1; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def keeps(self) -> Column:
        return self.rule_number() == 0


def _thresholds(rows: DataFrame, features: tuple[str, ...], bins: int) -> dict[str, list[float]]:
    """Distinct quantiles of each feature, ascending; a step just above the least value is always among them."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in features], *[F.min(f).alias(f"min_{f}") for f in features]).first()
    out = {}
    for f in features:
        values = sorted({v for v in found[f] or [] if v > found[f"min_{f}"]})
        out[f] = values
    return out


def _binned(rows: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """Rows with ``bins``: for each feature the number of thresholds that the value reaches."""
    return rows.withColumn("bins", F.array(*[_reached(F.col(f), ts) for f, ts in thresholds.items()]))


def _reached(value: Column, thresholds: list[float]) -> Column:
    return F.aggregate(F.array(*[F.lit(t) for t in thresholds]), F.lit(0), lambda n, t: n + (value >= t).cast("int")) if thresholds else F.lit(0)


def _histogram(rows: DataFrame) -> dict[int, dict[int, list[int]]]:
    """By feature and bin the number of good and bad rows: one job."""
    counted = rows.select(F.posexplode("bins").alias("feature", "bin"), "target").groupBy("feature", "bin").agg(
        F.count_if(F.col("target") == 1).alias("good"), F.count_if(F.col("target") == 0).alias("bad")
    )
    out: dict[int, dict[int, list[int]]] = defaultdict(dict)
    for r in counted.collect():  # features x bins rows
        out[r.feature][r.bin] = [r.good, r.bad]
    return out


def _best_condition(histogram: dict, thresholds: dict[str, list[float]], good: int, bad: int, least: int) -> tuple[float, Condition, int, int] | None:
    """The condition of the highest FOIL gain: its gain, itself, and the good and bad rows that stay."""
    best = None
    before = math.log2(bad / (bad + good))
    for k, (feature, ts) in enumerate(thresholds.items()):
        upto_good = upto_bad = 0
        for j, t in enumerate(ts):  # bin j holds the values below ts[j]
            g, b = histogram.get(k, {}).get(j, (0, 0))
            upto_good, upto_bad = upto_good + g, upto_bad + b
            for at_least, g2, b2 in ((False, upto_good, upto_bad), (True, good - upto_good, bad - upto_bad)):
                if b2 < least or (g2, b2) == (good, bad):
                    continue
                gain = b2 * (math.log2(b2 / (b2 + g2)) - before)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, Condition(feature, at_least, t), g2, b2)
    return best if best and best[0] > 0 else None


def learn(rows: DataFrame, features: tuple[str, ...] = FEATURES, bins: int = 40, max_rules: int = 12, max_conditions: int = 3, precision: float = 0.9, least: int = 5) -> DecisionList:
    """Learn from ``rows`` with ``doc_id``, the features and ``target`` (1 good, 0 bad). ``rows`` should be materialised."""
    thresholds = _thresholds(rows, features, bins)
    rows = _binned(rows, thresholds).withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) > 0)
    rules: list[Rule] = []
    rest = rows
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        covered = rest.filter("grow")
        histogram = _histogram(covered)
        good, bad = (sum(h[k] for h in histogram.get(0, {}).values()) for k in (0, 1))
        while len(conditions) < max_conditions and bad >= least and good:
            found = _best_condition(histogram, thresholds, good, bad, least)
            if not found:
                break
            _, condition, good, bad = found
            conditions.append(condition)
            covered = covered.filter(condition.column())
            if good and len(conditions) < max_conditions:
                histogram = _histogram(covered)
        if not conditions:
            break
        rule = _pruned(rest.filter("not grow"), conditions)
        if rule is None or rule.covered_bad < least / 2 or rule.covered_bad < precision * (rule.covered_bad + rule.covered_good):
            break
        rules.append(rule)
        rest = rest.filter(~rule.column())
    return DecisionList(tuple(rules))


def _pruned(rows: DataFrame, conditions: list[Condition]) -> Rule | None:
    """The prefix of the conjunction that does best on rows it was not grown on; of equals the shortest."""
    prefixes = [Rule(tuple(conditions[:n]), 0, 0) for n in range(1, len(conditions) + 1)]
    counts = rows.agg(
        *[F.count_if(p.column() & (F.col("target") == 0)).alias(f"bad{k}") for k, p in enumerate(prefixes)],
        *[F.count_if(p.column() & (F.col("target") == 1)).alias(f"good{k}") for k, p in enumerate(prefixes)],
    ).first()
    rules = [Rule(p.conditions, counts[f"bad{k}"], counts[f"good{k}"]) for k, p in enumerate(prefixes)]
    worth = [(r.covered_bad - r.covered_good) / max(1, r.covered_bad + r.covered_good) for r in rules]
    best = max(range(len(rules)), key=lambda k: (worth[k], -k))
    return rules[best] if rules[best].covered_bad else None


def one_of_each_id(labelled: DataFrame) -> DataFrame:
    """``doc_id, target`` and the features, one row an id: of rows that repeat an id the one with the smallest features."""
    return labelled.groupBy("doc_id", "target").agg(F.min(F.struct(*FEATURES)).alias("least")).select("doc_id", "target", "least.*")


#: A document fails outright with fewer words, or with a larger percentage of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def judge(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 30_000) -> tuple[DataFrame, DecisionList]:
    """A verdict for every row of ``docs``, and the list it comes from, learned from at most ``max_fit_rows`` labelled documents.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule``. A
    null or empty text has no words and fails; repeated rows are judged each on its own; ``rule`` is the number of the
    learned rule that fires, 0 if none. Labels without a document are ignored, documents need none.
    """
    rows = materialize(with_features(with_counts(docs)), "rule-features")
    sample = F.broadcast(bounded_labels(labels, F.col("quality"), max_fit_rows))
    fit = materialize(one_of_each_id(rows.join(sample, "doc_id")), "rule-fit")
    learned = learn(fit)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = rows.withColumn("base_failed", base_failed).withColumn("rule", learned.rule_number())
    out = judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )
    return out, learned
