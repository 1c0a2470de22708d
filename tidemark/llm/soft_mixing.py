"""Mixing to target weights with soft membership.

A classifier fitted on the label table gives every document a posterior over domains. Document rates then solve a
least-squares problem over all documents,

    minimise  1/2 sum_d (sum_i w_i r_i p_id - t_d)^2 / s_d  +  penalty/2 sum_i w_i (r_i - 1)^2,   0 <= r_i <= max_rate

with w_i the document's share of all tokens, p_id its posterior, t_d the target share and s_d the present share of a
domain, by projected gradient: each iteration is one distributed sum of a few numbers, the residual of each domain. In
the token-weighted metric a document's step depends on its own posterior and the residuals alone, so its rate is a fold
over the residuals so far and no state is kept by document. The folds run on arrays: a fit may take hundreds of steps.

Contract: a null text counts as empty and has no tokens; rows may repeat, and each has its own rate; copies are decided
by id and text, so unlike texts under a null or repeated id are documents of their own; without labels all posteriors
are equal; an empty table gives an empty result; other columns are ignored, whatever their names. Labels without a
document are ignored. A fit that does not come to rest raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, bounded_labels, id_key, materialize, spare, text_key

DOMAINS = ("clean", "low_quality", "toxic")


def domain_of(labels: DataFrame) -> Column:
    """Place in ``DOMAINS`` of a label row: toxic goes before low quality. Null flags count as not set and good."""
    toxic, quality = F.coalesce(F.col("toxic"), F.lit(0)), F.coalesce(F.col("quality"), F.lit(1))
    return F.when(toxic == 1, F.lit(2)).when(quality == 0, F.lit(1)).otherwise(F.lit(0))


#: ASCII punctuation and control characters become blanks.
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
N_SHAPES = 8


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_BLANKED).split()


def shapes(raw: bytes, tokens: int, distinct: int) -> tuple[float, ...]:
    """Eight numbers about the form of a text."""
    size = max(1, len(raw))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    return (math.log1p(tokens), size / max(1, tokens), share(_SYMBOLS), share(_UPPER), share(b"!"), share(_DIGITS), distinct / max(1, tokens), distinct / max(1.0, tokens**0.8))


@dataclass
class DomainModel:
    """Multinomial logistic regression on shapes and the presence of lexicon words."""

    lexicon: dict[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (1 + shapes + lexicon, domains)

    def features(self, text: str) -> tuple[int, tuple[float, ...], list[int]]:
        """Tokens (words between blanks), shapes and lexicon hits of a text."""
        raw = text.encode()
        tokens = len(raw.split())
        distinct = set(_words(raw))
        return tokens, shapes(raw, tokens, len(distinct)), [self.lexicon[w] for w in distinct & self.lexicon.keys()]

    def posteriors(self, forms: np.ndarray, hits: list[list[int]]) -> np.ndarray:
        z = self.weights[0] + ((forms - self.mean) / self.scale) @ self.weights[1 : 1 + N_SHAPES]
        rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        np.add.at(z, rows, self.weights[1 + N_SHAPES + np.fromiter((k for h in hits for k in h), np.int64, len(rows))])
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def _softmax_regression(x: np.ndarray, y: np.ndarray, n_classes: int, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Adam on the full batch; deterministic."""
    target = np.eye(n_classes)[y]
    weights = np.zeros((x.shape[1], n_classes))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        z = x @ weights
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - target) / len(x) + ridge * weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def _lexicon(sample: DataFrame, size: int, least: int = 8) -> list[str]:
    """The words of the sample whose presence tells most about the domain, by mutual information; ties by word."""
    words = F.array_distinct(F.split(F.lower(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " "))
    by_word = sample.select("target", F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("target") == d).alias(f"n{d}") for d in range(len(DOMAINS))]
    )
    totals = [r or 0 for r in sample.agg(*[F.count_if(F.col("target") == d) for d in range(len(DOMAINS))]).first()]
    n = max(1, sum(totals))
    told = F.lit(0.0)
    for d, total in enumerate(totals):
        for present in (True, False):
            joint = F.col(f"n{d}") if present else F.lit(total) - F.col(f"n{d}")
            margin = F.col("n") if present else F.lit(n) - F.col("n")
            told = told + F.when((joint > 0) & (margin > 0), joint / n * F.log(joint * float(n) / (margin * float(max(1, total))))).otherwise(0.0)
    top = by_word.filter(F.col("n") >= least).select("word", F.round(told, 9).alias("told")).orderBy(F.desc("told"), "word").limit(size)
    return sorted(r.word for r in top.collect())  # at most `size` rows


def learn_domains(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 12_000, lexicon_size: int = 256) -> DomainModel:
    """Fit on at most ``max_fit_rows`` labelled documents."""
    limit = bounded_labels(labels, domain_of(labels), max_fit_rows)
    sample = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(limit), "doc_id").groupBy("doc_id", "target").agg(F.min("text").alias("text")),
        "labelled-sample",
    )
    lexicon = {w.encode(): k for k, w in enumerate(_lexicon(sample, lexicon_size))}
    blank = DomainModel(lexicon, np.zeros(N_SHAPES), np.ones(N_SHAPES), np.zeros((1 + N_SHAPES + len(lexicon), len(DOMAINS))))
    rows = [(r.target, *r.found) for r in _featurise(sample, blank).orderBy("doc_id").select("target", F.struct("forms", "hits").alias("found")).collect()]
    if not rows:
        return blank
    y = np.array([r[0] for r in rows])
    forms = np.array([r[1] for r in rows])
    blank.mean, blank.scale = forms.mean(axis=0), np.maximum(forms.std(axis=0), 1e-9)
    x = np.zeros((len(rows), len(blank.weights)))
    x[:, 0] = 1
    x[:, 1 : 1 + N_SHAPES] = (forms - blank.mean) / blank.scale
    for k, r in enumerate(rows):
        x[k, [1 + N_SHAPES + h for h in r[2]]] = 1
    blank.weights = _softmax_regression(x, y, len(DOMAINS))
    return blank


def _featurise(sample: DataFrame, model: DomainModel) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("target").cast(pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.list_(pa.int32()))],
                ["doc_id", "target", "forms", "hits"],
            )

    return sample.select("doc_id", "target", "text").mapInArrow(run, "doc_id long, target int, forms array<double>, hits array<int>")


def posterior_table(docs: DataFrame, model: DomainModel) -> DataFrame:
    """``doc_id, text_hash, n_tokens`` and a posterior for each domain, for every row of ``docs``: one pass."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{d}" for d in DOMAINS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [shared.value.features(t) for t in batch.column("text").to_pylist()]
            p = shared.value.posteriors(np.array([f[1] for f in found]), [f[2] for f in found])
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array([f[0] for f in found], pa.int64()), *[pa.array(p[:, k]) for k in range(len(DOMAINS))]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_tokens", *names])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, n_tokens long, " + ", ".join(f"{n} double" for n in names))


@dataclass(frozen=True)
class Rates:
    """The gradient steps of the fit: a document's rate is a fold of its posterior over them."""

    steps: tuple[tuple[float, ...], ...]  # by iteration, for each domain its residual / present share
    rate: float
    penalty: float
    max_rate: float | None
    #: By domain, what the expected share of all tokens misses its target by; not 0 where no allowed rates meet it.
    residuals: tuple[float, ...] = ()

    def column(self, names: list[str]) -> Column:
        if not self.steps:
            return F.lit(1.0)
        history = F.array(*[F.array(*[F.lit(float(g)) for g in step]) for step in self.steps])

        def step(r: Column, g: Column) -> Column:
            slope = self.penalty * (r - 1.0)
            for k, name in enumerate(names):
                slope = slope + F.col(name) * g[k]
            moved = F.greatest(F.lit(0.0), r - self.rate * slope)
            return moved if self.max_rate is None else F.least(moved, F.lit(float(self.max_rate)))

        return F.aggregate(history, F.lit(1.0), step)

    def of(self, posteriors: list[np.ndarray]) -> np.ndarray:
        """As ``column``, with the same sums in the same order."""
        r = np.ones(len(posteriors[0]))
        for step in self.steps:
            slope = self.penalty * (r - 1.0)
            for p, g in zip(posteriors, step, strict=True):
                slope = slope + p * g
            r = np.maximum(0.0, r - self.rate * slope)
            if self.max_rate is not None:
                r = np.minimum(r, float(self.max_rate))
        return r

    def rated(self, table: DataFrame, names: list[str]) -> DataFrame:
        """``table`` with ``rate``: many steps over many rows are arrays' work."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(self.of(_columns(batch, names)))], [*batch.schema.names, "rate"])

        return table.mapInArrow(run, T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())]))

    def totals(self, posteriors: DataFrame, names: list[str]) -> list[float]:
        """By domain the expected tokens at these rates: a row of sums a task, added up exactly."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(names))
            for batch in batches:
                tokens, *p = _columns(batch, ["n_tokens", *names])
                kept = tokens * self.of(p)
                sums += [(kept * x).sum() for x in p]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names)

        rows = posteriors.select("n_tokens", *names).mapInArrow(run, ", ".join(f"`{n}` double" for n in names)).collect()  # a row a task
        return [math.fsum(r[k] for r in rows) for k in range(len(names))]


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for n in names]


def fit_rates(posteriors: DataFrame, target_weights: dict[str, float], budget: float | None = 1.0, max_rate: float | None = None, penalty: float = 1e-3, iterations: int = 400, tolerance: float = 1e-4) -> Rates:
    """Rates whose expected domain token totals match ``target_weights`` of ``budget`` times all tokens.

    A budget of None is the one at which the target of the clean domain is what there is of it.
    ``posteriors`` should be materialised. Stops when every domain is within ``tolerance`` of its target, relative to
    all tokens, or when a step changes no residual by a tenth of that: no allowed rates come closer then, and
    ``residuals`` says how far off they are. Raises if neither happens in ``iterations``.
    """
    if set(target_weights) != set(DOMAINS) or min(target_weights.values()) < 0 or not sum(target_weights.values()):
        raise ValueError(f"weights for {DOMAINS} are needed, none negative, not all 0")
    names = [f"p_{d}" for d in DOMAINS]
    whole = sum(target_weights.values())
    if budget is None and not target_weights["clean"]:
        raise ValueError("a budget is needed where no clean text is wanted")
    tokens = F.col("n_tokens").cast("double")
    first = posteriors.agg(F.sum(tokens), *[F.sum(tokens * F.col(n)) for n in names]).first()
    total = first[0] or 0.0
    if not total:
        return Rates((), 1.0, penalty, max_rate)
    present = [max(x / total, 1e-6) for x in first[1:]]
    shares = [x / total for x in first[1:]]
    if budget is None:
        budget = shares[DOMAINS.index("clean")] * whole / target_weights["clean"]
    targets = [budget * target_weights[d] / whole for d in DOMAINS]
    # every row of the scaled Gram matrix sums to at most 1, so its norm is at most 1 and this step is safe
    rate = 1 / (1 + penalty)
    steps: list[tuple[float, ...]] = []
    for _ in range(iterations + 1):
        residuals = tuple(s - t for s, t in zip(shares, targets, strict=True))
        moved = max(abs(a - b) for a, b in zip(before, shares, strict=True)) if steps else 1.0
        if max(map(abs, residuals)) <= tolerance or moved <= tolerance / 10:
            return Rates(tuple(steps), rate, penalty, max_rate, residuals)
        steps.append(tuple(e / s for e, s in zip(residuals, present, strict=True)))
        before, shares = shares, [x / total for x in Rates(tuple(steps), rate, penalty, max_rate).totals(posteriors, names)]
    raise RuntimeError(f"the rates do not come to rest in {iterations} iterations")


#: Target token shares of the domains.
TARGETS = {"clean": 0.94, "low_quality": 0.04, "toxic": 0.02}


def _mixed(docs: DataFrame, labels: DataFrame, target_weights: dict[str, float] | None, budget: float | None, max_rate: float | None) -> DataFrame:
    table = materialize(posterior_table(docs, learn_domains(docs, labels)), "posteriors")
    rates = fit_rates(table, target_weights or TARGETS, budget, max_rate)
    rated = rates.rated(table, [f"p_{d}" for d in DOMAINS])
    return rated.withColumn("copies", copies(F.col("rate"), id_key(), F.col("text_hash")))


def mix(docs: DataFrame, labels: DataFrame, target_weights: dict[str, float] | None = None, budget: float | None = 1.0, max_rate: float | None = None) -> DataFrame:
    """``doc_id, n_tokens``, posteriors, ``rate`` and ``copies`` for every row of ``docs``.

    ``copies`` is the rate rounded up or down by a hash of id and text, so its expectation is the rate.
    """
    return _mixed(docs, labels, target_weights, budget, max_rate).drop("text_hash")


def copies(rate: Column, *row: Column) -> Column:
    chance = F.pmod(F.xxhash64(*row, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def resample(docs: DataFrame, labels: DataFrame, target_weights: dict[str, float] | None = None, budget: float | None = 1.0, max_rate: float | None = None) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` says, with all their columns; rows of equal id and text share a decision."""
    keys = spare(docs, "key", "text_hash", "copies", "copy")
    rated = _mixed(docs, labels, target_weights, budget, max_rate)
    decided = rated.groupBy(id_key().alias(keys[0]), F.col("text_hash").alias(keys[1])).agg(F.max("copies").alias(keys[2])).filter(F.col(keys[2]) > 0)
    joined = docs.withColumns({keys[0]: id_key(), keys[1]: text_key()}).join(decided.hint("merge"), keys[:2])
    if max_rate is not None and max_rate <= 1:
        return joined.select(*docs.columns)
    return joined.withColumn(keys[3], F.explode(F.sequence(F.lit(1).cast("long"), F.col(keys[2])))).select(*docs.columns)
