"""Cross-entropy difference between two n-gram language models.

The target model is counted over the documents that the label table calls good, the background model over all
documents. Both are matched: one vocabulary, the words of all documents, and the same smoothing, so their losses differ
by their counts alone. A document's score is the mean over its tokens of target loss minus background loss: the lower,
the closer to the target.

    p(w | h) = (c(h, w) + STRENGTH p(w)) / (c(h) + STRENGTH),    p(w) = (c(w) + STRENGTH q(w)) / (c() + STRENGTH)

with q(w) the share of a word in all documents, so every word of the corpus has a probability in either model, and the
probabilities of each context sum to one. Nothing is pruned: all words and all bigrams count, however many there are,
so what the models hold grows with the corpus, and no table of it is ever in one place.

Counts meet the documents in one shuffle. A task numbers the words of some texts, counts the bigrams of each text and
deals them out by word, in parcels of one row for each bucket of words. A bucket thus has all that the two models know
about its words: c(h, w) and c(w), and c(h) of its words as contexts, whose logarithms are a term of their own. Losses
are added up by chunk of texts, in parcels again, in fixed point, so the order of tasks does not matter. Words and bigrams that hold too large a
share of all tokens for one bucket are counted beforehand, by exact sums over all texts, and broadcast: at most
``16 x partitions`` of either. Their losses are added where they stand; other bigrams of such words are dealt by bigram.
A word is told by 64 bits of its hash.

Contract: null texts count as empty; documents without words have no losses (null); labels without a document are
ignored, and where values for an id differ, one that calls it good counts; rows may repeat and are counted and scored
each on its own; without target documents the target model is that of the words' shares alone; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Bytes and texts that a task numbers at once, and bytes that it hashes at once: bounds its memory.
CHUNK_BYTES, CHUNK_TEXTS, BLOCK_BYTES = 4 << 20, 1 << 16, 1 << 19
#: Arrow batches of texts.
BATCH = "4m"
#: Tokens that a bucket gets on average, entries that are scored at once.
BUCKET_TOKENS, ENTRIES_AT_ONCE = 1 << 18, 1 << 20
STRENGTH = 100.0
#: Fixed point of the summed losses.
UNIT = 1 << 24
#: At most so many labelled documents are broadcast; beyond, texts are joined by a shuffle.
MAX_BROADCAST_LABELS = 1_000_000

#: Bytes of words: letters, digits and all of what is not ASCII.
_OF_WORDS = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_RNG = np.random.default_rng(1729)
_LETTERS = np.where(_OF_WORDS, _RNG.integers(1, 1 << 64, 256, dtype=np.uint64), np.uint64(0))
_RADIX = int(_RNG.integers(0, 1 << 62)) * 2 + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    return mixed ^ (mixed >> np.uint64(32))


#: What is no word: before the first word of a text, after its last one.
BEGIN, END = 0, 1
EDGES = _mixed(np.array([1, 2], np.uint64))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where the combination of some columns, sorted together, begins anew."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sum_at(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.empty(0, values.dtype)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the radix and of its inverse, modulo 2^64."""
    return tuple(np.concatenate([[np.uint64(1)], np.full(n - 1, r & ((1 << 64) - 1), np.uint64)]).cumprod(dtype=np.uint64) for r in (_RADIX, pow(_RADIX, -1, 1 << 64)))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word: polynomials in the radix, all words of a block at once."""
    hashes, places, at = [], [], 0
    while at < len(raw):
        until = at + BLOCK_BYTES
        if until < len(raw):  # words end at blanks
            until = max(raw.rfind(b" ", at, until), at)
            if until == at:
                until = raw.find(b" ", at + BLOCK_BYTES)
                until = len(raw) if until < 0 else until
        block = np.frombuffer(raw, np.uint8, min(until, len(raw)) - at, at)
        letters = _LETTERS[block]
        edges = np.flatnonzero(np.diff(letters != 0, prepend=False, append=False))
        starts = edges[::2]
        powers, inverses = (x[: len(block)] for x in _powers(max(BLOCK_BYTES, 1 << len(block).bit_length())))
        letters *= powers
        hashes.append(_mixed(_sum_at(letters, starts) * inverses[starts]))  # what stands between words adds nothing
        places.append(starts + at)
        at = min(until, len(raw))
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


class Chunk:
    """The words of some texts, or parts of texts: the hash of each and its text, and of the last word of each text.

    ``before`` is the hash of the last word of the first text so far, where an earlier chunk has its begin.
    """

    def __init__(self, parts: list[tuple[int, int | None, bool, bytes]], before: int | None, over: bool):
        self.rows, self.ids, target, raws = zip(*parts, strict=True)
        self.is_target = np.array(target, bool)
        self.word, places = word_hashes(b" ".join(raws))
        begins = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
        self.doc = np.searchsorted(begins, places, "right") - 1
        self.n = len(self.word)
        self.n_words = np.bincount(self.doc, minlength=len(parts))
        self.begins = full = self.n_words > 0
        self.context = np.concatenate([EDGES[:1], self.word[:-1]])[: self.n]
        self.context[(np.cumsum(self.n_words) - self.n_words)[full]] = EDGES[BEGIN]
        ended = full.copy()
        ended[-1] &= over
        self.final_word, self.final_doc = self.word[np.cumsum(self.n_words)[ended] - 1], np.flatnonzero(ended)
        if before is not None:
            self.begins = full & (np.arange(len(parts)) > 0)
            if full[0]:
                self.context[0] = before
            elif over or len(parts) > 1:
                self.final_word, self.final_doc = np.append(self.final_word, np.uint64(before)), np.append(self.final_doc, 0)
        #: the hash that the next chunk carries on from, if the last text goes on
        self.last = None if over else int(self.word[-1]) if full[-1] else before if len(parts) == 1 else None

    def entries(self) -> tuple[np.ndarray, ...]:
        """Hashes of the distinct words; then number of word, of context, place of text and count, sorted.

        The context END marks the last word of a text.
        """
        number, distinct = pd.factorize(np.concatenate([EDGES, self.word, self.context[:1], self.final_word]))  # the first context may be of another chunk
        word = number[len(EDGES) : len(EDGES) + self.n]
        context = np.concatenate([number[len(EDGES) + self.n :][:1], word[:-1]]) if self.n else word
        context[(np.cumsum(self.n_words) - self.n_words)[self.begins]] = BEGIN
        final = number[len(number) - len(self.final_word) :]
        wide, deep = len(distinct).bit_length(), len(self.rows).bit_length()
        packed = np.concatenate([word << (wide + deep) | context << deep | self.doc, final << (wide + deep) | END << deep | self.final_doc])
        packed.sort()
        first = _runs(packed)
        each = packed[first]
        return distinct, each >> (wide + deep), each >> deep & ((1 << wide) - 1), each & ((1 << deep) - 1), np.diff(np.append(first, len(packed)))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of ``row, doc_id, is_target, text``; a very long text may be spread over several."""
    parts, size, before = [], 0, None
    for batch in batches:
        for *told, text in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "is_target", "text")], strict=True):
            raw, at = text.lower().encode(), 0
            while len(raw) - at > CHUNK_BYTES:  # cut at a blank
                until = raw.find(b" ", at + CHUNK_BYTES)
                if until < 0:
                    break
                chunk = Chunk([*parts, (*told, raw[at:until])], before, False)
                yield chunk
                parts, size, before, at = [], 0, chunk.last, until
            parts.append((*told, raw[at:]))
            size += len(raw) - at + 1
            if size >= CHUNK_BYTES or len(parts) >= CHUNK_TEXTS:
                yield Chunk(parts, before, True)
                parts, size, before = [], 0, None
    if parts:
        yield Chunk(parts, before, True)


@dataclass(frozen=True)
class Totals:
    """Tokens and texts with words: of all documents, of the target."""

    tokens: int = 0
    target_tokens: int = 0
    texts: int = 0
    target_texts: int = 0


def pair_codes(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return word ^ _mixed(context)


def places(among: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each hash its place among sorted ones, or -1."""
    if not len(among):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(among, hashes), len(among) - 1)
    return np.where(among[at] == hashes, at, -1)


@dataclass
class Frequent:
    """Exact counts of the words and bigrams that one bucket could not hold, sorted by their hashes."""

    words: np.ndarray
    counts: np.ndarray  # of each word: n, of the target, last of a text, of the target
    pairs: np.ndarray  # word and context of each bigram, sorted by their code
    pair_counts: np.ndarray  # of each bigram: n, of the target

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash its place among the words, or -1."""
        return places(self.words, hashes)

    def pair_places(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of each bigram, by hashes, its place or -1."""
        if not len(self.pairs):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(pair_codes(self.pairs[:, 0], self.pairs[:, 1]), pair_codes(word, context)), len(self.pairs) - 1)
        return np.where((self.pairs[at, 0] == word) & (self.pairs[at, 1] == context), at, -1)


COUNTED = "kind int, word long, context long, n long, n_target long, n_last long, n_last_target long"
_COUNTED = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("word", "context", "n", "n_target", "n_last", "n_last_target")]])
TOTAL, WORD, PAIR = range(3)


def _often(hashes: np.ndarray, least: float) -> np.ndarray:
    """The values that stand at least so often, sorted."""
    ordered = np.sort(hashes)
    first = _runs(ordered)
    return ordered[first[np.diff(np.append(first, len(ordered))) >= least]]


def _tally(chunk: Chunk, share: float | None, asked: Frequent | None) -> pa.RecordBatch:
    """Totals, and counts of words and bigrams: of those with a share of the chunk's tokens, or of those that are asked for."""
    words = _often(chunk.word, share * chunk.n) if asked is None else asked.words
    target, final_target = chunk.is_target[chunk.doc], chunk.is_target[chunk.final_doc]
    totals = [chunk.n, int(target.sum()), len(chunk.final_word), int(final_target.sum())]
    place, final = places(words, chunk.word), places(words, chunk.final_word)
    counts = [np.bincount(at[at >= 0], minlength=len(words)) for at in (place, place[target], final, final[final_target])]
    # a frequent bigram ends in a frequent word
    at = np.flatnonzero(place >= 0)
    code, first, number, n = np.unique(pair_codes(chunk.word[at], chunk.context[at]), return_index=True, return_inverse=True, return_counts=True)
    word, context = chunk.word[at][first], chunk.context[at][first]
    some = n >= share * chunk.n if asked is None else asked.pair_places(word, context) >= 0
    n_target = np.bincount(number, target[at], len(code)).astype(np.int64)
    none = np.zeros(int(some.sum()), np.int64)
    columns = [
        np.concatenate([[TOTAL], np.full(len(words), WORD), np.full(len(none), PAIR)]),
        np.concatenate([[0], words.view(np.int64), word[some].view(np.int64)]),
        np.concatenate([[0], np.zeros(len(words), np.int64), context[some].view(np.int64)]),
        *[np.concatenate([[totals[k]], counts[k], (n, n_target)[k][some] if k < 2 else none]) for k in range(4)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if t == pa.int32() else np.int64)) for c, t in zip(columns, _COUNTED.types, strict=True)], schema=_COUNTED)


def _tallies(texts: DataFrame, share: float | None = None, asked=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield _tally(chunk, share, asked.value if asked is not None else None)

    sums = [F.sum(c).alias(c) for c in ("n", "n_target", "n_last", "n_last_target")]
    return texts.mapInArrow(run, COUNTED).groupBy("kind", "word", "context").agg(*sums)


def count_frequent(texts: DataFrame, n_partitions: int) -> tuple[Totals, Frequent]:
    """Totals, and exact counts of the words and bigrams with at least ``1 / (8 n_partitions)`` of all tokens.

    What has that share of all has at least half of it within the chunks where it has half that share, so the first
    pass, which counts within chunks, misses none that could fill a bucket; the second one counts over all texts.
    """
    share = 1 / (16 * n_partitions)
    local = materialize(_tallies(texts, share), "locally-frequent")
    n = local.filter(F.col("kind") == TOTAL).agg(F.sum("n")).first()[0] or 0
    found = local.filter((F.col("kind") != TOTAL) & (F.col("n") >= max(1.0, share * n))).select("kind", "word", "context").collect()  # at most 16 n_partitions of either
    # the context of a kept bigram is no word of its own here, but its word is frequent, too
    words = np.unique(np.array([r.word for r in found], np.int64).view(np.uint64))
    pairs = np.array([(r.word, r.context) for r in found if r.kind == PAIR], np.int64).reshape(-1, 2).view(np.uint64)
    pairs = pairs[np.argsort(pair_codes(pairs[:, 0], pairs[:, 1]))]
    asked = Frequent(words, np.zeros((len(words), 4), np.int64), pairs, np.zeros((len(pairs), 2), np.int64))
    totals = Totals()
    for r in _tallies(texts, asked=texts.sparkSession.sparkContext.broadcast(asked)).collect():
        if r.kind == TOTAL:
            totals = Totals(r.n, r.n_target, r.n_last, r.n_last_target)
        elif r.kind == WORD:
            asked.counts[asked.places(np.array([r.word], np.int64).view(np.uint64))[0]] = r.n, r.n_target, r.n_last, r.n_last_target
        else:
            asked.pair_counts[asked.pair_places(*[np.array([x], np.int64).view(np.uint64) for x in (r.word, r.context)])[0]] = r.n, r.n_target
    return totals, asked


@dataclass(frozen=True)
class Models:
    """What a task must know of both models beside the counts in hand."""

    totals: Totals
    frequent: Frequent

    def priors(self, n: np.ndarray, n_target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(w) of the target and of the background, from the counts of words."""
        q = n / max(1, self.totals.tokens)
        return (n_target + STRENGTH * q) / (self.totals.target_tokens + STRENGTH), q

    def numerators(self, pairs: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """-log(c(h, w) + STRENGTH p(w)) of the target and of the background; counts are (all, target)."""
        priors = self.priors(*words)
        return [-np.log(c + STRENGTH * p) for c, p in zip(reversed(pairs), priors, strict=True)]

    @staticmethod
    def denominators(n: np.ndarray, n_target: np.ndarray) -> list[np.ndarray]:
        """log(c(h) + STRENGTH) of the target and of the background."""
        return [np.log(c + STRENGTH) for c in (n_target, n)]


PARCEL = "bucket long, kind int, base long, a binary, b binary, c binary, d binary, e binary, f binary"
_PARCEL = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("base", pa.int64()), *[(c, pa.binary()) for c in "abcdef"]])
#: Kinds of parcels: what is known of the texts of a chunk, bigrams, and what buckets found of the texts of a chunk.
TEXTS, BIGRAMS, FOUND = range(3)
def _fixed(losses: np.ndarray) -> np.ndarray:
    return np.rint(losses * UNIT).astype(np.int64)


def parcels(chunk: Chunk, models: Models, n_buckets: int) -> pa.RecordBatch:
    """A row of what is known of the chunk's texts, and one for each bucket with the bigrams that are dealt to it."""
    frequent = models.frequent
    hashes, word, context, doc, n = chunk.entries()
    target, rows = chunk.is_target, np.array(chunk.rows, np.int64)
    place = frequent.places(hashes)  # of each number of the chunk
    starts = _runs(word, context)
    runs = np.diff(np.append(starts, len(word)))
    pair_word, pair_context = word[starts], context[starts]
    known = place[pair_word] >= 0
    pair_place = np.full(len(starts), -1)
    if len(frequent.pairs):
        at = np.flatnonzero(known)
        pair_place[at] = frequent.pair_places(hashes[pair_word[at]], hashes[pair_context[at]])
    # losses that need no other chunk: the begin of a text, frequent words as contexts, frequent bigrams
    own = np.zeros((2, len(rows)))
    for k, d in enumerate(models.denominators(np.array([models.totals.texts]), np.array([models.totals.target_texts]))):
        own[k, chunk.begins] += d[0]
    is_end = pair_context == END
    sums = np.zeros((2, len(starts)))
    if known.any():
        counts = frequent.counts[place[pair_word[known]]]
        for k, d in enumerate(models.denominators(counts[:, 0] - counts[:, 2], counts[:, 1] - counts[:, 3])):
            sums[k, known] += np.where(is_end[known], -d, d)
        both = pair_place >= 0
        counts, pair_counts = frequent.counts[place[pair_word[both]]], frequent.pair_counts[pair_place[both]]
        for k, x in enumerate(models.numerators((pair_counts[:, 0], pair_counts[:, 1]), (counts[:, 0], counts[:, 1]))):
            sums[k, both] += x
        for k in range(2):
            own[k] += np.bincount(doc, np.repeat(sums[k], runs) * n, len(rows))
    texts = [rows, np.array([i or 0 for i in chunk.ids], np.int64), np.array([i is None for i in chunk.ids]), chunk.n_words.astype(np.int64), *map(_fixed, own)]
    base = int(rows.min())
    out = [(int(_mixed(rows[:1].view(np.uint64))[0] % np.uint64(n_buckets)), TEXTS, base, *[x.tobytes() for x in texts])]
    # the rest by bucket
    sent = (pair_place < 0) & ~(known & is_end)
    key = hashes[pair_word]
    key = np.where(known, pair_codes(key, hashes[pair_context]), key)
    bucket = (_mixed(key) % np.uint64(n_buckets)).astype(np.int64)
    chosen = np.flatnonzero(sent)
    chosen = chosen[np.argsort(bucket[chosen].astype(np.uint16 if n_buckets <= 1 << 16 else np.int64), kind="stable")]
    sizes = runs[chosen]
    upto = np.cumsum(sizes)
    at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[chosen] - (upto - sizes), sizes)
    apart = (rows - base).astype(np.uint64)
    if int(apart.max()) < 1 << 32:
        apart = apart.astype(np.uint32)
    docs, counted = apart[doc[at]], (n[at] << 1 | target[doc[at]]).astype(np.uint32)
    words, contexts, lengths = hashes[pair_word[chosen]], hashes[pair_context[chosen]], sizes.astype(np.uint32)
    cuts = _runs(bucket[chosen])
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chosen)][: len(cuts)], strict=True):
        a, b = int(upto[lo] - sizes[lo]), int(upto[hi - 1])
        fresh = _runs(words[lo:hi])
        repeats = np.diff(np.append(fresh, hi - lo)).astype(np.uint32)
        out.append((int(bucket[chosen[lo]]), BIGRAMS, base, words[lo:hi][fresh].tobytes(), repeats.tobytes(), contexts[lo:hi].tobytes(), lengths[lo:hi].tobytes(), docs[a:b].tobytes(), counted[a:b].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PARCEL.types, strict=True)], schema=_PARCEL)


@dataclass
class Opened:
    """A parcel of bigrams: words and how many bigrams each has, the contexts and how many entries, the entries."""

    base: int
    words: np.ndarray
    repeats: np.ndarray
    contexts: np.ndarray
    lengths: np.ndarray
    apart: np.ndarray  # row, from the base
    counted: np.ndarray  # count, with the target flag lowest

    @classmethod
    def of(cls, parcel: tuple) -> Opened:
        _, _, base, words, repeats, contexts, lengths, apart, counted = parcel
        counted = np.frombuffer(counted, np.uint32)
        return cls(
            base, np.frombuffer(words, np.uint64), np.frombuffer(repeats, np.uint32).astype(np.int64), np.frombuffer(contexts, np.uint64), np.frombuffer(lengths, np.uint32).astype(np.int64),
            np.frombuffer(apart, np.uint32 if len(apart) == 4 * len(counted) else np.uint64), counted.astype(np.int64),
        )


SUMS = "row long, doc_id long, n_words long, target long, background long"
_SUMS = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "n_words", "target", "background")])


def _by_chunk(parts: list[Opened], sums: list[np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
    """By the base of a chunk the rows of its texts, from there, and the sums of their entries."""
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    at = 0
    for p in parts:
        apart = p.apart.astype(np.int64)
        found.setdefault(p.base, []).append((apart, *[s[at : at + len(apart)] for s in sums]))
        at += len(apart)
    out = {}
    for base, held in found.items():
        apart, *each = (np.concatenate(c) for c in zip(*held, strict=True))
        span = int(apart.max()) + 1
        if span <= 8 * len(apart) + 4096:  # the rows of a chunk mostly lie together
            rows, place = np.flatnonzero(np.bincount(apart, minlength=span)), apart
        else:
            rows, place = np.unique(apart, return_inverse=True)
            span = len(rows)
        totals = [np.bincount(place, e, span) for e in each]  # whole numbers below 2^53
        out[base] = rows, *[(t[rows] if place is apart else t).astype(np.int64) for t in totals]
    return out


def scored(parts: list[Opened], models: Models) -> pa.RecordBatch:
    """Summed losses by row, of whole buckets."""
    words, repeats, context, lengths, counted = (np.concatenate([getattr(p, c) for p in parts]) for c in ("words", "repeats", "contexts", "lengths", "counted"))
    n = counted >> 1
    entry = np.cumsum(lengths) - lengths
    by_chunk = [_sum_at(n, entry), _sum_at(n * (counted & 1), entry)]
    is_end = context == EDGES[END]
    # counts of words; those of a frequent word are known, as its bigrams are spread over buckets
    number, distinct = pd.factorize(words)
    first = np.cumsum(repeats) - repeats
    every = [np.bincount(number, _sum_at(np.where(is_end, 0, x), first)) for x in by_chunk]  # whole numbers below 2^53
    last = [np.bincount(number, _sum_at(np.where(is_end, x, 0), first)) for x in by_chunk]
    place = models.frequent.places(distinct)
    known = place >= 0
    if known.any():
        for k in range(2):
            every[k][known] = models.frequent.counts[place[known], k]
    below = [np.where(known, 0.0, d) for d in models.denominators(every[0] - last[0], every[1] - last[1])]
    # counts of bigrams
    number = np.repeat(number, repeats)
    pair, codes = pd.factorize(pair_codes(np.repeat(words, repeats), context))
    of, ends = np.empty(len(codes), np.int64), np.empty(len(codes), bool)
    of[pair], ends[pair] = number, is_end
    pairs = [np.bincount(pair, x) for x in by_chunk]
    sums = []
    for top, bottom in zip(models.numerators((pairs[0], pairs[1]), (every[0][of], every[1][of])), below, strict=True):
        by_pair = _fixed(np.where(ends, -bottom[of], top + bottom[of]))
        sums.append(np.repeat(by_pair[pair], lengths) * n)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*[(0, FOUND, base, *[x.tobytes() for x in each], b"", b"", b"") for base, each in _by_chunk(parts, sums).items()], strict=True), _PARCEL.types, strict=True)],
        schema=_PARCEL,
    )


def added_up(base: int, told: list[tuple]) -> pa.RecordBatch:
    """``SUMS`` of the texts of the chunks with one base, from their ``TEXTS`` and ``FOUND`` parcels."""
    rows, target, background, known = [], [], [], []
    for kind, *columns in told:
        if kind == FOUND:
            places, *each = (np.frombuffer(c, np.int64) for c in columns[:3])
            places = places + base
        else:
            places, ids, n_words, *each = (np.frombuffer(columns[k], np.int64) for k in (0, 1, 3, 4, 5))
            known.append((places, ids, np.frombuffer(columns[2], bool), n_words))
        rows.append(places)
        target.append(each[0])
        background.append(each[1])
    every, place = np.unique(np.concatenate(rows), return_inverse=True)
    sums = [np.zeros(len(every), np.int64) for _ in range(3)]
    for held, values in zip(sums, (target, background), strict=False):
        np.add.at(held, place, np.concatenate(values))
    ids, no_id = np.zeros(len(every), np.int64), np.ones(len(every), bool)
    for places, i, none, n in known:
        at = np.searchsorted(every, places)
        np.add.at(sums[2], at, n)
        ids[at], no_id[at] = i, none
    return pa.RecordBatch.from_arrays([pa.array(every), pa.array(ids, mask=no_id), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])], schema=_SUMS)


def _sums(texts: DataFrame, models, n_buckets: int) -> DataFrame:
    """``row, doc_id, n_words, target, background``: summed losses of every row of ``texts``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield parcels(chunk, models.value, n_buckets)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket = [], 0, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            if (kinds == TEXTS).any():
                yield batch.filter(pa.array(kinds == TEXTS))
            for parcel in zip(*[c.to_pylist() for c in batch.filter(pa.array(kinds == BIGRAMS)).columns], strict=True):
                if parcel[0] != bucket:
                    bucket = parcel[0]
                    if size >= ENTRIES_AT_ONCE:
                        yield scored(held, models.value)
                        held, size = [], 0
                held.append(Opened.of(parcel))
                size += len(held[-1].counted)
        if held:
            yield scored(held, models.value)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, told = None, []
        for batch in batches:
            for at, kind, *columns in zip(*[batch.column(c).to_pylist() for c in ("base", "kind", *"abcdef")], strict=True):
                if told and at != base:
                    yield added_up(base, told)
                    told = []
                base = at
                told.append((kind, *columns))
        if told:
            yield added_up(base, told)

    found = texts.mapInArrow(deal, PARCEL).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, PARCEL)
    summed = found.repartition("base").sortWithinPartitions("base").mapInArrow(add_up, SUMS)
    # the parts of a very long text may be of chunks with different bases
    return summed.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "target", "background")])


def _flagged(docs: DataFrame, labels: DataFrame, max_broadcast: int) -> DataFrame:
    """``row, doc_id, is_target, text``: rows numbered, those called good marked."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("good_id")).dropna().distinct()
    if good.limit(max_broadcast + 1).count() <= max_broadcast:
        return texts.join(F.broadcast(good), texts["doc_id"] == good["good_id"], "left").select("row", "doc_id", F.col("good_id").isNotNull().alias("is_target"), "text")
    # texts without an id have no label, so no key stands for all of them
    flagged = texts.filter("doc_id IS NOT NULL").join(good.hint("merge"), texts["doc_id"] == good["good_id"], "left").select("row", "doc_id", F.col("good_id").isNotNull().alias("is_target"), "text")
    return materialize(flagged.unionByName(texts.filter("doc_id IS NULL").select("row", "doc_id", F.lit(False).alias("is_target"), "text")), "flagged-texts")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, max_broadcast: int = MAX_BROADCAST_LABELS) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` (losses a word, in nats) for every row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark, BATCH)
    texts = _flagged(docs, labels, max_broadcast)
    n_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    totals, frequent = count_frequent(texts, n_partitions)
    n_buckets = max(4 * n_partitions, totals.tokens // BUCKET_TOKENS)
    sums = _sums(texts, spark.sparkContext.broadcast(Models(totals, frequent)), n_buckets)
    losses = [F.when(F.col("n_words") > 0, F.col(c) / float(UNIT) / F.col("n_words")).alias(f"{c}_loss") for c in ("target", "background")]
    return sums.select("doc_id", "n_words", *losses).withColumn("score", F.col("target_loss") - F.col("background_loss"))
