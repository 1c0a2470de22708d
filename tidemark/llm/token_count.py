"""Token counts of a SentencePiece BPE model, with overlap resynchronisation for huge documents.

A text of at most ``chunk_chars`` characters is encoded whole. A longer one is encoded in chunks that overlap. Two
neighbouring encodings are compared in their overlap, by the offsets of their tokens, and spliced at a common boundary,
one at which either begins a token, that is proven stable: no piece of the vocabulary contains the two characters that
meet there, so no merge of the whole text can span it, and what either side encodes to does not depend on the other.
Where the alignment fails, because the overlap has no such boundary, it is widened, towards the begin of the chunk
before and, when that is used up, by a longer chunk, until there is one or the text ends.

Contract: null texts count as empty (0 bytes, 0 tokens); rows may repeat and are counted each on its own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import bounded_batches

SPACE = "▁"


def inner_pairs(pieces: list[str]) -> set[str]:
    """Every two characters that stand side by side inside some piece."""
    return {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1)}


class ResyncEncoder:
    """Whole-text token ids of a SentencePiece model, from bounded chunks."""

    def __init__(self, processor, chunk_chars: int = 1 << 16, overlap_chars: int = 1 << 9):
        if overlap_chars < 1 or chunk_chars <= 2 * overlap_chars:
            raise ValueError("chunks must be more than twice as long as their overlaps")
        self.processor, self.chunk_chars, self.overlap_chars = processor, chunk_chars, overlap_chars
        pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
        self.joined = inner_pairs(pieces)
        self.known = {p for p in pieces if len(p) == 1}
        spec = sentencepiece_model_pb2.ModelProto.FromString(processor.serialized_model_proto())
        self.bytes_for_unknown = spec.trainer_spec.byte_fallback
        # the proof holds for merges of unchanged characters only
        self.provable = (
            spec.trainer_spec.model_type == spec.trainer_spec.BPE
            and spec.normalizer_spec.name == "identity"
            and not spec.normalizer_spec.remove_extra_whitespaces
            and not spec.trainer_spec.user_defined_symbols
        )

    def stable(self, left: str, right: str) -> bool:
        """Whether no token of any text can hold ``left`` and the ``right`` after it."""
        pair = (left + right).replace(" ", SPACE)
        return pair not in self.joined and (self.bytes_for_unknown or bool(self.known & set(pair)))

    def offsets(self, text: str, begin: int, end: int, at: int) -> tuple[list[int], list[int]]:
        """Token ids of ``text[begin:end]`` and the UTF-8 position in the text at which each begins, that of ``begin`` being ``at``."""
        pieces = self.processor.encode(text[begin:end], return_type="proto").pieces
        return [p.id for p in pieces], [at + p.begin for p in pieces]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.chunk_chars or not self.provable:
            return self.processor.encode(text)
        out: list[int] = []
        done = done_at = 0  # the kept tokens cover text[:done], its first done_at bytes
        end = min(len(text), self.chunk_chars)
        begin, begin_at = 0, 0
        left = self.offsets(text, begin, end, begin_at)
        while end < len(text):
            overlap, size = self.overlap_chars, self.chunk_chars
            while True:
                start = max(done, end - overlap)
                start_at = done_at + len(text[done:start].encode())
                until = min(len(text), max(start + size, end + self.overlap_chars))
                right = self.offsets(text, start, until, start_at)
                cut = self._common(text, start, end, start_at, left[1], right[1])
                if cut or until == len(text) and start == done:
                    break
                if start > done:  # alignment failed: widen the overlap
                    overlap *= 2
                else:  # and then the chunk
                    size *= 2
                    end = min(len(text), begin + max(size, end - begin + self.chunk_chars))
                    left = self.offsets(text, begin, end, begin_at)
                    overlap = end - done
            if not cut:  # nothing aligns up to the end of the text: the chunk before takes it all
                end = len(text)
                left = self.offsets(text, begin, end, begin_at)
                break
            out += left[0][bisect_left(left[1], done_at) if done else 0 : bisect_left(left[1], cut[1])]
            done, done_at = cut
            begin, begin_at, end, left = start, start_at, until, right
        return out + left[0][bisect_left(left[1], done_at) if done else 0 :]

    def _common(self, text: str, start: int, end: int, start_at: int, left: list[int], right: list[int]) -> tuple[int, int] | None:
        """The last stable boundary between ``start`` and ``end`` at which both encodings begin a token: its character and byte.

        The first character of the overlap does not count: there the model may add a prefix.
        """
        both = set(left[bisect_left(left, start_at + 1) :]).intersection(right)
        at, found = start_at, None
        for k in range(start, end):
            if k > start and at in both and self.stable(text[k - 1], text[k]):
                found = k, at
            at += _width(text[k])
        return found


def _width(character: str) -> int:
    """Bytes of a character in UTF-8."""
    code = ord(character)
    return 1 if code < 0x80 else 2 if code < 0x800 else 3 if code < 0x10000 else 4


@cache
def load_encoder(model_path: str, chunk_chars: int, overlap_chars: int) -> ResyncEncoder:
    """One encoder for each worker process and setting."""
    return ResyncEncoder(sentencepiece.SentencePieceProcessor(model_file=model_path), chunk_chars, overlap_chars)


def count_batch(texts: list[str], encoder: ResyncEncoder) -> list[int]:
    """Token counts of texts; the short ones go to the library together."""
    short = [k for k, t in enumerate(texts) if len(t) <= encoder.chunk_chars]
    counts = [0] * len(texts)
    for k, ids in zip(short, encoder.processor.encode([texts[k] for k in short], num_threads=1), strict=True):
        counts[k] = len(ids)
    for k, t in enumerate(texts):
        if len(t) > encoder.chunk_chars:
            counts[k] = len(encoder.encode(t))
    return counts


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk_chars: int = 1 << 16, overlap_chars: int = 1 << 9) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``. ``model_path`` must exist on every executor."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(model_path, chunk_chars, overlap_chars)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(count_batch(texts, encoder), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
