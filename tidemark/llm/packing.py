"""Sum-of-squares online packing of token sequences.

Each task packs its own rows, in order, as they stream by; nothing is shuffled. A document is cut into whole windows
while it is longer than one; what is left goes to the fill level that minimises the sum of squared counts of partially
filled windows, which a level array tracks. A window is emitted when it is full.

Windows that are still open at the end, or when more than ``max_open`` are, are closed by cutting: pieces of the
emptiest fill the gaps of the fullest, and the one window that stays partial is cut into windows of power-of-two
lengths, which need no padding. So no text is dropped, memory is bounded by ``max_open`` windows, and there is no
padding at all.

Contract: a null text counts as empty and gives only the end token; rows that repeat are packed each on its own; an
empty table gives an empty result; other columns are ignored. ``sequence_id`` is unique over all tasks: the number of
the task, then a count within it.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches

#: Characters at which ``str.split`` splits but the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANK_CHUNKS = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: A chunk that is one word of the tokenizer, or one and a run of punctuation.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
#: Entries of the chunk cache, about 80 MB; it starts anew beyond.
CACHE_SIZE = 500_000
SEQUENCE_BITS = 36


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


#: Normalisers that change characters one by one, or compose them with a mark that follows.
LOCAL_NORMALISERS = {"NFC", "Lowercase", "Replace"}


def drops_blanks(spec: dict, tokenizer: Tokenizer) -> bool:
    """Whether no token of this tokenizer can depend on what stands beyond a blank."""
    steps = spec.get("normalizer") or {"normalizers": []}
    steps = steps.get("normalizers", [steps])
    local = all(n["type"] in LOCAL_NORMALISERS for n in steps) and all(n["content"].isspace() and n["pattern"] == {"Regex": r"\s+"} for n in steps if n["type"] == "Replace")
    parts = spec.get("pre_tokenizer") or {}
    parts = parts.get("pretokenizers", [parts])
    first = parts[0]
    removed = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    plain = all(p.get("add_prefix_space", False) is False for p in parts) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens", []))
    if not (local and removed and plain and added and spec.get("post_processor") is None):
        return False
    words = [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str("ab \t\ncd  é")]
    return words[:2] == ["ab", "cd"] and len(words) == 3


class CachedTokenizer:
    """Little-endian 32-bit ids of texts. Chunks between blanks are encoded on their own and remembered.

    That is exact for a tokenizer whose normaliser maps character by character or composes marks with the character
    before, and whose pre-tokenizer drops blanks: no token can span one. ``by_chunks`` tells whether the tokenizer's
    own description says so; the texts of any other one are encoded whole. Chunks of plain words go straight to the
    model where a probe shows that the tokenizer treats them so; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.seen: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.by_chunks = drops_blanks(json.loads(self.tokenizer.to_str()), self.tokenizer)
        self.direct = all(self._plain(x) == self._full(x) for x in ("Word.", "straßE", "!!", "Été$$$", "x", "it'"))

    def _full(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, chunk: str) -> bytes | None:
        """Ids of a plain chunk, else None."""
        found = PLAIN.fullmatch(chunk)
        if not found:
            return None
        word, marks = found.groups()
        ids = self._model_ids(word.lower()) if word else b""
        if marks:
            if marks not in self.marks:
                if len(self.marks) >= 10_000:
                    self.marks.clear()
                self.marks[marks] = self._model_ids(marks)
            ids += self.marks[marks]
        return ids

    def _model_ids(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return b"".join([self.packed[t.id] for t in self.model.tokenize(word)])

    def _new(self, chunk: str) -> bytes:
        ids = self._plain(chunk) if self.direct else None
        if ids is None:
            ids = self._full(chunk)
        if len(self.seen) >= CACHE_SIZE:
            self.seen.clear()
        self.seen[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_chunks:
            return self._full(text)
        chunks = BLANK_CHUNKS.split(text) if SEPARATORS.search(text) else text.split()
        found = list(map(self.seen.get, chunks))
        if None in found:
            found = [self.seen.get(c) or self._new(c) if f is None else f for c, f in zip(chunks, found, strict=True)]
        return b"".join(found)


@cache
def load_tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


@dataclass
class Piece:
    """A part of a document's ids; cutting copies none of them."""

    doc_id: int | None
    start: int
    ids: memoryview
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head, tail = self.ids[: 4 * at], self.ids[4 * at :]
        return Piece(self.doc_id, self.start, head, self.doc_tokens), Piece(self.doc_id, self.start + at, tail, self.doc_tokens)


@dataclass
class SumOfSquaresPacker:
    """Takes documents one by one; ``add`` and ``close`` yield windows that are done, as lists of pieces."""

    size: int = 4096
    max_open: int = 512
    #: levels[h]: open windows that hold h tokens
    levels: np.ndarray = field(init=False)
    windows: dict[int, list[list[Piece]]] = field(init=False, default_factory=dict)
    n_open: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        self.levels = np.zeros(self.size + 1, np.int64)

    def best_level(self, length: int) -> int:
        """The fill level (0: a new window) whose use adds least to the sum of squares; of equals the fullest."""
        open_levels = np.flatnonzero(self.levels[1 : self.size - length + 1]) + 1
        counts = self.levels[open_levels + length]
        change = 2 * (counts - self.levels[open_levels]) + 2
        change[open_levels + length == self.size] = 1 - 2 * self.levels[self.size - length]  # a full window counts no more
        new = 2 * self.levels[length] + 1
        if not len(change) or new < change.min():
            return 0
        return int(open_levels[np.flatnonzero(change == change.min())[-1]])

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece) >= self.size:
            head, piece = piece.cut(self.size)
            yield [head]
        if not len(piece):
            return
        if piece.start:  # an open window must not hold on to the whole of a long document
            piece.ids = memoryview(bytes(piece.ids))
        level = self.best_level(len(piece))
        window: list[Piece] = []
        if level:
            window = self.windows[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        window.append(piece)
        yield from self._put(window, level + len(piece))
        if self.n_open > self.max_open:
            yield from self._consolidate()

    def _put(self, window: list[Piece], level: int) -> Iterator[list[Piece]]:
        if level == self.size:
            yield window
        else:
            self.windows.setdefault(level, []).append(window)
            self.levels[level] += 1
            self.n_open += 1

    def _consolidate(self) -> Iterator[list[Piece]]:
        """Fill the fullest open windows with pieces of the emptiest, cut where need be; at most one stays open."""
        by_level = [(level, w) for level in sorted(self.windows) for w in self.windows[level]]
        self.windows, self.n_open = {}, 0
        self.levels[:] = 0
        low, high = 0, len(by_level) - 1
        while low < high:
            level, window = by_level[high]
            given_level, giver = by_level[low]
            take = min(self.size - level, given_level)
            left = take
            while left:
                piece = giver.pop()
                if len(piece) > left:
                    kept, piece = piece.cut(len(piece) - left)
                    giver.append(kept)
                window.append(piece)
                left -= len(piece)
            by_level[high], by_level[low] = (level + take, window), (given_level - take, giver)
            if level + take == self.size:
                yield window
                high -= 1
            if given_level == take:
                low += 1
        if low == high:
            yield from self._put(by_level[low][1], by_level[low][0])

    def close(self) -> Iterator[list[Piece]]:
        """All that is open: full windows, then one for each power of two in the number of tokens left."""
        yield from self._consolidate()
        rest = deque(piece for ws in self.windows.values() for w in ws for piece in w)
        self.windows, self.n_open = {}, 0
        self.levels[:] = 0
        left = sum(map(len, rest))
        for power in reversed(range(left.bit_length())):
            if not left >> power & 1:
                continue
            window, room = [], 1 << power
            while room:
                piece = rest.popleft()
                if len(piece) > room:
                    piece, after = piece.cut(room)
                    rest.appendleft(after)
                window.append(piece)
                room -= len(piece)
            yield window


PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _rows(windows: Iterable[list[Piece]], first_id: int) -> list[tuple]:
    rows = []
    for k, window in enumerate(windows, first_id):
        offset = 0
        for p in window:
            rows.append((p.doc_id, p.start, len(p), bytes(p.ids), p.doc_tokens, k, offset))
            offset += len(p)
    return rows


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 4096, max_open: int = 512) -> DataFrame:
    """One row for each piece: its document, place there, ids (little-endian unsigned 32-bit), sequence and offset there.

    Sequences are ``size`` long, but for powers of two at the end of a task. ``tokenizer_path`` must exist on every
    executor; its special strings inside texts are handled as the library does by default.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = load_tokenizer(tokenizer_path), SumOfSquaresPacker(size, max_open)
        next_id = TaskContext.get().partitionId() << SEQUENCE_BITS

        def emitted(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal next_id
            rows = _rows(windows, next_id)
            next_id += len(windows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        done: list[list[Piece]] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokenizer.encode(text) + end
                for window in packer.add(Piece(doc_id, 0, memoryview(ids), len(ids) // 4)):
                    done.append(window)
                    if len(done) >= 256:
                        yield emitted(done)
                        done = []
        done += packer.close()
        if done:
            yield emitted(done)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, PACKED)


def piece_digests(packed: DataFrame) -> DataFrame:
    """``packed`` with the CRC-32 of each piece's ids in place of the ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
