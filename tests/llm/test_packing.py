import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a\x1c!b x\x85y z", "é É ﬁ é", "<|endoftext|> a<|startoftext|>b", "it's  'S 're\n\n12 3", "　 \xa0x", "İI ς Σ", "\x1f\x1c", "", "don't!! x'", "Á b​c", "word.%%% $$$x"]


def test_cached_ids_are_the_librarys(spark, small):
    plain, cached = Tokenizer.from_file(PATH), P.CachedTokenizer(PATH)
    assert cached.direct
    texts = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for text in texts + texts:
        assert cached.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:50]


def best_level_brute(levels, length, size):
    def cost(level):
        after = levels.copy()
        if level:
            after[level] -= 1
        after[level + length] += 1
        return sum(int(x) ** 2 for x in after[1:size])

    options = [0] + [h for h in range(1, size - length + 1) if levels[h]]
    least = min(map(cost, options))
    return {h for h in options if cost(h) == least}


def test_level_is_the_sum_of_squares_choice():
    rng = random.Random(1)
    for _ in range(300):
        packer = P.SumOfSquaresPacker(16, 10_000)
        for h in range(1, 16):
            packer.levels[h] = rng.choice([0, 0, 1, 2, 5])
        length = rng.randint(1, 15)
        assert packer.best_level(length) in best_level_brute(packer.levels, length, 16)


@pytest.mark.parametrize("max_open", [1, 5, 512])
def test_packing_loses_nothing(max_open):
    rng = random.Random(2)
    packer = P.SumOfSquaresPacker(64, max_open)
    docs = {k: bytes(rng.randbytes(4 * rng.choice([1, 3, 40, 64, 65, 130, 200]))) for k in range(400)}
    windows = [w for k, ids in docs.items() for w in packer.add(P.Piece(k, 0, ids, len(ids) // 4))] + list(packer.close())
    back = defaultdict(dict)
    for w in windows:
        for p in w:
            back[p.doc_id][p.start] = p.ids
    assert {k: b"".join(v[s] for s in sorted(v)) for k, v in back.items()} == docs
    lengths = [sum(map(len, w)) for w in windows]
    short = [n for n in lengths if n < 64]
    assert max(lengths) == 64 and all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short))


def test_query_contract(spark):
    rows = [(k, "word " * (k * 37 % 900)) for k in range(60)] + [(7, None), (None, "x"), (100, "long text " * 9000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, sequence_id string").repartition(3)
    plain = Tokenizer.from_file(PATH)
    got = P.piece_digests(P.pack(df, PATH)).collect()
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096
    for doc_id, text in rows:
        if doc_id == 7:
            continue
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert P.pack(df.limit(0), PATH).count() == 0


def test_null_and_repeated_ids_lose_nothing(spark):
    rows = [(7, None), (7, "one two"), (7, "one two"), (None, "x y z"), (None, "x"), (1, "")]
    plain = Tokenizer.from_file(PATH)
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    want = sorted(((i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows), key=repr)
    assert sum(r.length for r in got) == sum(len(w[1]) // 4 for w in want)
    # windows are read in order of their sequences: the ids of each document's pieces, cut or whole
    tokens = lambda pairs: sorted((repr(i), ids[k : k + 4]) for i, ids in pairs for k in range(0, len(ids), 4))
    assert tokens((r.doc_id, bytes(r.ids)) for r in got) == tokens(want)
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(i, len(ids) // 4) for i, ids in want}


def test_time_grows_with_the_text(spark):
    """Cutting copies nothing: a piece of a long text is a view of it."""
    packer = P.SumOfSquaresPacker(64, 8)
    ids = memoryview(bytes(4 * 64 * 1000 + 40))
    windows = list(packer.add(P.Piece(1, 0, ids, len(ids) // 4)))
    assert len(windows) == 1000 and all(w[0].ids.obj is ids.obj for w in windows)
    (left,) = [p for ws in packer.windows.values() for w in ws for p in w]
    assert len(left) == 10 and left.ids.obj is not ids.obj  # what stays open holds no long text


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    spec = json.loads(Tokenizer.from_file(PATH).to_str())
    assert P.CachedTokenizer(PATH).by_chunks
    for change in ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Prepend", "prepend": "x"}}):
        path = str(tmp_path / "other.json")
        Tokenizer.from_str(json.dumps(spec | change)).save(path)
        other = P.CachedTokenizer(path)
        assert not other.by_chunks
        for text in ("one two  three", " x\ty"):
            assert other.encode(text) == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
