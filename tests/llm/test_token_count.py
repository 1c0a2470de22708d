import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import token_count as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return T.ResyncEncoder(sentencepiece.SentencePieceProcessor(model_file=MODEL), 64, 8)


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 3000, "日本語" * 900, "😀x " * 800, "\n\n  \t" * 500, "▁ ▁" * 300, "</s><s> <unk>" * 60, "abc" * 1000])
def test_odd_texts(encoder, text):
    assert encoder.encode(text) == encoder.processor.encode(text)


def test_random_texts(encoder):
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(rng.choice("ab  th▁e\né日😀  xq=") for _ in range(rng.randint(60, 900)))
        assert encoder.encode(text) == encoder.processor.encode(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(17, 1), (33, 2), (64, 8), (200, 64)])
def test_no_chunk_length_changes_a_count(chunk, overlap, spark, small):
    encoder = T.ResyncEncoder(sentencepiece.SentencePieceProcessor(model_file=MODEL), chunk, overlap)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    for text in [*texts, "a" * 900 + " b" * 60, "x" * 100 + "日" * 700, "\n" * 500 + "end of it all " * 9]:
        assert encoder.encode(text) == encoder.processor.encode(text)


def test_splices_are_common_to_both_encodings(encoder, monkeypatch):
    """Boundaries that the other encoding lacks are refused, and the overlap is widened."""
    text, asked, plain = "one two three " * 200, [], T.ResyncEncoder._common

    def common(self, text, start, end, start_at, left, right):
        asked.append(end - start)
        # as if the right encoding began no token in a narrow overlap
        return plain(self, text, start, end, start_at, left, right if end - start > 20 else [])

    monkeypatch.setattr(T.ResyncEncoder, "_common", common)
    assert encoder.encode(text) == encoder.processor.encode(text)
    assert max(asked) > 20 and min(asked) <= 8


def test_documents(encoder, spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for r in docs.collect():
        assert encoder.encode(r.text) == encoder.processor.encode(r.text)


def test_every_row_is_counted(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "x y", 5), (3, "word " * 9000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    plain = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for chunk, overlap in ((1 << 16, 1 << 9), (100, 10)):
        got = sorted(map(tuple, T.count_tokens(df, MODEL, chunk_chars=chunk, overlap_chars=overlap).collect()), key=str)
        want = [(i, len((t or "").encode()), len(plain.encode(t or "")), len(plain.encode(t or "")) > 4096) for i, t, _ in rows]
        assert got == sorted(want, key=str)
    assert T.count_tokens(df.limit(0), MODEL).count() == 0


def test_bad_sizes():
    with pytest.raises(ValueError):
        T.ResyncEncoder(sentencepiece.SentencePieceProcessor(model_file=MODEL), 10, 5)
