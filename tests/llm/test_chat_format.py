import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
TURNS = [
    (1, 0, "system", "", "clash"), (1, 1, "user", "a <turn b>\n</turn>\n \\e \\l \\\\", "clash"), (1, 2, "assistant", "x\\", None), (1, 3, "assistant", "\\", None),
    (2, 0, "assistant", None, None), (2, 0, None, "é日😀 < > \\g", None), (None, 5, "user", "z", None), (3, None, "a>\n<b", "t", None),
    (4, 0, "user", "same", None), (4, 0, "user", "same", None),
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        told = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(TURNS, SCHEMA)
    formatted = C.format_chats(df)
    got = {r.conv_id: tuple(r)[1:5] for r in C.chat_digests(formatted).collect()}
    assert got == expected(TURNS)
    for r in formatted.collect():
        body = re.sub(r"<turn [^<>]*>\n|</turn>\n", "", r.formatted)
        assert "<" not in body and ">" not in body  # no mark of the template inside a text
        for s in r.spans:
            assert r.formatted[s.start + s.length :].startswith("</turn>\n") and r.formatted[: s.start].endswith("<turn assistant>\n")


def test_typed_parts(spark):
    parts = [("text", "see <image>", None, None, None, None, None), ("image", None, "s3://a", 56, 57, None, None), ("audio", None, None, None, None, 1.5, None), ("document", None, "d", None, None, None, 3), (None, "!", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", parts[:1])], f"conv_id long, turn long, role string, content array<{C.PART}>")
    r = C.format_chats(df).first()
    assert r.formatted.startswith("<turn user>\nsee \\limage\\g<image><audio><document>!</turn>\n")
    assert [(a.place, a.turn_index, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "s3://a", 6), (1, 0, "audio", "", 38), (2, 0, "document", "d", 3072)]
    assert [s.turn_index for s in r.spans] == [1, 2]


def test_empty_and_native(spark, small):
    assert C.chat_digests(C.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
    plan = C.chat_digests(C.format_chats(spark.read.parquet(f"{small}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hot_conversation(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("<"), F.col("id").cast("string")).alias("text"))
    r = C.chat_digests(C.format_chats(df)).first()
    assert r.n_turns == 3000 and r.loss_sha256 == hashlib.sha256("".join(f"<{i}" for i in range(3000)).encode()).hexdigest()


def test_parts_are_told_from_texts_that_say_the_same(spark):
    body = r"see \limage\g<image><audio>a\eb<document>!"
    got = spark.range(1).select(C.parts_of(F.lit(body)).alias("p")).first().p
    assert [tuple(x) for x in got] == [("text", "see <image>"), ("image", None), ("audio", None), ("text", "a\\b"), ("document", None), ("text", "!")]


def test_a_column_named_content_of_another_type_is_ignored(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello", "else")], "conv_id long, turn long, role string, text string, content string")
    assert C.format_chats(df).first().formatted == "<turn user>\nhello</turn>\n"
