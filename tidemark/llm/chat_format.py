"""Chat formatting with typed content parts, as column expressions only.

A message's content is an array of parts: text, image, audio or document. A visitor turns each kind into a column
expression: text is escaped, any other part becomes an ordered placeholder, with its reference recorded and the tokens
that the placeholder will expand to counted.

Template, one turn: ``<turn ROLE>`` newline TEXT ``</turn>`` newline. Inside roles and texts the escape character and
both angle brackets are replaced by two-character escapes, so no text can hold a mark of the template, and replacing
the escapes back in order restores it exactly. The loss mask is an array of spans, one for each assistant turn.

Main path native: only DataFrame and SQL functions. A conversation is one output string, so its turns meet in one row;
its size is bounded by what one string may hold.

Contract: null texts, roles and references count as empty; turns go by ``turn``, nulls first, ties by role, then text;
repeated rows are turns of their own; rows with a null ``conv_id`` make one conversation; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_of, appended, let, nothing

#: In the order of escaping; undone in the opposite order.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), (">", "\\g"))
OPEN, AFTER_ROLE, CLOSE = "<turn ", ">\n", "</turn>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    """Exact: in an escaped text every escape character begins an escape, and the escape of itself is undone last."""
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


class PartVisitor:
    """One method for each kind of part: ``(rendered text, expanded tokens)``. Override to change what a kind costs."""

    patch, tokens_a_second, tokens_a_page = 28, 25, 1024

    def visit_text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")

    def visit_image(self, part: Column) -> tuple[Column, Column]:
        tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / self.patch) * F.ceil(F.coalesce(part["height"], F.lit(0)) / self.patch)
        return F.lit("<image>"), tiles.cast("long")

    def visit_audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<audio>"), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.tokens_a_second).cast("long")

    def visit_document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<document>"), (F.coalesce(part["pages"], F.lit(0)) * self.tokens_a_page).cast("long")

    def visit(self, part: Column) -> Column:
        """Struct ``(rendered, kind, ref, tokens)``; a null or unknown kind is read as text."""
        kind = F.coalesce(part["kind"], F.lit("text"))
        rendered, tokens = self.visit_text(part)
        rendered_as, tokens_as = None, None
        for name in ("image", "audio", "document"):
            r, t = getattr(self, f"visit_{name}")(part)
            rendered_as = F.when(kind == name, r) if rendered_as is None else rendered_as.when(kind == name, r)
            tokens_as = F.when(kind == name, t) if tokens_as is None else tokens_as.when(kind == name, t)
        return F.struct(rendered_as.otherwise(rendered).alias("rendered"), kind.alias("kind"), F.coalesce(part["ref"], F.lit("")).alias("ref"), tokens_as.otherwise(tokens).alias("tokens"))


def text_parts(text: Column) -> Column:
    """A plain text as one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def format_chats(turns: DataFrame, visitor: PartVisitor | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation of ``turns(conv_id, turn, role, text or content)``.

    Returns ``conv_id``, ``formatted``, ``spans`` (an array, one for each turn under the loss: the number of the turn
    from 0, where its text starts in the turn and in ``formatted``, and its length, in code points) and ``attachments``
    (turn, place among the attachments of the conversation, kind, reference and expanded tokens of every placeholder).
    ``content`` is an array of parts as ``PART`` describes; without it, or where a column of that name is of another
    type, ``text`` is the only part.
    """
    visitor = visitor or PartVisitor()
    kinds = dict(turns.dtypes)
    content = F.col("content") if kinds.get("content", "").startswith("array<struct<kind:") else text_parts(F.col("text"))
    role = F.coalesce(F.col("role"), F.lit(""))
    parts = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.transform(F.coalesce(content, F.array().cast(f"array<{PART}>")), visitor.visit).alias("parts"),
    )
    rendered = parts.select(
        "conv_id", "turn", "role",
        F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("body"),
        F.filter("parts", lambda p: p["kind"].isin("image", "audio", "document")).alias("refs"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(AFTER_ROLE))
    row = F.struct("turn", "role", "body", head.alias("head"), "refs")
    grouped = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))

    def turn_text(t: Column) -> Column:
        return F.concat(t["head"], t["body"], F.lit(CLOSE))

    def spans(turns: Column) -> Column:
        empty = F.struct(F.lit(0).cast("long").alias("at"), nothing("long").alias("starts"))
        length = lambda t: (F.char_length(t["head"]) + F.char_length(t["body"]) + len(CLOSE)).cast("long")
        starts = F.aggregate(turns, empty, lambda acc, t: F.struct((acc["at"] + length(t)).alias("at"), appended(acc["starts"], acc["at"]).alias("starts")), lambda acc: all_of(acc["starts"]))

        def with_starts(at: Column) -> Column:
            every = F.transform(
                turns,
                lambda t, i: F.struct(
                    i.cast("long").alias("turn_index"), F.char_length(t["head"]).cast("long").alias("offset"),
                    (F.get(at, i) + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).cast("long").alias("length"),
                    t["role"].isin(*loss_roles).alias("loss"),
                ),
            )
            return F.transform(F.filter(every, lambda s: s["loss"]), lambda s: s.dropFields("loss"))

        return let(starts, with_starts)

    def attachments(turns: Column) -> Column:
        flat = F.flatten(F.transform(turns, lambda t, i: F.transform(t["refs"], lambda p: F.struct(i.cast("long").alias("turn_index"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))))
        return F.transform(flat, lambda p, k: F.struct(k.cast("long").alias("place"), p["turn_index"].alias("turn_index"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))

    return grouped.select(
        "conv_id", F.array_join(F.transform("turns", turn_text), "").alias("formatted"),
        spans(F.col("turns")).alias("spans"), attachments(F.col("turns")).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns(role, text), loss_texts`` from ``formatted`` and ``spans`` alone.

    Placeholders stay in the texts as they are; ``parts_of`` tells them from texts that say the same.
    """
    pieces = F.split(F.col("formatted"), CLOSE)  # the last is empty: every turn ends in the mark, which no text holds
    cut = formatted.select("conv_id", "formatted", "spans", F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("pieces"))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, AFTER_ROLE, 1)
        text = F.substring(piece, F.char_length(role) + len(AFTER_ROLE) + 1, F.char_length(piece))
        return F.struct(unescape(F.substring(role, F.lit(len(OPEN) + 1), F.char_length(role))).alias("role"), unescape(text).alias("text"))

    def masked(span: Column) -> Column:
        piece = F.get(F.col("pieces"), span["turn_index"].cast("int"))
        return unescape(F.substring(piece, (span["offset"] + 1).cast("int"), span["length"].cast("int")))

    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.transform("spans", masked).alias("loss_texts"))


def parts_of(body: Column) -> Column:
    """Array of ``(kind, text)`` of a turn's formatted text: placeholders and the texts between them, in order.

    In an escaped text no angle bracket stands, so a bracket always belongs to a placeholder. Adjacent texts are one part.
    """
    # a part begins at every opening bracket and after every closing one
    pieces = F.filter(F.split(body, r"(?=<)|(?<=>)"), lambda p: p != "")
    is_mark = lambda p: F.startswith(p, F.lit("<"))
    return F.transform(pieces, lambda p: F.struct(F.when(is_mark(p), F.btrim(p, F.lit("<>"))).otherwise("text").alias("kind"), F.when(is_mark(p), F.lit(None).cast("string")).otherwise(unescape(p)).alias("text")))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from the output of ``format_chats``."""
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
