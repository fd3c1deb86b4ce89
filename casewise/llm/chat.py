r"""Chat formatting of typed content parts, with DataFrame functions only.

A turn's content is an array of parts (``PART``): text, image, audio or document. A visitor walks the parts in order: text is escaped and
written out, every other kind becomes a placeholder ``<kind:i>`` (i counts the turn's attachments from 0), is recorded
with its reference, and gets the number of tokens that the model will see in its place.

A conversation reads ``### role: content</turn>\n`` per turn. Inside texts and roles, a backslash becomes ``\b``, ``<`` becomes ``\l`` and
``#`` becomes ``\h`` (in roles ``:`` becomes ``\c`` too), so no marker or placeholder can arise there, and undoing the
codes in any order but ``\b`` last gives the text back exactly.

The loss mask is a list of spans of the formatted string, one per text part of an assistant turn.

Null roles and texts count as empty, null part lists as no parts; a part of an unknown kind is treated as text. Turns are ordered by turn number (nulls
first), then role, then content; repeated rows are turns of their own; rows without a conversation id form one. Each
conversation is one string and so one row: it must fit in a task, as any output row must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512  # pixels of a patch's side, tokens a second, tokens a page
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages"))).cast(PART))


def _patches(side: Column) -> Column:
    return F.ceil(F.coalesce(side, F.lit(0)) / PATCH)


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment takes in the model's input."""
    kind = part["kind"]
    return (F.when(kind == "image", _patches(part["width"]) * _patches(part["height"]))
            .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
            .when(kind == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)).cast("long")


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def _visit(parts: Column, trained: Column) -> Column:
    """Folds a turn's parts into (body, loss spans inside it, attachments)."""
    start = F.struct(
        F.lit("").alias("body"), F.lit(0).cast("long").alias("size"),
        F.expr("CAST(array() AS array<struct<start:bigint,stop:bigint>>)").alias("spans"),
        F.expr("CAST(array() AS array<struct<kind:string,ref:string,placeholder:string,tokens:bigint>>)").alias("attachments"))

    def step(seen, part):
        held = F.concat(F.lit("<"), part["kind"], F.lit(":"), F.size(seen["attachments"]).cast("string"), F.lit(">"))
        piece = F.when(_is_attachment(part), held).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
        size = seen["size"] + F.char_length(piece)
        span = F.array(F.struct(seen["size"].alias("start"), size.alias("stop")))
        attachment = F.array(F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), held.alias("placeholder"), expanded_tokens(part).alias("tokens")))
        return F.struct(
            F.concat(seen["body"], piece).alias("body"), size.alias("size"),
            F.when(trained & ~_is_attachment(part), F.concat(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"),
            F.when(_is_attachment(part), F.concat(seen["attachments"], attachment)).otherwise(seen["attachments"]).alias("attachments"))

    return F.aggregate(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), start, step)


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans`` of it, ``attachments`` in order, and ``attachment_tokens``."""
    rows = turns.select(turns[conv].alias("conv"), turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), turns[parts].alias("parts"))
    seen = rows.select("conv", "turn", "role", _visit(F.col("parts"), F.col("role") == TRAINED_ROLE).alias("seen"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(MIDDLE))
    written = seen.select("conv", "turn", "role", "seen", F.concat(head, F.col("seen.body"), F.lit(CLOSE)).alias("piece"), F.char_length(head).alias("head"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "piece")
    before = F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["stop"] + F.col("at")).alias("stop"))
    placed = written.withColumn("place", F.row_number().over(order)).withColumn("at", F.col("head") + before).select(
        "conv", "place", "piece", F.transform("seen.spans", shift).alias("spans"), F.col("seen.attachments").alias("attachments"))
    joined = placed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "spans", "attachments"))).alias("turns"))
    attachments = F.flatten(F.col("turns.attachments"))
    return joined.select(
        F.col("conv").alias(conv), F.array_join("turns.piece", "").alias("formatted"), F.flatten("turns.spans").alias("loss_spans"),
        attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text); placeholders are left out of the text."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece):
        middle = F.instr(piece, MIDDLE)
        role = F.substr(piece, F.lit(len(OPEN) + 1), middle - len(OPEN) - 1)
        body = F.substr(piece, middle + len(MIDDLE), F.char_length(piece))
        return F.struct(unescape_role(role).alias("role"), unescape(F.regexp_replace(body, "<[a-z]+:[0-9]+>", "")).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
