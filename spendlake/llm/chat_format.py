"""Chat formatting with typed content parts (operator 5), in DataFrame functions only.

A turn's content is a list of typed parts. A visitor folds over them in order: text is escaped and
appended, an image, audio or document part becomes a placeholder and an attachment record with its
reference and the number of tokens it will expand to. Turns become blocks of the template

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

and a conversation is its blocks in turn order. Control strings cannot occur inside escaped text:
a backslash is doubled, then ``<|`` becomes ``<\\|``. Doubling leaves only even runs of backslashes, so
the single one between ``<`` and ``|`` is always the inserted one and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SPAN = "struct<offset:int,length:int>"
ATTACHMENT = "struct<type:string,ref:string,offset:int,n_tokens:long>"
#: Pixels of an image tile's side, audio tokens a second, tokens a document page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def expanded_tokens(p: Column) -> Column:
    """Tokens that a part's placeholder stands for, at least 1 where its size is null or not positive."""
    tiles = F.ceil(p["width"] / TILE) * F.ceil(p["height"] / TILE)
    n = (
        F.when(p["type"] == "image", tiles)
        .when(p["type"] == "audio", F.ceil(p["seconds"] * AUDIO_RATE))
        .when(p["type"] == "document", p["pages"] * F.lit(PAGE_TOKENS))
    )
    return F.greatest(F.coalesce(n.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))


def visit(parts: Column, base: Column) -> Column:
    """Fold of the parts: content, spans of its text and attachments, offsets counted from ``base``.

    A part without a type, or of type text, is text (null as empty); any type but the four known ones
    gets the placeholder ``<|attachment|>``.
    """
    known = F.array(*[F.lit(x) for x in ("image", "audio", "document")])

    def step(acc: Column, p: Column) -> Column:
        is_text = F.coalesce(p["type"] == "text", F.lit(True))
        name = F.when(F.array_contains(known, F.coalesce(p["type"], F.lit(""))), p["type"]).otherwise(F.lit("attachment"))
        piece = F.when(is_text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), name, F.lit("|>")))
        at = base + F.length(acc["content"])
        span = F.struct(at.alias("offset"), F.length(piece).alias("length")).cast(SPAN)
        file = F.struct(p["type"].alias("type"), p["ref"].alias("ref"), at.alias("offset"), expanded_tokens(p).alias("n_tokens"))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        return F.struct(
            F.concat(acc["content"], piece).alias("content"),
            F.concat(acc["spans"], F.when(is_text, F.array(span)).otherwise(none(SPAN))).alias("spans"),
            F.concat(acc["files"], F.when(is_text, none(ATTACHMENT)).otherwise(F.array(file.cast(ATTACHMENT)))).alias("files"),
        ).cast(f"struct<content:string,spans:array<{SPAN}>,files:array<{ATTACHMENT}>>")

    empty = F.struct(
        F.lit("").alias("content"),
        F.array().cast(f"array<{SPAN}>").alias("spans"),
        F.array().cast(f"array<{ATTACHMENT}>").alias("files"),
    ).cast(f"struct<content:string,spans:array<{SPAN}>,files:array<{ATTACHMENT}>>")
    return F.aggregate(parts, empty, step)


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: formatted text, loss spans and attachments.

    ``parts_col`` names an array of ``PART`` structs; without it a turn is one text part. Columns out:
    ``conv_col``, ``n_turns``, ``formatted``, ``loss_spans`` array of (turn, offset in the turn's block,
    start in ``formatted``, length; code points), ``attachments`` array of (turn, type, ref, start,
    n_tokens) in reading order, ``attachment_tokens``.

    Turns are ordered by number (null first), then role, then content; equal turns all stay. A null role
    or text is empty; rows with a null conversation form one. Roles are escaped like text, their line
    breaks as ``<|nl|>``. An empty table gives no rows; other columns are not read.

    Blocks are built and measured row by row before the shuffle; a conversation meets in one task only
    because its formatted text is one value.
    """
    if parts_col:
        parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>")
    else:
        none = [F.lit(None).cast(t) for t in ("string", "int", "int", "double", "int")]
        parts = F.array(F.struct(F.lit("text"), F.col(text_col), *none)).cast(f"array<{PART}>")
    role = F.coalesce(F.col(role_col), F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn_no"), role.alias("role"), head.alias("head"), parts.alias("parts")
    )
    rows = rows.withColumn("v", visit(F.col("parts"), F.length("head"))).select(
        "conv",
        "turn_no",
        "role",
        F.concat("head", "v.content", F.lit(END)).alias("block"),
        F.when(F.col("role") == loss_role, F.col("v.spans")).otherwise(F.array().cast(f"array<{SPAN}>")).alias("spans"),
        F.col("v.files").alias("files"),
    )
    order = W.partitionBy("conv").orderBy("turn_no", "role", "block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select(
        "conv",
        F.struct(
            F.row_number().over(order).alias("i"),
            F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)).alias("start"),
            "block",
            "spans",
            "files",
        ).alias("turn"),
    )
    grouped = rows.groupBy("conv").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    span = lambda x, s: F.struct(x["i"].alias("turn"), s["offset"].alias("offset"), (x["start"] + s["offset"]).alias("start"), s["length"].alias("length"))
    file = lambda x, f: F.struct(x["i"].alias("turn"), f["type"].alias("type"), f["ref"].alias("ref"), (x["start"] + f["offset"]).alias("start"), f["n_tokens"].alias("n_tokens"))
    out = grouped.select(
        F.col("conv").alias(conv_col),
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["block"]), "").alias("formatted"),
        F.flatten(F.transform("t", lambda x: F.transform(x["spans"], lambda s: span(x, s)))).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: F.transform(x["files"], lambda f: file(x, f)))).alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"])
    return out.withColumn("attachment_tokens", total)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (head and content as written, role, text)."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def parse(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = F.replace(F.substring(head, F.lit(len(START) + 1), F.length(head)), F.lit(NEWLINE), F.lit("\n"))
        text = F.substring(b, F.length(head) + 2, F.length(b))
        return F.struct(b.alias("block"), unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, parse)


def read_loss(turns: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss mask, read out of the blocks of ``read_turns``."""
    cut = lambda s: F.substring(F.get(turns, s["turn"] - 1)["block"], s["offset"] + 1, s["length"])
    return F.array_join(F.transform(loss_spans, lambda s: unescape(cut(s))), "")
