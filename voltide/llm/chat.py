"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts. The visitor walks them in order: text is escaped, every other
part becomes one placeholder, and what the placeholder stands for is recorded beside the text: where it
came from, its reference and how many tokens it expands to.

Turn layout: ``<|im_start|>ROLE\\nCONTENT<|im_end|>\\n``. Control strings all begin with ``<|``. Inside
texts and roles a backslash is doubled and ``<|`` is written ``<\\|``, and so is a ``|`` that begins a later text part, so no
text, and no row of texts, can hold a control string and reading back is exact; a role's line feed is written ``\\n``.

Defined results: a null role, text or part list counts as empty; turns are ordered by turn number, then
role, then content (nulls first), so ties and repeated rows have one order; a part of unknown type is an
attachment of no tokens; an empty table gives an empty result. One conversation is one output value by
definition, so its turns meet in one row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
PART = ("struct<type:string,text:string,ref:string,width:bigint,height:bigint,"
        "seconds:double,pages:bigint>")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A backslash pair stands for itself; only an ``n`` after an odd run is a line feed."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def text_part(text: Column) -> Column:
    """A part list that holds one text."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("bigint").alias("pages")))


def visit(parts: Column, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512) -> Column:
    """Flatten a part list: array of (content, kind, ref, tokens), one per part, in order.

    Tokens: an image has one per started ``patch`` x ``patch`` square, audio ``audio_rate`` a second
    (rounded up), a document ``page_tokens`` a page; missing sizes count as 0.
    """
    def one(p: Column, i: Column) -> Column:
        kind = F.coalesce(p["type"], F.lit("text"))
        tokens = (
            F.when(kind == "image", F.ceil(F.coalesce(p["width"], F.lit(0)) / patch) * F.ceil(F.coalesce(p["height"], F.lit(0)) / patch))
            .when(kind == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * audio_rate))
            .when(kind == "document", F.coalesce(p["pages"], F.lit(0)) * page_tokens)
            .otherwise(0).cast("bigint"))
        placeholder = F.when(kind.isin(*KINDS), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(F.lit("<|attachment|>"))
        # "<" at the end of one text and "|" at the start of the next would join to a control string's beginning
        text = F.when((i > 0) & F.startswith(p["text"], F.lit("|")), F.concat(F.lit("\\"), escape(p["text"]))).otherwise(escape(p["text"]))
        return F.struct(
            F.when(kind == "text", text).otherwise(placeholder).alias("content"),
            kind.alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one)


def format_chat(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation.

    ``formatted``; ``blocks``, the turns' pieces of it; ``loss_spans``, where in which block (code points)
    the loss counts: the content of turns of ``learn_role``; ``attachments`` (turn, part, kind, ref, tokens),
    in the order of their placeholders; ``expanded_tokens``, the sum of their tokens. Columns of other names
    are dropped.
    """
    seen = turns.select(
        F.col(conversation).alias("c"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("flat")).alias("t"))
    gathered = seen.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def block(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))
        body = F.concat_ws("", F.transform(t["flat"], lambda f: f["content"]))
        return F.struct(
            F.concat(head, body, F.lit(CLOSE + "\n")).alias("block"),
            F.when(t["role"] == learn_role, F.struct(F.char_length(head).alias("start"), F.char_length(body).alias("length"))).alias("span"))

    blocks = gathered.select("c", "ts", F.transform("ts", block).alias("bs"))
    spans = F.filter(
        F.transform("bs", lambda b, i: F.struct(i.alias("block"), b["span"]["start"].alias("start"), b["span"]["length"].alias("length"))),
        lambda s: s["start"].isNotNull())
    attachments = F.flatten(F.transform("ts", lambda t, i: F.filter(
        F.transform(t["flat"], lambda f, j: F.struct(
            i.alias("turn"), j.alias("part"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))),
        lambda a: a["kind"] != "text")))
    return blocks.select(
        F.col("c").alias(conversation), F.concat_ws("", F.col("bs.block")).alias("formatted"), F.col("bs.block").alias("blocks"),
        spans.alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def read_blocks(formatted: Column) -> Column:
    """The turns' blocks, split at the opening control string."""
    split = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_147_483_646)
    return F.transform(split, lambda b: F.concat(F.lit(OPEN), b))


def parse_chat(formatted: Column) -> Column:
    """Read turns back: array of (role, text), unescaped. Placeholders stay in the text as they are."""
    def one(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substr(b, F.char_length(role) + 2, F.char_length(b) - F.char_length(role) - F.lit(1 + len(CLOSE) + 1))
        return F.struct(unescape_role(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescape(body).alias("text"))

    return F.transform(read_blocks(formatted), one)


def parse_parts(formatted: Column) -> Column:
    """Read turns back with their parts: array of (role, parts: array of (kind, text)).

    Texts beside each other come back as one. A placeholder is a part without text, a text that says the same is a text.
    """
    def one(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substr(b, F.char_length(role) + 2, F.char_length(b) - F.char_length(role) - F.lit(1 + len(CLOSE) + 1))
        pieces = F.regexp_extract_all(body, F.lit(r"<\|\w+\|>|(?:(?!<\|)[\s\S])+"), F.lit(0))
        parts = F.transform(pieces, lambda x: F.when(F.startswith(x, F.lit("<|")), F.struct(
            F.regexp_extract(x, r"\w+", 0).alias("kind"), F.lit(None).cast("string").alias("text"))).otherwise(
            F.struct(F.lit("text").alias("kind"), unescape(x).alias("text"))))
        return F.struct(unescape_role(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), parts.alias("parts"))

    return F.transform(read_blocks(formatted), one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order, joined by nothing."""
    blocks = read_blocks(formatted)
    return F.concat_ws("", F.transform(spans, lambda s: unescape(
        F.substr(F.get(blocks, s["block"]), s["start"] + 1, s["length"]))))
