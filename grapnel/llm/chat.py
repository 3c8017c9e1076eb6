r"""Chat formatting: conversations to training text with a loss mask, in Spark expressions only.

Method.  A conversation's turns are collected as structs and sorted; runs of one role become one block
by array functions; blocks are concatenated.  A block is ``<turn role>text<sep>text</turn>`` and a line
feed, so merged turns stay apart.  Inside roles and texts a backslash, ``<`` and ``>`` are written
``\b``, ``\l`` and ``\g``: no text can hold a control string, and :func:`parse` gives back every turn.
The loss mask is an array of (start, length) over the code points of the formatted text: the bodies of
the assistant's blocks.

Defined results.  Null texts and roles count as empty.  Turns sort by turn, role, text, nulls first;
equal rows are turns of their own.  A null id is a conversation like another.  A conversation is one
row, so one conversation has to fit into a row (2 GB); its turns are collected nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grapnel.llm.text import before, let

LOSS_ROLE = "assistant"
OPEN, CLOSE, SEP = "<turn ", "</turn>\n", "<sep>"
LEAF = 4096  # code points


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss`` (array of start, length)."""
    empty = F.lit("")
    one = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), empty).alias("r"), F.coalesce(F.col(text), empty).alias("x"))
    chats = turns.groupBy(F.col(conv_id)).agg(F.sort_array(F.collect_list(one)).alias("__turns"))

    def merged(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["r"] != F.get(t, F.greatest(i - 1, F.lit(0)))["r"]))

        def block(s: Column, stop: Column) -> Column:
            texts = F.transform(F.slice(t, s + 1, stop - s), lambda x: escape(x["x"]))
            return F.struct(F.get(t, s)["r"].alias("role"), F.concat(F.lit(OPEN), escape(F.get(t, s)["r"]), F.lit(">")).alias("head"), F.array_join(texts, SEP).alias("body"))

        return let(starts, lambda st: F.transform(st, lambda s, j: block(s, F.coalesce(F.get(st, j + 1), F.size(t)))))

    blocks = chats.select(conv_id, let(F.col("__turns"), merged).alias("__blocks"))
    starts = before(F.transform("__blocks", lambda b: F.length(b["head"]) + F.length(b["body"]) + len(CLOSE)))
    bodies = F.zip_with("__blocks", starts, lambda b, at: F.struct((b["role"] == LOSS_ROLE).alias("told"), (at.cast("int") + F.length(b["head"])).alias("start"), F.length(b["body"]).alias("length")))
    spans = F.transform(F.filter(bodies, lambda x: x["told"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    formatted = F.array_join(F.transform("__blocks", lambda b: F.concat(b["head"], b["body"], F.lit(CLOSE))), "")
    return blocks.select(conv_id, formatted.alias("formatted"), spans.alias("loss"))


def parse(formatted: Column) -> Column:
    """Array of (role, text): the turns that :func:`format_chats` was given."""

    def turns(block: Column) -> Column:
        role = F.regexp_extract(block, "^<turn ([^>]*)>", 1)
        body = F.substr(block, F.length(role) + len(OPEN) + 2)
        return F.transform(F.split(body, SEP), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: str, loss: str) -> Column:
    """The text under the loss mask, unescaped, nothing between.

    A position in a long text is found by walking to it, so the text is cut into leaves first and a span
    only looks at its own.
    """
    def inside(leaves: Column) -> Column:
        def cut(s: Column) -> Column:
            first, last = F.floor(s["start"] / LEAF), F.floor((s["start"] + s["length"]) / LEAF)
            own = F.array_join(F.slice(leaves, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
            return unescape(F.replace(F.substr(own, (F.pmod(s["start"], F.lit(LEAF)) + 1).cast("int"), s["length"]), F.lit(SEP), F.lit("")))

        return F.array_join(F.transform(loss, cut), "")

    return let(F.regexp_extract_all(F.col(formatted), F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0)), inside)
