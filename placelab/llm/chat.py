"""Chat formatting: turns of a conversation become one marked string, with the mask of what is learned.

Sort the collected turns, merge neighbours of the same role into one block and join
everything, with Spark expressions only:

    <s>[TURN]user[TEXT]first[NEXT]second[/TURN][TURN]assistant[TEXT]answer[/TURN]</s>

Control strings inside roles and texts get a ``~`` behind their bracket (one more if
they already have some), so they never act as marks and come back unchanged.

Null texts and roles count as empty; turns of equal number are ordered by role and
text, a null turn comes first; a null conversation id is a conversation of its own;
repeated rows stay; other columns are ignored. A conversation is one row of the
result, so it has to fit in one task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
TURN, TEXT, NEXT, STOP = "[TURN]", "[TEXT]", "[NEXT]", "[/TURN]"
#: What a bracket must not be followed by inside a text: the template's marks and common instruction marks.
_TAIL = r"(?:/?s>|/?TURN\]|TEXT\]|NEXT\]|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(?=~*{_TAIL})", "$1~")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~(?=~*{_TAIL})", "$1")


def format_chats(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learned: str = "assistant",
) -> DataFrame:
    """(conversation, formatted, loss_spans): one row per conversation.

    ``loss_spans`` is an array of (start, length) in code points of ``formatted``: the
    escaped texts of the ``learned`` role, without any mark.
    """
    turns = rows.select(
        F.col(conversation).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # a piece is what a turn adds to the string: its lead-in, its text, and what closes the block if it is the last
    def piece(t: Column, i: Column) -> Column:
        before, after = F.get(F.col("ts"), i - 1)["role"], F.get(F.col("ts"), i + 1)["role"]
        lead = F.when(before.eqNullSafe(t["role"]), F.lit(NEXT)).otherwise(
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
        )
        return F.struct(
            lead.alias("lead"), escape(t["text"]).alias("body"),
            F.when(after.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(STOP)).alias("tail"),
            (t["role"] == learned).alias("learned"),
        )

    pieces = ordered.select("conv", F.transform("ts", piece).alias("ps"))
    start = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def advance(acc: Column, p: Column) -> Column:
        body, lead = F.length(p["body"]).cast("long"), F.length(p["lead"])
        begin = acc["at"] + lead
        return F.struct(
            (begin + body + F.length(p["tail"])).alias("at"),
            F.when(
                p["learned"] & (body > 0),
                F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), body.alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        )

    return pieces.select(
        F.col("conv").alias(conversation),
        F.concat(
            F.lit(BEGIN),
            F.array_join(F.transform("ps", lambda p: F.concat(p["lead"], p["body"], p["tail"])), ""),
            F.lit(END),
        ).alias("formatted"),
        F.aggregate("ps", start, advance, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    inner = F.substring(formatted, len(BEGIN) + 1, F.length(formatted) - len(BEGIN) - len(END))
    blocks = F.filter(F.split(inner, r"\[/TURN\]"), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.element_at(F.split(b, r"\[TEXT\]", 2), 2), r"\[NEXT\]"),
        lambda text: F.struct(
            unescape(F.substring(F.element_at(F.split(b, r"\[TEXT\]", 2), 1), len(TURN) + 1, F.length(b))).alias("role"),
            unescape(text).alias("text"),
        ),
    )))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The learned texts: what lies under the mask, unescaped and joined without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
    )), "")
