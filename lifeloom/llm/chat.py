"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only its reply is
trainable. A turn is written as

    [INST] role\\n<escaped text></s>\\n

so `[INST] ` opens and `</s>` closes a turn. Inside texts the characters the control strings are made of are escaped
reversibly, so that no text can hold a control string: `\\` becomes `\\\\`, `[` becomes `\\(`, `]` becomes `\\)` and `<`
becomes `\\{`; in roles, which end at a line end, a line end becomes `\\|`.

A turn's formatted text stands once in the table of turns; an example points to a prefix of its conversation by number
of turns and characters and holds its own reply. No conversation is gathered into one row to be formatted, so a
conversation of any length costs its own size; render_examples() writes prefixes out where full texts are wanted. Only
read_back(), which digests whole conversations, puts a conversation's written text into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, TRAINED = "[INST] ", "</s>\n", "assistant"
#: In this order; the first is the escape character itself.
ESCAPES = (("\\", "\\\\"), ("[", "\\("), ("]", "\\)"), ("<", "\\{"), ("\n", "\\|"))


def escape(text: Column, line_ends: bool = False) -> Column:
    for plain, escaped in ESCAPES if line_ends else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    """Undo escape(): the escaped escape character is told apart from the others by splitting at it first."""
    parts = F.split(text, r"\\\\", -1)

    def plain_part(part: Column) -> Column:
        for plain, escaped in ESCAPES[1:]:
            part = F.replace(part, F.lit(escaped), F.lit(plain))
        return part

    return F.array_join(F.transform(parts, plain_part), "\\")


def formatted_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, is_target, head, body, tail): the written form of each turn of (conv_id, turn, role, text).

    place counts a conversation's turns from 1 by (turn, role, text); repeated rows are turns of their own. A null text
    is empty, a null role is written as an empty one; a null turn comes first; a null conv_id is a conversation. An empty
    table gives no row. Other columns are ignored.
    """
    kept = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return kept.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("place"),
        "role",
        (F.col("role") == TRAINED).alias("is_target"),
        F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        F.lit(CLOSE).alias("tail"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn: its prefix (turns and characters before it), its reply, and the loss mask.

    loss_from and loss_to are places of the reply's characters in the example's whole text: the context, the turn's
    head, then the trainable reply.
    """
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.concat("head", "body", "tail")).cast("long")
    context = F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")
    marked = turns.withColumn("context_chars", context)
    start = F.col("context_chars") + F.length("head")
    return marked.where("is_target").select(
        "conv_id",
        F.col("place").alias("target"),
        (F.col("place") - 1).alias("context_turns"),
        "context_chars",
        "head",
        F.col("body").alias("reply"),
        "tail",
        start.alias("loss_from"),
        (start + F.length("body")).alias("loss_to"),
    )


def render_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, target, text, loss_from, loss_to) with each example's whole text, context included.

    Contexts are joined to targets by conversation, so a conversation of n turns gives n * n / 2 rows on the way:
    that is the size of the texts themselves.
    """
    own = examples(turns)
    pieces = turns.select("conv_id", "place", F.concat("head", "body", "tail").alias("piece"))
    met = own.join(pieces, (own["conv_id"] == pieces["conv_id"]) & (pieces["place"] < own["target"]), "left").select(
        own["conv_id"], "target", "head", "reply", "tail", "loss_from", "loss_to", "place", "piece"
    )
    grouped = met.groupBy("conv_id", "target", "head", "reply", "tail", "loss_from", "loss_to").agg(
        F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "piece")))).alias("context")
    )
    context = F.array_join(F.transform("context", lambda c: c["piece"]), "")
    return grouped.select("conv_id", "target", F.concat(context, "head", "reply", "tail").alias("text"), "loss_from", "loss_to")


def parse_turns(written: Column) -> Column:
    """array<struct<role,text>> read back from a written conversation: split at the marks, unescaped."""
    parts = F.filter(F.split(written, CLOSE, -1), lambda p: p != "")
    inner = F.transform(parts, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(
        inner,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def read_back(turns: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, written, turns, trained): each conversation's turns and what its examples train, from the written text.

    The trained texts are cut out of the written conversation at each example's loss mask and unescaped, in order.
    """
    written = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", F.concat("head", "body", "tail").alias("piece")))).alias("pieces")
    )
    written = written.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("written"))
    masks = own.groupBy(F.col("conv_id").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("target", "loss_from", "loss_to"))).alias("masks")
    )
    met = written.join(masks, written["conv_id"].eqNullSafe(masks["of"]), "left")
    cut = F.transform(
        "masks",
        lambda m: unescape(
            F.substring(F.col("written"), (m["loss_from"] + 1).cast("int"), (m["loss_to"] - m["loss_from"]).cast("int"))
        ),
    )
    return met.select("conv_id", "written", parse_turns(F.col("written")).alias("turns"), F.coalesce(cut, F.array().cast("array<string>")).alias("trained"))
