"""Chat formatting with Spark expressions only.

A conversation becomes `<|im_start|>role\\ntext<|im_end|>\\n` for each run of turns of one role; the turns of a run stand
in one block, parted by `<|im_next|>`. A line break in a role becomes `<|im_break|>`. Inside roles and texts a backslash is doubled and `<|` becomes `<\\|`, so the marks
occur nowhere else and everything reads back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT = "<|im_start|>", "<|im_end|>", "<|im_next|>"
#: A line break inside a role, as the first one ends the role.
BREAK = "<|im_break|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, segments): segments are the pieces of formatted in order, (text, loss).

    turns: conv_id, turn, role, text and any other columns. Turns go by (turn, role, text), nulls first, so that ties
    and repeated rows have one order; each row is a turn. Null roles and texts are empty; a null conv_id is a
    conversation like any other. loss is true for the texts of loss_roles alone, never for marks or roles. A
    conversation without rows does not exist, so an empty table gives none. A conversation is one value and is
    collected whole.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # a turn opens a block unless the one before it has the same role, and closes one unless the next has
    pieces = F.flatten(
        F.transform(
            "ts",
            lambda t, i: F.array(
                F.struct(
                    F.when((i > 0) & (F.get("ts", i - 1)["role"] == t["role"]), F.lit(NEXT))
                    .otherwise(F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n")))
                    .alias("text"),
                    F.lit(False).alias("loss"),
                ),
                F.struct(escaped(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")),
                F.struct(
                    F.when((i + 1 < F.size("ts")) & (F.get("ts", i + 1)["role"] == t["role"]), F.lit(""))
                    .otherwise(F.lit(END + "\n"))
                    .alias("text"),
                    F.lit(False).alias("loss"),
                ),
            ),
        )
    )
    segments = sorted_turns.select("conv_id", F.filter(pieces, lambda x: x["text"] != "").alias("segments"))
    return segments.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, array of (role, text), as they were given."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(len(START) + 1), F.char_length(b)), "\n", 2))
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.split(F.get(p, F.lit(1)), r"<\|im_next\|>", -1),
                lambda x: F.struct(unescaped(F.replace(F.get(p, F.lit(0)), F.lit(BREAK), F.lit("\n"))).alias("role"), unescaped(x).alias("text")),
            ),
        )
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
