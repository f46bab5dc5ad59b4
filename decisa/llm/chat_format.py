r"""Chat formatting by prefix-target expansion, in column expressions only.

Every assistant turn becomes its own example: all turns before it are context and only its reply is trainable. A turn
is written `### role: text</turn>\n`. Inside roles and texts a backslash, `<`, `#` and `:` are written `\b`, `\l`,
`\h` and `\c`, so no control string can occur there and each escape is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chat_examples(rows: DataFrame, trainable: str = "assistant") -> DataFrame:
    """(conv_id, example, text, mask_start, mask_end): one example for each trainable turn.

    rows: (conv_id, turn, role, text). Turns are ordered by turn, nulls first, then role and text; null roles and
    texts are empty, repeated rows are turns of their own, rows with a null conv_id are one conversation. The mask is
    the range of characters of the escaped reply, from 0, end excluded. A conversation that doesn't end with a
    trainable turn has one more example with an empty mask (0, 0), so the output holds every turn.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(AFTER_ROLE), escape(t["text"]), F.lit(CLOSE)))
    talks = talks.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), parts.alias("parts"))
    talks = talks.withColumn("sizes", F.transform("parts", F.length))
    targets = F.filter(F.sequence(F.lit(1), F.size("roles")), lambda i: (F.element_at("roles", i) == trainable) | (i == F.size("roles")))
    each = talks.select("conv_id", "roles", "parts", "sizes", F.posexplode(targets).alias("example", "target"))
    own = F.element_at("sizes", F.col("target"))
    end = F.aggregate(F.slice("sizes", F.lit(1), F.col("target")), F.lit(0), lambda a, x: a + x)
    head = F.length(escape(F.element_at("roles", F.col("target")))) + len(OPEN) + len(AFTER_ROLE)
    trains = F.element_at("roles", F.col("target")) == trainable
    return each.select(
        "conv_id", "example",
        F.array_join(F.slice("parts", F.lit(1), F.col("target")), "").alias("text"),
        F.when(trains, end - own + head).otherwise(0).alias("mask_start"),
        F.when(trains, end - len(CLOSE)).otherwise(0).alias("mask_end"),
    )


def read_examples(examples: DataFrame) -> DataFrame:
    """(conv_id, turns array of (role, text), losses array of trained texts in order, formatted_chars) from the output alone."""
    reply = unescape(F.substring(F.col("text"), F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start")))
    trained = F.when(F.col("mask_end") > 0, F.struct("example", reply.alias("reply")))
    talks = examples.groupBy("conv_id").agg(
        F.max(F.struct(F.col("example"), F.col("text"))).getField("text").alias("whole"),
        F.sort_array(F.collect_list(trained)).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    lines = F.split(F.col("whole"), CLOSE)
    turns = F.transform(
        F.slice(lines, F.lit(1), F.size(lines) - 1),
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), AFTER_ROLE, 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, AFTER_ROLE) + len(AFTER_ROLE))).alias("text"),
        ),
    )
    return talks.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: x["reply"]).alias("losses"), "formatted_chars")
