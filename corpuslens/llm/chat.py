"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to and including it, of which only its text
is trainable. A turn reads ``<s>[INST]role[/INST]text</s>``. A control string inside a role or text gets one
backslash after its first character (``</s>`` to ``<\\/s>``, ``<\\/s>`` to ``<\\\\/s>``), so none is left, and taking one
backslash away gives back what was there.

Null roles and texts count as empty, a null turn comes first, turns that tie go by role and text, rows that
repeat are turns of their own, and null is a conversation id like any other. A conversation that doesn't
end with an assistant's turn gets one more example with all its turns and nothing trainable, so that the
output holds every turn. Columns beside conv_id, turn, role and text are ignored.

A conversation's turns meet in one row, as its examples hold them together anyway; conversations are the
keys of the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START, ROLE_END, TURN_END = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit("$1\\\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def expand(conversations: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (index of its last turn), n_turns, formatted, loss_start and
    loss_chars (the trainable code points of formatted; 0 long where nothing is trainable)."""
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == trainable_role).alias("trainable"),
                F.concat(F.lit(TURN_START), escape(t["role"]), F.lit(ROLE_END)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("parts"),
    )
    size = F.size("parts")
    last = F.filter(F.sequence(F.lit(1), size), lambda k: F.element_at("parts", k)["trainable"] | (k == size))
    examples = parts.select("conv_id", "parts", F.explode(last).alias("k"))
    end = F.element_at("parts", F.col("k"))
    before = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("k") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "")
    return examples.select(
        "conv_id", F.col("k"), end.alias("end"), F.concat(before, end["head"]).alias("context")
    ).select(
        "conv_id",
        (F.col("k") - 1).cast("long").alias("example"),
        F.col("k").cast("long").alias("n_turns"),
        F.concat("context", F.col("end.body"), F.lit(TURN_END)).alias("formatted"),
        F.length("context").cast("long").alias("loss_start"),
        F.when(F.col("end.trainable"), F.length("end.body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """Roles and texts, read back from a formatted text."""
    segments = F.filter(F.split(formatted, F.lit(TURN_END)), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.struct(
            unescape(F.substring(F.substring_index(s, ROLE_END, 1), len(TURN_START) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring(s, F.length(F.substring_index(s, ROLE_END, 1)) + len(ROLE_END) + 1, F.length(s))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, read back from a formatted text."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, all of it read back from its examples."""
    loss = F.struct("example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text"))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.count("*").cast("long").alias("n_examples"),
    )
    turns, losses = read_turns(F.col("longest")), F.array_join("losses.text", "")
    read = per.select("conv_id", turns.alias("turns"), losses.alias("loss"), "formatted_chars", "n_examples")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
