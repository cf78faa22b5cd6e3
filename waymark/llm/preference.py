"""Preference formatting, in DataFrame functions only.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns is rendered
once as the prompt; the rest of each is its completion, with the spans that a loss may use: the
text of its assistant turns and the mark that ends them. Spans are (start, end) in characters of
the completion.

A turn is rendered as ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed.

Cases: null role or text renders as empty and equals another null only as what it renders to; equal conversations
have empty completions and no spans; a conversation without turns is empty; turns with equal
numbers are ordered by role and text, and repeated rows are turns of their own; texts of any length are rendered whole; rows with a null conversation id are one conversation; an
empty table gives an empty result; other columns are not read. All turns of one conversation
are gathered in one row, since that row holds them in the result as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(f"{END}\n"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two arrays of turns have in common from the start."""
    least = F.least(F.size(a), F.size(b))
    same = F.when(least > 0, F.transform(F.sequence(F.lit(1), least), lambda i: F.element_at(a, i) == F.element_at(b, i))).otherwise(F.array().cast("array<boolean>"))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, least).otherwise(first - 1)


def spans(turns: Column) -> Column:
    """(start, end) of what a loss may use in the rendered ``turns``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["role"]) + 5
        end = start + F.length(turn["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(turn["role"] == "assistant", F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    return F.aggregate(turns, zero, add, lambda s: s["found"])


def format_pairs(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id, chosen, rejected: arrays of (role, text)) to id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans."""

    def clean(turns: str) -> Column:
        return F.transform(
            F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")),
            lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
        )

    def text(turns: Column) -> Column:
        return F.array_join(F.transform(turns, render), "")

    both = pairs.select(F.col(id_col), clean("chosen").alias("c"), clean("rejected").alias("r"))
    cut = both.withColumn("prompt_turns", common_turns(F.col("c"), F.col("r")))
    rest = {x: F.slice(F.col(x), F.col("prompt_turns") + 1, F.greatest(F.lit(0), F.size(x) - F.col("prompt_turns"))) for x in "cr"}
    return cut.select(
        id_col,
        "prompt_turns",
        text(F.slice("c", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        text(rest["c"]).alias("chosen"),
        text(rest["r"]).alias("rejected"),
        spans(rest["c"]).alias("chosen_spans"),
        spans(rest["r"]).alias("rejected_spans"),
    )


def reply_pairs(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pairs from a table of turns: each conversation up to its last assistant turn is chosen; rejected is the
    same with that reply replaced by the conversation's first assistant reply (an empty one if there is no other).

    A conversation without an assistant turn is its own rejected one.
    """
    ordered = turns.groupBy(F.col(id_col).alias("pair_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
        ).alias("turns")
    )
    roles = F.transform("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
    first = F.array_position(roles, F.lit(True)).cast("int")
    back = F.array_position(F.reverse(roles), F.lit(True)).cast("int")
    placed = ordered.withColumn("first", first).withColumn("last", F.when(back > 0, F.size("turns") + 1 - back).otherwise(F.size("turns")))
    other = F.when(F.col("first") < F.col("last"), F.element_at("turns", F.col("first"))["text"]).otherwise(F.lit(""))
    replaced = F.concat(
        F.slice("turns", F.lit(1), F.greatest(F.lit(0), F.col("last") - 1)), F.array(F.struct(F.lit("assistant").alias("role"), other.alias("text")))
    )
    chosen = F.slice("turns", F.lit(1), F.col("last"))
    return placed.select("pair_id", chosen.alias("chosen"), F.when(F.col("first") > 0, replaced).otherwise(chosen).alias("rejected"))
