"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and
all others as named users.  Masks are the spans of the assistant's turns: what a model is to learn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one rendered row; a longer dialogue goes on in further rows (part 1, 2, ...).
TURNS = 64
SYSTEM = "system"


def safe(text: Column) -> Column:
    """A text in which no turn marker can be forged."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, most_turns: int = TURNS) -> DataFrame:
    """conv_id, participant, part, n_turns, n_masked, rendered, mask from ``turns`` (conv_id, turn, role, text).

    Participants are the distinct roles but ``system``, whose turns are context for all; a null role counts as the role ``unknown``.
    A turn reads ``<|assistant|>text<|end|>``, ``<|user:role|>text<|end|>`` or ``<|system|>text<|end|>``, one after the other without separators.
    mask lists ``start:end`` (code points of rendered, end exclusive) of the participant's texts with their end marks, comma-joined.
    Turn numbers are kept in parts of ``most_turns`` consecutive numbers, so a conversation of any length is never
    one row or one task; a null turn number comes first, in part 0.  Rows equal in conv_id, turn, role and text are one turn; different
    rows of one turn number follow by role and text.  A conversation of system turns only has no participant and no
    row.  A null conv_id is a conversation of its own; null texts are empty; an empty table gives an empty result.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), safe(F.col("text")).alias("text")).distinct()
    part = F.coalesce(F.floor(F.col("turn") / most_turns), F.lit(0)).cast("long")
    rows = rows.withColumn("part", part)
    people = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("participant")).distinct()
    all_turns = rows.join(people, rows["conv_id"].eqNullSafe(people["of"])).drop("of")
    own = F.col("role") == F.col("participant")
    head = F.when(own, F.lit("<|assistant|>")).when(F.col("role") == SYSTEM, F.lit("<|system|>")).otherwise(F.concat(F.lit("<|user:"), safe(F.col("role")), F.lit("|>")))
    body = F.concat("text", F.lit("<|end|>"))
    all_turns = all_turns.select("conv_id", "participant", "part", "turn", "role", "text", own.alias("own"), head.alias("head"), body.alias("body"))
    order = Window.partitionBy("conv_id", "participant", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = F.sum(F.length("head") + F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    number = F.row_number().over(order)
    span = F.when(F.col("own"), F.concat_ws(":", (F.col("upto") - F.length("body")).cast("string"), F.col("upto").cast("string")))
    placed = all_turns.withColumn("upto", upto).withColumn("number", number).withColumn("span", span)
    grouped = placed.groupBy("conv_id", "participant", "part").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.col("own").cast("long")).alias("n_masked"),
        F.array_sort(F.collect_list(F.struct("number", F.concat("head", "body").alias("line"), "span"))).alias("lines"),
    )
    rendered = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    mask = F.array_join(F.transform("lines", lambda x: x["span"]), ",")
    return grouped.select("conv_id", "participant", "part", "n_turns", "n_masked", rendered.alias("rendered"), mask.alias("mask"))
