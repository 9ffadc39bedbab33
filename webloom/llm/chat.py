"""Chat formatting from the perspective of every participant.

For each participant of a conversation the whole dialogue is rendered with that speaker as the
assistant and all others as named users; a system turn stays one and is nobody's perspective. A
rendering is a table of segments, one for each turn, whose texts joined in order of ``position`` are
the dialogue. ``start`` and ``end`` place a segment in it (in characters), and the mask covers what the
model learns to write: the speaker's own words with the end mark, never the headers or other speakers.

Conversations may have any length and number of turns: they are cut into blocks, first of turn
numbers, then of positions, and positions and offsets are sums within a block plus those of the blocks
before it, so no task needs a whole conversation. Equal rows are counted before they are numbered.
Only DataFrame functions are used.

A turn without a role is spoken by ``unknown``; a null text is empty. Turns without a number come
first; ties are ordered by role, then text, and equal rows are separate turns. Rows without a
conversation id form one conversation. A conversation of system turns alone has no participant and
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers, then positions, in a block.
BLOCK = 4096
#: Fixed values of the rendering.
SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"


def _running(rows: DataFrame, group: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Add, as ``values[name]``, the sum of ``name`` over all rows of the group up to each row.

    ``_block`` numbers the ordered pieces of a group. Each piece is summed by itself, and the
    sums of the pieces before it (one row for each piece) are added.
    """
    piece = [*group, "_block"]
    inside = Window.partitionBy(*piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*piece).agg(*[F.sum(n).alias(f"_{n}_total") for n in values])
    totals = totals.select(*[F.col(c).alias(f"_g_{c}") for c in piece],
                           *[F.coalesce(F.sum(f"_{n}_total").over(before), F.lit(0)).alias(f"_{n}_before") for n in values])
    rows = rows.select("*", *[F.sum(n).over(inside).alias(f"_{n}_inside") for n in values])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in piece])
    rows = rows.join(totals, same)
    added = [(F.col(f"_{n}_inside") + F.col(f"_{n}_before")).alias(to) for n, to in values.items()]
    used = [f"_{n}_{x}" for n in values for x in ("inside", "before")] + [f"_g_{c}" for c in piece]
    return rows.select("*", *added).drop(*used)


def perspectives(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each conversation, participant and turn.

    ``(conv_id, perspective, position, turn, chat_role, name, segment, start, end, mask_start, mask_end)``;
    the mask is null where the speaker is not the perspective.
    """
    turns = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    counted = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("_copies"))
    counted = counted.withColumn("_block", F.floor(F.col("turn") / block))
    numbered = _running(counted, ["conv_id"], ["turn", "role", "text"], {"_copies": "_last"})
    numbered = numbered.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"), F.coalesce("text", F.lit("")).alias("body"),
        F.explode(F.sequence(F.col("_last") - F.col("_copies") + 1, "_last")).alias("position"))
    people = turns.withColumn("speaker", F.coalesce("role", F.lit(UNKNOWN))).where(F.col("speaker") != SYSTEM).select(
        F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    lines = numbered.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    name = F.when(~own & ~system, F.col("speaker"))
    chat_role = F.when(system, SYSTEM).when(own, "assistant").otherwise("user")
    head = F.concat(F.lit("<|"), chat_role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("|>\n"))
    lines = lines.select(
        "conv_id", "perspective", "position", "turn", chat_role.alias("chat_role"), name.alias("name"),
        own.alias("own"), F.concat(head, "body", F.lit(END)).alias("segment"), F.length(head).alias("_head"))
    lines = lines.withColumns({"_length": F.length("segment"), "_block": F.floor(F.col("position") / block)})
    placed = _running(lines, ["conv_id", "perspective"], ["position"], {"_length": "end"})
    start = F.col("end") - F.col("_length")
    return placed.select(
        "conv_id", "perspective", "position", "turn", "chat_role", "name", "segment", start.alias("start"), "end",
        F.when(F.col("own"), start + F.col("_head")).alias("mask_start"), F.when(F.col("own"), F.col("end") - 1).alias("mask_end"))
