"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered anew: messages of that speaker are the assistant's, all others are
those of users, with their names. The result has one row per message and perspective; a perspective's rows, joined in order of
`position`, are the rendered dialogue, and `start`, `mask_start`, `mask_end` are character offsets in it. Loss is wanted on
[mask_start, mask_end): the assistant's text with its end mark. Offsets are running sums in two levels, within blocks of turns and
over blocks, so that a very long conversation spreads over tasks.

Defined results: messages are ordered by turn (null last), then speaker and text; a null text is empty; a null speaker is the user
"unknown" and has no perspective; messages without a conversation id form one conversation; equal rows are messages of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_LAST = (1 << 63) - 1


def rotate(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, position, turn, speaker, role, rendered, start, mask_start, mask_end."""
    said = messages.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(speaker).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.floor(F.coalesce(F.col(turn).cast("long"), F.lit(_LAST)) / BLOCK_TURNS).cast("long").alias("block"),
    )
    views = said.where("speaker is not null").select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(views, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), F.coalesce("speaker", F.lit("unknown")), F.lit("\n")))
    rows = rows.withColumn("own", own).withColumn("head", head).withColumn("size", (F.length("head") + F.length("text") + len(CLOSE)).cast("long"))
    order = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), "text")
    rows = rows.withColumn("nth", F.row_number().over(order) - 1).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = rows.groupBy("conv_id", "perspective", "block").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"),
    )
    rows = rows.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("s0") + F.col("upto") - F.col("size")
    return rows.select(
        "conv_id", "perspective", (F.col("n0") + F.col("nth")).cast("long").alias("position"), "turn", "speaker",
        F.when(F.col("own"), "assistant").otherwise("user").alias("role"),
        F.concat("head", "text", F.lit(CLOSE)).alias("rendered"),
        start.alias("start"),
        F.when(F.col("own"), start + F.length("head")).alias("mask_start"),
        F.when(F.col("own"), start + F.col("size") - 1).alias("mask_end"),
    )
