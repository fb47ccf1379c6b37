"""Chat formatting by perspective rotation: each participant in turn is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1024


def rotate(turns: DataFrame) -> DataFrame:
    """One row per (conversation, perspective, turn): the rendered turn, its loss mask and its place in the dialogue.

    Columns: conv_id, perspective, turn, part (order among rows of one turn), chat_role, name, rendered, loss
    (1 where the perspective speaks), start and end_ (characters from the dialogue's begin; the mask covers
    [start + header, end_ - 11) of rows with loss 1), header.

    ``system`` turns are instructions: they are rendered as such from every
    perspective and have none of their own.  Rows with a null conversation, turn
    or role belong to no dialogue that could be rotated and get one row of their own
    with perspective null and loss 0.  Null text is empty.  Rows that repeat a
    turn are ordered by role, then text; equal rows stay.  Input columns other
    than the four are not read.

    A dialogue is never held in one place: rows carry offsets, which are prefix
    sums over blocks of turns, so a conversation may hold any share of the table.
    """
    base = turns.select(
        "conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    speakers = base.where("conv_id is not null and turn is not null and role is not null and role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    whole = F.expr("conv_id is not null and turn is not null and role is not null")
    loose = base.where(~whole).withColumn("perspective", F.lit(None).cast("string"))
    seen = base.where(whole).join(speakers, "conv_id").unionByName(loose, allowMissingColumns=True)
    mine = F.coalesce(F.col("perspective") == F.col("role"), F.lit(False))
    system = F.coalesce(F.col("role") == "system", F.lit(False))
    shown = seen.withColumn("chat_role", F.when(system, "system").when(mine, "assistant").otherwise("user"))
    shown = shown.withColumn("name", F.when(F.col("chat_role") == "user", F.coalesce("role", F.lit("unknown"))))
    head = F.concat(F.lit("<|im_start|>"), "chat_role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    shown = shown.withColumn("header", F.length(head).cast("long")).withColumn("rendered", F.concat(head, "text", F.lit("<|im_end|>\n")))
    shown = shown.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("size", F.length("rendered").cast("long"))
    keys = [F.col("conv_id"), F.col("perspective")]
    inner = W.partitionBy(*keys, "block").orderBy("turn", "role", "text")
    placed = shown.withColumn("upto", F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.withColumn("part", F.row_number().over(W.partitionBy(*keys, "block", "turn").orderBy("role", "text")).cast("long") - 1)
    blocks = shown.where("perspective is not null").groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("block_size"))
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("block_size").over(before), F.lit(0).cast("long"))).drop("block_size")
    out = placed.join(blocks, ["conv_id", "perspective", "block"], "left")
    end = F.when(F.col("perspective").isNull(), F.col("size")).otherwise(F.col("before") + F.col("upto"))
    return out.select(
        "conv_id", "perspective", "turn", F.when(F.col("perspective").isNull(), F.lit(0).cast("long")).otherwise(F.col("part")).alias("part"),
        "chat_role", "name", "rendered", mine.cast("int").alias("loss"), (end - F.col("size")).alias("start"), end.alias("end_"), "header",
    )
