"""Chat formatting by rotation of perspectives.

For every participant of a conversation the dialogue is rendered with that participant as the assistant, all others as named
users, and system turns as they are. The mask holds the character spans that the assistant's turns (with their end marks) take:
what a loss may be counted on. Participants are the distinct speakers but "system"; a conversation of system turns only has none.

A rendering is cut into parts of at most PART_TURNS turns, by blocks of turn numbers, so that a conversation of any length is
rendered whole without any task holding it whole; block and part number the pieces, and their concatenation is the dialogue.
Only DataFrame functions are used; turns meet speakers in an equi-join that adaptive execution splits where it is skewed.

A null conversation id is a conversation of its own, a null speaker is the user "unknown", a null text is empty, and turns
without a number come first. Turns of one number are ordered by speaker, then text; repeated rows are repeated turns. Marks of
the format inside texts and speakers' names are defused by a space after "<|", line ends in names by a space; participants are told
apart by their names as they are. A text of any length stays whole, within one part. Turns without a number, and those of one
number beyond PART_TURNS, are ordered within one task for each conversation and block. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 512
SYSTEM, UNKNOWN = "system", "unknown"


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|im_start|>"), F.lit("<| im_start|>")), F.lit("<|im_end|>"), F.lit("<| im_end|>"))


def turns_of(conversations: DataFrame) -> DataFrame:
    said = _safe(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("speaker"), said.alias("said"))


def rotated(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, perspective, block, part, n_turns, rendered, mask, masked_chars): a row for each participant and part.

    mask: spans "start-end" of the part's characters, comma-separated.
    """
    turns = turns_of(conversations).withColumn("block", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1).cast("long")))
    # Parts of a block hold part_turns turns: more than one part only where turn numbers repeat.
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("said")]
    ranked = turns.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)) - 1).withColumn("part", F.floor(F.col("rank") / part_turns).cast("int"))
    speakers = turns.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = ranked.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == SYSTEM, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), _safe(F.translate("speaker", "\r\n", "  "))))
    opened = F.concat(F.lit("<|im_start|>"), head, F.lit("\n"))
    entry = F.struct("rank", opened.alias("opened"), F.concat("said", F.lit("<|im_end|>")).alias("body"), own.alias("own"))
    parts = seen.groupBy("conv_id", "perspective", "block", "part").agg(F.sort_array(F.collect_list(entry)).alias("turns"))  # part_turns entries at most
    # Ends of turns: running sums of lengths.
    ends = F.aggregate("turns", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t["opened"]) + F.length(t["body"]) + 1)))
    spans = F.transform("turns", lambda t, i: F.struct(t["own"].alias("own"), (F.get("ends", i) + F.length(t["opened"])).alias("start"), (F.get("ends", i + 1) - 1).alias("end")))
    mine = F.filter("spans", lambda s: s["own"])
    out = parts.withColumn("ends", ends).withColumn("spans", spans).withColumn("mine", mine)
    return out.select(
        "conv_id",
        "perspective",
        "block",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["opened"], t["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("mine", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias("mask"),
        F.aggregate("mine", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("masked_chars"),
    )
