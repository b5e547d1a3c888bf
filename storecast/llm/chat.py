"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Logs often hold a conversation again after every turn. Each turn gets a rolling hash of all turns up
to it; a conversation whose last hash is the hash of a proper prefix of another one is a snapshot of
it and goes. Of equal conversations one stays. What remains is rendered in ChatML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storecast.llm.common import materialize

# The ChatML turn frame.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    """Hash of a turn at its place; a null is not the same as an empty string."""
    return F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def hashed_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, conv_id, pos, n, h1, h2, role, text) of every turn: its place, its conversation's length and the rolling
    hash (two words of 64 bits) of all turns up to it. A turn's hash covers its place, so the rolling exclusive-or
    tells orders apart. One conversation is sorted and walked by one task, which spills and keeps no turns in memory.
    """
    key = F.when(F.col(id_col).isNotNull(), F.concat(F.lit("c"), F.col(id_col).cast("string"))).otherwise(
        F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string")))
    rows = turns.select(key.alias("key"), F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    conversation = Window.partitionBy("key")
    order = conversation.orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    upto = conversation.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"t1": _turn_hash(1), "t2": _turn_hash(2)})
    rows = rows.withColumns({"h1": F.bit_xor("t1").over(upto), "h2": F.bit_xor("t2").over(upto)})
    last = F.lead("pos").over(conversation.orderBy("pos")).isNull()
    return rows.withColumn("last", last).select("key", "conv_id", "pos", "last", "h1", "h2", "role", "text")


def collapse(turns: DataFrame) -> DataFrame:
    """(key, conv_id, n_turns, n_copies) of the maximal conversations of written ``turns`` (see :func:`hashed_turns`).

    Equal conversations and prefixes are first reduced to one row each, on the map side, so that a
    conversation or a first turn that a third of all logs share is a few rows in the anti-join.
    """
    whole = turns.where("last").groupBy("h1", "h2", "pos").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("kept"), F.count("*").alias("n_copies"))
    prefixes = turns.where(~F.col("last")).select("h1", "h2", "pos").distinct()
    maximal = whole.join(prefixes, ["h1", "h2", "pos"], "left_anti")
    return maximal.select(F.col("kept.key").alias("key"), F.col("kept.conv_id").alias("conv_id"), F.col("pos").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: id, n_turns, n_copies (equal conversations) and ``rendered`` (ChatML).

    Turns go by their number; turns of one number go by role and text, nulls first, and all stay. A null
    role is rendered as ``user``, a null text as empty. A turn without a conversation id is a
    conversation of its own. Of equal conversations the least id stays. Snapshots of any length go,
    also those of conversations that are themselves snapshots. Other columns are not read; an empty
    table gives no rows.
    """
    hashed = materialize(hashed_turns(turns, id_col, turn_col, role_col, text_col), "turns")
    kept = materialize(collapse(hashed), "conversations")
    line = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(TURN_END))
    rendered = hashed.select("key", "pos", line.alias("line")).join(kept, "key").groupBy("key", "conv_id", "n_turns", "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return rendered.select(F.col("conv_id").alias(id_col), "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
