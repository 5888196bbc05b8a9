"""Chats of any length from a table of turns: one row a piece, with its place in the whole chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunedata.functions.chat import Place
from tunedata.functions.text import div

TURNS_PER_PIECE = 1024


def chat_pieces(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    size: int = TURNS_PER_PIECE,
) -> DataFrame:
    """(key, piece, place, messages): the turns of every chat in order, at most `size` in a row.

    Turns meet by chat and block of turn numbers, so a chat of any length is spread over tasks. One small
    row per block is summed up along its chat and joined back: `place` says how many turns come before
    the piece and what holds for the whole chat, so that openings, questions and images go where they
    belong and the texts of the pieces join to the text of the chat (see `Place`). Turn numbers are
    unique within a chat and may start and skip as they like; a null key is one chat of its own.
    """
    numbered = turns.select(F.col(key).alias("_key"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    numbered = numbered.withColumn("_block", div(F.col("turn"), size))
    pieces = numbered.groupBy("_key", "_block").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns")
    )
    blocks = numbered.groupBy("_key", "_block").agg(
        F.count(F.lit(1)).alias("_count"),
        F.min_by("role", "turn").alias("_first_role"),
        F.bool_and(F.col("role").isNotNull()).alias("_sound"),
    )
    chat = W.partitionBy("_key").orderBy("_block")
    whole = W.partitionBy("_key")
    before = F.sum("_count").over(chat.rowsBetween(W.unboundedPreceding, -1))
    places = blocks.select(
        F.col("_key").alias("_k"),
        F.col("_block").alias("_b"),
        (F.row_number().over(chat) - 1).cast("bigint").alias("piece"),
        F.struct(
            F.coalesce(before, F.lit(0)).alias("offset"),
            F.sum("_count").over(whole).alias("total"),
            F.coalesce(F.first("_first_role").over(chat) == "system", F.lit(False)).alias("system_first"),
            F.min("_sound").over(whole).alias("sound"),
        ).alias("place"),
    )
    messages = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    joined = pieces.join(places, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    return joined.select(F.col("_key").alias(key), "piece", "place", messages.alias("messages"))


def count_chats(place: str = "place") -> Column:
    """The number of chats among their pieces, for an aggregation."""
    return F.count_if(Place.of(place).starts)
