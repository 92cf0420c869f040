"""Chat formatting: collapse cumulative snapshots, render what is left.  DataFrame operations only.

A logger that writes the whole conversation after each turn leaves many conversations
that are prefixes of longer ones.  Each turn gets a position-tagged 128-bit hash; the
running XOR of these is the hash of the prefix up to that turn.  A conversation whose
full hash is a proper prefix hash of another one goes; of equal ones the smallest
``conv_id`` stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is written; {role} and {text} are replaced.
TURN = ("<|", "|>\n", "<|end|>\n")


def _code() -> Column:
    """A text's MD5; empty for a null one."""
    return F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))


def _turn_hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("code"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1, h2: the hash of turns 1 to pos.

    Turns are taken by ``turn`` (null first), then role and the text's MD5; so repeated rows and
    ties have a defined place and count as turns of their own.  Texts are hashed where they
    are read and do not move.
    """
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "code")
    placed = turns.select("conv_id", "turn", "role", _code().alias("code")).withColumn("pos", F.row_number().over(line))
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("conv_id", "pos", *[F.bit_xor(_turn_hash(seed)).over(so_far).alias(h) for seed, h in (("a", "h1"), ("b", "h2"))])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that stay.

    n_copies: conversations with exactly these turns, itself included.  Rows whose
    conv_id is null belong to no conversation and are left out.
    """
    hashed = prefix_hashes(turns.where("conv_id IS NOT NULL"))
    length = Window.partitionBy("conv_id")
    hashed = hashed.withColumn("n_turns", F.max("pos").over(length))
    # equal conversations meet here as partial sums, however many they are
    whole = (
        hashed.where("pos = n_turns")
        .groupBy("h1", "h2", F.col("pos").alias("n_turns"))
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    inner = hashed.where("pos < n_turns").select("h1", "h2", F.col("pos").alias("n_turns")).distinct()
    return whole.join(inner, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat: one row per conversation that stays.

    A null role or text is written as an empty one.  A conversation is one row of the
    result, so it must fit in a row; nothing else is gathered.  An empty table gives no rows;
    other columns are ignored, whatever their names.  Only texts of conversations that stay are
    put in order.
    """
    kept = maximal_conversations(turns)
    before_role, after_role, after_text = map(F.lit, TURN)
    said = F.concat(before_role, F.coalesce("role", F.lit("")), after_role, F.coalesce("text", F.lit("")), after_text)
    written = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", "role", _code().alias("code"), said.alias("said")).alias("one"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["said"]), "")
    chats = written.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(line.alias("chat"))
    return kept.join(chats, "conv_id")
