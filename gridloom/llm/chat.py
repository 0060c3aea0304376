"""Cumulative-snapshot collapse of logged conversations, with DataFrame functions only.

A log often holds a conversation again each time it grows. A rolling hash over a conversation's turns gives each
prefix one value; a conversation whose whole hash is a proper prefix of another is a snapshot and is dropped by an
anti-join. Of equal conversations the one of least conv_id stays. What remains is rendered.

Equal conversations are merged by partial aggregation before prefixes are listed, and prefixes are made distinct
before the anti-join, so a first turn that a third of all conversations share costs one row a task.

Defined cases: a null role or text counts as empty; turns of equal number go by role, then text; a null conv_id
is one conversation; turns repeated in full are turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

OPEN, SHUT = "<|im_start|>", "<|im_end|>"


def _turn_hash(turn: Column) -> Column:
    return F.sha2(F.concat(F.length(turn["role"]).cast("string"), F.lit(":"), turn["role"], turn["text"]), 256)


def prefix_hashes(turns: Column) -> Column:
    """The rolling hash after each turn of an array of (turn, role, text)."""
    start = F.array().cast("array<string>")
    step = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), _turn_hash(x)), 256)))
    return F.aggregate(turns, start, step)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(SHUT + "\n"))), "")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, n_turns) of the conversations that no other one continues."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    hashed = cut(convs.withColumn("_p", prefix_hashes(F.col("turns"))))
    whole = F.element_at("_p", -1)
    distinct = hashed.groupBy(whole.alias("_h")).agg(F.min_by(F.struct("conv_id", "turns", "_p"), F.struct(F.col("conv_id").isNotNull(), F.col("conv_id"))).alias("_c"))
    distinct = distinct.select("_h", "_c.*")
    shorter = distinct.select(F.explode(F.slice("_p", F.lit(1), F.size("_p") - 1)).alias("_h")).distinct()
    return distinct.join(shorter, "_h", "left_anti").select("conv_id", "turns", F.size("turns").alias("n_turns"))


def collapsed_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations."""
    return maximal_conversations(turns).select("conv_id", "n_turns", render(F.col("turns")).alias("rendered"))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, list((role, text) ORDER BY turn NULLS FIRST, role, text) AS turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered FROM t GROUP BY conv_id
), d AS (
  SELECT turns, min(conv_id) AS conv_id, any_value(rendered) AS rendered FROM c GROUP BY turns
), p AS (
  SELECT DISTINCT turns[1:i] AS turns FROM d, LATERAL (SELECT unnest(range(1, len(turns))) AS i)
)
SELECT conv_id, len(turns)::INTEGER AS n_turns, rendered FROM d WHERE turns NOT IN (SELECT turns FROM p)
"""
