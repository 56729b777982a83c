"""Chat logs: collapse cumulative snapshots, then render the conversations that remain.

Logs often hold a conversation again and again, each time with more turns. A conversation whose turns are
the first turns of a longer one is dropped; of equal ones the least conv_id stays. A rolling hash over the turns names every prefix: the
hash of a turn's number, role and text, xor'ed into that of the prefix before it, 128 bits from two seeds, beside the number of turns. The prefixes shorter than their conversation form one set, deduplicated
before it is shuffled, and an anti-join keeps the conversations whose whole hash isn't in it.

Turns are dealt out by conversation once; hashes roll along a window, a turn at a time, so the work is in proportion to the turns. Only hashes are
compared: no pair of conversations is formed, and a first turn shared by a third
of the log is one row of the set. What is rendered is a conversation at a time; a single conversation must
fit in a task, as its rendered text does.

Defined results: turns are ordered by turn (null first), then role, then text, and a repeated turn row counts
as a turn. A null role or text differs from an empty one when conversations are compared, and is rendered as empty. Rows with a null
conv_id form one conversation. An empty table gives no rows. Other columns aren't read. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEEDS = (4, 44)


def render(turns: Column) -> Column:
    """The chat template: ``<|role|>``, a line break, the text, ``<|end|>``, a line break, for each turn."""
    empty = F.lit("")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], empty), F.lit("|>\n"), F.coalesce(t["text"], empty), F.lit("<|end|>\n"))), "")


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, turn, role, text, n (its number from 1), n_turns (of its conversation), and hash, which names the conversation up to there."""
    whole = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(whole))
    so_far = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A null is skipped in the hash of several values, so each says whether it is one.
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "n", F.col("role").isNull(), "role", F.col("text").isNull(), "text")).over(so_far) for seed in SEEDS]
    return rows.withColumns({"hash": F.struct("n", *(m.alias(f"h{i}") for i, m in enumerate(marks))), "n_turns": F.count(F.lit(1)).over(Window.partitionBy("conv_id")).cast("int")})


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered of the conversations that are no prefix of another."""
    turns = prefixes(conversations)
    shorter = turns.where("n < n_turns").select("hash").distinct()
    whole = turns.where("n = n_turns").groupBy("hash").agg(F.min("conv_id").alias("conv_id"))
    kept = whole.join(shorter, "hash", "left_anti").select(F.col("conv_id").alias("kept"))
    left = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")
    listed = left.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    return listed.select("conv_id", "n_turns", render(F.col("turns")).alias("rendered"))


ORACLE = """
WITH chats AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM conversations GROUP BY conv_id
),
prefixes AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM chats))
SELECT min(conv_id) AS conv_id, CAST(len(any_value(turns)) AS INTEGER) AS n_turns, any_value(rendered) AS rendered
FROM chats WHERE turns NOT IN (SELECT turns FROM prefixes) GROUP BY turns
"""
