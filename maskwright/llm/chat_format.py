"""Chat formatting: cumulative snapshots collapse to the longest logged conversation, then are rendered.

A conversation's turns, in order, give rolling prefix hashes: each is the one before plus a hash of the
turn's place, role and text (two sums of 64-bit hashes, kept whole). A conversation whose last hash is an
inner hash of another is a prefix of that one and goes, by an anti-join on hashes; of equal conversations
the one of least id stays. What remains is rendered with role markers.

Null roles and texts count as empty; exact repeats of a row count once; turns of equal number are ordered
by role and text, null numbers first. A row of a null conv_id belongs to no known conversation: it is one
of a single turn, with a null id (the least). Very long conversations are hashed turn by turn over a
sorted window; only the rendered text has to fit a row. An empty table gives no conversations. Only
conv_id, turn, role and text are read, whatever the other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, session

#: Around each turn. Fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def turn_hash(place: Column, role: Column, text: Column, kind: int) -> Column:
    """One of two hashes of a turn and its place, as a term of a sum that can't overflow."""
    return F.xxhash64(F.lit(kind), place, role, text).cast("decimal(20,0)")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and turns of the maximal conversations."""
    spark = session(conversations.sparkSession)
    stages = Stages(spark, "chat")
    said = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.struct("turn", "role", "text")
    whole = said.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(turns)).alias("turns")).withColumn("mark", F.lit(0).cast("bigint"))
    lone = said.where("conv_id is null").groupBy("role", "text").agg(F.first("conv_id").alias("conv_id"), F.min("turn").alias("turn"))
    whole = stages.write(whole.unionByName(lone.select("conv_id", F.array(turns).alias("turns"), F.xxhash64("role", "text").alias("mark"))))
    each = whole.select("conv_id", "mark", F.size("turns").alias("n"), F.posexplode("turns").alias("place", "t"))
    each = each.select("conv_id", "mark", "n", (F.col("place") + 1).alias("place"), *(turn_hash(F.col("place"), F.col("t.role"), F.col("t.text"), k).alias(f"h{k}") for k in (0, 1)))
    rolling = Window.partitionBy("conv_id", "mark").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = stages.write(each.select("conv_id", "mark", "n", "place", *(F.sum(f"h{k}").over(rolling).alias(f"h{k}") for k in (0, 1))))
    prefix = ["place", "h0", "h1"]
    # Copies first: a partial minimum before the shuffle, so that one conversation logged by thousands is no hot key.
    ids = rolled.where("place = n").groupBy(*prefix).agg(F.min(F.struct("conv_id", "mark")).alias("least"))
    kept = ids.join(rolled.where("place < n").select(*prefix).distinct(), prefix, "left_anti")
    kept = kept.select(F.col("least.conv_id").alias("k"), F.col("least.mark").alias("m"))
    same = F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m"))
    return whole.join(kept, same, "left_semi").select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), "turns")


def chat_texts(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text of the maximal conversations."""
    return collapse(conversations).select("conv_id", "n_turns", render(F.col("turns")).alias("text"))


SQL = f"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN coalesce(role, '') || chr(31) || coalesce(text, '') END AS lone FROM conversations
), rolled AS (
  SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, lone) AS n,
    string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE.strip()}' || chr(10), '') OVER w AS told
  FROM (SELECT conv_id, lone, role, text, CASE WHEN lone IS NULL THEN turn END AS turn FROM said GROUP BY ALL)
  WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT told, min(n) AS n_turns, CASE WHEN bool_or(conv_id IS NULL) THEN NULL ELSE min(conv_id) END AS conv_id FROM rolled WHERE k = n GROUP BY told
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, told AS text FROM whole
WHERE told NOT IN (SELECT told FROM rolled WHERE k < n)
"""
