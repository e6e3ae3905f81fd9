"""Chat formatting: a dialogue of several speakers rendered once for each, with that speaker as the assistant.

Other speakers are users with their names; system turns stay system turns and are no one's view. The mask gives the
spans of code points, [start, end), that the model learns: the assistant's turns with their end marks.

All work is on DataFrame functions, and conversations are rendered whole. A conversation that no row can hold must be
split, and that is the caller's word: part_turns cuts it by turn number, and each part begins with the system turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks of the template. SAFE within a text or a role is written with a space and line ends in a role are
#: spaces, so that neither can open or end a turn.
OPEN, CLOSE, SAFE = "<|im_start|>", "<|im_end|>\n", "<|im_"
SYSTEM, UNNAMED = "system", "unknown"


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(SAFE), F.lit("< |im_"))


def perspectives(turns: DataFrame, part_turns: int | None = None) -> DataFrame:
    """Rows (conv_id, perspective, part, n_turns, rendered, mask), one for each speaker of a conversation, and part of it.

    Turns go by number, then role, then text; a null number is 0, a null role is `unknown`, a null text is empty. Null
    conv_ids are one conversation. Rows that repeat are turns of their own. A conversation of system turns alone has no
    speaker and no row. Without part_turns there is one part, 0. With it, part p has the turns whose number is in
    [p * part_turns, (p + 1) * part_turns), after the system turns of earlier parts; a speaker silent in a part has a row
    there with an empty mask. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))
    role = F.translate(unmarked(F.coalesce("role", F.lit(UNNAMED))), "\r\n", "  ")
    rows = turns.select(
        F.col("conv_id").alias("conv_id"), turn.alias("turn"), role.alias("role"), unmarked(F.coalesce("text", F.lit(""))).alias("text"),
        (F.floor(turn / part_turns) if part_turns else F.lit(0)).cast("long").alias("part"),
    )
    speakers = rows.where(F.col("role") != SYSTEM).select("conv_id", "role").distinct().withColumnRenamed("conv_id", "__c")
    if part_turns:
        system = rows.where(F.col("role") == SYSTEM).withColumnRenamed("part", "__from").withColumnRenamed("conv_id", "__c")
        later = rows.select("conv_id", "part").distinct().join(system, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__from") < F.col("part")))
        rows = rows.unionByName(later.select("conv_id", "turn", "role", "text", "part"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    each = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("__c"))).select("conv_id", F.col("role").alias("perspective"), "part", "turns")

    def shown(t):
        head = F.when(t["role"] == F.col("perspective"), "assistant").when(t["role"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.struct(F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["role"] == F.col("perspective")).alias("own"))

    each = each.withColumn("turns", F.transform("turns", shown))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(state, t):
        start = state["at"] + F.char_length(t["head"])
        end = start + F.char_length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(state["mask"], span)).otherwise(state["mask"]).alias("mask"))

    return each.select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "").alias("rendered"),
        F.aggregate("turns", empty, step, lambda s: s["mask"]).alias("mask"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return out.select(
        "conv_id", "perspective", "part", "n_turns", F.char_length("rendered").cast("long").alias("n_chars"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"]).alias("trained_chars"),
        spans.alias("mask"), F.sha2("rendered", 256).alias("rendered_sha256"),
    )


OP6_SQL = """
WITH t AS (
  SELECT conv_id, 0::BIGINT AS part, coalesce(turn, 0) AS turn, translate(replace(coalesce(role, 'unknown'), '<|im_', '< |im_'), chr(13) || chr(10), '  ') AS role,
         replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS body FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT t.*, perspective, role = perspective AS own, '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, perspective ORDER BY turn, role, body ROWS UNBOUNDED PRECEDING) AS stop FROM r
)
SELECT conv_id, perspective, part, count(*)::BIGINT AS n_turns, sum(length(head) + length(body))::BIGINT AS n_chars,
       coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS trained_chars,
       coalesce(string_agg((stop - length(body))::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR, ',' ORDER BY stop) FILTER (WHERE own), '') AS mask,
       sha256(string_agg(head || body, '' ORDER BY stop)) AS rendered_sha256
FROM o GROUP BY conv_id, perspective, part
"""
