"""Chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered once more with that speaker as the
assistant and all others as named users; the mask holds the character spans of the assistant's turns,
end marker included, which a trainer learns from. System turns stay system turns in every rendering.

A conversation is rendered in segments of ``SEGMENT`` consecutive turn numbers, so that a row stays
bounded however long a conversation is; segments in order are the whole rendering.

Defined results: a null role is the speaker ``unknown``, a null text is empty, a null turn comes first
and is in segment -1; a row that repeats another (conversation, turn, role and text) is one turn; turns
of equal number are ordered by speaker and text; a conversation with system turns alone has one
rendering, of no speaker, with an empty mask. A marker inside a text is broken up by a space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1024
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    return conversations.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / segment), F.lit(-1)).cast("long").alias("segment"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).distinct()


def rotate(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, speaker, n_turns, rendered, mask`` (``start:end`` of each span, joined by commas) and ``n_masked``."""
    said = turns(conversations, segment)
    speakers = said.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__of"), F.col("role").alias("speaker")).distinct()
    dialogue = said.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    each = dialogue.join(speakers, F.col("conv_id").eqNullSafe(F.col("__of")), "left")
    own = "t.role <=> speaker"
    head = f"CASE WHEN {own} THEN 'assistant' WHEN t.role = '{SYSTEM}' THEN '{SYSTEM}' ELSE concat('user name=', t.role) END"
    each = each.withColumn("parts", F.expr(f"transform(turns, t -> struct({own} AS own, concat('{START}', {head}, '\\n') AS head, concat(t.text, '{END}\\n') AS body))"))
    step = "named_struct('at', a.at + length(p.head) + length(p.body), 'spans', CASE WHEN p.own THEN concat(a.spans, array(named_struct('s', a.at + length(p.head), 'e', a.at + length(p.head) + length(p.body)))) ELSE a.spans END)"
    start = "named_struct('at', 0L, 'spans', cast(array() AS array<struct<s: bigint, e: bigint>>))"
    each = each.withColumn("spans", F.expr(f"aggregate(parts, {start}, (a, p) -> {step}).spans"))
    return each.select(
        "conv_id",
        "segment",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("array_join(transform(parts, p -> concat(p.head, p.body)), '')").alias("rendered"),
        F.expr("array_join(transform(spans, x -> concat(x.s, ':', x.e)), ',')").alias("mask"),
        F.expr("aggregate(spans, 0L, (n, x) -> n + x.e - x.s)").alias("n_masked"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    from kinloom.llm.tables import table

    return rotate(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH said AS (
  SELECT DISTINCT conv_id, coalesce(floor(turn / 1024), -1)::BIGINT AS segment, turn, coalesce(role, 'unknown') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'
), parts AS (
  SELECT s.conv_id, segment, speaker, turn, role, text, role IS NOT DISTINCT FROM speaker AS own,
         '<|im_start|>' || CASE WHEN role IS NOT DISTINCT FROM speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM said s LEFT JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, (sum(length(head) + length(body)) OVER w)::BIGINT AS upto
  FROM parts WINDOW w AS (PARTITION BY conv_id, segment, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, segment, speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg((upto - length(body)) || ':' || upto, ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS mask,
       coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_masked
FROM placed GROUP BY ALL
"""
