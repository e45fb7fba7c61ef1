"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets a rendering of it in which that speaker is the
assistant and every other speaker a named user. System turns belong to nobody and stay
system turns. The mask says which characters are trained on: the assistant's texts with
their end marks. It is a list of runs, ``1:n`` trained and ``0:n`` not, over the rendering.

A conversation is one row for each participant. One that goes on beyond ``SEGMENT`` turn
numbers continues in further rows, so that no task ever holds a dialogue without bound;
put together in order they are the whole rendering, and so are their masks. Only DataFrame
expressions are used. Equal turns are counted before the shuffle and rendered as often as
they occur; participants are found by partial aggregation, and joined by conversation, which
AQE splits where one conversation is hot. A conversation of p participants is written p
times: that is the method, and its output grows with p.

A text cannot speak for somebody else: ``<|`` is written as ``< |`` in texts and names, and
line ends in names as blanks, so marks and headers only come from the format.

Defined results: a null role is a speaker named ``unknown``; null text is empty; a null turn
number counts as -1, and negative ones stand in the first row; equal turn numbers go by role, then text; rows
without a conversation id are one conversation of their own (null id); a conversation of
system turns only has no participant and so no row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 4096
UNKNOWN = "unknown"
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, perspective, segment, n_turns, rendered, mask."""
    rows = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("s_conv"), F.col("role").alias("perspective")).distinct()
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    parts = counted.groupBy("conv_id", F.floor(F.greatest(F.col("turn"), F.lit(0)) / segment).alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "times"))).alias("turns")
    )
    repeated = F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["times"].cast("int"))))
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("s_conv"))).select("conv_id", "segment", "perspective", repeated.alias("turns"))
    own = lambda t: t["role"] == F.col("perspective")
    name = lambda t: F.translate(F.replace(t["role"], F.lit("<|"), F.lit("< |")), "\r\n", "  ")
    label = lambda t: F.when(own(t), "assistant").when(t["role"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), name(t)))
    head = lambda t: F.concat(F.lit(OPEN), label(t), F.lit("\n"))
    body = lambda t: F.concat(t["text"], F.lit(CLOSE))
    size = lambda c: F.char_length(c).cast("string")
    mask = lambda t: F.when(
        own(t), F.concat(F.lit("0:"), size(head(t)), F.lit(",1:"), size(body(t)), F.lit(",0:1"))
    ).otherwise(F.concat(F.lit("0:"), size(F.concat(head(t), body(t), F.lit("\n")))))
    return both.select(
        "conv_id",
        "perspective",
        "segment",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), body(t), F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("turns", mask), ",").alias("mask"),
    )


SQL = f"""
    WITH t AS (
        SELECT conv_id, coalesce(turn, -1)::BIGINT AS turn, coalesce(role, '{UNKNOWN}') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
        FROM conversations
    ), s AS (
        SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'
    ), r AS (
        SELECT t.conv_id, s.perspective, floor(greatest(turn, 0) / {SEGMENT}.0)::BIGINT AS segment, turn, role, text, role = perspective AS own,
               '{OPEN}' || CASE WHEN role = perspective THEN 'assistant' WHEN role = '{SYSTEM}' THEN role
                           ELSE 'user name=' || translate(replace(role, '<|', '< |'), chr(13) || chr(10), '  ') END || chr(10) AS head,
               text || '{CLOSE}' AS body
        FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
    )
    SELECT conv_id, perspective, segment, count(*) AS n_turns,
           string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS rendered,
           string_agg(CASE WHEN own THEN '0:' || length(head) || ',1:' || length(body) || ',0:1'
                           ELSE '0:' || (length(head) + length(body) + 1) END, ',' ORDER BY turn, role, text) AS mask
    FROM r GROUP BY conv_id, perspective, segment
"""
