"""Multi-party perspective rotation: a dialogue once for each participant, who then is the assistant.

A conversation's participants are its speakers (the ``role`` column holds the
speaker) other than ``system``.  In a participant's rendering its own turns
are the assistant's and trained on, the others' are users' with their names,
and system turns stay what they are.  The result has one row a rendered turn,
with its place in the rendering; nothing gathers a conversation in one row,
and offsets are prefix sums in two levels, over runs of RUN turns and over the
runs, so that one very long conversation is still many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
RUN = 1024
#: What stands around a turn.
OPEN, NAMED, BODY, CLOSE = "<|turn|>", " name=", "\n", "<|end|>\n"


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, seat, role, name, rendered, char_start, mask_start, mask_end) of conversations(conv_id, turn, role, text).

    ``seat`` numbers a rendering's turns from 0.  ``rendered`` is the turn with
    its markers, ``char_start`` where it begins in the rendering;
    mask_start and mask_end bound what is trained on (the assistant's text and
    its closing marker), null for turns that aren't.  Lengths are code points.

    Turns stand by turn number (null first), then speaker, then text;
    repeated rows are rendered each.  A null or empty speaker has no
    perspective and speaks as a user without a name.  A null text is empty.
    Rows of null conv_id are one conversation.  A conversation of system turns
    only has no rendering.  Other columns are not read.  Empty in, empty out.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    people = rows.where((F.col("speaker") != "") & (F.col("speaker") != SYSTEM)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user"))
    name = F.when(~own & (F.col("speaker") != SYSTEM) & (F.col("speaker") != ""), F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.when(name.isNotNull(), F.concat(F.lit(NAMED), name)).otherwise(F.lit("")), F.lit(BODY))
    df = seen.select("conv_id", "perspective", "turn", "speaker", "text", role.alias("role"), name.alias("name"), F.length(head).alias("head"), F.concat(head, F.col("text"), F.lit(CLOSE)).alias("rendered"), own.alias("own"))
    df = df.withColumn("run", F.floor(F.col("turn") / RUN)).withColumn("chars", F.length("rendered").cast("long"))
    # every run's characters and rows, then those of the runs before it
    totals = df.groupBy("conv_id", "perspective", "run").agg(F.sum("chars").alias("run_chars"), F.count("*").alias("run_rows"))
    runs = Window.partitionBy("conv_id", "perspective").orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("run").alias("r"), F.coalesce(F.sum("run_chars").over(runs), F.lit(0)).alias("before"), F.coalesce(F.sum("run_rows").over(runs), F.lit(0)).alias("seats"))
    df = df.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("run").eqNullSafe(F.col("r")))
    order = [F.col("turn").asc_nulls_first(), "speaker", "text"]
    within = Window.partitionBy("conv_id", "perspective", "run").orderBy(*order)
    start = F.col("before") + F.sum("chars").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")
    df = df.withColumns({"char_start": start, "seat": (F.col("seats") + F.row_number().over(within) - 1).cast("long")})
    trained = lambda c: F.when(F.col("own"), c)
    return df.select("conv_id", "perspective", "turn", "seat", "role", "name", "rendered", "char_start", trained(F.col("char_start") + F.col("head")).alias("mask_start"), trained(F.col("char_start") + F.col("chars")).alias("mask_end"))


ORACLE_SQL = f"""
WITH r AS (SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, coalesce(role, '') speaker, coalesce(text, '') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker NOT IN ('', '{SYSTEM}')),
s AS (SELECT r.*, p.perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role,
  CASE WHEN speaker NOT IN (perspective, '{SYSTEM}', '') THEN speaker END AS name FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '{OPEN}' || role || CASE WHEN name IS NULL THEN '' ELSE '{NAMED}' || name END || chr(10) AS head FROM s),
t AS (SELECT *, head || body || '{CLOSE.strip()}' || chr(10) AS rendered FROM h),
w AS (SELECT *, sum(length(rendered)) OVER o - length(rendered) AS begins, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body) - 1 AS seat
  FROM t WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, CAST(seat AS BIGINT) seat, role, name, rendered, CAST(begins AS BIGINT) char_start,
  CASE WHEN speaker = perspective THEN CAST(begins + length(head) AS BIGINT) END mask_start, CASE WHEN speaker = perspective THEN CAST(begins + length(rendered) AS BIGINT) END mask_end
FROM w
"""
