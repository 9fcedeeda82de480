"""Chat formatting with multi-party perspective rotation (DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that participant as the assistant and all
others as named users; the loss mask covers exactly what the assistant says. System turns are context: they are
rendered as such under every perspective and are nobody's.

The result has one row per perspective and turn, in a form that streams: role and name under the perspective,
the rendered segment, its offsets in the whole rendering and its mask. So a conversation of any length stays spread
over tasks; offsets are sums in two steps, over blocks of turns and then inside each block. `transcripts` joins the
segments of bounded conversations into one text each.

Defined results: a null role speaks as "unknown", a null text is empty; turn marks inside a text or a name and newlines
inside a name are escaped, so renderings can be taken apart again; turns that tie are ordered by role, then
text; a null conversation id is a conversation of its own; a conversation of system turns alone has no perspective
and no rows; columns other than the four named are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text):
    """The text with a backslash after the beginning of any turn mark in it (and one more where there is one already), so
    that what looks like a mark in a rendering is one."""
    return F.replace(F.replace(text, F.lit("<|im\\"), F.lit("<|im\\\\")), F.lit("<|im_"), F.lit("<|im\\_"))


def one_line(name):
    """A name that cannot end its line: backslashes doubled, newlines as \\n, marks as in texts."""
    return F.replace(escaped(F.replace(name, F.lit("\\"), F.lit("\\\\"))), F.lit("\n"), F.lit("\\n"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, turn, position (0-based, long), role, name, segment, start, stop (code points, stop
    exclusive) and mask_start, mask_stop (the assistant's words and its end mark; equal where nothing is learnt)."""
    raw = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("words"),
    )
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)
    rows = raw.withColumn("_block", block)
    people = raw.where(F.col("speaker") != "system").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    people = people.withColumnRenamed("conv_id", "_conv")
    seen = rows.join(people, rows["conv_id"].eqNullSafe(people["_conv"])).drop("_conv")
    mine, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == "system"
    role = F.when(system, "system").when(mine, "assistant").otherwise("user")
    name = F.when(~system & ~mine, F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), one_line(name)), F.lit("")), F.lit("\n"))
    shown = seen.select(
        "conv_id", "perspective", "turn", "_block", "speaker", "words", role.alias("role"), name.alias("name"),
        F.concat(head, escaped(F.col("words")), F.lit(CLOSE)).alias("segment"), F.length(head).alias("_head"), mine.alias("_mine"),
    ).withColumn("_size", F.length("segment").cast("long"))
    blocks = shown.groupBy("conv_id", "perspective", "_block").agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_block").alias("_b"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_chars0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
    )
    joined = shown.join(blocks, shown["conv_id"].eqNullSafe(blocks["_c"]) & (F.col("perspective") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    inside = Window.partitionBy("conv_id", "perspective", "_block").orderBy("turn", "speaker", "words")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    stop = F.col("_chars0") + F.sum("_size").over(upto)
    out = joined.select("*", stop.alias("stop"), (F.col("_rows0") + F.row_number().over(inside) - 1).cast("long").alias("position"))
    start = F.col("stop") - F.col("_size")
    mask_stop = F.when(F.col("_mine"), F.col("stop") - 1).otherwise(start)
    mask_start = F.when(F.col("_mine"), start + F.col("_head")).otherwise(start)
    return out.select("conv_id", "perspective", "turn", "position", "role", "name", "segment", start.alias("start"), "stop", mask_start.alias("mask_start"), mask_stop.alias("mask_stop"))


def transcripts(segments: DataFrame) -> DataFrame:
    """One rendering for each conversation and perspective, with its masks; for conversations that fit into a row."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "segment", "mask_start", "mask_stop")))
    one = segments.groupBy("conv_id", "perspective").agg(ordered.alias("_s"))
    masks = F.filter(F.transform("_s", lambda s: F.struct(s["mask_start"].alias("start"), s["mask_stop"].alias("stop"))), lambda m: m["start"] < m["stop"])
    return one.select("conv_id", "perspective", F.array_join(F.transform("_s", lambda s: s["segment"]), "").alias("text"), masks.alias("masks"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_SQL_MARKS = "replace(replace({}, '<|im' || chr(92), '<|im' || chr(92) || chr(92)), '<|im_', '<|im' || chr(92) || '_')"
OP2_SQL = f"""
WITH people AS (SELECT DISTINCT conv_id, coalesce(role, 'unknown') AS perspective FROM conversations WHERE coalesce(role, 'unknown') <> 'system'),
seen AS (
  SELECT c.conv_id, p.perspective, c.turn::BIGINT AS turn, coalesce(c.role, 'unknown') AS speaker, coalesce(c.text, '') AS words
  FROM conversations c JOIN people p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
roles AS (
  SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name FROM seen),
heads AS (SELECT *, '{OPEN}' || role || coalesce(' name=' || replace({_SQL_MARKS.format("replace(name, chr(92), chr(92) || chr(92))")}, chr(10), chr(92) || 'n'), '') || chr(10) AS head FROM roles),
parts AS (SELECT *, head || {_SQL_MARKS.format("words")} || '<|im_end|>' || chr(10) AS segment FROM heads),
placed AS (
  SELECT *, sum(length(segment)) OVER w AS stop, row_number() OVER w - 1 AS position FROM parts
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, words ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, turn, position::BIGINT AS position, role, name, segment, (stop - length(segment))::BIGINT AS start, stop::BIGINT AS stop,
       (CASE WHEN role = 'assistant' THEN stop - length(segment) + length(head) ELSE stop - length(segment) END)::BIGINT AS mask_start,
       (CASE WHEN role = 'assistant' THEN stop - 1 ELSE stop - length(segment) END)::BIGINT AS mask_stop
FROM placed
"""
