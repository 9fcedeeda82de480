"""Streaming queries: `events` as a live stream of positions, folded by user."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import exists, scratch_root, table
from ..streaming import live
from .timelines import SQL_EVENTS

#: The parts of the table are not in order of time, so every sample may come as late as the whole recording is long.
LATENESS = "3650 days"


def live_fold(spark, sf_dir):
    """The file stream of events is folded to the end; updates go to a table in the shared folder."""
    folder = f"{scratch_root(spark)}/live-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    # The path of the table itself: a file, or a folder of parts. The pattern matches it alone.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/[e]vents.parquet")
    samples = stream.select(F.col("user_id").alias("capture"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    live.run_to_end(live.fold_paths(samples, LATENESS), lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"), f"{folder}/checkpoint")
    # No batch has run if there are no rows.
    updates = spark.read.parquet(f"{folder}/out") if exists(spark, f"{folder}/out") else spark.createDataFrame([], live.RESULT)
    out = live.latest(updates)
    return out.select("capture", "n", F.round("length", 4).alias("length"), "t")


SQL_LIVE = f"""
SELECT user_id AS capture, count(*)::BIGINT AS n, round(coalesce(sum(s), 0.0::DOUBLE), 4) AS length, max(t)::BIGINT AS t FROM (
  SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS s
  FROM (SELECT user_id, t, value AS x, (event_id % 97)::DOUBLE AS y FROM ({SQL_EVENTS})) WINDOW w AS (PARTITION BY user_id ORDER BY t, x, y)) GROUP BY user_id
"""

QUERIES = {"live_fold": live_fold}
ORACLE_SQL = {"live_fold": SQL_LIVE}
