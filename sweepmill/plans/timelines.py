"""Queries over time series (`events`, by user) and ordered tables (`orders`, by customer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align, series
from ..session import table

SECOND = 1_000_000
WEEK = 7 * 86400 * SECOND
SQL_EVENTS = "SELECT event_id, user_id, event_type, value, epoch_us(ts)::BIGINT AS t FROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with t, their time in microseconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


def r6(column, name: str):
    """Rounded to six places as SQL does it: the product with a million, halves away from 0. (F.round takes the decimal digits
    of the number, which decides otherwise where the product rounds to a half.)"""
    column = F.col(column) if isinstance(column, str) else column
    big = F.abs(column) * 1e6
    return F.when(big < 2.0**52, F.signum(column) * F.floor(big + 0.5) / 1e6 + 0.0).otherwise(column).alias(name)


def asof_nearest(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("view_id"))
    out = align.nearest(left, right, ["user_id"], "t", ["view_id"], tie="earlier", bucket=WEEK)
    return out.select("event_id", F.col("match.at").alias("view_t"), (F.col("t") - F.col("match.at")).alias("lag_us"))


def _sql_nearest(tie: str) -> str:
    return f"""
SELECT event_id, rt AS view_t, t - rt AS lag_us FROM (
  SELECT l.event_id, l.t, r.t AS rt, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t) NULLS LAST, r.t {tie}) AS k
  FROM (SELECT * FROM ({SQL_EVENTS}) WHERE event_type = 'purchase') l
  LEFT JOIN (SELECT * FROM ({SQL_EVENTS}) WHERE event_type = 'view') r ON l.user_id = r.user_id) WHERE k = 1"""


def asof_tolerance(spark, sf_dir):
    """Coverage by matches within an hour, ties to the later row: the gate on clocks that must overlap."""
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'click'").select("user_id", "t", F.col("event_id").alias("click_id"))
    out = align.nearest(left, right, ["user_id"], "t", ["click_id"], tie="later", tolerance=3600 * SECOND, bucket=WEEK)
    hit = F.col("match").isNotNull()
    cover = out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(hit).alias("covered"), F.max(F.abs(F.col("t") - F.col("match.at"))).alias("worst_us"))
    return cover.withColumn("passes", F.col("covered") >= F.greatest(F.lit(1), F.floor(F.col("n") * 9 / 10)))


SQL_TOLERANCE = f"""
WITH near AS (
  SELECT event_id, user_id, t, CASE WHEN abs(t - rt) <= {3600 * SECOND} THEN rt END AS rt FROM (
    SELECT l.event_id, l.user_id, l.t, r.t AS rt, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t) NULLS LAST, r.t DESC) AS k
    FROM (SELECT * FROM ({SQL_EVENTS}) WHERE event_type = 'purchase') l
    LEFT JOIN (SELECT * FROM ({SQL_EVENTS}) WHERE event_type = 'click') r ON l.user_id = r.user_id) WHERE k = 1)
SELECT user_id, count(*)::BIGINT AS n, count(rt)::BIGINT AS covered, max(abs(t - rt))::BIGINT AS worst_us,
       count(rt) >= greatest(1, floor(count(*) * 9 / 10.0)) AS passes FROM near GROUP BY user_id
"""


def interp_join(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    out = align.interpolated(left, right, ["user_id"], "t", "value", bucket=WEEK)
    return out.select("event_id", F.round("value_at", 6).alias("value_at"))


SQL_INTERP = f"""
WITH r AS (SELECT user_id, t, avg(value) AS value FROM ({SQL_EVENTS}) WHERE event_type = 'view' GROUP BY user_id, t),
l AS (SELECT event_id, user_id, t FROM ({SQL_EVENTS}) WHERE event_type = 'purchase'),
ends AS (
  SELECT l.event_id, l.t, max(r.t) FILTER (WHERE r.t <= l.t) AS t0, arg_max(r.value, r.t) FILTER (WHERE r.t <= l.t) AS v0,
         min(r.t) FILTER (WHERE r.t >= l.t) AS t1, arg_min(r.value, r.t) FILTER (WHERE r.t >= l.t) AS v1
  FROM l LEFT JOIN r ON l.user_id = r.user_id GROUP BY l.event_id, l.t)
SELECT event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t0 = t1 THEN v0
  ELSE (1.0::DOUBLE - (t - t0) / (t1 - t0)::DOUBLE) * v0 + (t - t0) / (t1 - t0)::DOUBLE * v1 END, 6) + 0.0 AS value_at FROM ends
"""


def interp_bucketed(spark, sf_dir):
    """The same for many points and few knots, by buckets of a day instead of a sort."""
    e = events(spark, sf_dir)
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    knots = e.where("event_type = 'view'").groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    out = align.bracketed(points, knots, ["user_id"], "t", "value", 86400 * SECOND)
    return out.select("event_id", F.round("value_at", 6).alias("value_at"))


def interval_upper_median(spark, sf_dir):
    gaps = series.positive_gaps(events(spark, sf_dir), ["user_id"], "t")
    out = series.upper_median(gaps, ["user_id"], "gap")
    return out.select("user_id", F.col("median").alias("median_us"), "n", (F.col("median") <= 6 * 3600 * SECOND).alias("passes"))


SQL_MEDIAN = f"""
SELECT user_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS median_us, count(*)::BIGINT AS n,
       list_sort(list(gap))[len(list(gap)) // 2 + 1] <= {6 * 3600 * SECOND} AS passes
FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM ({SQL_EVENTS})) WHERE gap > 0 GROUP BY user_id
"""


def trimmed_mean(spark, sf_dir):
    out = series.trimmed_mean(events(spark, sf_dir), ["user_id"], "value")
    return out.select("user_id", r6(F.col("mean"), "mean"), "n")


SQL_TRIMMED = f"""
SELECT user_id, round(avg(value), 6) AS mean, any_value(n)::BIGINT AS n FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ({SQL_EVENTS}))
WHERE r > CASE WHEN n >= 20 THEN n // 10 ELSE 0 END AND r <= n - CASE WHEN n >= 20 THEN n // 10 ELSE 0 END GROUP BY user_id
"""


def static_calibration(spark, sf_dir):
    """Mean and spread of each user's first ten days, and whether the window counts as still."""
    first = series.static_window(events(spark, sf_dir), ["user_id"], "t", 10 * 86400 * SECOND)
    bias = series.trimmed_mean(first, ["user_id"], "value").select("user_id", F.col("mean").alias("bias"))
    spread = first.groupBy("user_id").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("std"), (F.max("t") - F.min("t")).alias("span_us"), F.avg("value").alias("mean"))
    joined = spread.join(bias, "user_id")
    still = (F.col("n") >= 10) & (F.col("span_us") >= 8 * 86400 * SECOND) & (F.col("std") < 1.2 * F.col("mean"))
    return joined.select("user_id", "n", "span_us", r6(F.col("bias"), "bias"), r6(F.col("std"), "std"), still.alias("still"))


SQL_STATIC = f"""
WITH w AS (SELECT * FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0 FROM ({SQL_EVENTS})) WHERE t <= t0 + {10 * 86400 * SECOND}),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS m FROM w),
b AS (SELECT user_id, avg(value) AS bias FROM k WHERE r > CASE WHEN m >= 20 THEN m // 10 ELSE 0 END AND r <= m - CASE WHEN m >= 20 THEN m // 10 ELSE 0 END GROUP BY user_id)
SELECT w.user_id, count(*)::BIGINT AS n, (max(t) - min(t))::BIGINT AS span_us, round(any_value(bias), 6) AS bias, round(stddev_pop(value), 6) AS std,
       count(*) >= 10 AND max(t) - min(t) >= {8 * 86400 * SECOND} AND stddev_pop(value) < 1.2 * avg(value) AS still
FROM w JOIN b ON w.user_id = b.user_id GROUP BY w.user_id
"""


#: Ten days: the runs, frames and paths of a user are worked out in pieces of this length.
PIECE = 10 * 86400 * SECOND


def sustained_run(spark, sf_dir):
    return series.sustained_runs(events(spark, sf_dir), ["user_id"], "t", F.col("value") > 30.0, 6 * 3600 * SECOND, PIECE)


SQL_RUN = f"""
SELECT user_id, min(start)::BIGINT AS start FROM (
  SELECT user_id, run, min(t) AS start, max(t) AS stop FROM (
    SELECT user_id, t, value > 30.0 AS m, sum(CASE WHEN value > 30.0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run
    FROM ({SQL_EVENTS})) WHERE m GROUP BY user_id, run) WHERE stop - start >= {6 * 3600 * SECOND} GROUP BY user_id
"""


def reject_streak(spark, sf_dir):
    out = series.longest_streak(events(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("event_type") == "error", PIECE)
    return out.select("user_id", F.col("longest").cast("long").alias("longest"), F.col("current").cast("long").alias("current"))


SQL_STREAK = f"""
SELECT user_id, max(n)::BIGINT AS longest, arg_max(n, run)::BIGINT AS current FROM (
  SELECT user_id, run, count(*) FILTER (WHERE event_type = 'error') AS n FROM (
    SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run
    FROM ({SQL_EVENTS})) GROUP BY user_id, run) GROUP BY user_id
"""


def sliding_count_frame(spark, sf_dir):
    out = series.sliding_frame(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", 12, PIECE)
    return out.select("event_id", r6(F.col("frame_sum"), "frame_sum"), "frame_n")


SQL_FRAME = f"""
SELECT event_id, round(sum(value) OVER w, 6) + 0.0 AS frame_sum, (count(*) OVER w)::BIGINT AS frame_n FROM ({SQL_EVENTS})
WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
"""


def keyframe_stride(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    out = series.keyframes(o, ["o_custkey"], ["o_orderkey"], 3, 4, 100_000)
    return out.select("o_custkey", "o_orderkey", "place", F.coalesce("following", F.lit(0).cast("long")).alias("following"))


SQL_STRIDE = """
SELECT o_custkey, o_orderkey, place, coalesce(following, 0) AS following FROM (
  SELECT o_custkey, o_orderkey, (row_number() OVER w - 1)::BIGINT AS place, lead(o_orderkey) OVER w AS following, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE place % greatest(3, ceil(n / 4.0)::BIGINT) = 0
"""


def path_length_bbox(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "t", "event_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    out = series.path(e, ["user_id"], ["t", "event_id"], ["x", "y"], PIECE)
    return out.select("user_id", *[r6(F.col(c), c) for c in ("x_min", "x_max", "y_min", "y_max")], F.round("length", 4).alias("length"))


SQL_PATH = f"""
SELECT user_id, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, round(coalesce(sum(s), 0.0::DOUBLE), 4) AS length FROM (
  SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS s
  FROM (SELECT user_id, t, event_id, value AS x, (event_id % 97)::DOUBLE AS y FROM ({SQL_EVENTS})) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) GROUP BY user_id
"""


def trajectory_thin(spark, sf_dir):
    return series.thinned(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 10, PIECE).select("user_id", "event_id", "t")


SQL_THIN = f"""
SELECT user_id, event_id, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ({SQL_EVENTS}))
WHERE i % greatest(1, ceil(n / 10.0)::BIGINT) = 0 OR i = n - 1
"""


def linspace_sample(spark, sf_dir):
    return series.linspace_rows(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 16, PIECE).select("user_id", "event_id")


SQL_LINSPACE = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ({SQL_EVENTS})),
picked AS (SELECT DISTINCT user_id, floor(j * (n - 1) / 15.0)::BIGINT AS i FROM (SELECT DISTINCT user_id, n FROM r WHERE n > 16), range(16) x(j))
SELECT r.user_id, r.event_id FROM r LEFT JOIN picked p ON r.user_id = p.user_id AND r.i = p.i WHERE r.n <= 16 OR p.i IS NOT NULL
"""


def scan_index(spark, sf_dir):
    """Dense renumbering of one global order, in parts: counts of each part shift the numbers inside it."""
    e = events(spark, sf_dir).withColumn("part", F.floor(F.col("t") / (86400 * SECOND)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = e.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part").orderBy("t", "event_id")
    return e.withColumn("i", F.row_number().over(inside) - 1).join(F.broadcast(shift), "part").select("event_id", (F.col("i") + F.col("shift")).alias("scan_index"))


SQL_INDEX = f"SELECT event_id, (row_number() OVER (ORDER BY t, event_id) - 1)::BIGINT AS scan_index FROM ({SQL_EVENTS})"

QUERIES = {f.__name__: f for f in (
    asof_nearest, asof_tolerance, interp_join, interp_bucketed, interval_upper_median, trimmed_mean, static_calibration, sustained_run, reject_streak,
    sliding_count_frame, keyframe_stride, path_length_bbox, trajectory_thin, linspace_sample, scan_index)}
ORACLE_SQL = {
    "asof_nearest": _sql_nearest("ASC"), "asof_tolerance": SQL_TOLERANCE, "interp_join": SQL_INTERP, "interp_bucketed": SQL_INTERP, "interval_upper_median": SQL_MEDIAN,
    "trimmed_mean": SQL_TRIMMED, "static_calibration": SQL_STATIC, "sustained_run": SQL_RUN, "reject_streak": SQL_STREAK,
    "sliding_count_frame": SQL_FRAME, "keyframe_stride": SQL_STRIDE, "path_length_bbox": SQL_PATH, "trajectory_thin": SQL_THIN,
    "linspace_sample": SQL_LINSPACE, "scan_index": SQL_INDEX,
}
