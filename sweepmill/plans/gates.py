"""Queries of gates on captures and scans: users of `events` and customers of `orders` stand for captures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import imaging, loops, motion, registration, series
from ..session import table
from ..sources import bags
from .places import SQL_PROPOSALS, _proposals
from .timelines import SECOND, SQL_EVENTS, WEEK, events, r6


def frame_rate_gate(spark, sf_dir):
    """The upper median gap of weeks, or of times where fewer than half of a user's events begin a new week."""
    e = events(spark, sf_dir).withColumn("week", F.floor(F.col("t") / WEEK))
    return series.frame_interval(e, ["user_id"], "week", "t", 6 * 3600 * SECOND)


def _sql_median(at: str) -> str:
    return f"""
SELECT user_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS m, count(*) AS n
FROM (SELECT user_id, {at} - lag({at}) OVER (PARTITION BY user_id ORDER BY {at}) AS gap FROM (SELECT *, floor(t / {WEEK}.0::DOUBLE)::BIGINT AS week FROM ({SQL_EVENTS}))) WHERE gap > 0 GROUP BY user_id"""


SQL_FRAME_RATE = f"""
SELECT u.user_id, CASE WHEN coalesce(a.n, 0) * 2 < u.n THEN b.m ELSE a.m END AS median, coalesce((CASE WHEN coalesce(a.n, 0) * 2 < u.n THEN b.m ELSE a.m END) <= {6 * 3600 * SECOND}, FALSE) AS passes
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u LEFT JOIN ({_sql_median("week")}) a ON a.user_id = u.user_id LEFT JOIN ({_sql_median("t")}) b ON b.user_id = u.user_id
"""


def pairing_gate(spark, sf_dir):
    """Whether a customer's orders and their images belong together, by gaps that are functions of the key."""
    gaps = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") * 7919 % 601 - 300).alias("gap"))
    return registration.pairing_holds(gaps, ["o_custkey"], "gap", 150, 290).select("o_custkey", "median", F.col("outliers").cast("long").alias("outliers"), "n", "passes")


SQL_PAIRING = """
SELECT o_custkey, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS median, (count(*) FILTER (WHERE gap > 290))::BIGINT AS outliers, count(*)::BIGINT AS n,
  list_sort(list(gap))[len(list(gap)) // 2 + 1] <= 150 AND count(*) FILTER (WHERE gap > 290) <= greatest(20, floor(count(*) / 20.0)) AS passes
FROM (SELECT o_custkey, abs(o_orderkey * 7919 % 601 - 300) AS gap FROM orders) GROUP BY o_custkey
"""


def failure_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("capture")).agg(F.count_if(F.col("o_orderkey") % 3 == 0).alias("failed"), F.count("*").alias("total"))
    return o.select("capture", "failed", "total", registration.within_budget(F.col("failed"), F.col("total")).alias("passes"))


SQL_BUDGET = """
SELECT capture, failed, total, failed <= greatest(20, floor(total / 4.0)) AS passes FROM (
  SELECT o_custkey % 40 AS capture, (count(*) FILTER (WHERE o_orderkey % 3 = 0))::BIGINT AS failed, count(*)::BIGINT AS total FROM orders GROUP BY 1)
"""


def usable_images(spark, sf_dir):
    k = F.col("o_orderkey")
    ok = imaging.usable_image((k % 7 - 3) * 120_000_000, k % 5 != 0, F.when(k % 11 != 0, k % 30 + 0.5))
    return table(spark, sf_dir, "orders").select("o_orderkey", ok.alias("usable"))


SQL_USABLE = """
SELECT o_orderkey, coalesce(abs((o_orderkey % 7 - 3) * 120000000) <= 300000000 AND o_orderkey % 5 <> 0 AND CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 30 + 0.5 END >= 12.0, FALSE) AS usable FROM orders
"""


def full_scans(spark, sf_dir):
    """Lineitems of accepted orders that have at least five of them: a semi join and a gate on counts."""
    accepted = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return motion.enough_points(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], 5, accepted)


SQL_FULL = """
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 0) WHERE n >= 5
"""


def best_loop(spark, sf_dir):
    p = _proposals(spark, sf_dir).withColumn("source", F.col("source") * 1_000_000 + F.col("id"))
    return loops.best_per_target(p, ["user_id", "target"]).select("user_id", "target", "source", "fitness", "rmse")


SQL_BEST = f"""
SELECT user_id, target, source, fitness, rmse FROM (
  SELECT user_id, target, source * 1000000 + id AS source, fitness, rmse, row_number() OVER (PARTITION BY user_id, target ORDER BY fitness DESC, rmse, source * 1000000 + id) AS n FROM ({SQL_PROPOSALS})) WHERE n = 1
"""


def sweep_durations(spark, sf_dir):
    """Orders as sweeps, in order of their keys, whose points are their lineitems."""
    o = table(spark, sf_dir, "orders").select(F.lit("bag").alias("file"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 40_000_000).alias("timebase"))
    index = series.numbered(o.withColumn("part", F.floor(F.col("id") / 500)), "part", ["timebase", "id"], "scan_index").drop("part")
    points = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select(F.lit("bag").alias("file"), F.col("l_orderkey").alias("id"), (F.col("l_quantity") * 7_000_000).cast("long").alias("offset_ns"))
    return bags.sweep_duration(points, index).select("id", "scan_index", "duration_ns")


SQL_DURATION = """
WITH o AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS scan_index, (lead(o_orderkey) OVER (ORDER BY o_orderkey) - o_orderkey) * 40000000 AS gap FROM orders),
p AS (SELECT l_orderkey AS id, max((l_quantity * 7000000)::BIGINT) AS last FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT o.id, o.scan_index, (CASE WHEN last BETWEEN 1000000 AND 250000000 THEN last WHEN gap BETWEEN 10000000 AND 250000000 THEN gap ELSE 100000000 END)::BIGINT AS duration_ns FROM o LEFT JOIN p ON o.id = p.id
"""


def _imu(spark, sf_dir):
    """Events as samples of a sensor that mostly stands still: one for each user and second."""
    e = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / SECOND).alias("t")).agg(F.max("event_id").alias("k"))
    k = F.col("k")
    g = {f"g{a}": (k % m - m // 2) / 400.0 for a, m in zip("xyz", (7, 9, 11), strict=True)}
    a = {f"a{a}": (k % m - m // 2) / 50.0 + (9.8 if a == "z" else 0.0) for a, m in zip("xyz", (5, 13, 3), strict=True)}
    return e.select("user_id", "t", *[c.alias(n) for n, c in (g | a).items()])


_SQL_IMU = f"""
SELECT user_id, t, {", ".join(f"(k % {m} - {m // 2}) / 400.0::DOUBLE AS g{a}" for a, m in zip("xyz", (7, 9, 11), strict=True))},
  {", ".join(f"(k % {m} - {m // 2}) / 50.0::DOUBLE + {9.8 if a == 'z' else 0.0}::DOUBLE AS a{a}" for a, m in zip("xyz", (5, 13, 3), strict=True))}
FROM (SELECT user_id, floor(t / {SECOND}.0::DOUBLE)::BIGINT AS t, max(event_id) AS k FROM ({SQL_EVENTS}) GROUP BY 1, 2)
"""
DAY = 86400


def still_sensor(spark, sf_dir):
    """Biases, gravity and the gates of each user's first ten days, a day being a second."""
    out = series.static_imu(_imu(spark, sf_dir), ["user_id"], "t", DAY, least=10)
    return out.select("user_id", "n", *[r6(F.col(c), c.replace("b", "bias_") if c[0] == "b" else c) for c in ("bx", "by", "bz", "mx", "my", "mz", "gyro_std", "accel_norm", "accel_std")], "valid")


def _sql_trimmed(axis: str, name: str) -> str:
    return f"""(SELECT user_id, avg({axis}) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {axis}) AS r, count(*) OVER (PARTITION BY user_id) AS m FROM w)
  WHERE r > CASE WHEN m >= 20 THEN m // 10 ELSE 0 END AND r <= m - CASE WHEN m >= 20 THEN m // 10 ELSE 0 END GROUP BY user_id) t_{name}"""


_AXES = tuple(zip(("gx", "gy", "gz", "ax", "ay", "az"), ("bias_x", "bias_y", "bias_z", "mx", "my", "mz"), strict=True))
SQL_STILL = f"""
WITH s AS ({_SQL_IMU}), w AS (SELECT * FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0 FROM s) WHERE t <= t0 + {10 * DAY}),
b AS (SELECT t_bias_x.user_id, {", ".join(n for _, n in _AXES)} FROM {_sql_trimmed(*_AXES[0])} {" ".join(f"JOIN {_sql_trimmed(*x)} ON t_{x[1]}.user_id = t_bias_x.user_id" for x in _AXES[1:])}),
c AS (SELECT *, CASE WHEN sqrt(mx * mx + my * my + mz * mz) < 3.0 THEN 9.80665::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM b),
d AS (SELECT w.user_id, count(*)::BIGINT AS n, (max(t) - min(t)) / {DAY}.0::DOUBLE AS seconds, sqrt(avg((gx - bias_x) ** 2 + (gy - bias_y) ** 2 + (gz - bias_z) ** 2)) AS gyro_std,
             avg(scale * sqrt(ax * ax + ay * ay + az * az)) AS accel_norm, stddev_pop(scale * sqrt(ax * ax + ay * ay + az * az)) AS accel_std FROM w JOIN c ON c.user_id = w.user_id GROUP BY w.user_id)
SELECT d.user_id, n, {", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in ("bias_x", "bias_y", "bias_z"))}, {", ".join(f"round({n} * scale, 6) + 0.0 AS {n}" for n in ("mx", "my", "mz"))},
  round(gyro_std, 6) AS gyro_std, round(accel_norm, 6) AS accel_norm, round(accel_std, 6) AS accel_std,
  seconds >= 8.0 AND n >= 10 AND sqrt(bias_x * bias_x + bias_y * bias_y + bias_z * bias_z) < 0.25 AND gyro_std < 0.08 AND accel_norm > 8.0 AND accel_norm < 11.5 AND accel_std < 0.50 AS valid
FROM d JOIN c ON c.user_id = d.user_id
"""


def rest_windows(spark, sf_dir):
    """Means over the two days that begin at each user's every 20th sample."""
    s = _imu(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("t")
    starts = s.select("user_id", F.col("t").alias("start"), F.row_number().over(w).alias("i")).where("i % 20 = 1").drop("i")
    out = series.stationary_mean(s, starts, ["user_id"], "t", 2 * DAY, least=5)
    return out.select("user_id", "start", "n", *[(F.round(c, 9) + 0.0).alias(c) for c in ("gx", "gy", "gz", "ax", "ay", "az")], "valid")


SQL_REST = f"""
WITH s AS ({_SQL_IMU}), w AS (SELECT user_id, t AS start FROM (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM s) WHERE i % 20 = 1),
m AS (SELECT w.user_id, w.start, count(*)::BIGINT AS n, {", ".join(f"avg({c}) AS {c}" for c, _ in _AXES)} FROM w JOIN s ON s.user_id = w.user_id AND s.t BETWEEN w.start AND w.start + {2 * DAY} GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT w.user_id, w.start, n, {", ".join(f"round({c}, 9) + 0.0 AS {c}" for c, _ in _AXES)},
  coalesce(sqrt(gx * gx + gy * gy + gz * gz) < 0.25 AND (sqrt(ax * ax + ay * ay + az * az) BETWEEN 0.5 AND 1.5 OR sqrt(ax * ax + ay * ay + az * az) BETWEEN 8.0 AND 12.0), FALSE) AS valid
FROM w LEFT JOIN m ON m.user_id = w.user_id AND m.start = w.start
"""

QUERIES = {f.__name__: f for f in (
    frame_rate_gate, pairing_gate, failure_budget, usable_images, full_scans, best_loop, sweep_durations, still_sensor, rest_windows)}
ORACLE_SQL = {
    "frame_rate_gate": SQL_FRAME_RATE, "pairing_gate": SQL_PAIRING, "failure_budget": SQL_BUDGET, "usable_images": SQL_USABLE, "full_scans": SQL_FULL,
    "best_loop": SQL_BEST, "sweep_durations": SQL_DURATION, "still_sensor": SQL_STILL, "rest_windows": SQL_REST,
}
