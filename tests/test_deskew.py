"""Deskewing in batches against the expressions of one point."""

import math

from pyspark.sql import functions as F

from sweepmill.functions import rotations as r
from sweepmill.operators import motion
from sweepmill.plans import motions


def test_batches_say_what_the_expressions_say(spark):
    k = F.col("id")
    fields = [(k * (i + 3) % 7 / 4.0 - 0.5).alias(f"{side}{n}") for side in "ab" for i, n in enumerate(r.Pose._fields)]
    points = spark.range(60).select("id", (k % 9 / 6.0 - 0.2).alias("share"), F.when(k != 5, k * 1.5).alias("u"), (k % 4 * 1.0).alias("v"), (k % 3 * -1.0).alias("w"), *fields)
    mounting, moved = (0.1, -0.2, 0.05, 0.0, 0.0, 0.6, 0.8), (0.5, 0.0, -0.25)
    got = motion.deskewed(points, r.pose_of(prefix="a"), r.pose_of(prefix="b"), F.col("share"), [F.col(c) for c in "uvw"], mounting, moved, ["id"])
    start, end, m, v = r.pose_of(prefix="a"), r.pose_of(prefix="b"), r.Pose(*map(F.lit, mounting)), r.point(F.col("u"), F.col("v"), F.col("w"))
    at = points.withColumn("at", r.between(start, end, F.col("share")))
    here = r.pose_of("at")
    ends = motion.to_scan_end(v, here, end, m)
    first = motion.to_scan_start(v, r.multiply(r.conjugate(start.rotation), here.rotation), m, F.col("share"), list(map(F.lit, moved)))
    want = {x["id"]: x for x in at.select("id", ends.alias("e"), first.alias("s")).collect()}
    for x in got.collect():
        for side in "es":
            for n in "xyz":
                a, b = x[side + n], want[x["id"]][side][n]
                assert (a is None) == (b is None) == (x["id"] == 5) and (a is None or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


def test_the_query_interprets_no_lambdas(spark):
    plan = motions.deskewed_points(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
