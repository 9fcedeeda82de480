"""Gates on counts: tasks follow the number of points."""

from pyspark.sql import functions as F

from sweepmill.operators import motion


def test_tasks_hold_a_bounded_number_of_points(spark):
    points = spark.range(2000).select((F.col("id") % 300).alias("scan"), "id")
    accepted = spark.range(0, 300, 3).select(F.col("id").alias("scan"))
    got = motion.enough_points(points, ["scan"], 7, accepted, per_task=50)
    assert got.rdd.getNumPartitions() == 40
    assert {(r["scan"], r["id"]) for r in got.collect()} == {(i % 300, i) for i in range(2000) if i % 300 % 3 == 0 and i % 300 < 200}
