"""Means on the edge of a rounding: added up from the smallest, and rounded as SQL does."""

import random

import duckdb

from compare import DATA, assert_same
from pyspark.sql import functions as F
from sweepmill.operators import series
from sweepmill.plans import gates, timelines


def test_small_keys_are_added_up_from_the_smallest(spark):
    rng = random.Random(3)
    values = {k: [(rng.randrange(7) - 3) / 400.0 for _ in range(rng.choice((16, 20, 28, 30)))] for k in range(200)}
    rows = [(k, v) for k, vs in values.items() for v in vs]
    rng.shuffle(rows)
    got = {r["k"]: r["mean"] for r in series.trimmed_mean(spark.createDataFrame(rows, "k long, v double"), ["k"], "v").collect()}
    for k, vs in values.items():
        cut = len(vs) // 10 if len(vs) >= 20 else 0
        kept, total = sorted(vs)[cut : len(vs) - cut], 0.0
        for v in kept:
            total += v
        assert got[k] == total / len(kept), k


def test_rounds_as_sql(spark):
    values = [float("nan"), 1e300, -1e-9, 0.0, *[i / 3.2e6 for i in range(-40, 40)], *[i * 3.125e-4 + j * 5.4e-20 for i in range(-9, 9) for j in range(-3, 4)]]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(timelines.r6(F.col("v"), "v")).collect()]
    with duckdb.connect() as con:
        want = [con.execute("SELECT round(?::DOUBLE, 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert [str(x) for x in got] == [str(x) for x in want]


def test_still_sensor_on_more_users(spark):
    assert_same(gates.still_sensor(spark, f"{DATA}/sf0.01"), gates.SQL_STILL, f"{DATA}/sf0.01")
