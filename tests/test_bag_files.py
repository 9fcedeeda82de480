"""Bags of many messages: files grow in number, and payloads are made where they are written."""

import pyarrow as pa
from pyspark.sql import functions as F

from sweepmill.sources import bag_source


def test_files_follow_the_messages(spark, tmp_path):
    def encoded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["stamp"], pa.array(["/a"] * b.num_rows), pa.array([str(v).encode() for v in b["value"].to_pylist()])], names=["stamp", "topic", "data"])

    rows = spark.range(1000).select((F.col("id") * 10).alias("stamp"), (F.col("id") * 3).alias("value"))
    bag_source.write(rows, f"{tmp_path}/bag", {"/a": "x/A"}, files=2, encode=encoded, per_file=100)
    assert len(list((tmp_path / "bag").glob("*.db3"))) == 10
    back = bag_source.load(spark, f"{tmp_path}/bag").orderBy("stamp").collect()
    assert [(r["stamp"], bytes(r["data"])) for r in back] == [(10 * i, str(3 * i).encode()) for i in range(1000)]
    assert max(r["n"] for r in bag_source.load(spark, f"{tmp_path}/bag").groupBy("file").agg(F.count("*").alias("n")).collect()) <= 150
