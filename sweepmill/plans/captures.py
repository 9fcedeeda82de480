"""Queries over recorded captures, made of `events`: bags that Spark writes, and what the bag source reads of them."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import scratch_root, table
from ..sources import bag_source, bags

DAY_NS = 86_400_000_000_000
KINDS = {"/imu": "sensor_msgs/msg/Imu", "/lidar": "livox/msg/CustomMsg"}
# An IMU message, little endian: encapsulation, time, name of the frame, then quaternion, rates and
# accelerations with their covariances.
IMU = np.dtype([("encapsulation", "S4"), ("seconds", "<i4"), ("nanos", "<u4"), ("length", "<u4"), ("frame", "S4"), ("values", "<f8", 37)])


def encoded(batches):
    """mapInArrow: stamp, topic, gx, gy, az -> stamp, topic, data."""
    for b in batches:
        stamp = b["stamp"].to_numpy()
        out = np.zeros(len(stamp), dtype=IMU)
        out["encapsulation"], out["seconds"], out["nanos"] = b"\0\1", stamp // 1_000_000_000, stamp % 1_000_000_000
        out["length"], out["frame"], out["values"][:, 3] = 4, b"imu", 1.0
        for place, c in ((13, "gx"), (14, "gy"), (27, "az")):
            out["values"][:, place] = b[c].to_numpy()
        data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(IMU.itemsize), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b["stamp"], b["topic"], data], names=["stamp", "topic", "data"])


def bag_imu(spark, sf_dir):
    """Events as IMU messages in four bags or more, among those of another topic; ten days of one topic are read back and decoded."""
    e = table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("stamp"), "event_id", "value")
    rows = e.select("stamp", F.when(F.col("event_id") % 3 == 0, "/lidar").otherwise("/imu").alias("topic"), F.col("value").alias("gx"), (F.col("event_id") % 97).cast("double").alias("gy"), F.lit(9.8).alias("az"))
    folder = f"{scratch_root(spark)}/sweepmill-{uuid.uuid4().hex}/bags"
    bag_source.write(rows, folder, KINDS, encode=encoded)
    begin = e.agg(F.min("stamp")).first()[0] or 0
    raw = bags.messages(spark, folder, "/Imu", split_bytes=1 << 20)
    out = bags.imu(raw.where((F.col("stamp") >= begin + 10 * DAY_NS) & (F.col("stamp") < begin + 20 * DAY_NS)))
    return out.select("stamp", "qw", "gx", "gy", "az")


SQL_BAG_IMU = f"""
SELECT epoch_us(ts)::BIGINT * 1000 AS stamp, 1.0::DOUBLE AS qw, value AS gx, (event_id % 97)::DOUBLE AS gy, 9.8::DOUBLE AS az
FROM events, (SELECT min(epoch_us(ts))::BIGINT * 1000 AS begin FROM events) WHERE event_id % 3 <> 0
  AND epoch_us(ts)::BIGINT * 1000 >= begin + {10 * DAY_NS} AND epoch_us(ts)::BIGINT * 1000 < begin + {20 * DAY_NS}
"""

QUERIES = {"bag_imu": bag_imu}
ORACLE_SQL = {"bag_imu": SQL_BAG_IMU}
