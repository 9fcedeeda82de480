"""Recorded captures: messages of SQLite bags, their LiDAR and IMU payloads, and binary IMU sidecars.

Bags are read by the data source of bag_source, or, from stores that only Spark reads, with the binaryFile source, where a
file is one row (recorders split bags well below that source's limit of 2 GB). Payloads are decoded with numpy, a message at a
time; broken ones are left out."""

from __future__ import annotations

import sqlite3
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from ..session import exists
from . import bag_source

MOST_POINTS = 200_000
# The layout of a LiDAR point and of a sidecar record, little endian.
POINT = np.dtype([("offset_ns", "<u4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("reflectivity", "u1"), ("tag", "u1"), ("line", "u1"), ("pad", "u1")])
SIDECAR = np.dtype([("receive_ns", "<i8"), ("header_ns", "<i8"), ("raw_ns", "<i8"), *[(c, "<f8") for c in ("qx", "qy", "qz", "qw", "gx", "gy", "gz", "ax", "ay", "az")]])


def natural_order(name):
    """Order of files that end in a number: by the number, then those without one, ties by name."""
    stem = F.regexp_extract(name, r"(\d+)\.[^./]*$", 1)
    return F.struct((stem == "").alias("none"), F.when(stem != "", stem.cast("decimal(38,0)")).alias("number"), name.alias("name"))


def _open(content: bytes) -> sqlite3.Connection:
    base = sqlite3.connect(":memory:")
    base.deserialize(content)
    return base


def _files(spark: SparkSession, path: str, glob: str = "*.db3") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def topics(spark: SparkSession, path: str) -> DataFrame:
    """file, topic_id, name, type of every bag below path."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with _open(content) as base:
                    rows += [(file, *r) for r in base.execute("SELECT id, name, type FROM topics ORDER BY id")]
            yield pd.DataFrame(rows, columns=["file", "topic_id", "name", "type"])

    return _files(spark, path).select("path", "content").mapInPandas(run, "file string, topic_id int, name string, type string")


def messages(spark: SparkSession, path: str, kind: str, preferred: str | None = None, split_bytes: int = bag_source.SPLIT_BYTES) -> DataFrame:
    """file, id, stamp, data of the messages of one topic in each bag: that of the preferred name, else the last whose
    type contains `kind`. Where the operating system shows the bags, several tasks read a file where it lies and filters
    reach it; bags in other stores are read file by file."""
    if bag_source.local_path(path) is not None:
        return bag_source.load(spark, path, kind, preferred, split_bytes).drop("topic")
    return whole_files(spark, path, kind, preferred)


def whole_files(spark: SparkSession, path: str, kind: str, preferred: str | None = None) -> DataFrame:
    """The same from any store that Spark reads: a file is one task's work, and in memory whole."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with _open(content) as base:
                    known = [(i, n) for i, n, t in base.execute("SELECT id, name, type FROM topics ORDER BY id") if kind in t]
                    wanted = [i for i, n in known if n == preferred] or [i for i, _ in known]
                    if not wanted:
                        continue
                    cursor = base.execute("SELECT id, timestamp, data FROM messages WHERE topic_id = ? ORDER BY timestamp, id", (wanted[-1],))
                    while rows := cursor.fetchmany(64):
                        out = pd.DataFrame(rows, columns=["id", "stamp", "data"])
                        out.insert(0, "file", file)
                        yield out

    return _files(spark, path).select("path", "content").mapInPandas(run, "file string, id long, stamp long, data binary")


def _payload(data: bytes) -> tuple[int, int]:
    """Stamp of the common header in ns, and where the payload begins: encapsulation, time, frame name, padding to 4."""
    seconds, nanos, length = struct.unpack_from("<iII", data, 4)
    end = 16 + length
    if length > len(data):
        raise ValueError("frame name")
    return seconds * 1_000_000_000 + nanos, (end + 3) // 4 * 4


def sweep_header(data: bytes) -> tuple[int, int, int]:
    """timebase, number of points, where they begin."""
    _, at = _payload(data)
    timebase, count = struct.unpack_from("<QI", data, at)
    at = (at + 16 + 3) // 4 * 4
    (listed,) = struct.unpack_from("<I", data, at)
    if listed != count or count > MOST_POINTS or at + 4 + count * POINT.itemsize > len(data) + 1 or timebase >= 2**63:
        raise ValueError("sweep")
    return timebase, count, at + 4


def sweep_points(data: bytes) -> np.ndarray:
    """The points of a sweep; the last byte of padding may be missing."""
    _, count, at = sweep_header(data)
    return np.frombuffer(data + b"\0", dtype=POINT, count=count, offset=at)


def imu_sample(data: bytes) -> tuple | None:
    """Stamp (0 where the header has none), quaternion, rates and accelerations; None unless all are finite."""
    stamp, at = _payload(data)
    values = np.frombuffer(data, dtype="<f8", count=28, offset=at)
    picked = np.concatenate([values[:4], values[13:16], values[25:28]])
    return (max(0, stamp), *map(float, picked)) if np.isfinite(picked).all() else None


def _decoded(of, columns: str, names: list[str]):
    def run(batches):
        for pdf in batches:
            rows = []
            for file, key, stamp, data in zip(pdf["file"], pdf["id"], pdf["stamp"], pdf["data"], strict=True):
                try:
                    got = of(bytes(data))
                except (struct.error, ValueError):
                    continue
                if got is not None:
                    rows.append((file, key, stamp, *got))
            yield pd.DataFrame(rows, columns=["file", "id", "stamp", *names])

    return run, f"file string, id long, stamp long, {columns}"


def sweep_index(raw: DataFrame) -> DataFrame:
    """file, id, stamp, timebase, n_points, scan_index of the sweeps of a capture that decode, in one order of time."""
    run, schema = _decoded(lambda d: sweep_header(d)[:2], "timebase long, n_points int", ["timebase", "n_points"])
    # Numbered minute by minute: counts of each minute shift the numbers inside it.
    headers = raw.mapInPandas(run, schema).withColumn("_minute", F.floor(F.col("timebase") / 60_000_000_000))
    return series.numbered(headers, "_minute", ["timebase", "stamp", natural_order(F.col("file")), "id"], "scan_index").drop("_minute")


def sweeps(raw: DataFrame) -> DataFrame:
    """file, id, stamp, timebase, offset_ns, x, y, z, reflectivity, tag, line: one row a point."""
    fields = [n for n in POINT.names if n != "pad"]

    def run(batches):
        for pdf in batches:
            for file, key, stamp, data in zip(pdf["file"], pdf["id"], pdf["stamp"], pdf["data"], strict=True):
                try:
                    timebase, points = sweep_header(bytes(data))[0], sweep_points(bytes(data))
                except (struct.error, ValueError):
                    continue
                out = pd.DataFrame({n: points[n].astype(np.int64 if points[n].dtype.kind == "u" else np.float32) for n in fields})
                yield out.assign(file=file, id=key, stamp=stamp, timebase=timebase)

    return raw.mapInPandas(run, "file string, id long, stamp long, timebase long, offset_ns long, x float, y float, z float, reflectivity int, tag int, line int")


def imu(raw: DataFrame) -> DataFrame:
    """stamp (of the header, else of the bag), qx .. az of the samples that decode."""
    names = ["header_ns", "qx", "qy", "qz", "qw", "gx", "gy", "gz", "ax", "ay", "az"]
    run, schema = _decoded(imu_sample, "header_ns long, " + ", ".join(f"{n} double" for n in names[1:]), names)
    out = raw.mapInPandas(run, schema)
    return out.withColumn("stamp", F.when(F.col("header_ns") > 0, F.col("header_ns")).otherwise(F.col("stamp"))).drop("file", "id", "header_ns")


def imu_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """receive_ns, header_ns, raw_ns, qx .. az of the finite records of imu.bin files."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = np.frombuffer(content, dtype=SIDECAR, count=len(content) // SIDECAR.itemsize)
                out = pd.DataFrame({n: rows[n] for n in SIDECAR.names})
                yield out[np.isfinite(out.iloc[:, 3:]).all(axis=1)]

    names = SIDECAR.names
    return _files(spark, path, "imu.bin").select("content").mapInPandas(run, ", ".join(f"{n} {'long' if i < 3 else 'double'}" for i, n in enumerate(names)))


def imu_samples(spark: SparkSession, capture: str, bags: str, scans: int = 0, preferred: str | None = None, least: int = 10) -> DataFrame:
    """stamp, qx .. az of a capture: of its sidecar if it has one with its manifest and enough samples (`least`, and five
    for each of `scans` sweeps), else of its bags. Raises with fewer than `least` samples."""
    values = [n for n in SIDECAR.names if not n.endswith("_ns")]
    if exists(spark, f"{capture}/windows_lio_manifest.json") and exists(spark, f"{capture}/imu.bin"):
        side = imu_sidecar(spark, f"{capture}/imu.bin")
        side = side.select(F.when(F.col("header_ns") > 0, F.col("header_ns")).otherwise(F.col("receive_ns")).alias("stamp"), *values)
        if side.count() >= max(least, 5 * scans):
            return side
    out = imu(messages(spark, bags, "sensor_msgs/msg/Imu", preferred)).select("stamp", *values)
    if out.count() < least:
        raise ValueError(f"fewer than {least} IMU samples: {capture}")
    return out


def sweep_duration(points: DataFrame, index: DataFrame) -> DataFrame:
    """index with duration_ns: the sweep's last offset if 1 to 250 ms, else the gap to the next if 10 to 250 ms, else 100 ms."""
    last = points.groupBy("file", "id").agg(F.max("offset_ns").alias("_last"))
    after = index.select((F.col("scan_index") - 1).alias("scan_index"), F.col("timebase").alias("_after"))
    ms = 1_000_000
    whole = F.when(F.col("_last").between(ms, 250 * ms), F.col("_last")).when(F.col("_gap").between(10 * ms, 250 * ms), F.col("_gap")).otherwise(100 * ms)
    timed = index.join(after, "scan_index", "left").withColumn("_gap", F.col("_after") - F.col("timebase")).drop("_after")
    return timed.join(last, ["file", "id"], "left").withColumn("duration_ns", whole.cast("long")).drop("_gap", "_last")
