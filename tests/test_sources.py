"""Decoders and products against generated files."""

import json
import math
import re
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import DATA, assert_same
from sweepmill.plans import live as live_queries
from sweepmill.sources import bag_source, bags, files
from sweepmill.streaming import live


def header(seconds, nanos, frame=b"livox\0"):
    raw = b"\0\1\0\0" + struct.pack("<iII", seconds, nanos, len(frame)) + frame
    return raw + b"\0" * (-len(raw) % 4)


def sweep(timebase, points, short=False, listed=None):
    raw = header(5, 6) + struct.pack("<QIB3x", timebase, len(points), 0)
    raw += struct.pack("<I", len(points) if listed is None else listed)
    rows = np.zeros(len(points), dtype=bags.POINT)
    for i, p in enumerate(points):
        rows[i] = (*p, 0)
    raw += rows.tobytes()
    return raw[:-1] if short else raw


def imu(stamp, gyro, accel, bad=False):
    values = [0, 0, 0, 1, *[0] * 9, *gyro, *[0] * 9, *accel, *[0] * 9]
    if bad:
        values[14] = math.nan
    return header(stamp, 0) + struct.pack("<37d", *map(float, values))


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    root = tmp_path_factory.mktemp("capture")
    bag = root / "raw_lidar_imu_rosbag2"
    bag.mkdir()
    for n in (10, 2):
        base = sqlite3.connect(bag / f"part_{n}.db3")
        base.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
        base.execute("CREATE TABLE messages (id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        base.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/livox/imu", "sensor_msgs/msg/Imu"), (2, "/livox/lidar", "livox/msg/CustomMsg"), (3, "/other", "x/CustomMsg")])
        rows = [(1, 2, 100 + n, sweep(1000 + n, [(0, 1.0, 2.0, 3.0, 9, 1, 2), (50_000_000, 4.0, 5.0, 6.0, 8, 0, 1)], short=n == 2))]
        rows += [(2, 2, 101, b"broken"), (3, 2, 102, sweep(7, [(0, 1.0, 1.0, 1.0, 0, 0, 0)], listed=4)), (4, 3, 103, sweep(1, []))]
        rows += [(5, 1, 200 + n, imu(n, (0.1, 0.2, 0.3), (0, 0, 9.8))), (6, 1, 300, imu(0, (1, 1, 1), (0, 0, 1))), (7, 1, 301, imu(9, (0, 0, 0), (0, 0, 0), bad=True))]
        base.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", rows)
        base.commit()
        base.close()
    (root / "LONG_CAPTURE_COMPLETE.json").write_text('{"format": "windows_lio_raw_v3"}')
    (root / "a.jpg").write_bytes(b"x" * 20)
    (root / "b.jpg").write_bytes(b"x" * 16)
    (root / "rgb_frames.csv").write_text("receive_stamp_ns,image_stamp_ns,image_file,extra\n5,6,a.jpg,1\n7,8,b.jpg,1\nx,9,a.jpg,1\n9,9,none.jpg,1\n")
    side = root / "side"
    side.mkdir()
    rows = np.zeros(3, dtype=bags.SIDECAR)
    rows["gx"] = (1.0, math.nan, 3.0)
    (side / "imu.bin").write_bytes(rows.tobytes() + b"tail")
    return str(root)


def test_bag(spark, capture):
    bag = f"{capture}/raw_lidar_imu_rosbag2"
    assert bags.topics(spark, bag).count() == 6
    ordered = bags.topics(spark, bag).select("file").distinct().orderBy(bags.natural_order(F.element_at(F.split("file", "/"), -1))).collect()
    assert [r["file"].rpartition("/")[2] for r in ordered] == ["part_2.db3", "part_10.db3"]
    raw = bags.messages(spark, bag, "/CustomMsg", "/livox/lidar")
    index = bags.sweep_index(raw)
    assert [(r["scan_index"], r["timebase"], r["n_points"]) for r in index.orderBy("scan_index").collect()] == [(0, 1002, 2), (1, 1010, 2)]
    points = bags.sweeps(raw).orderBy("timebase", "offset_ns").collect()
    assert [(r["timebase"], r["offset_ns"], r["x"], r["z"], r["reflectivity"], r["line"]) for r in points] == [(t, o, x, z, f, i) for t in (1002, 1010) for o, x, z, f, i in ((0, 1.0, 3.0, 9, 2), (50_000_000, 4.0, 6.0, 8, 1))]
    assert {r["duration_ns"] for r in bags.sweep_duration(bags.sweeps(raw), index).collect()} == {50_000_000}
    samples = bags.imu(bags.messages(spark, bag, "/Imu", "/livox/imu")).collect()
    assert sorted((r["stamp"], r["gx"]) for r in samples) == [(300, 1.0), (300, 1.0), (2_000_000_000, 0.1), (10_000_000_000, 0.1)]
    assert bags.messages(spark, bag, "/CustomMsg").count() == 2 and bags.messages(spark, bag, "/None").count() == 0


def test_sidecar_and_images(spark, capture):
    assert [r["gx"] for r in bags.imu_sidecar(spark, f"{capture}/side").orderBy("gx").collect()] == [1.0, 3.0]
    assert [tuple(r) for r in files.image_list(spark, capture).collect()] == [(5, 6, "a.jpg")]
    files.check_capture(spark, capture)


def test_calibration():
    text = "lidar:\n  extrinsic_R: [1,0,0, 0,1,0, 0,0,1]\n  extrinsic_T: [0.1, 0, 0]\n  Rcl: [1,0,0,0,1,0,0,0,1]\n  Pcl: [0,0,0]\nvoxel_size: 9\nmin_eigen_value: -1\nimu_time_offset: 0.5\nvalid: True\n"
    got = files.calibration(text, "fx: 400\nfy: 410\ncx: 1\ncy: 2\nd0: -0.1\nk3: 0.02\n")
    assert got["voxel_size"] == 0.5 and got["min_eigen_value"] == 0.0025 and got["imu_time_offset"] == 0.5 and got["d4"] == 0.02 and got["extrinsic_T"] == [0.1, 0, 0]
    assert files.yaml_flag(text, "valid") and not files.yaml_flag(text, "invalid")
    with pytest.raises(ValueError):
        files.calibration("voxel_size: 1")


def test_clouds(spark, tmp_path):
    rows = [(float(i), -1.0, 0.5, i * 2.0, 300.0, -4.0) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double, z double, red double, green double, blue double")
    files.write_text(spark, f"{tmp_path}/small.ply", files.small_ply(df))
    got = files.read_ply(spark, f"{tmp_path}/small.ply").orderBy("x").collect()
    assert len(got) == 100 and (got[9]["x"], got[9]["red"], got[9]["green"], got[9]["blue"]) == (9.0, 18, 255, 0)
    with pytest.raises(ValueError):
        files.small_ply(df, 99)
    tiled = df.withColumn("tx", F.floor(F.col("x") / 10)).withColumn("ty", F.lit(0)).withColumn("tz", F.lit(0))
    assert files.write_cloud(tiled, f"{tmp_path}/cloud") == 100
    parts = sorted((tmp_path / "cloud").glob("*/part-*"))
    lines = "".join(p.read_text() for p in parts).split("\n")
    end = lines.index("end_header")
    assert lines[:3] == ["ply", "format ascii 1.0", "element vertex 100"] and len([x for x in lines[end + 1 :] if x]) == 100
    tiles = [float(x.split()[0]) // 10 for x in lines[end + 1 :] if x]
    assert tiles == sorted(tiles)


def test_preview_spans_the_whole_trajectory(spark, tmp_path):
    cloud = spark.range(3).selectExpr("double(id) AS x", "0D AS y", "0D AS z", "7 AS red", "7 AS green", "7 AS blue")
    steps = spark.range(36_000).selectExpr("id AS scan_index", "id * 100 AS stamp_ns", "double(id) AS x", "0D AS y", "0D AS z", "0.9D AS fitness", "0.1D AS rmse", "1 AS accepted")
    live.publish_preview(spark, f"{tmp_path}/view", 0, cloud, steps, "registration", 0, 1)
    lines = files.read_text(spark, f"{tmp_path}/view/trajectory_0.csv").split()[1:]
    assert [int(x.split(",")[0]) for x in lines] == [*range(0, 36_000, 6), 35_999]


def test_trajectory_and_reports(spark, tmp_path):
    rows = [(i, i * 100, i * 0.5, 1.0, 0.0, 0.9, 0.05, 10, 9, int(i % 3 > 0), "a, \"b\"" if i == 0 else "accepted") for i in range(30)]
    df = spark.createDataFrame(rows, files.TRAJECTORY)
    files.write_trajectory(df, f"{tmp_path}/t")
    assert files.read_trajectory(spark, f"{tmp_path}/t").count() == 20
    assert files.read_trajectory(spark, f"{tmp_path}/t", accepted=False).where("index = 0").first()["reason"] == 'a, "b"'
    assert files.trajectory_svg(df).count("polyline") == 1 and files.quality_svg(df).count("<circle") == 30
    assert files.grid_step(100) == 20.0 and "no accepted" in files.trajectory_svg(df.limit(0))
    assert '"n": 30' in files.stats_json(df.agg(F.count("*").alias("n")))
    cloud = df.select("x", "y", "z", *[F.lit(7).alias(c) for c in ("red", "green", "blue")])
    steps = df.select(F.col("index").alias("scan_index"), F.col("lidar_stamp_ns").alias("stamp_ns"), "x", "y", "z", F.col("icp_fitness").alias("fitness"), F.col("icp_rmse").alias("rmse"), "accepted")
    for batch in range(4):
        live.publish_preview(spark, f"{tmp_path}/view", batch, cloud, steps, "registration", batch, 4)
    state = live.read_snapshot(spark, f"{tmp_path}/view")
    assert state["snapshot"] == 3 and state["cloud_file"] == "preview_0.ply" and state["points"] == 30
    assert files.read_ply(spark, f"{tmp_path}/view/{state['cloud_file']}").count() == 30


def test_chunks_swaps_and_initialization(spark, tmp_path):
    rows = np.zeros(3, dtype=files.CHUNK_POINT)
    rows["x"], rows["w"] = [1, 2, 3], [4, 5, 6]
    head = np.array([(b"VXF1", 1, 3)], dtype=files.CHUNK_HEAD)
    (tmp_path / "a.vxf").write_bytes(head.tobytes() + rows.tobytes())
    assert [(r["x"], r["w"]) for r in files.read_chunks(spark, f"{tmp_path}/a.vxf").orderBy("x").collect()] == [(1.0, 4), (2.0, 5), (3.0, 6)]
    (tmp_path / "b.vxf").write_bytes(b"VXF0" + head.tobytes()[4:])
    with pytest.raises(Exception, match="not a fused chunk"):
        files.read_chunks(spark, f"{tmp_path}/b.vxf").collect()
    cloud = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    for n in (1, 2):
        assert files.write_cloud(cloud.limit(n), f"{tmp_path}/cloud") == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.vxf", "b.vxf", "cloud"]
    for text in ("one", "two"):
        files.write_text(spark, f"{tmp_path}/t.json", text)
    assert (tmp_path / "t.json").read_text() == "two" and not (tmp_path / "t.json.tmp").exists()
    good = "valid: true\ngyro_bias_rad_s: [0.1, 0.2, 0.3]\naccel_mean_m_s2: [0, 0, 9.8]\ngravity_body_m_s2: [0, 0, -9.8]\nsample_count: 2000\n"
    assert files.imu_initialization(good)["gyro_bias_rad_s"] == [0.1, 0.2, 0.3] and files.imu_initialization(good)["accel_scale_to_m_s2"] == 1.0
    assert files.imu_initialization(good.replace("true", "false")) is None and files.imu_initialization("valid: true") is None
    assert live.publish_pose(spark, str(tmp_path), {"scan_index": 1, "stamp_ns": 2, "x": 0.0, "y": 0.0, "z": 0.0, "accepted": 1}, "live")
    assert live.publish_error(spark, str(tmp_path), 'a "quoted"\nline') and json.loads((tmp_path / "preview_error.json").read_text())["message"] == 'a "quoted"\nline'
    assert json.loads((tmp_path / "preview_pose.json").read_text())["accepted"] is True


def test_drawing_keeps_sparse_indices_and_the_end(spark):
    rows = spark.range(20_000).selectExpr("id * 4 AS index", "CAST(id AS DOUBLE) AS x", "0.0D AS y", "1 AS accepted")
    svg = files.trajectory_svg(rows, most=6000)
    drawn = re.search(r'points="([^"]*)"', svg)[1].split()
    steps = np.diff([float(p.split(",")[0]) for p in drawn])
    assert 4500 <= len(drawn) <= 6001 and drawn[-1].split(",")[0] == "960.0" and steps.max() < 0.4


def test_live_fold_of_a_folder_of_parts(spark, tmp_path):
    whole = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert_same(live_queries.live_fold(spark, str(tmp_path)), live_queries.SQL_LIVE, str(tmp_path))
    whole.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert live_queries.live_fold(spark, f"{tmp_path}/none").count() == 0


def test_bag_source_splits_and_filters(spark, capture, tmp_path):
    bag = f"{capture}/raw_lidar_imu_rosbag2"
    same = lambda df: sorted((r["file"], r["id"], r["stamp"], bytes(r["data"])) for r in df.collect())
    for kind, preferred in (("/CustomMsg", "/livox/lidar"), ("/CustomMsg", None), ("/Imu", "/none"), ("/None", None)):
        for split in (1 << 10, 1 << 30):
            assert same(bags.messages(spark, bag, kind, preferred, split)) == same(bags.whole_files(spark, bag, kind, preferred))
    # Two files of many messages.
    rows = spark.range(4000).selectExpr("id * 10 AS stamp", "if(id % 4 = 0, '/a', '/b') AS topic", "CAST(repeat(CAST(id AS STRING), 50) AS BINARY) AS data")
    bag_source.write(rows, f"{tmp_path}/bag", {"/a": "x/A", "/b": "x/B"}, files=2)
    whole = bag_source.load(spark, f"{tmp_path}/bag", split_bytes=1 << 16)
    assert whole.rdd.getNumPartitions() >= 4 and whole.count() == 4000 and whole.where("topic = '/a'").count() == 1000
    wanted = whole.where("stamp >= 20000 AND stamp < 20100 AND topic = '/b'")
    assert sorted(r["stamp"] for r in wanted.collect()) == [s for s in range(20000, 20100, 10) if s % 40]
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(\)|-) Filter", plan)
    assert whole.where("length(data) = 50 AND stamp >= 50").count() == 5


def test_bag_filters_reach_the_file(tmp_path, spark):
    rows = spark.range(1000).selectExpr("id AS stamp", "'/a' AS topic", "CAST('x' AS BINARY) AS data")
    bag_source.write(rows, f"{tmp_path}/bag", {"/a": "x/A"}, files=2)
    reader = bag_source.BagReader({"path": f"{tmp_path}/bag", "split_bytes": "8192"})
    assert len(reader.partitions()) >= 4
    left = [bag_source.IsNotNull(("data",))]
    asked = [bag_source.GreaterThanOrEqual(("stamp",), 900), bag_source.LessThan(("stamp",), 910), bag_source.In(("topic",), ("/a", "/c")), bag_source.IsNotNull(("stamp",)), *left]
    assert list(reader.pushFilters(asked)) == left
    parts = reader.partitions()
    assert {p.file for p in parts} == {bag_source.listed(f"{tmp_path}/bag")[1]}
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 10
    light = bag_source.BagReader({"path": f"{tmp_path}/bag", "payload": "false"})
    assert all(b["data"].null_count == b.num_rows for p in light.partitions() for b in light.read(p))
    with pytest.raises(ValueError):
        bag_source.BagReader({"path": "s3a://bucket/bag"})
