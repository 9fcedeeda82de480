"""The product plan on a generated sweep of a room seen from a moving, turning sensor."""

import json
import math

import numpy as np
import pytest

from sweepmill.functions import geometry as g
from sweepmill.plans import reconstruct


def scene(spark):
    rng = np.random.default_rng(8)
    walls = np.concatenate([np.stack([np.full(900, 3.0), rng.uniform(-2, 2, 900), rng.uniform(-1, 1, 900)], 1), np.stack([rng.uniform(-2, 3, 900), np.full(900, -2.0), rng.uniform(-1, 1, 900)], 1)])
    walls = np.concatenate([walls, [[10.0, 10.0, 10.0]]])
    poses, points = [], []
    for k in range(11):
        yaw = 0.1 * k
        poses.append(("c", k * 100_000_000, 0.05 * k, 0.0, 0.0, 0.0, 0.0, math.sin(yaw / 2), math.cos(yaw / 2)))
    for i, p in enumerate(walls):
        stamp = int(1_000_000_000 * (i % 997) / 997)
        share = stamp / 1e9
        yaw, d = share, p - np.array([0.5 * share, 0, 0])
        points.append(("c", i % 10, stamp, float(math.cos(yaw) * d[0] + math.sin(yaw) * d[1]), float(-math.sin(yaw) * d[0] + math.cos(yaw) * d[1]), float(d[2])))
    points.append(("c", 0, 5_000_000_000, 1.0, 1.0, 1.0))  # after the last pose
    return (
        spark.createDataFrame(points, "capture string, scan_index long, stamp long, x double, y double, z double"),
        spark.createDataFrame(poses, "capture string, stamp long, x double, y double, z double, qx double, qy double, qz double, qw double"),
    )


def test_points_land_on_their_walls(spark):
    points, poses = scene(spark)
    rows = reconstruct.posed(points, poses).collect()
    assert len(rows) == 1802
    late = [r for r in rows if r["stamp"] > 1_000_000_000]  # moved by the last pose
    yaw = 1.0
    assert len(late) == 1 and math.isclose(late[0]["wx"], math.cos(yaw) - math.sin(yaw) + 0.5) and math.isclose(late[0]["wy"], math.sin(yaw) + math.cos(yaw))
    assert all(min(abs(r["wx"] - 3), abs(r["wy"] + 2), abs(r["wx"] - 10)) < 1e-9 for r in rows if r not in late)


def test_product(spark, tmp_path):
    points, poses = scene(spark)
    points.write.parquet(f"{tmp_path}/points")
    poses.write.parquet(f"{tmp_path}/poses")
    reconstruct.main([f"{tmp_path}/points", f"{tmp_path}/poses", f"{tmp_path}/out", "--lidar-map-voxel", "0.1", "--isolation-radius", "0.4", "--export-normals"])
    report = json.loads((tmp_path / "out" / "stats.json").read_text())
    assert report["voxels"] > 800 and 0.8 * report["voxels"] < report["kept"] < report["voxels"]
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out" / "lidar_map").glob("*/part-*"))).split("\n")
    body = [x.split() for x in lines[lines.index("end_header") + 1 :] if x]
    assert len(body) == report["kept"] and all(len(x) == 9 for x in body) and not any(float(x[0]) > 9 for x in body)
    again = reconstruct.finish(spark, f"{tmp_path}/out", reconstruct.Options(lidar_map_voxel=0.1, isolation_radius=0.0, edge_plane_denoise=False, denoise_std=0.0))
    assert again["kept"] == again["voxels"] == report["voxels"]


def test_products_with_images(spark, tmp_path):
    """Two scans look along x at a wall; one has a red image, the other a blurred one."""
    rng = np.random.default_rng(3)
    points = [("c", k, 1_000 * k + i, 4.0, float(y), float(z)) for k in (0, 1) for i, (y, z) in enumerate(rng.uniform(-1, 1, (400, 2)))]
    poses = [("c", t, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for t in (0, 5_000)]
    points = spark.createDataFrame(points, "capture string, scan_index long, stamp long, x double, y double, z double")
    poses = spark.createDataFrame(poses, "capture string, stamp long, x double, y double, z double, qx double, qy double, qz double, qw double")
    scans = spark.createDataFrame([("c", 0, "red", 1_000_000, 50.0), ("c", 1, "red", 1_000_000, 3.0)], "capture string, scan_index long, image string, gap_ns long, sharpness double")
    pixels = spark.range(64 * 48).selectExpr("'red' AS image", "cast(id % 64 AS int) AS px", "cast(id div 64 AS int) AS py", "200 AS r", "10 AS g", "20 AS b")
    camera = g.Camera(fx=60.0, fy=60.0, cx=32.0, cy=24.0, width=64, height=48)
    look = ((0.0, -1.0, 0.0, 0.0), (0.0, 0.0, -1.0, 0.0), (1.0, 0.0, 0.0, 0.0))
    o = reconstruct.Options(map_voxel=0.05, lidar_map_voxel=0.1, isolation_radius=0.0, edge_plane_denoise=False, denoise_std=0.0)
    images = reconstruct.Images(scans, pixels, camera, look)
    rows = reconstruct.coloured_points(points, poses, images, o).groupBy("product", "red", "green", "blue").count().collect()
    assert {(r["product"], r["red"], r["green"], r["blue"]): r["count"] for r in rows if r["product"] == "rgb"} == {("rgb", 200.0, 10.0, 20.0): 400}
    assert sum(r["count"] for r in rows if r["product"] == "mixed") == sum(r["count"] for r in rows if r["product"] == "lidar") == 800
    assert sum(r["count"] for r in rows if r["product"] == "mixed" and r["red"] == 200.0) == 400
    report = reconstruct.reconstruct(spark, points, poses, f"{tmp_path}/out", o, images, accepted=scans.where("scan_index = 0"))
    assert report["rgb_points"] == report["mixed_points"] == report["lidar_points"] == 400 and report["accepted_scans"] == 1
    assert report["rgb_kept"] == report["rgb_voxels"] > 300 and (tmp_path / "out" / "mixed_map").exists()


def test_options_are_checked():
    for bad in ({"map_voxel": 0.0}, {"blind": 70.0}, {"lidar_color_bands": 0}, {"denoise_std": -1.0}):
        with pytest.raises(ValueError):
            reconstruct.Options(**bad)
