"""Triangle descriptors: what a turn leaves alike, the pose found again, keypoints of a plain room."""

import numpy as np

from sweepmill.operators import triangles as t


def turned(points, yaw, shift):
    c, s = np.cos(yaw), np.sin(yaw)
    return points @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + shift


def frames_of(spark, clouds):
    rows = [("c", f, i, *map(float, p)) for f, cloud in clouds.items() for i, p in enumerate(cloud)]
    return spark.createDataFrame(rows, "capture string, frame int, id long, x double, y double, z double")


def test_pose_of_a_place_seen_again(spark):
    rng = np.random.default_rng(4)
    here, there = rng.uniform(-10, 10, (30, 3)), rng.uniform(-10, 10, (30, 3))
    # The later frame sees the place of the earlier one turned, moved, a little noisy and with other points besides.
    seen = np.concatenate([turned(here[:24], 1.1, (3, -2, 0.5)) + rng.normal(0, 0.01, (24, 3)), rng.uniform(-10, 10, (6, 3))])
    shapes = t.triangles(frames_of(spark, {0: here, 1: there, 50: seen}), ["capture", "frame"]).cache()
    # From each corner, all pairs of its eight nearest; none twice.
    assert shapes.select("frame", "ids").distinct().count() == shapes.count() > 300
    assert shapes.where("sides[0] > sides[1] OR sides[1] > sides[2]").count() == 0
    for hot in (256, 1):
        pairs = t.best_frames(t.votes(shapes, "capture", "frame", 0.2, 10, hot), "capture", 2)
        best = pairs.where("rank = 1").first()
        assert (best["target"], best["source"]) == (50, 0)
    found = t.relative_poses(shapes, pairs, "capture", "frame", 0.2).where("source = 0").first()
    pose = np.array(found["pose"]).reshape(4, 4)
    assert found["inliers"] >= 50 and found["inliers"] <= found["matches"]
    back = turned(here, 1.1, (3, -2, 0.5)) @ pose[:3, :3].T + pose[:3, 3]
    assert np.abs(back - here).max() < 0.15


def test_every_fit_within_half_a_bin_meets(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(0, 5, (400, 3))
    rows = [(0, i, a[i].tolist()) for i in range(400)] + [(1, i, (a[i] + rng.uniform(-0.05, 0.05, 3)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "side int, id long, sides array<double>")
    mine = df.where("side = 1").select("id", t.side_bins(0.1).alias("key"))
    theirs = df.where("side = 0").select("id", t.F.explode(t.probes(0.1)).alias("key"))
    assert mine.join(theirs, ["id", "key"]).count() == 400 and theirs.distinct().count() == 3200


def test_keypoints_are_where_surfaces_end(spark):
    rng = np.random.default_rng(2)
    floor = np.c_[rng.uniform(0, 4, 8000), rng.uniform(0, 4, 8000), rng.normal(0, 0.005, 8000)]
    wall = np.c_[rng.normal(2.2, 0.005, 4000), rng.uniform(0, 4, 4000), rng.uniform(0, 2, 4000)]
    rows = [("c", 0, *map(float, p)) for p in np.concatenate([floor, wall])]
    df = spark.createDataFrame(rows, "capture string, frame int, x double, y double, z double")
    found = t.keypoints(df, ["capture", "frame"], 0.5, most=5).collect()
    assert len(found) == 5 and all(abs(r["x"] - 2.2) < 0.5 and r["z"] < 0.5 for r in found)
    assert t.keypoints(df.limit(0), ["capture", "frame"], 0.5).count() == 0


def test_loops_of_clouds(spark):
    """Whole path: rooms of boxes, one of them visited twice."""
    rng = np.random.default_rng(8)

    def room(seed):
        own = np.random.default_rng(seed)
        parts = [np.c_[rng.uniform(-9, 9, 9000), rng.uniform(-9, 9, 9000), rng.normal(0, 0.004, 9000)]]
        for x, y, h in zip(own.uniform(-8, 8, 14), own.uniform(-8, 8, 14), own.uniform(1, 3, 14), strict=True):
            parts.append(np.c_[np.full(700, x), y + rng.uniform(0, 1.4, 700), rng.uniform(0, h, 700)])
            parts.append(np.c_[x + rng.uniform(0, 1.4, 700), np.full(700, y), rng.uniform(0, h, 700)])
        return np.concatenate(parts)

    clouds = {0: room(1), 1: room(2), 40: turned(room(1), 0.0, (0.0, 0.0, 0.0))}
    rows = [("c", f, *map(float, p)) for f, cloud in clouds.items() for p in cloud]
    df = spark.createDataFrame(rows, "capture string, frame int, x double, y double, z double")
    found = t.triangle_loops(df, "capture", "frame", 0.5, 0.2, 10, most=1).collect()
    assert [(r["target"], r["source"]) for r in found] == [(40, 0)]
    assert np.abs(np.array(found[0]["pose"]).reshape(4, 4) - np.eye(4)).max() < 0.3
