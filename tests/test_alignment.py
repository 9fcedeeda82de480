"""Many clouds registered at once: onto planes, against the registration of one scan, and from coarse to fine."""

import math

import numpy as np
import pytest

from sweepmill.operators import alignment, registration, voxel

RNG = np.random.default_rng(12)


def room(n, seed=0):
    """Floor, two walls and a slanted board, without order."""
    rng = np.random.default_rng(seed)
    flat = [np.c_[rng.uniform(-4, 4, n), rng.uniform(-4, 4, n), np.full(n, -1.0)], np.c_[rng.uniform(-4, 4, n), np.full(n, 4.1), rng.uniform(-1, 2, n)], np.c_[np.full(n, 4.1), rng.uniform(-4, 4, n), rng.uniform(-1, 2, n)]]
    u, v = rng.uniform(0, 2, n // 2), rng.uniform(0, 1.5, n // 2)
    return np.concatenate([*flat, np.c_[-3 + u, -3 + 0.4 * u + 0.2 * v, -0.9 + v]])


def motion_of(yaw, pitch, shift):
    c, s, d, e = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
    out = np.eye(4)
    out[:3, :3] = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ np.array([[d, 0, e], [0, 1, 0], [-e, 0, d]])
    out[:3, 3] = shift
    return out


def seen_from(points, pose):
    """Points of the world in the frame of a pose."""
    return (points - pose[:3, 3]) @ pose[:3, :3]


def keyed(spark, clouds, key):
    rows = [(k, i, *map(float, p)) for k, cloud in clouds.items() for i, p in enumerate(cloud)]
    return spark.createDataFrame(rows, f"{key} int, id long, x double, y double, z double")


def poses(spark, found, key):
    return spark.createDataFrame([(k, p.ravel().tolist()) for k, p in found.items()], f"{key} int, pose array<double>")


def by_key(rows, key):
    return {r[key]: (np.array(r["pose"]).reshape(4, 4), r) for r in rows}


def test_all_scans_at_once(spark):
    world = room(700)
    planes = voxel.planes(keyed(spark, {0: world}, "scan"), 1.0).cache()
    truth = {k: motion_of(0.02 * k, 0.003 * k, (0.01 * k, -0.012 * k, 0.004 * k)) for k in range(6)}
    scans = keyed(spark, {k: seen_from(world[k::3], p) for k, p in truth.items()}, "scan")
    guess = {k: motion_of(0.02 * k + 0.015, 0.003 * k, (0.01 * k + 0.03, -0.012 * k, 0.004 * k - 0.02)) for k in truth}
    # A scan of nothing and one that lies nowhere near stay as they are.
    guess |= {7: motion_of(0, 0, (90, 0, 0)), 8: np.eye(4)}
    scans = scans.unionByName(keyed(spark, {7: world[:200]}, "scan"))
    got = by_key(alignment.register_scans(scans, planes, 1.0, poses(spark, guess, "scan"), ["scan"], rotation_prior=1e-3, translation_prior=1e-3).collect(), "scan")
    for k, p in truth.items():
        assert np.abs(got[k][0] - p).max() < 8e-3 and got[k][1]["fitness"] > 0.8 and got[k][1]["rmse"] < 0.05 and not got[k][1]["degenerate"]
    assert np.allclose(got[7][0], guess[7]) and got[7][1]["fitness"] == 0 and np.allclose(got[8][0], np.eye(4)) and math.isinf(got[8][1]["rmse"])
    # The same as one scan by itself, with its priors.
    one = scans.where("scan = 3")
    pose, fitness, rmse, degenerate = registration.register_to_planes(one, planes, 1.0, guess[3])
    many = by_key(alignment.register_scans(scans.where("scan in (3, 4)"), planes, 1.0, poses(spark, {k: guess[k] for k in (3, 4)}, "scan"), ["scan"]).collect(), "scan")
    assert np.allclose(many[3][0], pose, atol=1e-9) and many[3][1]["fitness"] == fitness and math.isclose(many[3][1]["rmse"], rmse) and many[3][1]["degenerate"] == degenerate


def test_jobs_do_not_grow_with_scans(spark):
    world = room(60)
    planes = voxel.planes(keyed(spark, {0: room(700)}, "scan"), 1.0).cache()
    planes.count()

    def jobs(n):
        scans = keyed(spark, {k: world for k in range(n)}, "scan").cache()
        start = poses(spark, {k: np.eye(4) for k in range(n)}, "scan").cache()
        spark.sparkContext.setJobGroup(f"scans {n}", "")
        assert alignment.register_scans(scans, planes, 1.0, start, ["scan"]).count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scans {n}"))

    try:
        few = jobs(2)
        assert jobs(150) <= few + 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_final_pass(spark):
    world = room(700)
    truth = {k: motion_of(0.03 * k, 0, (0.02 * k, 0.01 * k, 0)) for k in range(8)}
    points = keyed(spark, {k: seen_from(room(500, seed=k + 1), p) for k, p in truth.items()}, "scan")
    off = {k: p @ motion_of(0.004 * (-1) ** k, 0, (0.02 * (-1) ** k, 0.015, 0)) if k in (2, 5) else p for k, p in truth.items()}
    lost = {**off, 6: truth[6] @ motion_of(0.2, 0, (0.5, 0, 0))}
    scans = poses(spark, lost, "scan").selectExpr("*", "0.5D AS fitness", "0.1D AS rmse")
    got = by_key(alignment.refine_scans(scans, points, ["scan"], 1.0, voxel_size=0.1, rotation_prior=1e-3, translation_prior=1e-3).collect(), "scan")
    better = lambda k: np.abs(got[k][0] - truth[k]).max() < np.abs(off[k] - truth[k]).max()
    assert got[2][1]["refined"] and got[5][1]["refined"] and better(2) and better(5)
    # What would move too far stays.
    assert not got[6][1]["refined"] and np.allclose(got[6][0], lost[6]) and got[6][1]["fitness"] == 0.5
    assert len(world) > 0


def test_coarse_to_fine_goes_where_point_to_point_does_not(spark):
    world = room(1600)
    motions = {0: motion_of(0.22, 0.05, (0.45, -0.35, 0.2)), 1: motion_of(-0.2, 0.02, (-0.4, 0.3, -0.15))}
    source = keyed(spark, {k: seen_from(room(1600, seed=9), p) for k, p in motions.items()}, "pair")
    target = keyed(spark, dict.fromkeys(motions, world), "pair")
    fine = by_key(alignment.register_coarse_to_fine(source, target, 0.1).collect(), "pair")
    still = spark.createDataFrame([(k, np.eye(4).ravel().tolist()) for k in motions], "pair int, pose array<double>")
    plain = by_key(registration.register_pairs(source, target, 0.2, 12, still).collect(), "pair")
    for k, p in motions.items():
        assert np.abs(fine[k][0] - p).max() < 0.02 and fine[k][1]["fitness"] > 0.7 and fine[k][1]["rmse"] < 0.15
        assert np.abs(plain[k][0] - p).max() > 0.1
    # Clouds too small for a level are scored as they lie.
    few = alignment.register_coarse_to_fine(source.where("id < 20"), target.where("id < 20"), 0.1).collect()
    assert all(np.allclose(r["pose"], np.eye(4).ravel()) for r in few) and len(few) == 2


@pytest.mark.parametrize("seed", [0, 1])
def test_sums_against_matrices(spark, seed):
    rng = np.random.default_rng(seed)
    p, t = rng.normal(size=(30, 3)), rng.normal(size=(30, 3))
    n, m = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(30, 3)), rng.normal(size=(30, 3))))
    n[0] = 0
    h, right = np.zeros((6, 6)), np.zeros(6)
    for a, b, u, v in zip(p, t, n, m, strict=True):
        weight = np.linalg.inv(2 * np.eye(3) - alignment.FLAT * (np.outer(u, u) + np.outer(v, v)))
        j = np.hstack([-np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]]), np.eye(3)])
        h, right = h + j.T @ weight @ j, right + j.T @ weight @ (b - a)
    rows = [(0, *map(float, np.concatenate(x))) for x in zip(p, n, t, m, strict=True)]
    df = spark.createDataFrame(rows, "pair int, " + ", ".join(f"{c} double" for c in ("x", "y", "z", "nx", "ny", "nz", "tx", "ty", "tz", "mx", "my", "mz")))
    got = alignment.plane_to_plane(df, ["pair"]).first()
    assert all(math.isclose(got[f"h{i}{j}"], h[i, j], rel_tol=1e-7, abs_tol=1e-6) for i, j in alignment.UPPER)
    assert all(math.isclose(got[f"g{i}"], right[i], rel_tol=1e-7, abs_tol=1e-6) for i in range(6)) and got["inliers"] == 30
