"""Closed forms, brute force and invariances of the geometric operators."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from sweepmill.functions import geometry as g
from sweepmill.operators import graphs, imaging, loops, motion, neighbours, registration, series, voxel
from sweepmill.plans import places

RNG = np.random.default_rng(4)


def frame(spark, xyz, **more):
    rows = [(i, *map(float, p), *[v[i] for v in more.values()]) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double" + "".join(f", {c} {'long' if isinstance(v[0], int) else 'double'}" for c, v in more.items()))


def test_radius_and_knn_against_brute_force(spark):
    xyz = np.concatenate([RNG.normal(size=(150, 3)) * 0.05, RNG.uniform(-3, 3, size=(60, 3)), [[40.0, 0, 0], [0.0, -55, 0]]])
    df = frame(spark, xyz)
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    kept = {r["id"] for r in neighbours.radius_inliers(df, 0.08, 2).collect()}
    assert kept == {i for i in range(len(xyz)) if (d[i] <= 0.08).sum() - 1 >= 2}
    near = neighbours.knn(df, 5, 0.05).groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert {r["qid"]: r["ids"] for r in near} == {i: sorted(np.argsort(d[i])[1:6].tolist()) for i in range(len(xyz))}
    assert neighbours.knn(df.limit(3), 5, 0.05).count() == 6 and neighbours.knn(df.limit(0), 5, 0.05).count() == 0


def test_outlier_filters(spark):
    plane = np.array([[x * 0.05, y * 0.05, 0.001 * ((x * 7 + y * 3) % 3)] for x in range(12) for y in range(12)])
    off = np.array([[0.3, 0.3, 0.06]])
    df = frame(spark, np.concatenate([plane, off]))
    kept = {r["id"] for r in neighbours.edge_plane_inliers(df, k=12, residual=0.025, planarity=0.08).collect()}
    assert kept == set(range(144))
    assert 144 not in {r["id"] for r in neighbours.statistical_inliers(frame(spark, np.concatenate([plane, [[0.3, 0.3, 1.0]]])), k=8).collect()}
    n = neighbours.normals(df.where("id < 144").withColumn("z", F.col("z") + 2.0), 0.12).collect()
    assert all(abs(r["nz"] + 1) < 0.01 for r in n if r["n"] >= 6)


def test_registration_recovers_a_motion(spark):
    walls = np.concatenate([np.stack([RNG.uniform(-4, 4, 900), RNG.uniform(-4, 4, 900), np.zeros(900)], 1)[:, list(p)] + np.array(s) for p, s in (((0, 1, 2), (0, 0, -1)), ((0, 2, 1), (0, 4.1, 0)), ((2, 0, 1), (4.1, 0, 0)))])
    target = frame(spark, walls)
    c, s = math.cos(0.02), math.sin(0.02)
    back = np.array([[c, s, 0, -0.03], [-s, c, 0, 0.02], [0, 0, 1, 0.015], [0, 0, 0, 1]])
    moved = walls @ back[:3, :3].T + back[:3, 3]
    planes = voxel.planes(target, 1.0)
    pose, fitness, rmse, degenerate = registration.register_to_planes(frame(spark, moved), planes, 1.0, rotation_prior=1e-3, translation_prior=1e-3)
    assert np.abs(pose @ back - np.eye(4)).max() < 3e-3 and fitness > 0.8 and rmse < 0.01 and not degenerate
    icp, share, error = neighbours.register(frame(spark, walls[:300] @ back[:3, :3].T + back[:3, 3]), frame(spark, walls[:300]), 0.3)
    assert np.abs(icp @ back - np.eye(4)).max() < 1e-3 and share == 1.0 and error < 1e-3


def test_so3_round_trip():
    for v in ([0, 0, 0], [1e-9, 0, 0], [0.3, -0.2, 0.9], [0, 3.1, 0], [math.pi - 1e-6, 0, 0]):
        m = registration.exp_so3(np.array(v, dtype=float))
        assert np.allclose(registration.exp_so3(registration.log_so3(m)), m, atol=1e-6)


def test_pose_graph_closes_a_loop(spark):
    got = places.pose_graph(spark, "/root/testdata/sf0.001").where("nodes > 2").collect()
    assert got and all(r["cost1"] < r["cost0"] for r in got)
    poses = np.tile(np.eye(4), (5, 1, 1))
    poses[:, 0, 3] = [0, 1.1, 2.2, 3.3, 4.4]
    z = np.linalg.inv(poses[1:]) @ poses[:-1]
    loop = np.eye(4)
    loop[0, 3] = 4.0
    out, before, after = graphs.solve(poses, [0, 1, 2, 3, 4], [1, 2, 3, 4, 0], [*z, loop], [False] * 4 + [True])
    assert after < before and np.allclose(out[0], np.eye(4)) and 4.0 < out[4][0, 3] < 4.4


def test_gyro_and_slerp(spark):
    rows = [(1, i * 10_000_000, 0.0, 0.0, 0.5) for i in range(201)] + [(2, 0, 1.0, 1.0, 1.0)]
    out = motion.integrate_gyro(spark.createDataFrame(rows, "capture long, stamp long, gx double, gy double, gz double"), "capture")
    last = out.where("capture = 1").orderBy(F.desc("stamp")).first()
    assert math.isclose(2 * math.atan2(last["qz"], last["qw"]), 1.0, abs_tol=1e-9)
    q = [F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(p, graphs.POSE[3:], strict=True)]) for p in ((0, 0, 0, 1), (0, 0, math.sin(0.5), math.cos(0.5)))]
    got = spark.range(1).select(graphs.slerp(*q, F.lit(0.25)).alias("q")).first()["q"]
    assert math.isclose(2 * math.atan2(got["qz"], got["qw"]), 0.25, abs_tol=1e-12)


def test_visibility(spark):
    camera = g.Camera(fx=100.0, fy=100.0, cx=50.0, cy=50.0, width=100, height=100)
    front = [(x * 0.01, y * 0.01, 1.0) for x in range(-10, 11) for y in range(-10, 11)]
    df = frame(spark, [*front, (0.0, 0.0, 3.0), (0.0, 0.6, 2.0), (0.0, 0.0, 1.05), (0.0, 0.0, -1.0)])
    assert {r["id"] for r in imaging.visible(df, camera).collect()} == {*range(441), 442, 443}


def test_images_round_trip(spark):
    data = bytearray(np.arange(6 * 5 * 3, dtype=np.uint8).tobytes())
    row = [(("f", 5, 6, 3, 16, data),)]
    images = spark.createDataFrame(row, "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    px = {(r["px"], r["py"]): (r["r"], r["g"], r["b"]) for r in imaging.pixels_of(images).collect()}
    assert len(px) == 30 and px[0, 0] == (2, 1, 0) and px[1, 0] == (5, 4, 3) and px[0, 1] == (20, 19, 18)
    assert imaging.image_sharpness(images).first()["sharpness"] == 0.0


def test_voxels_do_not_depend_on_order_or_parts(spark):
    xyz = RNG.uniform(-5, 5, size=(500, 3))
    df = frame(spark, xyz, w=[int(v) for v in RNG.integers(1, 9, 500)])
    once = {tuple(r[k] for k in voxel.KEY): r for r in voxel.weighted(df, 2.0).collect()}
    state = voxel.sums_by_cell(df.repartition(7), 2.0, part=F.col("id") % 5)
    for r in voxel.merge_sums(state).collect():
        o = once[tuple(r[k] for k in voxel.KEY)]
        assert r["w"] == o["w"] and all(math.isclose(r[a], o[a], abs_tol=1e-9) for a in "xyz")
    twice = voxel.weighted(voxel.weighted(df, 2.0), 2.0)
    assert twice.count() == len(once) and twice.agg(F.sum("w")).first()[0] == sum(r["w"] for r in once.values())


def test_tiles_keep_every_point_once(spark):
    tiled = neighbours.with_halo(frame(spark, RNG.uniform(-5, 5, size=(300, 3))), 2.0, 0.3)
    assert tiled.where("core").count() == 300
    for r in tiled.collect():
        assert all(t * 2.0 - 0.3 - 1e-9 <= r[a] <= (t + 1) * 2.0 + 0.3 + 1e-9 for a, t in zip("xyz", (r["tx"], r["ty"], r["tz"])))


def test_loops(spark):
    poses = [(1, i, float(i % 10), 0.0, 0.0) for i in range(40)]
    cells = spark.createDataFrame([(1, i, i % 10, 1.0 + 0.2 * (i % 3), 1.0) for i in range(40)], "capture int, frame int, sector int, ring double, z double")
    pts = cells.select("capture", "frame", (F.col("ring") * 10 * F.cos(F.col("sector") * 0.6)).alias("x"), (F.col("ring") * 10 * F.sin(F.col("sector") * 0.6)).alias("y"), "z")
    d = loops.descriptors(loops.polar_cells(pts, ["capture", "frame"]), ["capture", "frame"])
    frames = spark.createDataFrame(poses, "capture int, frame int, x double, y double, z double").join(d, ["capture", "frame"])
    got = loops.candidates(frames, "capture", separation=20, radius=0.5, ring_limit=-1.0).collect()
    assert {(r["source"] % 10 == r["target"] % 10) for r in got} == {True} and max(r["rank"] for r in got) <= 4
    taken = loops.suppressed(spark.createDataFrame([(1, t) for t in (5, 10, 34, 36, 70, 99, 101)], "capture int, target int"), "capture")
    assert sorted(r["target"] for r in taken.collect()) == [5, 36, 70, 101]


def test_gate_reasons(spark):
    rows = [(0.9, 0.05, 0.1, 1.0, "accepted"), (0.5, 0.05, 0.1, 1.0, "fitness 0.500 below 0.700"), (0.9, 0.3, 0.1, 1.0, "rmse 0.300 m above 0.180 m"), (0.9, 0.05, 5.0, 1.0, "translation 5.000 m above 0.750 m"), (0.75, 0.05, 0.5, 1.0, "translation 0.500 m above 0.400 m"), (0.9, 0.05, 0.1, 90.0, "rotation 90.000 deg above 24.000 deg"), (float("nan"), 0.05, 0.1, 1.0, "non-finite ICP result")]
    df = spark.createDataFrame(rows, "f double, r double, m double, t double, want string")
    got = df.select("want", registration.gate_reason(F.col("f"), F.col("r"), F.col("m"), F.col("t"), F.lit(0.1)).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_pairs_are_registered_together(spark):
    rows_s, rows_t = [], []
    for pair in range(3):
        xyz = RNG.uniform(-2, 2, size=(150, 3)) if pair < 2 else RNG.uniform(-2, 2, size=(150, 3)) * 20
        c, s = math.cos(0.05 * pair), math.sin(0.05 * pair)
        turned = xyz @ np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]) + [0.05, -0.1 * pair, 0.02]
        other = turned if pair < 2 else RNG.uniform(-2, 2, size=(150, 3))
        rows_s += [(pair, i, *map(float, p)) for i, p in enumerate(xyz)]
        rows_t += [(pair, i, *map(float, p)) for i, p in enumerate(other)]
    source, target = (spark.createDataFrame(r, "pair long, id long, x double, y double, z double") for r in (rows_s, rows_t))
    there, back = registration.register_pairs(source, target, 0.6, rounds=8), registration.register_pairs(target, source, 0.6, rounds=8)
    got = {r["pair"]: r for r in registration.symmetric_loops(there, back).collect()}
    assert got[0]["reason"] == got[1]["reason"] == "accepted" and got[2]["reason"] == "forward registration"
    assert math.isclose(got[0]["pose"][3], 0.05, abs_tol=1e-6) and got[1]["fitness"] == 1.0


def test_small_gates(spark):
    df = spark.createDataFrame([("a", i * 1_000_000) for i in range(100)] + [("b", 400_000_000)] * 30, "capture string, gap long")
    got = {r["capture"]: (r["median"], r["outliers"], r["passes"]) for r in registration.pairing_holds(df, ["capture"], "gap").collect()}
    assert got == {"a": (50_000_000, 0, True), "b": (400_000_000, 30, False)}
    row = spark.range(1).select(registration.within_budget(F.lit(21), F.lit(100)).alias("a"), registration.within_budget(F.lit(21), F.lit(40)).alias("b"), registration.good_refinement(F.lit(0.9), F.lit(0.05), F.lit(0.05), F.lit(3.0)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (True, False, False)


def test_empty_tables(spark):
    empty = frame(spark, np.zeros((1, 3))).limit(0)
    for out in (neighbours.radius_inliers(empty, 0.1, 2), neighbours.statistical_inliers(empty), neighbours.normals(empty, 0.1), voxel.centroids(empty, 0.1), neighbours.with_halo(empty, 1.0, 0.1)):
        assert out.count() == 0
    assert list(itertools.islice(voxel.planes(empty, 0.1).toLocalIterator(), 1)) == []


def test_loops_are_found_and_closed(spark):
    """A walk around a cross-shaped hall, whose poses drift; its end sees what its beginning saw."""
    rng = np.random.default_rng(5)
    walls = np.concatenate([np.stack([rng.uniform(-9, 9, 700), np.full(700, y), rng.uniform(-1, 3, 700)], 1) for y in (-6.0, 7.0)] + [np.stack([np.full(700, x), rng.uniform(-6, 7, 700), rng.uniform(-1, 3, 700)], 1) for x in (-9.0, 8.0)] + [np.stack([rng.uniform(2, 4, 300), np.full(300, 2.0), rng.uniform(-1, 2, 300)], 1)])
    frames, clouds, truth, n = [], [], [], 24
    for k in range(n):
        a = 2 * math.pi * k / (n - 1)
        p, yaw = np.array([3 * math.cos(a) - 3, 3 * math.sin(a), 0.0]), 0.02 * k
        truth.append(p)
        c, s = math.cos(yaw), math.sin(yaw)
        own = (walls - p) @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
        seen = p + np.array([0.008, 0.004, 0.0]) * k  # the drift
        frames.append(("c", k, (*map(float, seen), 0.0, 0.0, math.sin(yaw / 2), math.cos(yaw / 2))))
        clouds += [("c", k, *map(float, q)) for q in own]
    f = spark.createDataFrame(frames, "capture string, frame long, pose struct<x:double,y:double,z:double,qx:double,qy:double,qz:double,qw:double>")
    solved, found = loops.closed_graph(f, spark.createDataFrame(clouds, "capture string, frame long, x double, y double, z double"), "capture", 0.5, separation=18, radius=1.5, apart=2, rounds=6, most_rmse=0.3)
    ends = {r["frame"]: r for r in solved.collect()}
    assert found.count() >= 1 and len(ends) == n and all(r["reason"] is None for r in ends.values())
    before = np.linalg.norm(np.array(frames[-1][2][:3]) - truth[-1])
    after = np.linalg.norm(np.array(ends[n - 1]["solved"][:3]) - truth[-1])
    assert before > 0.2 and after < 0.4 * before


def test_standing_still(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i * 5_000_000, *map(float, rng.normal(0, 0.01, 3) + 0.02), *map(float, rng.normal(0, 0.005, 3) + (0, 0, 1.0 if k == 1 else 9.8))) for k in (1, 2) for i in range(2200)]
    rows += [(3, i * 5_000_000, *map(float, rng.normal(0, 1, 3)), 0.0, 0.0, 9.8) for i in range(2200)]
    df = spark.createDataFrame(rows, "k long, t long, gx double, gy double, gz double, ax double, ay double, az double")
    got = {r["k"]: r for r in series.static_imu(df, ["k"], "t").collect()}
    assert got[1]["valid"] and got[1]["scale"] == 9.80665 and got[2]["valid"] and got[2]["scale"] == 1.0 and not got[3]["valid"]
    assert abs(got[2]["bx"] - 0.02) < 2e-3 and abs(got[1]["mz"] - 9.80665) < 0.01 and got[1]["n"] == 2001
    asked = spark.createDataFrame([(1, 1_000_000_000), (2, 10_900_000_000), (3, 0), (1, 50_000_000_000)], "k long, start long")
    rest = {(r["k"], r["start"]): (r["n"], r["valid"]) for r in series.stationary_mean(df, asked, ["k"], "t").collect()}
    assert rest == {(1, 1_000_000_000): (401, True), (2, 10_900_000_000): (20, True), (3, 0): (401, True), (1, 50_000_000_000): (None, False)}  # only means count
    stamps = [(1, i * 100_000_000, 0) for i in range(20)] + [(2, 0, i * 200_000_000) for i in range(20)]
    rate = {r["k"]: (r["median"], r["passes"]) for r in series.frame_interval(spark.createDataFrame(stamps, "k long, a long, b long"), ["k"], "a", "b").collect()}
    assert rate == {1: (100_000_000, True), 2: (200_000_000, False)}


def test_medians_and_trimmed_means(spark):
    rng = np.random.default_rng(4)
    groups = {k: rng.choice((rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.pareto(1, n))[k % 3], n) for k, n in enumerate((1, 2, 3, 19, 20, 21, 39, 40, 1000, 9_999, 30_001, 30_000))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(None, 1.0), (None, 3.0), (0, None)], "k long, v double")
    medians = {r["k"]: (r["median"], r["n"]) for r in series.upper_median(df, ["k"], "v").collect()}
    means = {r["k"]: (r["mean"], r["n"]) for r in series.trimmed_mean(df.where("v IS NOT NULL"), ["k"], "v").collect()}
    for k, vs in {**groups, None: np.array([1.0, 3.0])}.items():
        own, cut = sorted(vs), len(vs) // 10 if len(vs) >= 20 else 0
        assert medians[k] == (own[len(own) // 2], len(own))
        assert means[k][1] == len(own) and math.isclose(means[k][0], np.mean(own[cut : len(own) - cut]), rel_tol=1e-9, abs_tol=1e-12)


def test_trimmed_mean_near_its_cuts(spark):
    rng = np.random.default_rng(5)
    groups = {"large": rng.normal(size=25_000), "ties": np.concatenate([np.zeros(12_000), np.ones(9000), rng.normal(size=1000)]), "same": np.full(11_000, 3.0), "few": np.arange(19.0), "some": np.arange(25.0) ** 2, None: np.array([4.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("few", None)]
    got = {r["k"]: (r["mean"], r["n"]) for r in series.trimmed_mean(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, vs in groups.items():
        trim = len(vs) // 10 if len(vs) >= 20 else 0
        kept = np.sort(vs)[trim : len(vs) - trim]
        assert got[k][1] == len(vs) and math.isclose(got[k][0], kept.mean(), rel_tol=1e-9, abs_tol=1e-12)
