"""A moving cloud over one that stays, dealt to boxes once: nearest points and sums of pairs against all pairs, and the jobs of a round."""

import math

import numpy as np

from sweepmill.operators import boxes, neighbours


def frame(spark, ids, places):
    return spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, places, strict=True)], "id long, x double, y double, z double")


def cloud(seed=4):
    """A dense ball, one place held by thirty points, a few pairs of copies, a sheet of a grid, and lonely points."""
    rng = np.random.default_rng(seed)
    dense, wide = rng.normal(0, 0.01, (900, 3)), rng.normal(0, 1.0, (200, 3))
    grid = np.array([(x / 8, y / 8, 2.0) for x in range(12) for y in range(12)])
    return np.concatenate([dense, wide, grid, np.tile(dense[3], (30, 1)), wide[:5], [[40.0, 0.0, 0.0]]])


def brute(q, p, gate):
    d2 = (q[:, None, 0] - p[None, :, 0]) ** 2 + (q[:, None, 1] - p[None, :, 1]) ** 2 + (q[:, None, 2] - p[None, :, 2]) ** 2
    at = d2.argmin(axis=1)
    best = d2[np.arange(len(q)), at]
    return np.where(best <= gate * gate, best, np.inf), np.where(best <= gate * gate, at, -1)


def test_nearest_of_a_box():
    places, rng = cloud(), np.random.default_rng(5)
    # Halves of the grid's steps have several nearest points; some queries lie far outside.
    queries = np.concatenate([places[::3] + rng.normal(0, 0.01, places[::3].shape), places[1100:1244] + (1 / 16, 1 / 16, 0), places[:20], [[-90.0, 3.0, 1.0], [0.0, 0.0, 0.0]]])
    for p in (places, places[:1], np.tile(places[:1], (9, 1)), places[1100:1244], places[:0]):
        for gate in (0.15, 1.0, math.inf):
            got, want = boxes.nearest(queries, p, gate), brute(queries, p, gate) if len(p) else (np.full(len(queries), np.inf), np.full(len(queries), -1))
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def turned(angle, shift):
    pose = np.eye(4)
    pose[:2, :2] = [[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]]
    pose[:3, 3] = shift
    return pose


def test_rounds_against_all_pairs(spark, monkeypatch):
    places = cloud()
    ids = np.random.default_rng(6).permutation(len(places)) * 3
    nowhere = [[math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0]]
    still = frame(spark, [*ids, 7001, 7002], np.concatenate([places, nowhere]))
    moving = frame(spark, [*ids[::2], 7001], np.concatenate([places[::2], nowhere[:1]]))
    order = np.argsort(ids)
    for hold, few in ((64, 20_000), (64, 0), (100_000, 20_000)):
        monkeypatch.setattr(boxes, "HOLD", hold)
        monkeypatch.setattr(boxes, "FEW", few)
        search, asked = boxes.Search(moving, still, 0.15), 0
        assert search.n == len(places[::2]) + 1 and (search.boxes.depth > 3) == (hold == 64)
        for pose in (np.eye(4), turned(0.03, (0.01, -0.008, 0.005)), turned(0.4, (0.3, 0.2, 0.0)), turned(0.4, (0.3, 0.2, 0.01))):
            q = places[::2] @ pose[:3, :3].T + pose[:3, 3]
            d2, at = brute(q, places[order], 0.15)
            met = at >= 0
            want = boxes._sums(q[met], places[order][at[met]], d2[met], np.ones(met.sum()), search.centre)
            assert np.allclose(search.round(pose), want, rtol=1e-9, atol=1e-9)
            asked += search.left
        assert (asked > 0) == (hold == 64)
        search.close()


def test_clouds_without_pairs(spark):
    empty, some = frame(spark, [], []), frame(spark, range(5), np.arange(15.0).reshape(5, 3))
    for moving, still in ((empty, some), (some, empty), (some, frame(spark, [1], [[99.0, 0.0, 0.0]]))):
        pose, fitness, rmse = neighbours.register(moving, still, 0.3)
        assert np.array_equal(pose, np.eye(4)) and fitness == 0.0 and rmse == math.inf


def test_a_round_takes_few_jobs(spark, monkeypatch):
    """However thin the cloud is in places: wider and wider searches, each of several jobs, took most of a round."""
    monkeypatch.setattr(boxes, "HOLD", 512)
    rng = np.random.default_rng(8)
    places = np.concatenate([rng.normal(0, 0.02, (2000, 3)), rng.normal(0, 0.4, (1000, 3))])
    still, moving = frame(spark, range(3000), places), frame(spark, range(3000), places + (0.02, 0.0, 0.01))
    jobs = []
    for rounds in (2, 5):
        spark.sparkContext.setJobGroup(f"rounds {rounds}", "")
        neighbours.register(moving, still, 0.3, rounds=rounds, rest=0.0)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds {rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] > 2 and (jobs[1] - jobs[0]) / 3 <= 8, jobs
