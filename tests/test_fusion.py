"""A map grown in batches: any batching, stopped runs, and what moves."""

import dataclasses

import numpy as np
import pytest

from sweepmill.operators import fusion, voxel
from sweepmill.plans import reconstruct


def cloud(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, *map(float, p), float(w)) for i, (p, w) in enumerate(zip(rng.uniform(-3, 3, (n, 3)), rng.integers(1, 5, n), strict=True))]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, w double")


def rows(df):
    return sorted((r["vx"], r["vy"], r["vz"], round(r["x"], 9), round(r["y"], 9), round(r["z"], 9), r["w"]) for r in df.collect())


def test_any_batching_gives_one_map(spark, tmp_path):
    points = cloud(spark, 2000)
    want = rows(voxel.merge_sums(voxel.sums_by_cell(points, 0.5)))
    for n, fanout in ((1, 8), (9, 2), (5, 4)):
        store = fusion.FusionStore(spark, f"{tmp_path}/{n}", 0.5, fanout=fanout)
        for b in range(n):
            assert store.add(str(b), points.where(points["id"] % n == b))
        assert rows(store.cloud()) == want
        assert all(len(level) < fanout for level in store.levels)
        listed = {p.name for p in (tmp_path / str(n)).glob("run_*")}
        assert listed == set(store.runs())


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    points = cloud(spark, 900, 1)
    part = lambda b: points.where(points["id"] % 6 == b)
    store = fusion.FusionStore(spark, f"{tmp_path}/map", 0.5, fanout=3)
    for b in range(3):
        store.add(str(b), part(b))
    # Stopped between a batch's run and the list of runs.
    with monkeypatch.context() as m:
        m.setattr(fusion.FusionStore, "_save", lambda self: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            store.add("3", part(3))
    again = fusion.FusionStore(spark, f"{tmp_path}/map", 0.5, fanout=3)
    assert again.done == ["0", "1", "2"]
    assert [again.add(str(b), part(b)) for b in range(6)] == [False] * 3 + [True] * 3
    assert rows(again.cloud()) == rows(voxel.merge_sums(voxel.sums_by_cell(points, 0.5)))
    with pytest.raises(ValueError):
        fusion.FusionStore(spark, f"{tmp_path}/map", 0.25)
    with pytest.raises(ValueError):
        fusion.FusionStore(spark, f"{tmp_path}/none", 0.5).cloud()


def test_products_fused_in_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([("c", s, s * 100 + i % 90, *map(float, rng.uniform(1, 5, 3))) for s in range(7) for i in range(120)], "capture string, scan_index long, stamp long, x double, y double, z double")
    poses = spark.createDataFrame([("c", t, t / 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for t in range(0, 1001, 50)], "capture string, stamp long, x double, y double, z double, qx double, qy double, qz double, qw double")
    o = reconstruct.Options(lidar_map_voxel=0.5, isolation_radius=0.0, edge_plane_denoise=False, denoise_std=0.0)
    whole = rows(reconstruct.lidar_map(points, poses, o))
    batched = dataclasses.replace(o, fusion_batch_scans=3)
    assert rows(reconstruct.fuse_in_batches(spark, points, poses, f"{tmp_path}/store", batched)) == whole
    report = reconstruct.reconstruct(spark, points, poses, f"{tmp_path}/out", batched)
    assert report["voxels"] == len(whole) == report["kept"]
