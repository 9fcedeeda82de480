"""Live state and previews that are followed."""

import json

import numpy as np

from sweepmill.streaming import follow, live

SCHEMA = "capture long, t long, x double, y double"
SECOND = 1_000_000


def plain(rows):
    """The fold by hand: capture -> n, length, t."""
    out = {}
    for capture in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == capture)
        out[capture] = (len(own), round(float(sum(np.hypot(b[1] - a[1], b[2] - a[2]) for a, b in zip(own, own[1:], strict=False))), 6), own[-1][0])
    return out


def run(spark, folder, checkpoint, updates, lateness):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)

    def sink(rows, batch):
        updates.extend(tuple(r) for r in rows.collect())

    live.run_to_end(live.fold_paths(stream, lateness), sink, checkpoint)


def newest(updates):
    best = {}
    for r in updates:
        best[r[0]] = max(best.get(r[0], r), r, key=lambda u: u[1])
    return {k: (r[1], round(r[2], 6), r[5]) for k, r in best.items()}


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_fold_survives_disorder_restarts_and_late_rows(spark, tmp_path):
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/check"
    first = [(c, s * SECOND, float(s * c), 1.0) for c in (1, 2) for s in range(0, 40, 2)]
    between = [(1, s * SECOND, float(-s), 2.0) for s in range(31, 41, 2)]  # out of order, in time
    write(spark, folder, first)
    updates = []
    run(spark, folder, checkpoint, updates, "20 seconds")
    assert newest(updates) == plain(first)
    write(spark, folder, between)
    run(spark, folder, checkpoint, updates, "20 seconds")  # a second run goes on from the checkpoint
    assert newest(updates) == plain(first + between)
    far = [(1, 200 * SECOND, 5.0, 5.0), (3, 201 * SECOND, 0.0, 0.0)]
    write(spark, folder, far)
    run(spark, folder, checkpoint, updates, "20 seconds")
    write(spark, folder, [(1, 100 * SECOND, 9.0, 9.0), (2, 220 * SECOND, 7.0, 7.0)])  # the first is too late
    run(spark, folder, checkpoint, updates, "20 seconds")
    assert newest(updates) == plain(first + between + far + [(2, 220 * SECOND, 7.0, 7.0)])


def test_fold_leaves_out_rows_without_time_or_place(spark, tmp_path):
    rows = [(1, 5, 0.0, 0.0), (1, None, 1.0, 1.0), (1, 6, None, 1.0), (None, 7, 1.0, 1.0), (1, 7, 3.0, 4.0), (1, 7, 3.0, 4.0)]
    write(spark, f"{tmp_path}/in", rows)
    updates = []
    run(spark, f"{tmp_path}/in", f"{tmp_path}/check", updates, "1 second")
    assert newest(updates) == {1: (3, 5.0, 7)}


def test_path_goes_on():
    samples = np.array([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 5.0)], live.SAMPLE)
    whole = live.extended(None, samples)
    assert whole == live.extended(live.extended(None, samples[:2]), samples[2:]) == (3, 6.0, 3.0, 5.0, 3)
    assert live.extended(whole, samples[:0]) == whole and live.extended(None, samples[:0]) == (0, 0.0, None, None, None)


def test_preview_is_followed(spark, tmp_path):
    spark.dataSource.register(follow.PreviewSource)
    state = {"snapshot": 0, "cloud_file": "preview_0.ply", "trajectory_file": "trajectory_0.csv", "phase": "live", "processed": 1, "total": 9, "progress_percent": 11.1, "points": 5}
    (tmp_path / "view").mkdir()
    path = tmp_path / "view" / "preview_state.json"
    query = spark.readStream.format("preview").load(f"{tmp_path}/view").writeStream.format("memory").queryName("followed").option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        query.processAllAvailable()  # no preview yet
        for n in (0, 1):
            path.write_text(json.dumps(state | {"snapshot": n, "processed": n + 1}))
            query.processAllAvailable()
        for bad in ("{", json.dumps(state | {"snapshot": 7, "cloud_file": "../x"}), json.dumps({"snapshot": 8})):
            path.write_text(bad)
            query.processAllAvailable()
        assert [tuple(r) for r in spark.table("followed").select("snapshot", "processed", "cloud_file").orderBy("snapshot").collect()] == [(0, 1, "preview_0.ply"), (1, 2, "preview_0.ply")]
    finally:
        query.stop()
