"""Live mode: an ordered fold of each capture's samples, and previews that readers can trust at any moment."""

from __future__ import annotations

import json
import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import series
from ..session import settings
from ..sources import files

log = logging.getLogger(__name__)
RESULT = "capture long, n long, length double, x double, y double, t long"
SETTLED = "n long, length double, x double, y double, t long"
SAMPLE = np.dtype([("t", "<i8"), ("x", "<f8"), ("y", "<f8")])
#: Spark takes rows at or before 1970 as late from the start, so event times lie this many microseconds after t: recordings
#: whose clock starts at 0 count whole.
AHEAD = 1 << 50
#: The state of transformWithState is kept in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SLOTS = 3
TRAJECTORY_ROWS = 6000  # of a preview, at even strides over the whole trajectory, and its last row


def extended(path: tuple | None, samples: np.ndarray) -> tuple:
    """A path (n, length, x, y, t), or none yet, gone on through samples that are in order."""
    n, length, *last = path or (0, 0.0, None, None, None)
    if len(samples):
        xs, ys = (samples[c] if v is None else np.concatenate(([v], samples[c])) for c, v in zip("xy", last, strict=False))
        length += float(np.hypot(np.diff(xs), np.diff(ys)).sum())
        last = [float(xs[-1]), float(ys[-1]), int(samples["t"][-1])]
    return (n + len(samples), length, *last)


class PathFold(StatefulProcessor):
    """The path of a capture: `settled` is what lies behind the watermark, one short row; `waiting` are the samples that
    later ones may still precede, packed a batch to an element. A timer of event time settles what the watermark has passed,
    so the state of a capture holds no more samples than fit in the lateness allowed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.waiting = handle.getListState("waiting", "samples binary")

    def _path(self) -> tuple | None:
        return tuple(self.settled.get()) if self.settled.exists() else None

    def _samples(self) -> np.ndarray:
        packed = [np.frombuffer(bytes(row[0]), SAMPLE) for row in self.waiting.get()] if self.waiting.exists() else []
        return np.sort(np.concatenate(packed), order=["t", "x", "y"]) if packed else np.empty(0, SAMPLE)

    def _settle_after(self, t: int) -> None:
        self.handle.registerTimer(-(-(t + AHEAD) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            new = np.empty(len(pdf), SAMPLE)
            for c in SAMPLE.names:
                new[c] = pdf[c]
            self.waiting.appendValue((new.tobytes(),))
        samples = self._samples()
        if next(iter(self.handle.listTimers()), None) is None:
            self._settle_after(int(samples["t"][0]))
        yield pd.DataFrame([(key[0], *extended(self._path(), samples))], columns=["capture", "n", "length", "x", "y", "t"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        samples = self._samples()
        passed = int(np.searchsorted(samples["t"], timerValues.getCurrentWatermarkInMs() * 1000 - AHEAD, side="right"))
        if passed:
            self.settled.update(extended(self._path(), samples[:passed]))
        self.waiting.clear()
        if passed < len(samples):
            self.waiting.appendValue((samples[passed:].tobytes(),))
            self._settle_after(int(samples["t"][passed]))
        return iter(())

    def close(self) -> None:
        pass


def fold_paths(samples: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """capture, and so far: n samples, length of the path through x, y, last x, y, t. A stream of capture, t (microseconds),
    x, y.

    Samples may come out of order: the path is the one through all of them in order of t, x, y, as long as none is more than
    `lateness` behind the latest one of the batches before; those that are, Spark leaves out, of n too. Samples without
    capture, time or place are left out. Each batch updates the captures it has samples of."""
    known = samples.select("capture", F.timestamp_micros(F.col("t") + AHEAD).alias("at"), "t", "x", "y").dropna().withWatermark("at", lateness)
    return known.groupBy("capture").transformWithStateInPandas(PathFold(), RESULT, "Update", "EventTime")


def publish_preview(spark: SparkSession, folder: str, batch: int, cloud: DataFrame, trajectory: DataFrame, phase: str, processed: int, total: int) -> None:
    """One snapshot: the cloud and the trajectory go to one of three slots in turn, and the state file, written last,
    names them. A reader that follows the state file never meets a half-written snapshot."""
    slot = batch % SLOTS
    # The names of the files of a preview and of the keys of its state, which viewers read.
    names = {"cloud_file": f"preview_{slot}.ply", "trajectory_file": f"trajectory_{slot}.csv"}
    files.write_text(spark, f"{folder}/{names['cloud_file']}", files.small_ply(cloud))
    rows = series.thinned_line(trajectory, "scan_index", TRAJECTORY_ROWS).orderBy("scan_index").collect()
    lines = ["scan_index,stamp_ns,x,y,z,fitness,rmse,accepted"] + [",".join(str(r[c]) for c in ("scan_index", "stamp_ns", "x", "y", "z", "fitness", "rmse", "accepted")) for r in rows]
    files.write_text(spark, f"{folder}/{names['trajectory_file']}", "\n".join(lines) + "\n")
    state = {"snapshot": batch, **names, "phase": phase, "processed": processed, "total": total, "progress_percent": round(100.0 * processed / max(1, total), 3), "points": cloud.count()}
    files.write_text(spark, f"{folder}/preview_state.json", json.dumps(state))


def publish_pose(spark: SparkSession, folder: str, row, phase: str) -> bool:
    """The latest pose (scan_index, stamp_ns, x, y, z, accepted) as a small file of its own. A preview never stops the
    work it shows: whether it was written is told, not raised."""
    pose = {n: row[n] for n in ("scan_index", "stamp_ns", "x", "y", "z")} | {"accepted": bool(row["accepted"]), "phase": phase}
    return _published(spark, f"{folder}/preview_pose.json", pose)


def publish_error(spark: SparkSession, folder: str, message: str) -> bool:
    """What went wrong, for the viewer."""
    return _published(spark, f"{folder}/preview_error.json", {"phase": "failed", "message": message})


def _published(spark: SparkSession, path: str, content: dict) -> bool:
    try:
        files.write_text(spark, path, json.dumps(content, indent=2) + "\n")
    except Exception as failure:  # whatever the store raises through the gateway
        log.warning("preview not written: %s", failure)
        return False
    return True


def _signature(spark: SparkSession, path: str) -> tuple[int, int]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    return status.getModificationTime(), status.getLen()


def read_snapshot(spark: SparkSession, folder: str, tries: int = 100) -> dict:
    """The state of the last complete snapshot; file names must be bare. Read again if the state changed meanwhile; raises
    if it changed in each of `tries` reads."""
    path = f"{folder}/preview_state.json"
    for _ in range(tries):
        before = _signature(spark, path)
        state = json.loads(files.read_text(spark, path))
        if _signature(spark, path) == before:
            break
    else:
        raise TimeoutError(f"{path} changes faster than it can be read")
    for name in (state["cloud_file"], state["trajectory_file"]):
        if "/" in name or "\\" in name or name.startswith("."):
            raise ValueError(f"not a bare file name: {name}")
    return state


def run_to_end(stream: DataFrame, sink, checkpoint: str) -> None:
    """Process what a stream holds now, batch by batch; sink(batch rows, batch number). With the checkpoint of an earlier
    run it goes on where that one stopped."""
    with settings(stream.sparkSession, STORE):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each capture, of the rows that the fold has emitted."""
    return updates.groupBy("capture").agg(F.max_by(F.struct("length", "x", "y", "t"), "n").alias("s"), F.max("n").alias("n")).select("capture", "n", "s.*")
