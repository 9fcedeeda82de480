"""The small files of a capture and the products: calibration, image lists, point clouds, trajectories, reports."""

from __future__ import annotations

import json
import re
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import series

# The layout of a preview cloud's records, the columns of a trajectory, the name of the capture format.
PLY_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
TRAJECTORY = "index long, lidar_stamp_ns long, x double, y double, z double, icp_fitness double, icp_rmse double, projected long, valid_points long, accepted int, reason string"
FORMAT = "windows_lio_raw_v3"


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str | bytes) -> None:
    """A small file, written beside its place and renamed over it in one step, in any store that Spark writes: readers
    meet the old file or the new one."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = hadoop.Path(path), hadoop.Path(f"{path}.tmp")
    out = target.getFileSystem(conf).create(beside, True)
    out.write(bytearray(text.encode() if isinstance(text, str) else text))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    whole = target.getFileSystem(conf).makeQualified(target)
    hadoop.FileContext.getFileContext(whole.toUri(), conf).rename(whole.getFileSystem(conf).makeQualified(beside), whole, over)


def swap_in(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder `new` at path; what was there stands aside as `path`.previous until that has worked, and comes back
    if it does not."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    fresh, target, old = (hadoop.Path(p) for p in (new, path, f"{path}.previous"))
    store = target.getFileSystem(conf)
    store.delete(old, True)
    had = store.exists(target) and store.rename(target, old)
    if not store.rename(fresh, target):
        if had:
            store.rename(old, target)
        raise OSError(f"cannot rename to {path}")
    store.delete(old, True)


def check_capture(spark: SparkSession, path: str) -> None:
    """Raise unless the capture is complete and of the known format."""
    marker = read_text(spark, f"{path}/LONG_CAPTURE_COMPLETE.json")
    if json.loads(marker).get("format") != FORMAT:
        raise ValueError(f"not a {FORMAT} capture: {path}")


# ---------------------------------------------------------------- calibration

_MISSING = object()


def yaml_array(text: str, key: str) -> list[float]:
    found = re.search(rf"{re.escape(key)}[^\[]*\[([^\]]*)\]", text)
    return [float(v) for v in re.split(r"[,\s]+", found[1].strip()) if v] if found else []


def yaml_scalar(text: str, key: str, default=_MISSING) -> float:
    found = re.search(rf"^\s*{re.escape(key)}\s*:\s*([-+0-9.eE]+)", text, re.M)
    if not found and default is _MISSING:
        raise ValueError(f"missing {key}")
    return float(found[1]) if found else default


def yaml_flag(text: str, key: str) -> bool:
    return bool(re.search(rf"^\s*{re.escape(key)}\s*:\s*(true|1|yes)\b", text, re.M | re.I))


def calibration(text: str, camera: str | None = None) -> dict:
    """Extrinsics and map settings of the LiDAR's file, and the camera's intrinsics if there are any."""
    # The keys of the files, and the ranges that they are held to.
    out = {k: yaml_array(text, k) for k in ("extrinsic_R", "extrinsic_T", "Rcl", "Pcl")}
    if any(len(out[k]) != n for k, n in (("extrinsic_R", 9), ("extrinsic_T", 3), ("Rcl", 9), ("Pcl", 3))):
        raise ValueError("incomplete extrinsics")
    voxel, flat = yaml_scalar(text, "voxel_size", 0.5), yaml_scalar(text, "min_eigen_value", 0.0025)
    out |= {"voxel_size": voxel if 0.05 < voxel <= 5 else 0.5, "min_eigen_value": flat if flat > 0 else 0.0025}
    out |= {k: yaml_scalar(text, k, 0.0) for k in ("img_time_offset", "imu_time_offset")}
    if camera:
        out |= {k: yaml_scalar(camera, k) for k in ("fx", "fy", "cx", "cy")} | {k: yaml_scalar(camera, k, 0.0) for k in ("d0", "d1", "d2", "d3")}
        out["d4"] = yaml_scalar(camera, "k3", yaml_scalar(camera, "d4", 0.0))
    return out


def imu_initialization(text: str) -> dict | None:
    """Biases and gravity that an earlier run measured standing still; None unless it says `valid` and is complete."""
    vectors = {k: yaml_array(text, k) for k in ("gyro_bias_rad_s", "accel_mean_m_s2", "gravity_body_m_s2")}
    if not yaml_flag(text, "valid") or any(len(v) != 3 for v in vectors.values()):
        return None
    scalars = ("duration_s", "sample_count", "accel_scale_to_m_s2", "gyro_std_norm_rad_s", "accel_norm_std_m_s2")
    return vectors | {k: yaml_scalar(text, k, 1.0 if k == "accel_scale_to_m_s2" else 0.0) for k in scalars}


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """receive_stamp_ns, image_stamp_ns, image_file of rgb_frames.csv, without malformed rows and without images that
    are missing or of 16 bytes and less."""
    listed = spark.read.csv(f"{path}/rgb_frames.csv", header=True, mode="DROPMALFORMED")
    rows = listed.select(*[F.expr(f"try_cast({c} AS BIGINT)").alias(c) for c in ("receive_stamp_ns", "image_stamp_ns")], "image_file").dropna()
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 16").select(F.element_at(F.split("path", "/"), -1).alias("_name"))
    return rows.join(there.distinct(), F.element_at(F.split("image_file", "[/\\\\]"), -1) == F.col("_name"), "left_semi")


# ---------------------------------------------------------------- clouds


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, z, red, green, blue of binary point clouds with exactly these properties."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                head, mark, body = bytes(content).partition(b"end_header\n")
                count = re.search(rb"element vertex (\d+)", head)
                if not mark or b"format binary_little_endian" not in head or not count:
                    raise ValueError(f"not a binary point cloud: {file}")
                rows = np.frombuffer(body, dtype=PLY_POINT, count=int(count[1]))
                for at in range(0, len(rows), 100_000):
                    part = rows[at : at + 100_000]
                    yield pd.DataFrame({n: part[n].astype(np.float32 if n in "xyz" else np.int32) for n in PLY_POINT.names}).assign(file=file)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, x float, y float, z float, red int, green int, blue int")


# The layout of a fused chunk's header and records, little endian.
CHUNK_HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("count", "<u8")])
CHUNK_POINT = np.dtype([*[(n, "<f4") for n in ("x", "y", "z", "red", "green", "blue")], ("w", "<u8")])
CHUNK_MOST = 100_000_000


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, z, red, green, blue, w of fused chunks that another program wrote; raises on a broken header."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                head = np.frombuffer(content, dtype=CHUNK_HEAD, count=1)[0] if len(content) >= CHUNK_HEAD.itemsize else None
                if head is None or head["magic"] != b"VXF1" or head["version"] != 1 or head["count"] > CHUNK_MOST:
                    raise ValueError(f"not a fused chunk: {file}")
                rows = np.frombuffer(content, dtype=CHUNK_POINT, count=int(head["count"]), offset=CHUNK_HEAD.itemsize)
                for at in range(0, len(rows), 100_000):
                    part = rows[at : at + 100_000]
                    yield pd.DataFrame({n: part[n].astype(np.int64 if n == "w" else np.float32) for n in CHUNK_POINT.names}).assign(file=file)

    chunks = spark.read.format("binaryFile").load(path).select("path", "content")
    return chunks.mapInPandas(run, "file string, x float, y float, z float, red float, green float, blue float, w long")


def _header(count: int, kind: str, colour: bool, normal: bool) -> str:
    fields = [f"property float {a}" for a in "xyz"]
    fields += [f"property uchar {c}" for c in ("red", "green", "blue")] if colour else []
    fields += [f"property float n{a}" for a in "xyz"] if normal else []
    return "\n".join(["ply", f"format {kind} 1.0", f"element vertex {count}", *fields, "end_header"])


def _byte(c):
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col(c) + 0.5).cast("int"))).cast("string")


def write_cloud(points: DataFrame, path: str, order=("tx", "ty", "tz")) -> int:
    """A cloud of any size as a folder of text parts that, one after the other, are one PLY file: the header, then the
    points in order of their tiles. Every part is written by its own task. The folder takes the place of an earlier one
    as a whole. Returns the number of points."""
    names = points.columns
    colour, normal = "red" in names, "nx" in names
    keys = [c for c in order if c in names]
    cols = [F.col(a).cast("float").cast("string") for a in "xyz"]
    cols += [_byte(c) for c in ("red", "green", "blue")] if colour else []
    cols += [F.col(f"n{a}").cast("float").cast("string") for a in "xyz"] if normal else []
    sorted_points = points.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else points
    spark, new = points.sparkSession, f"{path}.new"
    seen = Observation()  # the job that writes the points counts them for the header
    sorted_points.select(F.concat_ws(" ", *cols).alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(new + "/00001-points")
    count = seen.get["n"]
    spark.createDataFrame([(_header(count, "ascii", colour, normal),)], "value string").coalesce(1).write.mode("overwrite").text(new + "/00000-header")
    swap_in(spark, new, path)
    return count


def small_ply(points: DataFrame, most: int = 50_000) -> bytes:
    """A bounded binary cloud for a preview: x, y, z, red, green, blue. Raises if there are more than `most`."""
    rows = points.select("x", "y", "z", "red", "green", "blue").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} points; sample them first")
    out = np.zeros(len(rows), dtype=PLY_POINT)
    for n in PLY_POINT.names:
        out[n] = rows[n] if n in "xyz" else np.clip(np.floor(rows[n].astype(float) + 0.5), 0, 255)
    return (_header(len(rows), "binary_little_endian", True, False) + "\n").encode() + out.tobytes()


# ---------------------------------------------------------------- trajectories and reports


def read_trajectory(spark: SparkSession, path: str, accepted: bool = True) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=TRAJECTORY, escape='"')
    return rows.where("accepted = 1") if accepted else rows


def write_trajectory(rows: DataFrame, path: str) -> None:
    """CSV in order of the index; reasons are quoted where they need it."""
    names = [part.split()[0] for part in TRAJECTORY.split(", ")]
    rows.select(*names).repartitionByRange("index").sortWithinPartitions("index").write.mode("overwrite").csv(path, header=True, escape='"')


def grid_step(span: float, lines: int = 8) -> float:
    """The 1, 2 or 5 times a power of ten that divides span into about `lines` parts."""
    raw = max(span, 1e-9) / lines
    power = 10.0 ** np.floor(np.log10(raw))
    return float(power * next((m for m in (1, 2, 5) if m * power >= raw), 10))


def trajectory_svg(rows: DataFrame, most: int = 6000, width: int = 1000, title: str = "Trajectory") -> str:
    """A drawing of the accepted positions seen from above; about `most` of them and the last, evenly spaced in order."""
    ok = rows.where("accepted = 1")
    box = ok.agg(*[f(a).alias(f"{a}{n}") for a in "xy" for n, f in ((0, F.min), (1, F.max))], F.count("*").alias("n")).first()
    if not box["n"]:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="100"><text x="10" y="50">no accepted poses</text></svg>'
    points = sorted(tuple(r) for r in series.thinned_line(ok.select("index", "x", "y"), "index", most).collect())
    span = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-6)
    scale, step = (width - 80) / span, grid_step(span)
    at = lambda x, y: (40 + (x - box["x0"]) * scale, 40 + (box["y1"] - y) * scale)
    high = int(80 + (box["y1"] - box["y0"]) * scale)
    lines = []
    for i in range(int(span / step) + 1):
        (gx, _), (_, gy) = at(box["x0"] + i * step, box["y0"]), at(box["x0"], box["y0"] + i * step)
        lines += [f'<line x1="{gx:.1f}" y1="40" x2="{gx:.1f}" y2="{high - 40}" stroke="#ddd"/>', f'<line x1="40" y1="{gy:.1f}" x2="{width - 40}" y2="{gy:.1f}" stroke="#ddd"/>']
    drawn = " ".join("{:.1f},{:.1f}".format(*at(x, y)) for _, x, y in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{high}">{"".join(lines)}<polyline fill="none" stroke="#06c" points="{drawn}"/><text x="40" y="25">{escape(title)} (grid {step:g} m)</text></svg>'


def quality_svg(rows: DataFrame, width: int = 1000, panel: int = 160) -> str:
    """Fitness, rmse and points of all scans as three panels, rejected scans marked. Scans that fall on one pixel are
    one value, their mean; rejected ones among them are marked at their own, so none is left out."""
    names = ("icp_fitness", "icp_rmse", "valid_points")
    box = rows.agg(F.min("index").alias("i0"), F.max("index").alias("i1")).first()
    if box["i0"] is None:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="100"><text x="10" y="50">no scans</text></svg>'
    inner, span = width - 80, max(1, box["i1"] - box["i0"])
    clean = lambda n: F.when(F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(F.col(n).cast("double"))
    pixel = F.floor((F.col("index") - box["i0"]) * inner / span).alias("p")
    values = rows.select(pixel, (F.col("accepted") == 0).alias("bad"), *[clean(n).alias(n) for n in names])
    per = values.groupBy("p").agg(*[F.avg(n).alias(n) for n in names], F.count_if("bad").alias("bad"), *[F.avg(F.when(F.col("bad"), F.col(n))).alias(f"bad_{n}") for n in names])
    drawn, body = sorted(per.collect(), key=lambda r: r["p"]), []
    for k, name in enumerate(names):
        top, low = max([*[r[name] for r in drawn], *[r[f"bad_{name}"] or 0.0 for r in drawn], 1e-9]), 30 + (k + 1) * panel - 20
        at = lambda r, v: (40 + r["p"], low - (panel - 50) * v / top)
        line = " ".join("{:.1f},{:.1f}".format(*at(r, r[name])) for r in drawn)
        marks = "".join('<circle cx="{:.1f}" cy="{:.1f}" r="2" fill="#c00"/>'.format(*at(r, r[f"bad_{name}"])) for r in drawn if r["bad"])
        body.append(f'<text x="40" y="{low - panel + 35}">{name} (max {top:.4g})</text><polyline fill="none" stroke="#06c" points="{line}"/>{marks}')
    rejected = sum(r["bad"] for r in drawn)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{3 * panel + 60}">{"".join(body)}<text x="40" y="{3 * panel + 50}">{rejected} scans rejected</text></svg>'


def stats_json(stats: DataFrame) -> str:
    """A table of one row as indented JSON."""
    return json.dumps(json.loads(stats.toJSON().first()), indent=2, sort_keys=True)
