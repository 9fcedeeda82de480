"""Motion between scans: predictions, gates on turns, corrections of a solved graph, deskewing; all column expressions
and windows by capture."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import rotations as r
from ..functions.rotations import Pose
from . import pieces, scans


def constant_velocity(before: Pose, now: Pose, ratio: Column, most: float = 3.0) -> Column:
    """The pose (a struct) after `ratio` times (0 to `most`) the interval from `before` to `now`, at the same speed and turn."""
    share = F.least(F.lit(most), F.greatest(F.lit(0.0), ratio))
    place = [q + share * (q - p) for p, q in zip(before.position, now.position, strict=True)]
    part = r.let(r.turn(r.multiply(now.rotation, r.conjugate(before.rotation))), lambda t: r.turn(r.power(r.turn_of(t), share)))
    return r.let(part, lambda t: Pose(*place, *r.multiply(r.turn_of(t), now.rotation)).packed())


def gyro_seed(seed: Column, last: Pose, turned, mounting) -> Column:
    """`seed` (a pose struct) with the rotation that the gyro measured since the last pose. turned: that rotation in the
    sensor's frame, null if it is unknown, when the last rotation stays; mounting: of the LiDAR in the sensor's frame."""
    half = r.let(r.turn(r.multiply(r.conjugate(mounting), turned)), lambda t: r.turn(r.multiply(r.turn_of(t), mounting)))
    rotation = r.let(half, lambda t: r.turn([F.coalesce(a, b) for a, b in zip(r.multiply(last.rotation, r.turn_of(t)), last.rotation, strict=True)]))
    return r.let(rotation, lambda t: Pose(*[seed[n] for n in "xyz"], *r.turn_of(t)).packed())


def turn_reason(found: Pose, predicted: Pose, most: float = 8.0) -> Column:
    """"accepted", or why a registered rotation is too far from the predicted one."""
    turn = r.degrees(r.multiply(found.rotation, r.conjugate(predicted.rotation)))
    text = F.format_string("rotation correction %.3f deg above IMU gate %.3f deg", turn, F.lit(most))
    return F.when(F.isnan(turn) | turn.isNull() | (turn > most), text).otherwise("accepted")


def recovered(found: Pose, predicted: Pose, shift: float = 2.0, turn: float = 20.0) -> Column:
    """Whether a registration against the whole map may bring back a lost scan."""
    moved = r.length([a - b for a, b in zip(found.position, predicted.position, strict=True)])
    return F.coalesce((moved <= shift) & (r.degrees(r.multiply(found.rotation, r.conjugate(predicted.rotation))) <= turn), F.lit(False))


def graph_reasons(frames: DataFrame, capture: str, order: str, shift: float = 0.30, turn: float = 6.0, local: float = 0.20, local_turn: float = 4.0, width: int = 100_000) -> DataFrame:
    """frames (capture, order, before, after: pose structs) with jump, jump_turn (of the correction, from the keyframe
    before to this one), change, change_turn (of the step between them) and reason, null where the graph is sound. width: of pieces."""
    before, after = r.pose_of("before"), r.pose_of("after")
    kept = frames.withColumn("_fix", r.compose(after, r.invert(before)).packed())
    kept = pieces.lagged(kept, [capture], [order], width, {f"_{c.strip('_')}1": c for c in ("_fix", "before", "after")})
    jump = r.compose(r.pose_of("_fix"), r.invert(r.pose_of("_fix1")))
    step = lambda a, b: r.compose(r.invert(r.pose_of(a)), r.pose_of(b))
    change = r.compose(r.invert(step("before", "_before1")), step("after", "_after1"))
    seen = kept.select(
        *frames.columns, r.length(jump.position).alias("jump"), r.degrees(jump.rotation).alias("jump_turn"),
        r.length(change.position).alias("change"), r.degrees(change.rotation).alias("change_turn"),
        F.col("_fix1").isNotNull().alias("_later"), sum((F.col(f"after.{n}") for n in Pose._fields[1:]), F.col("after.x")).alias("_all"),
    )
    bad = lambda a, m, b, n: (F.col(a) > m) | F.isnan(a) | (F.col(b) > n) | F.isnan(b)
    reason = (
        F.when(F.col("_all").isNull() | F.isnan("_all") | (F.abs("_all") == float("inf")), "non-finite optimized pose")
        .when(F.col("_later") & bad("jump", shift, "jump_turn", turn), "correction discontinuity")
        .when(F.col("_later") & bad("change", local, "change_turn", local_turn), "local odometry deformation")
    )
    return seen.select("*", reason.alias("reason")).drop("_later", "_all")


def corrected(scans: DataFrame, keys: DataFrame, capture: str, order: str, width: int = 100_000) -> DataFrame:
    """scans (capture, order, pose: a struct) with `corrected`: the pose after the correction of the keyframes around it,
    blended by how far between them it lies; held before the first and after the last. keys: capture, order, solved (a
    struct) of some of the scans. width: of pieces."""
    fixed = scans.join(keys.select(capture, order, "solved"), [capture, order], "left")
    fix = F.when(F.col("solved").isNotNull(), F.struct(F.col(order).alias("at"), r.compose(r.pose_of("solved"), r.invert(r.pose_of("pose"))).packed().alias("fix")))
    w, line = pieces.inside([order]), pieces.line([capture])
    marked = pieces.cut(fixed.withColumn("_fix", fix), [capture], [order], width)
    known = F.when(F.col("_fix").isNotNull(), F.col(order))
    ends = marked.groupBy(pieces.AT).agg(F.min_by("_fix", known).alias("_head"), F.max_by("_fix", known).alias("_tail"))
    marked = marked.select(
        "*", F.last("_fix", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_left"),
        F.first("_fix", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_right"),
    )
    past, coming = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    marked = pieces.told(marked, ends, _past=F.last("_tail", ignorenulls=True).over(past), _coming=F.first("_head", ignorenulls=True).over(coming))
    marked = marked.withColumns({"_left": F.coalesce("_left", "_past"), "_right": F.coalesce("_right", "_coming")})
    span = F.col("_right.at") - F.col("_left.at")
    share = F.when(span > 0, (F.col(order) - F.col("_left.at")) / span).otherwise(0.0)
    left, right = F.coalesce("_left", "_right"), F.coalesce("_right", "_left")
    by = r.between(r.pose_of(left["fix"]), r.pose_of(right["fix"]), share)
    whole = r.let(by, lambda fix: r.compose(r.pose_of(fix), r.pose_of("pose")).packed())
    return marked.select(*scans.columns, F.when(left.isNotNull(), whole).alias("corrected"))


def to_scan_end(v: Column, at: Pose, end: Pose, mounting: Pose | None = None) -> Column:
    """A LiDAR point v (a struct), taken when the sensor stood at `at`, in the LiDAR's frame at the scan's end. mounting:
    of the LiDAR in the sensor's frame."""
    v = r.inward(end, r.outward(at, r.outward(mounting, v) if mounting else v))
    return r.inward(mounting, v) if mounting else v


def to_scan_start(v: Column, turned, mounting: Pose | None = None, share: Column | None = None, moved=None) -> Column:
    """A LiDAR point v (a struct) in the LiDAR's frame at the scan's start, from the sensor's turn since then alone; with
    the scan's own motion `moved` (in that frame) in proportion to `share`, the part of the scan that has passed."""
    nowhere = [F.lit(0.0)] * 3
    v = r.outward(Pose(*nowhere, *turned), r.outward(mounting, v) if mounting else v)
    v = r.inward(mounting, v) if mounting else v
    if moved is None:
        return v
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    return r.let(v, lambda p: r.point(*[p[n] + part * c for n, c in zip("xyz", moved, strict=True)]))


def _parts(q, share: np.ndarray) -> tuple[np.ndarray, ...]:
    """rotations.power of arrays."""
    sine = np.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    half = np.arctan2(sine, np.abs(q[3])) * share
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(sine > 1e-12, np.where(q[3] < 0, -1.0, 1.0) * np.sin(half) / sine, 0.0)
    return (q[0] * scale, q[1] * scale, q[2] * scale, np.cos(half))


def deskewed(points: DataFrame, start: Pose, end: Pose, share: Column, v, mounting: tuple[float, ...], moved: tuple[float, ...], keep: list[str] | None = None) -> DataFrame:
    """points (or their columns `keep`) with ex ey ez and sx sy sz, what to_scan_end and to_scan_start say of LiDAR points v (three columns) that were
    taken a part `share` of the way from one pose to the other, for clouds of many points: batches of them in numpy, by the same
    steps, where Spark would interpret the nested lambdas row by row. Null where an input is."""
    inputs = [share, *start, *end, *v]
    own, names = keep or points.columns, [f"_{i}" for i in range(len(inputs))]
    out = ["ex", "ey", "ez", "sx", "sy", "sz"]
    carried, turn = mounting[:3], mounting[3:]

    def outward(place, q, p):
        return [a + b for a, b in zip(r.rotate(q, p), place, strict=True)]

    def inward(place, q, p):
        return r.rotate(r.conjugate(q), [a - b for a, b in zip(p, place, strict=True)])

    def run(batches):
        for b in batches:
            missing = np.zeros(b.num_rows, dtype=bool)
            for n in names:
                if b[n].null_count:
                    missing |= b[n].is_null().to_numpy(zero_copy_only=False)
            values = [b[n].to_numpy(zero_copy_only=False).astype(np.float64) for n in names]
            share, a, c, v = values[0], values[1:8], values[8:15], values[15:]
            q = r.multiply(_parts(r.multiply(c[3:], r.conjugate(a[3:])), share), a[3:])
            held = outward(carried, turn, v)
            world = outward([x + share * (y - x) for x, y in zip(a[:3], c[:3], strict=True)], q, held)
            ends = inward(carried, turn, inward(c[:3], c[3:], world))
            first = inward(carried, turn, outward((0.0, 0.0, 0.0), r.multiply(r.conjugate(a[3:]), q), held))
            passed = np.fmin(1.0, np.maximum(0.0, share))
            results = [*ends, *[x + passed * m for x, m in zip(first, moved, strict=True)]]
            yield pa.RecordBatch.from_arrays([*[b[n] for n in own], *[pa.array(x, mask=missing) for x in results]], names=[*own, *out])

    schema = StructType([*[points.schema[n] for n in own], *[StructField(n, DoubleType()) for n in out]])
    return points.select(*own, *[c.cast("double").alias(n) for c, n in zip(inputs, names, strict=True)]).mapInArrow(run, schema)


#: Points that a task of enough_points holds, about.
PER_TASK = 2_000_000


def enough_points(points: DataFrame, by: list[str], least: int = 100, accepted: DataFrame | None = None, per_task: int = PER_TASK) -> DataFrame:
    """The points of scans that have at least `least` of them and, if given, are among the `accepted` (by).

    Points are dealt by scan once, over so many tasks that one holds about `per_task` of them, and are counted and met there."""
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // per_task))
    dealt = points.repartition(tasks, *by)
    full = dealt.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    if accepted is not None:
        full = full.join(accepted.select(*by).repartition(tasks, *by), by, "left_semi")
    return dealt.join(full, by, "left_semi")


def last_frames(points: DataFrame, by: list[str], frame: str, most: int = 12) -> DataFrame:
    """The points of the last `most` frames of each key."""
    w = Window.partitionBy(*by).orderBy(F.col(frame).desc())
    kept = points.select(*by, frame).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    return points.join(kept, [*by, frame], "left_semi")


def refined(scans: DataFrame, found: DataFrame, by: list[str], good: Column) -> DataFrame:
    """scans (by, pose, fitness, rmse) with those of `found`, a registration of the scans against the finished map, where
    it is `good` (an expression over found's columns), and whether it was (`refined`)."""
    new = found.where(good).select(*by, *[F.col(c).alias(f"_{c}") for c in ("pose", "fitness", "rmse")], F.lit(True).alias("_ok"))
    joined = scans.join(new, by, "left")
    rest = [c for c in scans.columns if c not in ("pose", "fitness", "rmse")]
    ok = F.coalesce("_ok", F.lit(False))
    return joined.select(*rest, *[F.when(ok, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("pose", "fitness", "rmse")], ok.alias("refined"))


# ---------------------------------------------------------------- gyro


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of n x 4 unit quaternions."""
    v = a[:, 3:] * b[:, :3] + b[:, 3:] * a[:, :3] + np.cross(a[:, :3], b[:, :3])
    w = a[:, 3] * b[:, 3] - (a[:, :3] * b[:, :3]).sum(axis=1)
    out = np.concatenate([v, w[:, None]], axis=1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _turns(rates: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Quaternions of turning at n x 3 rates for the seconds."""
    v = rates * seconds[:, None]
    angle = np.linalg.norm(v, axis=1, keepdims=True)
    return np.concatenate([v * np.where(angle > 1e-12, np.sin(angle / 2) / np.maximum(angle, 1e-12), 0.5), np.cos(angle / 2)], axis=1)


def integrate_gyro(samples: DataFrame, capture: str, longest: float = 0.05) -> DataFrame:
    """capture, stamp and the attitude (qx qy qz qw) integrated from samples (capture, stamp in ns, gx, gy, gz in rad/s)
    by the trapezoid rule, from identity; gaps count as at most `longest` seconds. Samples of one time are ordered by
    their rates.

    Rotations multiply in order but group freely, so this is a scan: captures of any length, many to a batch."""
    rates, names = ["gx", "gy", "gz"], ["qx", "qy", "qz", "qw"]

    def turn(before: dict, now: dict) -> np.ndarray:
        mean = np.stack([(before[n] + now[n]) / 2 for n in rates], axis=1)
        return _turns(mean, np.clip((now["stamp"] - before["stamp"]) / 1e9, 0, longest))

    rows = samples.select(capture, F.col("stamp").cast("long").alias("stamp"), *[F.col(n).cast("double").alias(n) for n in rates])
    return scans.scan(rows, [capture], ["stamp", *rates], ["stamp", *rates], turn, _product, names).select(capture, "stamp", *names)
