"""Registration of many clouds at once, grouped by their key: scans onto a map of planes, and pairs of clouds onto one
another from coarse to fine.

A round is the same few joins and one aggregate however many clouds there are; what leaves the JVM is one row of sums for
each cloud, whose 6 x 6 systems are solved in batches. Clouds that have converged leave the rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import stash, unstash
from . import graphs, motion, neighbours, registration, voxel

AXES = ("x", "y", "z")
UPPER = [(i, j) for i in range(6) for j in range(i, 6)]
SUMS = [f"h{i}{j}" for i, j in UPPER] + [f"g{i}" for i in range(6)]
#: Share by which a point's spread along its surface is larger than across.
FLAT = 0.999


def _at(i: int) -> Column:
    return F.element_at("pose", i + 1)


def _moved(points: DataFrame, poses: DataFrame, by: list[str], turned: tuple[str, ...] = ()) -> DataFrame:
    """points in the frame of their key's pose; columns named in `turned` are a direction."""
    pose = [[_at(4 * i + j) for j in range(4)] for i in range(3)]
    place = [c.alias(a) for c, a in zip(g.transform(*[F.col(a) for a in AXES], pose), AXES, strict=True)]
    if turned:
        place += [c.alias(a) for c, a in zip(g.transform(*[F.col(a) for a in turned], [[*r[:3], F.lit(0.0)] for r in pose]), turned, strict=True)]
    return points.join(poses.select(*by, "pose"), by).select(*by, "id", *place)


def _systems(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n x 6 x 6 matrices, n x 6 right sides and n x 4 x 4 poses of rows."""
    h = np.zeros((len(pdf), 6, 6))
    for i, j in UPPER:
        h[:, i, j] = h[:, j, i] = pdf[f"h{i}{j}"].fillna(0)
    poses = np.array(pdf["pose"].tolist(), dtype=float).reshape(len(pdf), 4, 4)
    return h, pdf[[f"g{i}" for i in range(6)]].fillna(0).to_numpy(float), poses


def _limited(step: np.ndarray, most_turn: float, most_shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps cut to the limits; how long their turns and shifts are."""
    turn, shift = (np.linalg.norm(step[:, s], axis=1) for s in (slice(0, 3), slice(3, 6)))
    out = step.copy()
    out[:, :3] *= np.minimum(1.0, most_turn / np.maximum(turn, 1e-12))[:, None]
    out[:, 3:] *= np.minimum(1.0, most_shift / np.maximum(shift, 1e-12))[:, None]
    return out, np.minimum(turn, most_turn), np.minimum(shift, most_shift)


# ---------------------------------------------------------------- scans onto planes


def _on_planes(rotation_prior: float, translation_prior: float, last: bool):
    """mapInPandas: scans with their sums -> one step on, or at rest."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                yield pdf[[c for c in pdf.columns if c not in (*SUMS, "squares", "inliers")]]
                continue
            h, gradient, poses = _systems(pdf)
            prior = np.array(pdf["prior"].tolist(), dtype=float).reshape(len(pdf), 4, 4)
            inliers, total = pdf["inliers"].fillna(0).to_numpy(float), pdf["total"].to_numpy(float)
            pdf["fitness"] = inliers / np.maximum(total, 1)
            pdf["rmse"] = np.where(inliers > 0, np.sqrt(pdf["squares"].fillna(0).to_numpy(float) / np.maximum(inliers, 1)), np.inf)
            step = ~(pdf["closing"].to_numpy(bool) | last) & (inliers >= np.maximum(60, total // 12))
            values = np.linalg.eigvalsh(h[:, 3:, 3:])
            pdf["degenerate"] = np.where(step, np.maximum(values[:, 0], 0) / np.maximum(values[:, 2], 1e-12) < 1e-3, pdf["degenerate"])
            gradient[:, :3] += rotation_prior * graphs.logs(poses[:, :3, :3] @ np.swapaxes(prior[:, :3, :3], 1, 2))
            gradient[:, 3:] += translation_prior * (poses[:, :3, 3] - prior[:, :3, 3])
            h += np.diag([rotation_prior] * 3 + [translation_prior] * 3) + 1e-6 * np.eye(6)
            moved, turn, shift = _limited(-np.linalg.solve(h, gradient[:, :, None])[:, :, 0], 0.10, 0.30)
            new = np.where(step[:, None, None], graphs.moved(poses, moved), poses)
            pdf["pose"] = new.reshape(len(pdf), 16).tolist()
            pdf["closing"] = step & (turn < 2e-5) & (shift < 5e-5)
            pdf["moving"] = step
            yield pdf[[c for c in pdf.columns if c not in (*SUMS, "squares", "inliers")]]

    return run


def register_scans(points: DataFrame, planes: DataFrame, size: float, start: DataFrame, by: list[str], rounds: int = 8, rotation_prior: float = 350.0, translation_prior: float = 4.0) -> DataFrame:
    """by, pose (16 numbers by rows), fitness, rmse, degenerate of all scans (by, id, x, y, z in the sensor's frame), each laid on the
    same planes (of voxel.planes with cells of `size`) from its predicted pose (start: by, pose). As register_to_planes does for
    one scan: the prior holds attitude firmly and position loosely, steps are limited, too few inliers end it."""
    points, cells = stash(points.select(*by, "id", *AXES), "points"), stash(neighbours.plane_cells(planes), "planes")
    totals = points.groupBy(*by).agg(F.count("*").alias("total"))
    state = start.join(totals, by, "left").select(
        *by, "pose", F.col("pose").alias("prior"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.lit(False).alias("closing"), F.lit(True).alias("moving"),
        F.lit(0.0).alias("fitness"), F.lit(float("inf")).alias("rmse"), F.lit(False).alias("degenerate"),
    )
    state = stash(state, "scans")
    for n in range(rounds + 1):
        active = state.where("moving")
        matched = neighbours.nearest_plane(_moved(points, active, by), cells, size)
        sums = registration.normal_equations(matched, by)
        stepped = active.join(sums, by, "left").mapInPandas(_on_planes(rotation_prior, translation_prior, n == rounds), state.schema)
        new = stash(stepped.unionByName(state.where("NOT moving")), "scans")
        unstash(state)
        state = new
        if not state.where("moving").take(1):
            break
    unstash(points, cells)
    return state.select(*by, "pose", "fitness", "rmse", "degenerate")


def refine_scans(scans: DataFrame, points: DataFrame, by: list[str], size: float, threshold: float = 0.0025, voxel_size: float = 0.03, least_fitness: float = 0.70, most_rmse: float = 0.18, **settings) -> DataFrame:
    """The final pass over all scans: a map of planes of all points at the scans' poses, every scan laid on it again, and the
    new pose kept where it is good and near. scans: by, pose (16 numbers), fitness, rmse; points: by, id, x, y, z in the
    sensor's frame. Adds `refined` (boolean).

    The map is that of the whole trajectory, not of the scans before each one, so scans need no order."""
    world = _moved(points, scans, by).select(*AXES)
    planes = stash(voxel.planes(world, size, threshold), "map")
    thin = voxel.centroids(points, voxel_size, by=by).select(*by, F.xxhash64(*voxel.KEY).alias("id"), *AXES)
    found = register_scans(thin, planes, size, scans.select(*by, "pose"), by, **settings)
    unstash(planes)
    old, new = (lambda i: F.element_at("_old", i + 1)), (lambda i: F.element_at("pose", i + 1))
    both = found.join(scans.select(*by, F.col("pose").alias("_old")), by)
    # The correction new * old^-1: its turn from the trace of R R', its shift t - R R' t'.
    turn = [[sum((new(4 * i + k) * old(4 * j + k) for k in (1, 2)), new(4 * i) * old(4 * j)) for j in range(3)] for i in range(3)]
    shift = [new(4 * i + 3) - sum((turn[i][j] * old(4 * j + 3) for j in (1, 2)), turn[i][0] * old(3)) for i in range(3)]
    moved, turned = g.norm(*shift), g.rotation_degrees(turn[0][0] + turn[1][1] + turn[2][2])
    both = both.withColumns({"_moved": moved, "_turned": turned})
    return motion.refined(scans, both, by, registration.good_refinement(F.col("fitness"), F.col("rmse"), F.col("_moved"), F.col("_turned"), least_fitness, most_rmse))


# ---------------------------------------------------------------- pairs, from coarse to fine


def with_normals(points: DataFrame, by: list[str], reach: float, k: int = 20, least: int = 5) -> DataFrame:
    """by, id, x, y, z and the unit normal nx, ny, nz of the fit through the k nearest points within reach (zero with fewer than
    `least`), inside clouds of equal `by`. Clouds are voxel-reduced, which bounds what lies within reach."""
    near = neighbours.within(points, points, reach, by=tuple(by))
    rank = F.row_number().over(Window.partitionBy(*by, "qid").orderBy("d2", "id"))
    fit = neighbours.fitted(near.withColumn("_r", rank).where(F.col("_r") <= k), [*by, "qid"])
    normal = [F.when(F.col("n") >= least, F.col(f"u{a}")).otherwise(0.0).alias(f"n{a}") for a in AXES]
    return points.join(fit.select(*by, F.col("qid").alias("id"), *normal), [*by, "id"]).select(*by, "id", *AXES, *[f"n{a}" for a in AXES])


def _product(a, b):
    """A product of 3 x 3 matrices of columns, None standing for zero."""
    out = []
    for i in range(3):
        row = []
        for j in range(3):
            terms = [a[i][k] * b[k][j] for k in range(3) if a[i][k] is not None and b[k][j] is not None]
            row.append(sum(terms[1:], terms[0]) if terms else None)
        out.append(row)
    return out


def plane_to_plane(matched: DataFrame, by: list[str]) -> DataFrame:
    """(by,) h00..h55, g0..g5, squares and inliers of matches: x, y, z with normal nx, ny, nz (the moved point) and tx, ty, tz with
    normal mx, my, mz (its partner). Both points are spread along their surfaces and hardly across them; a match counts
    by the inverse of the summed spreads."""
    p, d = [F.col(a) for a in AXES], [F.col(f"t{a}") - F.col(a) for a in AXES]
    one = lambda i, j: F.lit(2.0 if i == j else 0.0)
    spread = [[one(i, j) - FLAT * (F.col(f"n{AXES[i]}") * F.col(f"n{AXES[j]}") + F.col(f"m{AXES[i]}") * F.col(f"m{AXES[j]}")) for j in range(3)] for i in range(3)]
    rows = matched.select(*by, *[c.alias(f"p{i}") for i, c in enumerate(p)], *[c.alias(f"d{i}") for i, c in enumerate(d)], *[spread[i][j].alias(f"s{i}{j}") for i in range(3) for j in range(i, 3)])
    s = lambda i, j: F.col(f"s{min(i, j)}{max(i, j)}")
    minor = lambda i, j: s((i + 1) % 3, (j + 1) % 3) * s((i + 2) % 3, (j + 2) % 3) - s((i + 1) % 3, (j + 2) % 3) * s((i + 2) % 3, (j + 1) % 3)
    det = s(0, 0) * minor(0, 0) + s(0, 1) * minor(0, 1) + s(0, 2) * minor(0, 2)
    rows = rows.withColumn("_det", det).select(*by, "p0", "p1", "p2", "d0", "d1", "d2", *[(minor(i, j) / F.col("_det")).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)])
    m = [[F.col(f"m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    q = [F.col(f"p{i}") for i in range(3)]
    cross = [[None, -q[2], q[1]], [q[2], None, -q[0]], [-q[1], q[0], None]]
    back = [[None if cross[j][i] is None else cross[j][i] for j in range(3)] for i in range(3)]
    top = _product(cross, m)
    turn = _product(top, back)
    whole = [[*turn[i], *top[i]] for i in range(3)] + [[None] * 3 + m[i] for i in range(3)]
    force = [sum((m[i][j] * F.col(f"d{j}") for j in (1, 2)), m[i][0] * F.col("d0")) for i in range(3)]
    lever = [q[1] * force[2] - q[2] * force[1], q[2] * force[0] - q[0] * force[2], q[0] * force[1] - q[1] * force[0]]
    sums = [F.sum(whole[i][j]).alias(f"h{i}{j}") for i, j in UPPER] + [F.sum(c).alias(f"g{i}") for i, c in enumerate([*lever, *force])]
    d2 = F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2")
    return rows.groupBy(*by).agg(*sums, F.sum(d2).alias("squares"), F.count("*").alias("inliers"))


def _on_pairs(rest: float, least: int):
    """mapInPandas: pairs with their sums -> one Gauss-Newton step on."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                h, right, poses = _systems(pdf)
                step = pdf["inliers"].fillna(0).to_numpy(float) >= least
                h += 1e-9 * (1 + np.trace(h, axis1=1, axis2=2))[:, None, None] * np.eye(6)
                moved, turn, shift = _limited(np.linalg.solve(h, right[:, :, None])[:, :, 0], 0.35, 2.0)
                pdf["pose"] = np.where(step[:, None, None], graphs.moved(poses, moved), poses).reshape(len(pdf), 16).tolist()
                pdf["moving"] = step & ((turn > rest) | (shift > rest))
            yield pdf[["pair", "pose", "moving"]]

    return run


def levels_of(size: float) -> list[tuple[float, float]]:
    """Reach of a match and cell of the clouds at each level."""
    return [(d, max(size, d / 2)) for d in (max(0.8, 7 * size), max(0.25, 4 * size), max(0.08, 2 * size))]


def register_coarse_to_fine(source: DataFrame, target: DataFrame, size: float, start: DataFrame | None = None, rounds: int = 15, levels: list[tuple[float, float]] | None = None, least: int = 40, rest: float = 1e-5) -> DataFrame:
    """pair, pose (16 numbers), fitness, rmse that lay source on target (pair, id, x, y, z), for all pairs at once.

    Plane to plane, on clouds of large cells first: far matches there find turns and shifts that point to point at full
    resolution would not. A pair with fewer than `least` cells on either side sits a level out. start: pair, pose; without
    it from rest. The score is taken on the whole clouds: points with a partner within max(2 size, 0.08)."""
    source, target = (stash(df.select("pair", "id", *AXES), name) for df, name in ((source, "source"), (target, "target")))
    kind = source.schema["pair"].dataType.simpleString()
    pairs = source.select("pair").distinct().join(target.select("pair").distinct(), "pair", "left_semi")
    still = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    poses = pairs.withColumn("pose", still) if start is None else start.select("pair", "pose").join(pairs, "pair", "left_semi")
    poses = stash(poses, "poses")
    for reach, cell in levels or levels_of(size):
        clouds = [stash(voxel.centroids(df, cell, by=["pair"]).select("pair", F.xxhash64(*voxel.KEY).alias("id"), *AXES), "cells") for df in (source, target)]
        enough = [c.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("pair") for c in clouds]
        s, t = (stash(with_normals(c, ["pair"], 3 * cell), "normals") for c in clouds)
        state = stash(poses.join(enough[0], "pair", "left_semi").join(enough[1], "pair", "left_semi").withColumn("moving", F.lit(True)), "state")
        for _ in range(rounds):
            active = state.where("moving")
            moved = _moved(s, active, ["pair"], ("nx", "ny", "nz"))
            near = neighbours.within(moved, t, reach, by=("pair",)).groupBy("pair", "qid").agg(F.min_by("id", F.struct("d2", "id")).alias("tid"))
            partner = t.select("pair", F.col("id").alias("tid"), *[F.col(a).alias(f"t{a}") for a in AXES], *[F.col(f"n{a}").alias(f"m{a}") for a in AXES])
            matched = moved.join(near.withColumnRenamed("qid", "id"), ["pair", "id"]).join(partner, ["pair", "tid"])
            stepped = active.join(plane_to_plane(matched, ["pair"]), "pair", "left").mapInPandas(_on_pairs(rest, least // 2), f"pair {kind}, pose array<double>, moving boolean")
            new = stash(stepped.unionByName(state.where("NOT moving")), "state")
            unstash(state)
            state = new
            if not state.where("moving").take(1):
                break
        new = stash(state.drop("moving").unionByName(poses.join(state.select("pair"), "pair", "left_anti")), "poses")
        unstash(poses, state, s, t, *clouds)
        poses = new
    gate = max(2 * size, 0.08)
    best = neighbours.within(_moved(source, poses, ["pair"]), target, gate, by=("pair",)).groupBy("pair", "qid").agg(F.min("d2").alias("d2"))
    score = best.groupBy("pair").agg(F.count("*").alias("inliers"), F.sqrt(F.avg("d2")).alias("rmse"))
    sizes = source.groupBy("pair").agg(F.count("*").alias("n"))
    out = poses.join(sizes, "pair").join(score, "pair", "left")
    return out.select("pair", "pose", (F.coalesce("inliers", F.lit(0)) / F.greatest(F.lit(1), F.col("n"))).alias("fitness"), "rmse")
