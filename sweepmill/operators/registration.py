"""Point-to-plane registration as Spark jobs, and the gates on its results.

One iteration is a join of points with the planes around them and one aggregate: 21 + 6 sums, whatever the number of
points. Many captures or scans are solved at once by grouping by their keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import stash, unstash
from . import neighbours

AXES = ("x", "y", "z")
HESSIAN = [f"h{i}{j}" for i in range(6) for j in range(i, 6)]
GRADIENT = [f"g{i}" for i in range(6)]


def normal_equations(matched: DataFrame, by: list[str] | None = None, huber: float = 0.05, ground: float = 0.001) -> DataFrame:
    """(by,) the upper triangle h00..h55 of J'WJ, g0..g5 of J'Wr, squared error and inliers of points matched with
    planes (neighbours.nearest_plane). Rows of J: rotation (p x n), then translation (n)."""
    n = [F.col(f"plane.n{a}") for a in AXES]
    p, r = [F.col(a) for a in AXES], F.col("distance")
    j = [p[1] * n[2] - p[2] * n[1], p[2] * n[0] - p[0] * n[2], p[0] * n[1] - p[1] * n[0], *n]
    robust = F.when(F.abs(r) <= huber, 1.0).otherwise(huber / F.greatest(F.abs(r), F.lit(1e-9)))
    w = robust / (ground + F.col("plane.variance"))
    rows = matched.where("plane IS NOT NULL").select(*(by or []), *[c.alias(f"j{i}") for i, c in enumerate(j)], w.alias("w"), r.alias("r"))
    sums = [F.sum(F.col("w") * F.col(f"j{i}") * F.col(f"j{k}")).alias(f"h{i}{k}") for i in range(6) for k in range(i, 6)]
    sums += [F.sum(F.col("w") * F.col(f"j{i}") * F.col("r")).alias(f"g{i}") for i in range(6)]
    return rows.groupBy(*(by or [])).agg(*sums, F.sum(F.col("r") * F.col("r")).alias("squares"), F.count("*").alias("inliers"))


def exp_so3(v: np.ndarray) -> np.ndarray:
    angle = float(np.linalg.norm(v))
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    if angle < 1e-9:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k


def log_so3(m: np.ndarray) -> np.ndarray:
    cos = np.clip((np.trace(m) - 1) / 2, -1, 1)
    angle, axis = float(np.arccos(cos)), np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])
    if angle < 1e-7:
        return axis / 2
    if np.pi - angle < 1e-4:  # the axis is the column of the largest diagonal element of m + 1
        whole = m + np.eye(3)
        column = whole[:, np.argmax(np.diag(whole))]
        return angle * column / np.linalg.norm(column)
    return angle / (2 * np.sin(angle)) * axis


def register_to_planes(points: DataFrame, planes: DataFrame, size: float, start: np.ndarray | None = None, rounds: int = 8, rotation_prior: float = 350.0, translation_prior: float = 4.0):
    """(4x4 pose, fitness, rmse, degenerate) that lays points on the planes, from a predicted pose. The prior holds
    attitude firmly and position loosely to the prediction; steps are limited; with too few inliers it stops."""
    prior = np.eye(4) if start is None else np.array(start, dtype=float)
    points, planes = stash(points.select("id", *AXES), "points"), stash(planes, "planes")  # read in each round
    pose, total, last = prior.copy(), points.count(), None
    need = max(60, total // 12)
    for _ in range(rounds + 1):
        moved = points.select("id", *[c.alias(a) for c, a in zip(g.transform(*[F.col(a) for a in AXES], pose), AXES, strict=True)])
        s = normal_equations(neighbours.nearest_plane(moved, planes, size)).first()
        inliers = s["inliers"]
        score = (inliers / max(1, total), float(np.sqrt(s["squares"] / inliers)) if inliers else float("inf"))
        if inliers < need or _ == rounds:
            break
        h = np.zeros((6, 6))
        for name in HESSIAN:
            i, j = int(name[1]), int(name[2])
            h[i, j] = h[j, i] = s[name]
        last = h[3:, 3:].copy()
        gradient = np.array([s[name] for name in GRADIENT])
        gradient[:3] += rotation_prior * log_so3(pose[:3, :3] @ prior[:3, :3].T)
        gradient[3:] += translation_prior * (pose[:3, 3] - prior[:3, 3])
        h += np.diag([rotation_prior] * 3 + [translation_prior] * 3) + 1e-6 * np.eye(6)
        step = -np.linalg.solve(h, gradient)
        turn, shift = step[:3], step[3:]
        turn = turn * min(1.0, 0.10 / max(np.linalg.norm(turn), 1e-12))
        shift = shift * min(1.0, 0.30 / max(np.linalg.norm(shift), 1e-12))
        update = np.eye(4)
        update[:3, :3], update[:3, 3] = exp_so3(turn), shift
        pose = update @ pose
        if np.linalg.norm(turn) < 2e-5 and np.linalg.norm(shift) < 5e-5:
            rounds = _ + 1
    unstash(points, planes)
    values = np.linalg.eigvalsh(last) if last is not None else np.zeros(3)
    return pose, *score, bool(last is not None and max(0.0, values[0]) / max(values[2], 1e-12) < 1e-3)


def _solved_pairs(batches):
    """mapInPandas: a pair's pose and the moments of its matches -> the pose one step on."""
    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            pose = np.array(r["pose"]).reshape(4, 4)
            if r["inliers"] >= 3:
                u, _, vt = np.linalg.svd(np.array([r[f"q{a}{b}"] for a in AXES for b in AXES]).reshape(3, 3))
                turn = vt.T @ np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
                step = np.eye(4)
                step[:3, :3] = turn
                step[:3, 3] = [r[a] for a in AXES] - turn @ [r[f"q{a}"] for a in AXES]
                pose = step @ pose
            out.append((r["pair"], pose.ravel().tolist(), r["n"], r["inliers"], r["d2"]))
        yield pd.DataFrame(out, columns=["pair", "pose", "n", "inliers", "d2"])


def register_pairs(source: DataFrame, target: DataFrame, gate: float, rounds: int = 12, start: DataFrame | None = None) -> DataFrame:
    """pair, pose (16 numbers by rows), fitness, rmse: ICP of many pairs of clouds (pair, id, x, y, z) at once. Every
    round is one grid join and one aggregate over all pairs; only a pair's 16 moments reach Python. start: pair, pose;
    without it, source starts with its centroid on the target's."""
    centre = lambda df, p: df.groupBy("pair").agg(*[F.avg(a).alias(f"{p}{a}") for a in AXES])
    if start is None:
        both = centre(source, "s").join(centre(target, "t"), "pair")
        rows = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] + [F.col(f"t{a}") - F.col(f"s{a}")] for i, a in enumerate(AXES)]
        start = both.select("pair", F.array(*[c for r in rows for c in r], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]).alias("pose"))
    poses = start.select("pair", "pose", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("inliers"), F.lit(None).cast("double").alias("d2"))
    moments = [F.covar_pop(f"q{a}", b).alias(f"q{a}{b}") for a in AXES for b in AXES]
    sizes = stash(source.groupBy("pair").agg(F.count("*").alias("n")), "sizes")
    for _ in range(rounds):
        at = lambda i: F.element_at("pose", i + 1)
        world = g.transform(*[F.col(a) for a in AXES], [[at(4 * i + j) for j in range(4)] for i in range(3)])
        moved = source.join(poses.select("pair", "pose"), "pair").select("pair", "id", *[c.alias(a) for c, a in zip(world, AXES, strict=True)])
        near = neighbours.within(moved, target, gate, by=("pair",))
        best = near.groupBy("pair", "qid").agg(F.min_by(F.struct("qx", "qy", "qz", *AXES, "d2"), F.struct("d2", "id")).alias("m")).select("pair", "m.*")
        sums = best.groupBy("pair").agg(F.count("*").alias("inliers"), F.avg("d2").alias("d2"), *[F.avg(c).alias(c) for c in ("qx", "qy", "qz", *AXES)], *moments)
        joined = poses.select("pair", "pose").join(sizes, "pair").join(sums, "pair", "left").fillna(0, ["inliers"])
        poses = stash(joined.mapInPandas(_solved_pairs, "pair " + source.schema["pair"].dataType.simpleString() + ", pose array<double>, n long, inliers long, d2 double"), "poses")
    return poses.select("pair", "pose", (F.col("inliers") / F.greatest(F.lit(1), F.col("n"))).alias("fitness"), F.sqrt("d2").alias("rmse"))


def symmetric_loops(forward: DataFrame, reverse: DataFrame, least_fitness: float = 0.60, most_rmse: float = 0.08, shift: float = 2.5, turn: float = 35.0, cycle: float = 0.20, cycle_turn: float = 8.0) -> DataFrame:
    """forward with `reason`: "accepted" if both directions (register_pairs of a pair and of its reverse) are good, the
    correction is small, and going there and back ends where it began."""
    b = reverse.select("pair", F.col("pose").alias("_back"), F.col("fitness").alias("_f"), F.col("rmse").alias("_r"))
    row = lambda c, i, j: F.element_at(c, 4 * i + j + 1)
    length = lambda parts: F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    loop = [[sum((row("_back", i, k) * row("pose", k, j) for k in range(1, 4)), row("_back", i, 0) * row("pose", 0, j)) for j in range(4)] for i in range(3)]
    bad = lambda f, r: (f < least_fitness) | F.coalesce(r > most_rmse, F.lit(True))
    moved, turned = length([row("pose", i, 3) for i in range(3)]), g.rotation_degrees(row("pose", 0, 0) + row("pose", 1, 1) + row("pose", 2, 2))
    ends, twist = length([loop[i][3] for i in range(3)]), g.rotation_degrees(loop[0][0] + loop[1][1] + loop[2][2])
    reason = (
        F.when(bad(F.col("fitness"), F.col("rmse")), "forward registration")
        .when((moved > shift) | (turned > turn), "correction too large")
        .when(F.col("_f").isNull() | bad(F.col("_f"), F.col("_r")), "reverse registration")
        .when((ends > F.greatest(F.lit(cycle), 2.5 * F.col("rmse"))) | (twist > cycle_turn), "cycle does not close")
        .otherwise("accepted")
    )
    return forward.join(b, "pair", "left").select(*forward.columns, reason.alias("reason"))


def gate_reason(fitness: Column, rmse: Column, moved: Column, turned: Column, seconds: Column, least_fitness: float = 0.70, most_rmse: float = 0.18, margin: float = 0.35, speed: float = 4.0, turn_margin: float = 12.0, turn_speed: float = 120.0, measured_turn: Column | None = None, turn_correction: float = 8.0) -> Column:
    """Why a registration is rejected, or "accepted". moved in m, turned in degrees since the last pose; uncertain
    results have a tighter motion envelope; measured_turn: the gyro's angle, which replaces the speed limit."""
    bad = ~g.finite(fitness, rmse, moved, turned)
    uncertain = (fitness < least_fitness + 0.10) | (rmse > most_rmse * 0.45)
    reach = F.when(uncertain, min(margin, 0.15) + min(speed, 2.5) * seconds).otherwise(margin + speed * seconds)
    free = F.when(uncertain, min(turn_margin, 7.0) + min(turn_speed, 75.0) * seconds).otherwise(turn_margin + turn_speed * seconds)
    arc = free if measured_turn is None else F.when(measured_turn.isNull(), free).otherwise(measured_turn + turn_correction)
    return (
        F.when(bad, "non-finite ICP result")
        .when(fitness < least_fitness, F.format_string("fitness %.3f below %.3f", fitness, F.lit(least_fitness)))
        .when(rmse > most_rmse, F.format_string("rmse %.3f m above %.3f m", rmse, F.lit(most_rmse)))
        .when(moved > reach, F.format_string("translation %.3f m above %.3f m", moved, reach))
        .when(turned > arc, F.format_string("rotation %.3f deg above %.3f deg", turned, arc))
        .otherwise("accepted")
    )


def good_refinement(fitness: Column, rmse: Column, moved: Column, turned: Column, least_fitness: float = 0.70, most_rmse: float = 0.18) -> Column:
    """Whether a second registration against the finished map may replace a pose."""
    return (fitness >= least_fitness) & (rmse <= min(0.06, most_rmse)) & (moved <= 0.10) & (turned <= 2.5)


def within_budget(failed: Column, total: Column, floor: int = 20, share: int = 4) -> Column:
    """Whether few enough scans failed to publish the result."""
    return failed <= F.greatest(F.lit(floor), F.floor(total / share))


def pairing_holds(gaps: DataFrame, by: list[str], gap: str, median_ns: int = 150_000_000, far_ns: int = 300_000_000) -> DataFrame:
    """by, median, outliers, passes: whether images and scans of a capture belong together, by the upper median of their
    gaps in time and by how many are far off."""
    from . import series

    sizes = gaps.select(*by, F.abs(gap).alias("_gap"))
    median = series.upper_median(sizes, by, "_gap")
    far = sizes.groupBy(*by).agg(F.count_if(F.col("_gap") > far_ns).alias("outliers"))
    fine = (F.col("median") <= median_ns) & (F.col("outliers") <= F.greatest(F.lit(20), F.floor(F.col("n") / 20)))
    return median.join(far, by).withColumn("passes", fine)
