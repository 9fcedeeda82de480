"""Pose graphs: residuals and their derivatives, edges, and a solver of small graphs in memory, which the tables of
substructure.solve_graphs are held against.

A pose is 7 numbers, x y z and a unit quaternion qx qy qz qw. An edge (a, b) measures Z = B^-1 A."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rotations
from .registration import log_so3

#: Graphs of at most so many nodes are solved by one dense system.
DENSE = 120
POSE = ("x", "y", "z", "qx", "qy", "qz", "qw")


def matrices(rows: np.ndarray) -> np.ndarray:
    """n x 7 poses as n x 4 x 4."""
    q = rows[:, 3:] / np.linalg.norm(rows[:, 3:], axis=1, keepdims=True)
    x, y, z, w = q.T
    out = np.zeros((len(rows), 4, 4))
    out[:, 0, :3] = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], 1)
    out[:, 1, :3] = np.stack([2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], 1)
    out[:, 2, :3] = np.stack([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1)
    out[:, :3, 3], out[:, 3, 3] = rows[:, :3], 1
    return out


def poses7(mats: np.ndarray) -> np.ndarray:
    v = logs(mats[:, :3, :3])
    angle = np.linalg.norm(v, axis=1, keepdims=True)
    axis = v / np.where(angle > 0, angle, 1)
    return np.concatenate([mats[:, :3, 3], axis * np.sin(angle / 2), np.cos(angle / 2)], axis=1)


def inverse(m: np.ndarray) -> np.ndarray:
    out = np.zeros_like(m)
    r = np.swapaxes(m[:, :3, :3], 1, 2)
    out[:, :3, :3], out[:, 3, 3] = r, 1
    out[:, :3, 3] = -(r @ m[:, :3, 3:])[:, :, 0]
    return out


def logs(m: np.ndarray) -> np.ndarray:
    """log_so3 of many rotations."""
    cos = np.clip((np.trace(m, axis1=1, axis2=2) - 1) / 2, -1, 1)
    angle = np.arccos(cos)
    axis = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], axis=1)
    small = angle < 1e-7
    out = axis * np.where(small, 0.5, angle / np.where(small, 1.0, 2 * np.sin(angle)))[:, None]
    for i in np.flatnonzero(np.pi - angle < 1e-4):
        out[i] = log_so3(m[i])
    return out


def _exps(v: np.ndarray) -> np.ndarray:
    """exp_so3 of many vectors."""
    angle = np.linalg.norm(v, axis=1)
    safe = np.where(angle < 1e-9, 1.0, angle)
    k = np.zeros((len(v), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    k -= np.swapaxes(k, 1, 2)
    first, second = np.where(angle < 1e-9, 1.0, np.sin(angle) / safe), np.where(angle < 1e-9, 0.5, (1 - np.cos(angle)) / safe**2)
    return np.eye(3) + first[:, None, None] * k + second[:, None, None] * (k @ k)


def _twist(e: np.ndarray) -> np.ndarray:
    return np.concatenate([logs(e[:, :3, :3]), e[:, :3, 3]], axis=1)


def moved(poses: np.ndarray, step: np.ndarray) -> np.ndarray:
    """exp(step) times each pose."""
    left = np.tile(np.eye(4), (len(poses), 1, 1))
    left[:, :3, :3] = _exps(step[:, :3])
    left[:, :3, 3] = step[:, 3:]
    return left @ poses


def moved7(poses: np.ndarray, step: np.ndarray) -> np.ndarray:
    """moved, of poses of seven numbers."""
    angle = np.linalg.norm(step[:, :3], axis=1)
    share = np.where(angle < 1e-9, 0.5, np.sin(angle / 2) / np.where(angle < 1e-9, 1.0, angle))
    v, w = step[:, :3] * share[:, None], np.cos(angle / 2)[:, None]
    q = poses[:, 3:] / np.linalg.norm(poses[:, 3:], axis=1, keepdims=True)
    turned = np.concatenate([w * q[:, :3] + q[:, 3:] * v + np.cross(v, q[:, :3]), w * q[:, 3:] - (v * q[:, :3]).sum(axis=1, keepdims=True)], axis=1)
    there = (_exps(step[:, :3]) @ poses[:, :3, None])[:, :, 0] + step[:, 3:]
    return np.concatenate([there, turned / np.linalg.norm(turned, axis=1, keepdims=True)], axis=1)


def residuals(poses: np.ndarray, a, b, z_inverse) -> np.ndarray:
    return _twist(z_inverse @ inverse(poses[b]) @ poses[a])


def jacobians(poses: np.ndarray, a, b, z_inverse, r: np.ndarray, tiny: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Of the residuals by small motions of the first and of the second pose, by differences."""
    before, nudges = z_inverse @ inverse(poses[b]), np.eye(6) * tiny
    there = moved(np.tile(np.eye(4), (6, 1, 1)), nudges)
    back = inverse(there)
    ja, jb = np.zeros((len(r), 6, 6)), np.zeros((len(r), 6, 6))
    for c in range(6):
        ja[:, :, c] = (_twist(before @ there[c] @ poses[a]) - r) / tiny
        jb[:, :, c] = (_twist(before @ back[c] @ poses[a]) - r) / tiny
    return ja, jb


def _step(n: int, a, b, ja, jb, w, r, damping: float) -> np.ndarray:
    """The Gauss-Newton step of a graph of n nodes, the first of which stays. Small graphs are solved at once; for others
    the normal equations are never formed: conjugate gradients apply the edges' 6 x 6 blocks one after another, with the
    diagonal blocks as preconditioner, so memory grows with the edges."""

    def gathered(v):
        out = np.zeros((n, 6))
        np.add.at(out, a, np.einsum("eij,ei->ej", ja, v))
        np.add.at(out, b, np.einsum("eij,ei->ej", jb, v))
        out[0] = 0
        return out

    diagonal = np.tile(damping * np.eye(6), (n, 1, 1))
    np.add.at(diagonal, a, np.einsum("e,eki,ekj->eij", w, ja, ja))
    np.add.at(diagonal, b, np.einsum("e,eki,ekj->eij", w, jb, jb))
    left = -gathered(w[:, None] * r)
    if n <= DENSE:
        blocks = np.zeros((n, n, 6, 6))
        blocks[np.arange(n), np.arange(n)] = diagonal
        cross = np.einsum("e,eki,ekj->eij", w, ja, jb)
        np.add.at(blocks, (a, b), cross)
        np.add.at(blocks, (b, a), np.swapaxes(cross, 1, 2))
        whole = blocks.transpose(0, 2, 1, 3).reshape(6 * n, 6 * n)[6:, 6:]
        return np.concatenate([np.zeros(6), np.linalg.solve(whole, left.ravel()[6:])]).reshape(n, 6)
    condition, step = np.linalg.inv(diagonal), np.zeros((n, 6))
    better = np.einsum("nij,nj->ni", condition, left)
    direction, power = better, float((left * better).sum())
    enough = max(1e-20, 1e-10 * power)
    for _ in range(6 * n + 50):
        if power < enough:
            break
        image = gathered(w[:, None] * (np.einsum("eij,ej->ei", ja, direction[a]) + np.einsum("eij,ej->ei", jb, direction[b]))) + damping * direction
        length = power / float((direction * image).sum())
        step, left = step + length * direction, left - length * image
        better = np.einsum("nij,nj->ni", condition, left)
        fresh = float((left * better).sum())
        direction, power = better + fresh / power * direction, fresh
    step[0] = 0
    return step


def solve_many(poses: np.ndarray, sizes, a, b, z, loop, rounds: int = 15, huber: float = 0.30, loop_weight: float = 2.0, damping: float = 1e-4, most: float = 0.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gauss-Newton over several graphs at once: (poses, costs before, costs after). poses: those of all graphs, one after
    the other, of `sizes` nodes each, the first of which stays; a, b: the edges' places in poses. Residuals and their
    derivatives are taken of all edges together; each graph has its own steps and its own end."""
    a, b, loop, z_inverse = np.asarray(a, dtype=int), np.asarray(b, dtype=int), np.asarray(loop, dtype=bool), inverse(np.asarray(z))
    sizes = np.asarray(sizes, dtype=int)
    begin, graphs = np.concatenate(([0], np.cumsum(sizes))), len(sizes)
    owner = np.searchsorted(begin, a, side="right") - 1
    order = np.argsort(owner, kind="stable")
    a, b, loop, z_inverse, owner = a[order], b[order], loop[order], z_inverse[order], owner[order]
    first = np.searchsorted(owner, np.arange(graphs + 1))

    def costs(r, which):
        size = np.linalg.norm(r, axis=1)
        each = np.where(loop[which] & (size > huber), loop_weight * (2 * huber * size - huber**2), np.where(loop[which], loop_weight, 1.0) * size**2)
        return np.bincount(owner[which], each, graphs)

    everything = np.ones(len(a), dtype=bool)
    start = costs(residuals(poses, a, b, z_inverse), everything) if len(a) else np.zeros(graphs)
    open_graphs, cost = np.diff(first) > 0, start.copy()
    for _ in range(rounds):
        live = np.flatnonzero(open_graphs[owner]) if len(a) else np.empty(0, int)
        if not len(live):
            break
        at, to, zi = a[live], b[live], z_inverse[live]
        r = residuals(poses, at, to, zi)
        w = np.where(loop[live], loop_weight * np.minimum(1.0, huber / np.maximum(np.linalg.norm(r, axis=1), 1e-12)), 1.0)
        ja, jb = jacobians(poses, at, to, zi, r)
        step, biggest = np.zeros((len(poses), 6)), np.zeros(graphs)
        ends = np.searchsorted(owner[live], np.arange(graphs + 1))
        for g in np.flatnonzero(open_graphs):
            e, n = slice(ends[g], ends[g + 1]), slice(begin[g], begin[g + 1])
            own = _step(sizes[g], at[e] - begin[g], to[e] - begin[g], ja[e], jb[e], w[e], r[e], damping)
            biggest[g] = np.abs(own).max()
            step[n] = own * min(1.0, most / max(biggest[g], 1e-12))
        tried = moved(poses, step)
        reached = costs(residuals(tried, at, to, zi), live)
        good = open_graphs & (reached <= cost)
        poses = np.where(np.repeat(good, sizes)[:, None, None], tried, poses)
        settled = (biggest < 1e-7) | (cost - reached <= 1e-8 * cost)
        cost = np.where(good, reached, cost)
        open_graphs = good & ~settled
    return poses, start, cost


def solve(poses: np.ndarray, a, b, z, loop, **settings) -> tuple[np.ndarray, float, float]:
    """solve_many of one graph."""
    out, before, after = solve_many(poses, [len(poses)], a, b, z, loop, **settings)
    return out, float(before[0]), float(after[0])


def chain_edges(frames: DataFrame, capture: str) -> DataFrame:
    """The edges between consecutive nodes, as measured by their poses: a window, no gathering."""
    w = Window.partitionBy(capture).orderBy("node")
    pose = rotations.pose_of().packed()
    rows = frames.select(capture, F.lag("node").over(w).alias("a"), F.col("node").alias("b"), pose.alias("_p"), F.lag(pose).over(w).alias("_q")).where("a IS NOT NULL")
    z = rotations.compose(rotations.invert(rotations.pose_of("_p")), rotations.pose_of("_q"))
    return rows.select(capture, "a", "b", *z.named(), F.lit(False).alias("loop"))


def quaternion(m):
    """qx qy qz qw of nine columns, the rows of a rotation matrix."""
    big = [1.0 + m[0] - m[4] - m[8], 1.0 - m[0] + m[4] - m[8], 1.0 - m[0] - m[4] + m[8], 1.0 + m[0] + m[4] + m[8]]  # 4 times the squares
    top = F.greatest(*big)
    size = F.sqrt(top) * 2.0
    rows = [
        (big[0] / size, (m[1] + m[3]) / size, (m[2] + m[6]) / size, (m[7] - m[5]) / size), ((m[1] + m[3]) / size, big[1] / size, (m[5] + m[7]) / size, (m[2] - m[6]) / size),
        ((m[2] + m[6]) / size, (m[5] + m[7]) / size, big[2] / size, (m[3] - m[1]) / size), ((m[7] - m[5]) / size, (m[2] - m[6]) / size, (m[3] - m[1]) / size, big[3] / size),
    ]
    out = []
    for c in range(4):
        # The largest component divides best.
        out.append(F.when(top == big[3], rows[3][c]).when(top == big[0], rows[0][c]).when(top == big[1], rows[1][c]).otherwise(rows[2][c]))
    return tuple(out)


def slerp(a, b, share):
    """The quaternion columns (structs qx qy qz qw) blended along the shorter arc; nearly equal ones linearly."""
    names = POSE[3:]
    dot = sum((a[n] * b[n] for n in names[1:]), a["qx"] * b["qx"])
    side = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    near = angle < 1e-6
    wa = F.when(near, 1.0 - share).otherwise(F.sin((1.0 - share) * angle) / F.sin(angle))
    wb = side * F.when(near, share).otherwise(F.sin(share * angle) / F.sin(angle))
    parts = [wa * a[n] + wb * b[n] for n in names]
    size = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return F.struct(*[(p / size).alias(n) for p, n in zip(parts, names, strict=True)])
