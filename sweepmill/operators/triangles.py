"""Place recognition by triangles: geometric hashing of keypoints, so that a place is found again from any direction.

Keypoints are cells where surfaces end: not flat themselves, but beside flat ones. Each keypoint makes triangles with
pairs of its nearest ones; a triangle's key is its three side lengths, cut into bins. Frames that share keys collect votes
block by block of frames, so neither keys that many share nor pairs of frames become rows. For
the frames with most votes the triangles themselves meet, each match gives a pose from its three corners, and the pose on
which most matches agree is the frames' relative pose.

Frames hold at most `most` keypoints, which bounds everything that happens inside one frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from . import voxel

#: Frames of a block of votes.
BLOCK = 512


def keypoints(points: DataFrame, by: list[str], size: float, most: int = 60, least: int = 8, threshold: float = 0.0025, flatness: float = 0.08) -> DataFrame:
    """by, id, x, y, z, score: centres of cells (of `size`) that are not flat and touch one that is; the `most` of a frame whose points
    are spread most evenly over all directions."""
    cells = voxel.planes(points, size, threshold, flatness, least, by=by)
    key = list(voxel.KEY)
    steps = F.array(*[F.struct(*[F.lit(d).alias(k) for d, k in zip((i, j, n), key, strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for n in (-1, 0, 1) if i or j or n])
    flat = cells.where("valid").select(*by, *key, F.explode(steps).alias("_d")).select(*by, *[(F.col(k) + F.col(f"_d.{k}")).alias(k) for k in key]).distinct()
    edges = cells.where(~F.col("valid")).join(flat, [*by, *key], "left_semi")
    scored = edges.select(*by, F.xxhash64(*key).alias("id"), *voxel.AXES, (F.col("e0") / F.greatest(F.col("e2"), F.lit(1e-9))).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def triangles(keys: DataFrame, by: list[str], near: int = 8, shortest: float = 0.0, longest: float = float("inf")) -> DataFrame:
    """by, ids (sorted), sides (ascending) and corners (structs of id, x, y, z, each opposite its side) of the triangles
    that keypoints (by, id, x, y, z) make with pairs of their `near` nearest in the frame. Each set of corners once."""
    corner = F.struct("id", *voxel.AXES)
    a, b = (keys.select(*by, corner.alias(n)) for n in ("p", "q"))
    square = lambda p, q: sum(((F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) * (F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) for c in "yz"), (F.col(f"{p}.x") - F.col(f"{q}.x")) * (F.col(f"{p}.x") - F.col(f"{q}.x")))
    met = a.join(b, by).where("p.id <> q.id").withColumn("d2", square("p", "q"))
    rank = F.row_number().over(Window.partitionBy(*by, "p.id").orderBy("d2", "q.id"))
    close = met.select(*by, "p", "q", rank.alias("_r")).where(F.col("_r") <= near).groupBy(*by, "p").agg(F.collect_list("q").alias("_q"))
    # At most `near` neighbours are paired in a row.
    ordered = close.withColumn("_q", F.array_sort("_q", lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)))
    pairs = F.flatten(F.transform("_q", lambda q, i: F.transform(F.slice("_q", i + 2, F.size("_q")), lambda s: F.struct(q.alias("q"), s.alias("s")))))
    rows = ordered.select(*by, "p", F.explode(pairs).alias("_e")).select(*by, "p", "_e.q", "_e.s")
    rows = rows.withColumn("ids", F.array_sort(F.array("p.id", "q.id", "s.id"))).dropDuplicates([*by, "ids"])
    length = lambda p, q: F.sqrt(square(p, q))
    sides = F.array(*[F.struct(length(*rest).alias("length"), F.col(f"{own}.id").alias("id"), F.col(own).alias("corner")) for own, rest in (("p", "qs"), ("q", "ps"), ("s", "pq"))])
    rows = rows.select(*by, "ids", F.array_sort(sides).alias("_s"))
    out = rows.select(*by, "ids", F.transform("_s", lambda s: s["length"]).alias("sides"), F.transform("_s", lambda s: s["corner"]).alias("corners"))
    return out.where((F.element_at("sides", 1) >= shortest) & (F.element_at("sides", 3) <= longest))


def side_bins(bin_size: float) -> Column:
    """The key of a triangle: the bins of its sides."""
    return F.transform("sides", lambda s: F.floor(s / bin_size).cast("int"))


def probes(bin_size: float) -> Column:
    """The keys of all triangles whose sides differ by half a bin at most: two bins a side."""
    two = lambda i: [F.floor(F.element_at("sides", i) / bin_size + d).cast("int") for d in (-0.5, 0.5)]
    return F.array(*[F.array(x, y, z) for x in two(1) for y in two(2) for z in two(3)])


def shared(mine: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of a block of targets and one of sources, and their votes. mine, theirs: frame of each triangle, its sides in bins."""
    floor = lambda x: np.nan_to_num(np.floor(x), nan=0.0).astype(np.int64)
    at, t = np.unique(mine[0], return_inverse=True)
    of, s = np.unique(theirs[0], return_inverse=True)
    both = [[floor(theirs[1][i] + d) for d in (-0.5, 0.5)] for i in range(3)]
    sides = [(a, b, c) for a in both[0] for b in both[1] for c in both[2]]
    keys = np.concatenate([np.stack([floor(x) for x in mine[1]]), *[np.stack(x) for x in sides]], axis=1)
    # Keys are numbered by their sides in turn, so that any whole numbers will do.
    number = np.zeros(keys.shape[1], np.int64)
    for side in keys:
        number = np.unique(number * (side.max() - side.min() + 1) + side - side.min() if len(side) else number, return_inverse=True)[1]
    counted = []
    for frames, key, n in ((t, number[: len(t)], len(at)), (np.tile(s, 8), number[len(t) :], len(of))):
        pair, count = np.unique(key * n + frames, return_counts=True)
        counted.append((pair // n, pair % n, count))
    votes = np.zeros((len(at), len(of)), np.int64)
    (k, t, n), (l, s, m) = counted
    some = np.intersect1d(k, l)
    ends = [np.searchsorted(x, some, side) for x in (k, l) for side in ("left", "right")]
    for i, j, p, q in zip(*(e.tolist() for e in ends), strict=True):
        votes[t[i:j, None], s[p:q]] += np.minimum(n[i:j, None], m[p:q])
    return at, of, votes


def votes(shapes: DataFrame, capture: str, frame: str, bin_size: float, separation: int, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """capture, target, source, votes: for each pair of frames `separation` apart or more, the sum over keys of how many triangles
    both have, the later frame's by their bins and the earlier one's by all bins within half a bin.

    A task adds up the votes of `block` targets and as many sources, so rows that share a key never meet as rows. With
    `most`, it hands on that many sources of each target, those with most votes, ties to the earlier: no others can be
    among the best of all."""
    kinds = [shapes.schema[c].dataType.simpleString() for c in (capture, frame)]
    rows = shapes.where(F.col(capture).isNotNull() & F.col(frame).isNotNull())
    rows = stash(rows.select(capture, F.col(frame).alias("frame"), *[(F.element_at("sides", i + 1) / bin_size).alias(f"s{i}") for i in range(3)], F.floor(F.col(frame) / block).alias("_block")), "sides")
    blocks = F.broadcast(rows.groupBy(capture).agg(F.collect_set("_block").alias("_blocks")).withColumnRenamed(capture, "_capture"))
    met = rows.join(blocks, F.col(capture) == F.col("_capture"))
    # Blocks of which no two frames are far enough apart do not meet.
    far = lambda t, s: s * block + separation <= t * block + block - 1
    own = F.col("_block")
    roles = F.concat(
        F.transform(F.filter("_blocks", lambda o: far(own, o)), lambda o: F.struct(own.alias("t"), o.alias("s"), F.lit(True).alias("mine"))),
        F.transform(F.filter("_blocks", lambda o: far(o, own)), lambda o: F.struct(o.alias("t"), own.alias("s"), F.lit(False).alias("mine"))),
    )
    dealt = met.select(capture, "frame", "s0", "s1", "s2", F.explode(roles).alias("_role")).select(capture, "frame", "s0", "s1", "s2", "_role.*")

    def count(key, table):
        role, frames = table["mine"].to_numpy(), table["frame"].to_numpy()
        sides = np.array([table[f"s{i}"].to_numpy() for i in range(3)])
        at, of, found = shared((frames[role], sides[:, role]), (frames[~role], sides[:, ~role]))
        found[of[None, :] + separation > at[:, None]] = 0
        if most is not None and found.shape[1] > most:
            best = np.argsort(-found, axis=1, kind="stable")[:, :most]
            kept = np.zeros_like(found)
            np.put_along_axis(kept, best, np.take_along_axis(found, best, axis=1), axis=1)
            found = kept
        t, s = np.nonzero(found)
        kind = table.schema.field("frame").type
        return pa.table([pa.array([key[0].as_py()] * len(t), table.schema.field(capture).type), pa.array(at[t]).cast(kind), pa.array(of[s]).cast(kind), pa.array(found[t, s])], names=[capture, "target", "source", "votes"])

    return dealt.groupBy(capture, "t", "s").applyInArrow(count, f"{capture} {kinds[0]}, target {kinds[1]}, source {kinds[1]}, votes long")


def best_frames(found: DataFrame, capture: str, most: int, least: int = 1) -> DataFrame:
    """The `most` sources with most votes of each target, ties to the earlier."""
    rank = F.row_number().over(Window.partitionBy(capture, "target").orderBy(F.col("votes").desc(), "source"))
    return found.where(F.col("votes") >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def aligned(points: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """n rigid transforms (4 x 4) that lay n sets of points (n x k x 3) on others in least squares."""
    c, d = points.mean(axis=1, keepdims=True), onto.mean(axis=1, keepdims=True)
    u, _, vt = np.linalg.svd(np.swapaxes(points - c, 1, 2) @ (onto - d))
    flip = np.sign(np.linalg.det(np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)))
    vt[:, 2] *= flip[:, None]
    turn = np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)
    out = np.tile(np.eye(4), (len(points), 1, 1))
    out[:, :3, :3] = turn
    out[:, :3, 3] = (d - c @ np.swapaxes(turn, 1, 2))[:, 0]
    return out


def _poses(batches):
    """mapInArrow: nine coordinates of each side's corners -> the pose that lays the one on the other."""
    for b in batches:
        a, c = (b[n].flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3) for n in ("_mine", "_theirs"))
        pose = aligned(a, c).reshape(len(a), 16) if len(a) else np.zeros((0, 16))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pose) + 1, dtype=np.int32) * 16), pa.array(pose.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*[b[c] for c in b.schema.names if c not in ("_mine", "_theirs")], lists], names=[*[c for c in b.schema.names if c not in ("_mine", "_theirs")], "pose"])


def relative_poses(shapes: DataFrame, pairs: DataFrame, capture: str, frame: str, bin_size: float, tries: int = 64, within: float | None = None) -> DataFrame:
    """pairs (capture, target, source, ...) with matches, the triangles that fit side by side within half a bin; inliers, those
    whose corners a pose lays on one another (`within` metres, one bin by default); and that pose (16 numbers), of the target in the source's
    frame. Of the poses of the `tries` best fitting matches, the one with most inliers."""
    within = bin_size if within is None else within
    flat = lambda c: F.flatten(F.transform(c, lambda p: F.array(p["x"], p["y"], p["z"])))
    pair = [capture, "target", "source"]
    keep = pairs.select(*pair)
    mine = shapes.join(keep.select(capture, F.col("target").alias(frame)).distinct(), [capture, frame], "left_semi").select(capture, F.col(frame).alias("target"), side_bins(bin_size).alias("key"), F.col("ids").alias("_i"), F.col("sides").alias("_s"), flat("corners").alias("_mine"))
    theirs = shapes.join(keep.select(capture, F.col("source").alias(frame)).distinct(), [capture, frame], "left_semi").select(capture, F.col(frame).alias("source"), F.explode(probes(bin_size)).alias("key"), F.col("ids").alias("_j"), F.col("sides").alias("_t"), flat("corners").alias("_theirs"))
    # Frames of a pair meet first, so a key that many frames share joins only inside the pairs asked for.
    met = mine.join(keep, [capture, "target"]).join(theirs, [capture, "source", "key"])
    gap = F.aggregate(F.zip_with("_s", "_t", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: F.greatest(x, y))
    fits = met.withColumn("_gap", gap).where(F.col("_gap") <= bin_size / 2)
    fits = stash(fits.select(*pair, "_i", "_j", "_gap", "_mine", "_theirs"), "fits")
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy("_gap", "_i", "_j"))
    some = fits.withColumn("_r", rank).where(F.col("_r") <= tries).select(*pair, "_r", "_mine", "_theirs")
    kinds = ", ".join(f"{c} {shapes.schema[frame].dataType.simpleString() if c != capture else shapes.schema[capture].dataType.simpleString()}" for c in pair)
    guessed = some.mapInArrow(_poses, f"{kinds}, _r int, pose array<double>")
    at = lambda i: F.element_at("pose", i + 1)
    off = F.lit(0.0)
    for k in range(3):
        p, q = ([F.element_at(c, 3 * k + i + 1) for i in range(3)] for c in ("_mine", "_theirs"))
        moved = [at(4 * i) * p[0] + at(4 * i + 1) * p[1] + at(4 * i + 2) * p[2] + at(4 * i + 3) for i in range(3)]
        off = F.greatest(off, sum(((m - x) * (m - x) for m, x in zip(moved, q, strict=True)), F.lit(0.0)))
    tried = guessed.join(fits.select(*pair, "_mine", "_theirs"), pair).groupBy(*pair, "_r").agg(F.count_if(off <= within * within).alias("inliers"), F.count("*").alias("matches"))
    best = F.row_number().over(Window.partitionBy(*pair).orderBy(F.col("inliers").desc(), "_r"))
    won = tried.withColumn("_b", best).where("_b = 1").drop("_b").join(guessed, [*pair, "_r"]).drop("_r")
    return pairs.join(won, pair, "left").fillna(0, ["inliers", "matches"])


def triangle_loops(points: DataFrame, capture: str, frame: str, cell: float, bin_size: float, separation: int, most: int = 4, near: int = 8, longest: float = 30.0, least_inliers: int = 4) -> DataFrame:
    """capture, target, source, votes, rank, matches, inliers, pose: earlier frames that show the same place, from clouds (capture,
    frame, x, y, z in each frame's own axes), with the target's pose in the source's frame."""
    by = [capture, frame]
    shapes = stash(triangles(keypoints(points, by, cell), by, near, cell, longest), "triangles")
    pairs = stash(best_frames(votes(shapes, capture, frame, bin_size, separation, most=most), capture, most), "pairs")
    return relative_poses(shapes, pairs, capture, frame, bin_size).where(F.col("inliers") >= least_inliers)
