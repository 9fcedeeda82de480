"""A cloud that moves as a whole over one that stays: the nearest points of all its places, round after round, without
dealing the points anew in each.

Space is cut at medians of a bounded sample into boxes of about equally many points, whatever their density. A box's row holds
its own places of the moving cloud and the points of the other one that lie in it or within its halo. A round moves each box's
places and looks around them inside the box; only sums leave it, and the places whose nearest may lie beyond the halo. Those
are asked, by a join on boxes, of every box that they could reach. Places that have left their boxes are among them; when they grow
many the moving cloud is dealt again."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import settings, stash, stash_counted, unstash

AXES = ("x", "y", "z")
#: Points of both clouds in a box, about; sampled ones of them; boxes at most; pairs that are compared at once.
HOLD, SAMPLED, MOST, AT_ONCE = 8192, 64, 8192, 1 << 20
#: A halo's width in mean distances of points, and how many times a box's share of points its halo may add up to.
WIDE, CROWDED = 2.0, 4
#: Questions that may go to all tasks at once.
FEW = 20_000
#: The weights, squared distances, both places and their products, about the centre.
SUMS = 1 + 1 + 3 + 3 + 9
#: Rows of boxes are large, so few are read at once.
READING = {"spark.sql.parquet.columnarReaderBatchSize": "64"}


def spacing(edges: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far n points lie apart in boxes of these edges; flat and thin boxes count as areas and lines."""
    long = -np.sort(-edges, axis=-1)
    each = np.maximum(np.asarray(n, dtype=float), 1.0)
    return np.max([(np.prod(long[..., :d], axis=-1) / each) ** (1.0 / d) for d in (1, 2, 3)], axis=0)


class Boxes:
    """Cuts of space: below node i, 2 i + 1 holds what is at most cuts[i] on axis axes[i], 2 i + 2 the rest."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, inner = depth, (1 << depth) - 1
        self.axes, self.cuts = np.zeros(inner, dtype=int), np.zeros(inner)
        self.low, self.high = np.full((2 * inner + 1, 3), -np.inf), np.full((2 * inner + 1, 3), np.inf)
        own = {0: sample}
        for i in range(inner):
            some = own.pop(i)
            if len(some):
                self.axes[i] = np.argmax(np.ptp(some, axis=0))
                self.cuts[i] = np.median(some[:, self.axes[i]])
            side = some[:, self.axes[i]] <= self.cuts[i]
            for child, those in ((2 * i + 1, side), (2 * i + 2, ~side)):
                own[child] = some[those]
                self.low[child], self.high[child] = self.low[i], self.high[i]
            self.high[2 * i + 1, self.axes[i]] = self.low[2 * i + 2, self.axes[i]] = self.cuts[i]
        self.low, self.high = self.low[inner:], self.high[inner:]
        self.halo = np.zeros(inner + 1)

    def reached(self, places: np.ndarray, reach: np.ndarray | float = 0.0, halo: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, box) of the boxes within `reach` of each place, along each axis; with halo: of those whose halo holds it."""
        wide = np.concatenate([np.zeros(len(self.cuts)), self.halo])
        for i in range(len(self.cuts) - 1, -1, -1):
            wide[i] = max(wide[2 * i + 1], wide[2 * i + 2])
        if not halo:
            wide[:] = 0.0
        row, node, reach = np.arange(len(places)), np.zeros(len(places), dtype=int), np.broadcast_to(reach, len(places))
        for _ in range(self.depth):
            x, cut, r = places[row, self.axes[node]], self.cuts[node], reach[row]
            left, right = x - r - wide[2 * node + 1] <= cut, x + r + wide[2 * node + 2] > cut
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        box = node - len(self.cuts)
        if halo:
            kept = self.settles(places[row], box) >= 0
            row, box = row[kept], box[kept]
        return row, box

    def settles(self, places: np.ndarray, box) -> np.ndarray:
        """How far the halo of a box reaches around places, negative outside it."""
        h = self.halo[box][..., None]
        return np.minimum(places - (self.low[box] - h), (self.high[box] + h) - places).min(axis=-1)


def cut(moving: np.ndarray, still: np.ndarray, depth: int, share: float, gate: float) -> Boxes:
    """Boxes of samples of two clouds, and their halos: WIDE distances of points, less where that would hold too many."""
    both = np.concatenate([moving, still])
    boxes = Boxes(both, depth)
    if not len(still):
        return boxes
    count = len(boxes.halo)
    held = np.bincount(boxes.reached(still)[1], minlength=count)
    edges = np.maximum(0.0, np.minimum(boxes.high, still.max(axis=0)) - np.maximum(boxes.low, still.min(axis=0)))
    boxes.halo = np.where(held > 0, np.minimum(gate, WIDE * spacing(edges, held / share)), 0.0)
    for _ in range(6):
        full = np.bincount(boxes.reached(still, halo=True)[1], minlength=count) > CROWDED * max(1.0, len(both) / count)
        if not full.any():
            return boxes
        boxes.halo[full] /= 2
    boxes.halo[full] = 0.0
    return boxes


def _celled(points: np.ndarray, low: np.ndarray, edge: float) -> tuple[np.ndarray, np.ndarray]:
    """The key of each point's cell, and how many cells lie along each axis."""
    cells = np.floor((points - low) / edge).astype(np.int64)
    size = cells.max(axis=0) + 1
    return (cells[:, 0] * size[1] + cells[:, 1]) * size[2] + cells[:, 2], size


def nearest(queries: np.ndarray, points: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray]:
    """(square of the distance, row) of the nearest point of each query that is not farther than gate, of several the first; infinity
    and -1 where there is none. Points lie in cells, and a query sees its own and those that touch it; what is not proven by that
    goes on with cells twice as wide."""
    best, at = np.full(len(queries), np.inf), np.full(len(queries), -1)
    if not len(points) or not len(queries):
        return best, at
    low, extent = points.min(axis=0), np.ptp(points, axis=0)
    most = min(gate, 2.0 * float((np.maximum(points.max(axis=0), queries.max(axis=0)) - np.minimum(low, queries.min(axis=0))).sum()) or 1.0)
    least = max(float(extent.max()) * 2.0**-20, most * 2.0**-30)
    edge = max(least, min(most, float(spacing(extent, len(points))) * 1.2))
    while True:
        keys, size = _celled(points, low, edge)
        crowd = float((np.unique(keys, return_counts=True)[1].astype(float) ** 2).sum()) / len(keys)
        if crowd <= 4 or edge <= least:
            break
        edge = max(least, edge / 2.0 ** max(1, math.floor(math.log2(crowd / 4) / 3)))
    left = np.arange(len(queries))
    while True:
        order = np.argsort(keys, kind="stable")
        best[left], at[left] = _around(queries[left], points[order], keys[order], order, low, edge, size)
        left = left[best[left] > edge * edge]
        if edge >= most or not len(left):
            break
        edge = min(2 * edge, most)
        keys, size = _celled(points, low, edge)
    far = best > gate * gate
    best[far], at[far] = np.inf, -1
    return best, at


def _around(queries: np.ndarray, points: np.ndarray, keys: np.ndarray, rows: np.ndarray, low: np.ndarray, edge: float, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest among the points, in order of their keys, of the cells that touch a query's; their `rows` are given back."""
    cell = np.clip(np.floor((queries - low) / edge), -2, size + 1).astype(np.int64)
    beside = cell[:, None, :2] + np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    bottom, top = np.maximum(cell[:, 2] - 1, 0), np.minimum(cell[:, 2] + 2, size[2])
    inside = ((beside >= 0) & (beside < size[:2])).all(axis=2) & (bottom < top)[:, None]
    base = (beside[:, :, 0] * size[1] + beside[:, :, 1]) * size[2]
    begin = np.where(inside, np.searchsorted(keys, base + bottom[:, None]), 0)
    many = np.where(inside, np.searchsorted(keys, base + top[:, None]), 0) - begin
    total = many.sum(axis=1)
    best, at = np.full(len(queries), np.inf), np.full(len(queries), -1)
    some, first = np.flatnonzero(total), 0
    ends = np.cumsum(total[some])
    while first < len(some):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
        those = some[first:last]
        starts, runs, n = begin[those].ravel(), many[those].ravel(), total[those]
        p = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
        d2 = (np.repeat(queries[those, 0], n) - points[p, 0]) ** 2
        for axis in (1, 2):
            d2 += (np.repeat(queries[those, axis], n) - points[p, axis]) ** 2
        place = np.cumsum(n) - n
        best[those] = np.minimum.reduceat(d2, place)
        at[those] = np.minimum.reduceat(np.where(d2 == np.repeat(best[those], n), rows[p], len(rows)), place)
        first = last
    return best, at


def _places(column, row: int, names: tuple[str, ...] = AXES) -> np.ndarray:
    own = column[row].values
    return np.stack([own.field(a).to_numpy(zero_copy_only=False) for a in names], axis=1)


def _sums(q: np.ndarray, p: np.ndarray, d2: np.ndarray, w: np.ndarray, centre: np.ndarray) -> np.ndarray:
    q, p = q - centre, p - centre
    return np.concatenate([[w.sum(), w @ d2], w @ q, w @ p, ((w[:, None] * q).T @ p).ravel()])


def _dealt(boxes: Boxes, pose: np.ndarray, kind: str, asks: bool):
    """mapInArrow: places -> each with its box if they ask, else with all boxes whose halo holds it."""

    def run(batches):
        for b in batches:
            places = np.stack([b[a].to_numpy() for a in AXES], axis=1)
            row, box = boxes.reached(places @ pose[:3, :3].T + pose[:3, 3] if asks else places, halo=not asks)
            out = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(box), *[out[c] for c in ("id", *AXES, "w")], pa.array(np.full(len(row), asks))], names=["box", "id", *AXES, "w", "asks"])

    return run, f"box long, id {kind}, x double, y double, z double, w double, asks boolean"


def _looked(boxes: Boxes, pose: np.ndarray, gate: float, centre: np.ndarray, kind: str):
    """mapInArrow: boxes -> the sums of the places that are settled in them, a row a batch, and the moved places that are not, with how far
    their nearest may be."""

    def run(batches):
        for b in batches:
            sums, open_ids, open_rows = np.zeros(SUMS), [], []
            for i in range(b.num_rows):
                places = _places(b["asked"], i, (*AXES, "w"))
                q, w = places[:, :3] @ pose[:3, :3].T + pose[:3, 3], places[:, 3]
                p, ids = _places(b["points"], i), b["points"][i].values.field("id")
                d2, at = nearest(q, p[(order := ids.to_numpy(zero_copy_only=False).argsort(kind="stable"))], gate)
                far = np.minimum(np.sqrt(d2), gate)
                done = far <= boxes.settles(q, b["box"][i].as_py())
                met = done & (at >= 0)
                sums += _sums(q[met], p[order][at[met]], d2[met], w[met], centre)
                if not done.all():
                    open_ids.append(b["asked"][i].values.field("id").filter(pa.array(~done)))
                    open_rows.append(np.column_stack([q, w, far])[~done])
            n = sum(map(len, open_ids))
            rows = np.concatenate([np.full((1, 5), np.nan), *open_rows])
            none = pa.nulls(1, b.schema.field("asked").type.value_type.field("id").type)
            lists = pa.ListArray.from_arrays(pa.array(np.array([0, SUMS] + [SUMS] * n, dtype=np.int32)), pa.array(sums))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([none, *open_ids]), *[pa.array(rows[:, k]) for k in range(5)], lists], names=["id", *AXES, "w", "far", "sums"])

    return run, f"id {kind}, x double, y double, z double, w double, far double, sums array<double>"


def _asking(boxes: Boxes, kind: str):
    """mapInArrow: moved places and how far their nearest may be -> the boxes that reach so far, one row each."""

    def run(batches):
        for b in batches:
            row, box = boxes.reached(np.stack([b[a].to_numpy() for a in AXES], axis=1), b["far"].to_numpy() * (1 + 1e-9))
            out = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(box), *[out[c] for c in ("id", *AXES, "w")]], names=["box", "id", *AXES, "w"])

    return run, f"box long, id {kind}, x double, y double, z double, w double"


def _answered(gate: float, kind: str, other: str):
    """mapInArrow: boxes and the places that ask them -> the nearest of each that the box holds."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                places = _places(b["asked"], i, (*AXES, "w"))
                p, ids = _places(b["points"], i), b["points"][i].values.field("id")
                d2, at = nearest(places[:, :3], p[(order := ids.to_numpy(zero_copy_only=False).argsort(kind="stable"))], gate)
                met = at >= 0
                row = order[at[met]]
                columns = [b["asked"][i].values.field("id").filter(pa.array(met)), *[pa.array(places[met, k]) for k in range(4)], pa.array(d2[met]), ids.take(pa.array(row)), *[pa.array(p[row, k]) for k in range(3)]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *AXES, "w", "d2", "tid", *[f"t{a}" for a in AXES]])

    return run, f"id {kind}, x double, y double, z double, w double, d2 double, tid {other}, tx double, ty double, tz double"


def _added() -> list[Column]:
    """The sums of rows of pairs, whose places are given about the centre."""
    w, q, t = F.col("w"), [F.col(a) for a in AXES], [F.col(f"t{a}") for a in AXES]
    return [F.sum(v).alias(f"s{i}") for i, v in enumerate([w, w * F.col("d2"), *[w * a for a in q], *[w * b for b in t], *[w * a * b for a in q for b in t]])]


class Search:
    """The nearest points of `still` to a moving cloud, not farther than gate. Points in one place count as one: that of the smallest
    id answers, and the moving ones weigh as many as they are. Points without finite coordinates meet nothing."""

    def __init__(self, moving: DataFrame, still: DataFrame, gate: float):
        self.gate, self.spark = gate, still.sparkSession
        self.kinds = [df.schema["id"].dataType.simpleString() for df in (moving, still)]
        finite = " AND ".join(f"abs({a}) < double('Infinity')" for a in AXES)
        placed = [df.select("id", *AXES).groupBy(*AXES).agg(F.min("id").alias("id"), F.count("*").cast("double").alias("w")).select("id", *AXES, "w") for df in (moving, still)]
        seen = Observation()
        self.moving = stash(placed[0].observe(seen, F.sum("w").alias("n"), F.count_if(F.expr(finite)).alias("places")).where(finite), "moving")
        self.still, there = stash_counted(placed[1].where(finite), "still")
        self.n, self.places, self.least = int(seen.get["n"] or 0), seen.get["places"] or 0, 0
        total = self.places + there
        depth = min(max(0, math.ceil(math.log2(max(1, total) / HOLD))), int(math.log2(MOST)))
        share = min(1.0, SAMPLED * 2**depth / max(1, total))
        samples = [np.array([tuple(r) for r in df.select(*AXES).sample(share, seed=7).collect()], dtype=float).reshape(-1, 3) for df in (self.moving, self.still)]  # SAMPLED a box
        self.boxes = cut(*samples, depth, share, gate)
        self.centre = samples[1].mean(axis=0) if len(samples[1]) else np.zeros(3)
        self._deal(np.eye(4))

    def _deal(self, pose: np.ndarray) -> None:
        parts = min(1 << self.boxes.depth, 4 * self.spark.sparkContext.defaultParallelism)
        sides = [df.mapInArrow(*_dealt(self.boxes, pose, kind, asks)) for df, kind, asks in ((self.moving, self.kinds[0], True), (self.still, self.kinds[1], False))]
        asked, point = F.struct("id", *AXES, "w"), F.struct("id", *AXES)
        rows = sides[0].select("box", asked.alias("asked"), F.lit(None).cast(f"struct<id:{self.kinds[1]},x:double,y:double,z:double>").alias("point"))
        rows = rows.unionByName(sides[1].select("box", F.lit(None).cast(rows.schema["asked"].dataType).alias("asked"), point.alias("point")))
        # A box is bounded by its share of the points, and so is its halo.
        self.dealt = stash(rows.repartition(parts, "box").groupBy("box").agg(F.collect_list("asked").alias("asked"), F.collect_list("point").alias("points")), "boxes")
        self.pose, self.fresh = pose, True

    def round(self, pose: np.ndarray) -> np.ndarray:
        """The sums over all pairs of a place, moved by pose, and its nearest point."""
        gate, (kind, other) = self.gate, self.kinds
        if not self.fresh and self.left > 2 * self.least + self.places // 20:
            unstash(self.dealt)
            self._deal(pose)
        seen = Observation()
        with settings(self.spark, READING):
            looked = self.dealt.mapInArrow(*_looked(self.boxes, pose, gate, self.centre, kind))
            counts = [F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(SUMS)]
            looked = stash(looked.observe(seen, *counts, F.count("far").alias("rows"), F.count_if(F.size("sums") == 0).alias("left")), "looked")
            got = seen.get
            sums, self.left = np.array([got[f"s{i}"] for i in range(SUMS)]), got["left"]
            if self.fresh:
                self.least, self.fresh = self.left, False
            if self.left:
                pieces = 1 + self.left // HOLD
                asking = looked.where(F.size("sums") == 0).select("id", *AXES, "w", "far").mapInArrow(*_asking(self.boxes, kind))
                asking = asking.groupBy("box", F.pmod(F.xxhash64("id"), F.lit(pieces)).alias("piece")).agg(F.collect_list(F.struct("id", *AXES, "w")).alias("asked"))
                asking = F.broadcast(asking) if self.left <= FEW else asking.hint("merge")
                answers = self.dealt.select("box", "points").join(asking, "box").select("asked", "points").mapInArrow(*_answered(gate, kind, other))
                best = answers.groupBy("id", *AXES, "w").agg(F.min(F.struct("d2", "tid", *[f"t{a}" for a in AXES])).alias("b")).select(*AXES, "w", "b.*")
                about = [(F.col(c) - float(self.centre[i])).alias(c) for t in ("", "t") for i, c in enumerate(f"{t}{a}" for a in AXES)]
                rest = best.select("w", "d2", *about).agg(*_added()).first()
                sums += np.array([v or 0.0 for v in rest])
        unstash(looked)
        return sums

    def close(self) -> None:
        unstash(self.moving, self.still, self.dealt)
