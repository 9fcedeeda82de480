"""Pose graphs as tables: Gauss-Newton over all captures at once, none of them held by one task.

A round makes an element of each edge: its two nodes, the 12 x 12 block that it adds to the normal equations, its
right side and its cost. The equations are solved exactly by substructuring. Nodes lie in segments of their numbers, a row each
with their poses, beside a row of the edges inside. A segment makes the elements of these where it eliminates the nodes that nothing outside
it touches, so they are written nowhere, and leaves one element on the others. Elements that join segments are rows; they wait for a wider level, whose segments are `segment` times as long, until every node is eliminated; then the
levels are gone back, each giving its nodes their steps. A chain of n nodes takes log(n) levels of many small tasks.

(Conjugate gradients, the plainer way to solve by joins alone, pass news along a chain by one node a round, so a chain of 20 000
keyframes would take that many.) The front of a segment is dense: nodes of the segment that long loops touch stay to the
level that holds both ends, so its size grows with the loops, which loop closure keeps at least 30 keyframes apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settings, stash, stash_counted, unstash
from . import graphs

SEGMENT = 64
#: Elements that one call assembles, about.
TOGETHER = 4096
#: Captures whose costs may go to all tasks at once.
FEW = 100_000
SOLVED, ELEMENT, INNER, COST = 0, 1, 2, 3
#: A join of segments may use what a join of captures has dealt.
DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def _stacked(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _terms(poses: np.ndarray, a: np.ndarray, to: np.ndarray, z: np.ndarray, loop: np.ndarray, huber: float, loop_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges between poses: cost, 12 x 12 block and right side."""
    z = graphs.inverse(graphs.matrices(z))
    r = graphs.residuals(poses, a, to, z)
    size = np.linalg.norm(r, axis=1)
    cost = np.where(loop & (size > huber), loop_weight * (2 * huber * size - huber**2), np.where(loop, loop_weight, 1.0) * size**2)
    w = np.where(loop, loop_weight * np.minimum(1.0, huber / np.maximum(size, 1e-12)), 1.0)
    j = np.concatenate(graphs.jacobians(poses, a, to, z, r), axis=2)
    return cost, np.einsum("e,eki,ekj->eij", w, j, j), -np.einsum("e,eki,ek->ei", w, j, r)


def _linear(huber: float, loop_weight: float):
    """mapInArrow: edges that join segments, with both poses -> the element of each and its cost."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            poses = graphs.matrices(np.concatenate([_stacked(b[c], 7) for c in ("pa", "pb")]))
            cost, k, f = _terms(poses, np.arange(n), n + np.arange(n), _stacked(b["z"], 7), b["loop"].to_numpy(zero_copy_only=False), huber, loop_weight)
            ends = np.stack([b[c].to_numpy() for c in ("a", "b")], axis=1)
            yield pa.RecordBatch.from_arrays([b["capture"], _lists(ends), _lists(k.reshape(n, 144)), _lists(f), pa.array(cost)], names=["capture", "nodes", "k", "f", "cost"])

    return run


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b[name].flatten().to_numpy(zero_copy_only=False)


def _owners(b: pa.RecordBatch, name: str) -> np.ndarray:
    """The row that each value of a column of lists is of."""
    return np.repeat(np.arange(b.num_rows), pc.list_value_length(b[name]).to_numpy(zero_copy_only=False))


def _found(owner: np.ndarray, node: np.ndarray, owners: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Where the nodes of rows lie among those of `owners`, -1 where they do not."""
    wide = max(int(nodes.max(initial=0)), int(node.max(initial=0))) + 1
    keys, asked = owners * wide + nodes, owner * wide + node
    order = np.argsort(keys, kind="stable")
    at = np.searchsorted(keys[order], asked)
    here = at < len(keys)
    here[here] = keys[order[at[here]]] == asked[here]
    out = np.full(len(asked), -1)
    out[here] = order[at[here]]
    return out


def _segments(huber: float, loop_weight: float, damping: float, alone: bool):
    """mapInArrow: segments with their edges -> their cost, and what _eliminate makes of the edges' elements. The first node of a
    capture does not move, so it has no place in elements; a segment that it does not lie in has its pose as `fixed`.
    alone: costs are all that is wanted."""
    eliminate = _eliminate(damping)

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        owners, nodes, poses = _owners(b, "nodes"), _flat(b, "nodes"), _flat(b, "tried").reshape(-1, 7)
        owner, ends = _owners(b, "a"), np.stack([_flat(b, "a"), _flat(b, "b")], axis=1)
        has = b["fixed"].is_valid().to_numpy(zero_copy_only=False)
        places = np.stack([_found(owner, ends[:, i], owners, nodes) for i in (0, 1)], axis=1)
        away = (places < 0) & (ends <= 0) & has[owner][:, None]
        places = np.where(away, len(poses) + (np.cumsum(has) - 1)[owner][:, None], places)
        poses = np.concatenate([poses, _flat(b, "fixed").reshape(-1, 7)])
        kept = (places >= 0).all(axis=1)
        owner, ends, places = owner[kept], ends[kept], places[kept]
        cost, k, f = _terms(graphs.matrices(poses), places[:, 0], places[:, 1], _flat(b, "z").reshape(-1, 7)[kept], _flat(b, "loop")[kept].astype(bool), huber, loop_weight)
        parts = []
        for free in ([0, 1], [0], [1]):
            those = np.flatnonzero(((ends > 0) == np.isin([0, 1], free)).all(axis=1))
            cells = np.concatenate([np.arange(6) + 6 * x for x in free])
            parts.append(pd.DataFrame({"capture": owner[those], "nodes": list(ends[those][:, free]), "k": list(k[those][:, cells][:, :, cells].reshape(len(those), len(cells) ** 2)), "f": list(f[those][:, cells])}))
        edge = _flat(b, "border").astype(bool)
        parts.append(pd.DataFrame({"capture": owners[edge], "nodes": list(nodes[edge][:, None]), "k": None, "f": None}))
        some = pd.concat([x for x in parts if len(x)] or parts[:1], ignore_index=True).assign(segment=0)
        out = eliminate(some) if len(some) and not alone else pd.DataFrame({c: [] for c in ("capture", "segment", "kind", "nodes", "border", "k", "f")})
        paid = np.unique(owner)
        rows, n = np.concatenate([out["capture"].to_numpy(dtype=int), paid]), len(paid)
        costs, none = np.bincount(owner, cost, b.num_rows)[paid], [np.zeros(0)] * n
        lists = [pa.array([*out[c], *none], pa.list_(t)) for c, t in (("nodes", pa.int64()), ("border", pa.int64()), ("k", pa.float64()))]
        columns = [b["capture"].take(pa.array(rows)), b["segment"].take(pa.array(rows)), pa.array(np.concatenate([out["kind"].to_numpy(dtype=int), np.full(n, COST)]), pa.int32()), *lists, pa.array([*out["f"], *costs[:, None]], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["capture", "segment", "kind", "nodes", "border", "k", "f"])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            # Elements are large, so those of about TOGETHER edges are made at once.
            call = np.cumsum(pc.list_value_length(b["a"]).to_numpy(zero_copy_only=False)) // TOGETHER
            begins = np.flatnonzero(np.diff(call, prepend=-1))
            for first, last in zip(begins, [*begins[1:], b.num_rows], strict=True):
                yield made(b.slice(first, last - first))

    return run


def _alone(pdf: pd.DataFrame, segment: np.ndarray, damping: float) -> list[tuple]:
    """Segments that nothing outside touches, of elements of one and two nodes: all those of equally many nodes at once."""
    size = pdf["nodes"].map(len).to_numpy()
    nodes = np.full((len(pdf), 2), -1, dtype=np.int64)
    flat = np.concatenate(pdf["nodes"].tolist())
    begin = np.cumsum(size) - size
    nodes[:, 0], nodes[size == 2, 1] = flat[begin], flat[begin[size == 2] + 1]
    owners = np.stack([np.repeat(segment, size), flat])
    known, at = np.unique(owners, axis=1, return_inverse=True)
    first = np.searchsorted(known[0], np.unique(known[0]))
    count = np.diff(np.concatenate((first, [known.shape[1]])))
    row = np.searchsorted(np.unique(known[0]), segment)  # of each element's segment
    local = at.reshape(-1) - np.repeat(first[row], size)
    names = pdf.groupby(segment)[["capture", "segment"]].first()
    out: list[tuple] = []
    for m in np.unique(count):
        those = np.flatnonzero(count == m)
        place = np.full(len(count), -1)
        place[those] = np.arange(len(those))
        whole, right = np.zeros((len(those), 6 * m, 6 * m)), np.zeros((len(those), 6 * m))
        for p in (1, 2):
            some = np.flatnonzero((size == p) & (place[row] >= 0))
            if len(some):
                cells = (6 * local[begin[some][:, None] + np.arange(p)][:, :, None] + np.arange(6)).reshape(len(some), 6 * p)
                g = place[row[some]]
                np.add.at(whole, (g[:, None, None], cells[:, :, None], cells[:, None, :]), np.stack(pdf["k"].iloc[some].tolist()).reshape(-1, 6 * p, 6 * p))
                np.add.at(right, (g[:, None], cells), np.stack(pdf["f"].iloc[some].tolist()))
        whole[:, np.arange(6 * m), np.arange(6 * m)] += damping
        steps = np.linalg.solve(whole, right[:, :, None])[:, :, 0]
        for g, i in enumerate(those):
            out.append((names["capture"].iloc[i], names["segment"].iloc[i], SOLVED, known[1, first[i] : first[i] + m], [], [], steps[g]))
    return out


def _eliminate(damping: float):
    """applyInPandas: the elements of several segments -> the steps of nodes that nothing else touches, one element on the
    rest, and how their steps follow from the others'."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        segments = pdf.groupby(["capture", "segment"], sort=False).ngroup().to_numpy()
        hard = np.zeros(segments.max() + 1, dtype=bool)
        hard[segments[(pdf["k"].isna() | (pdf["nodes"].map(len) > 2)).to_numpy()]] = True
        easy = ~hard[segments]
        out = _alone(pdf[easy], segments[easy], damping) if easy.any() else []
        for (capture, segment), rows in pdf[~easy].groupby(["capture", "segment"], sort=False):
            own = rows[rows["k"].notna()]
            if not len(own):
                continue
            touched = set(np.concatenate(rows.loc[rows["k"].isna(), "nodes"].tolist() or [np.zeros(0)]).astype(int).tolist())
            nodes = np.unique(np.concatenate(own["nodes"].tolist()))
            border = np.array([x in touched for x in nodes.tolist()], dtype=bool)
            order = np.concatenate([nodes[~border], nodes[border]])
            place = {x: i for i, x in enumerate(order.tolist())}
            whole, right = np.zeros((6 * len(order), 6 * len(order))), np.zeros(6 * len(order))
            for some, k, f in zip(own["nodes"], own["k"], own["f"], strict=True):
                at = np.concatenate([np.arange(6) + 6 * place[x] for x in some.tolist()])
                whole[np.ix_(at, at)] += np.asarray(k).reshape(len(at), len(at))
                right[at] += f
            n = 6 * int((~border).sum())
            inner, outer = order[: n // 6], order[n // 6 :]
            whole[np.arange(n), np.arange(n)] += damping
            none: list = []
            if not n:
                out.append((capture, segment, ELEMENT, outer, none, whole.ravel(), right))
                continue
            both = np.linalg.solve(whole[:n, :n], np.concatenate([whole[:n, n:], right[:n, None]], axis=1))
            follow, alone = both[:, :-1], both[:, -1]
            if not len(outer):
                out.append((capture, segment, SOLVED, inner, none, none, alone))
                continue
            out.append((capture, segment, ELEMENT, outer, none, (whole[n:, n:] - whole[n:, :n] @ follow).ravel(), right[n:] - whole[n:, :n] @ alone))
            out.append((capture, segment, INNER, inner, outer, follow.ravel(), alone))
        return pd.DataFrame(out, columns=["capture", "segment", "kind", "nodes", "border", "k", "f"])

    return run


def _followed(batches):
    """mapInArrow: inner nodes with the steps of their border -> their own steps."""
    for b in batches:
        capture, nodes, steps = [], [], []
        for c, inner, k, f, x in zip(b["capture"], b["nodes"], b["k"], b["f"], b["x"], strict=True):
            f, x = f.values.to_numpy(), x.values.flatten().to_numpy()
            step = f - k.values.to_numpy().reshape(len(f), len(x)) @ x
            capture += [c] * len(inner)
            nodes.append(inner.values.to_numpy())
            steps.append(step.reshape(-1, 6))
        if capture:
            yield pa.RecordBatch.from_arrays([pa.array(capture, b.schema.field("capture").type), pa.array(np.concatenate(nodes)), _lists(np.concatenate(steps))], names=["capture", "node", "x"])


def _level(kind: str) -> str:
    return f"capture {kind}, segment long, kind int, nodes array<long>, border array<long>, k array<double>, f array<double>"


def solve_elements(elements: DataFrame, damping: float = 1e-4, segment: int = SEGMENT, calls: int | None = None, first: DataFrame | None = None, free: list | None = None) -> DataFrame | None:
    """capture, node, x (6 numbers): the solution of the summed elements (capture, nodes, k, f), with `damping` added to
    the diagonal. Nodes are whole numbers of 1 and more. calls: how many Python calls a level is dealt to. first: the lowest level,
    if that is made already; elements are then those that join its segments, and what it has solved itself is not given again (None, if
    that is all). free: gets the tables to unstash when the result has been used."""
    kind, free = elements.schema["capture"].dataType.simpleString(), [] if free is None else free
    calls = calls or max(1, -(-elements.count() // TOGETHER))
    width, levels, left = segment, [], elements.where(F.size("nodes") > 0).select("capture", "nodes", "k", "f")
    if first is not None:
        width, levels, left = width * segment, [first], first.where(F.col("kind") == ELEMENT).select("capture", "nodes", "k", "f").unionByName(left)
    while not levels or left.take(1):
        if levels:
            left = stash(left, "elements")
            free.append(left)
        part = lambda x, w=width: F.floor(x / w).cast("long")
        low, high = part(F.array_min("nodes")), part(F.array_max("nodes"))
        inside = left.where(low == high).select("capture", low.alias("segment"), "nodes", "k", "f")
        across = left.where(low < high)
        missing = F.lit(None).cast("array<double>")
        touches = across.select("capture", F.explode("nodes").alias("n")).distinct().select("capture", part(F.col("n")).alias("segment"), F.array("n").alias("nodes"), missing.alias("k"), missing.alias("f"))
        call = F.pmod(F.xxhash64("capture", "segment"), F.lit(calls))
        done = stash(inside.unionByName(touches).groupBy(call.alias("call")).applyInPandas(_eliminate(damping), _level(kind)), "level")
        levels.append(done)
        free.append(done)
        left = done.where(F.col("kind") == ELEMENT).select("capture", "nodes", "k", "f").unionByName(across)
        width *= segment
    zipped = F.transform("nodes", lambda n, i: F.struct(n.alias("node"), F.slice("f", 6 * i + 1, 6).alias("x")))
    solved = None
    for done in reversed(levels):
        steps = done.where((F.col("kind") == SOLVED) & F.lit(done is not first)).select("capture", F.explode(zipped).alias("s")).select("capture", "s.node", "s.x")
        if solved is not None:
            inner = done.where(F.col("kind") == INNER)
            asked = inner.select("capture", "segment", F.posexplode("border").alias("place", "node"))
            # The border of a segment is bounded by its front.
            known = asked.join(solved.hint("merge"), ["capture", "node"]).groupBy("capture", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("x"))
            ready = inner.join(known.hint("merge"), ["capture", "segment"]).select("capture", "nodes", "k", "f", "x")
            steps = steps.unionByName(ready.mapInArrow(_followed, f"capture {kind}, node long, x array<double>")).unionByName(solved)
        solved = stash(steps, "steps") if len(levels) > 1 else steps
        free += [solved] if len(levels) > 1 else []
    return solved if first is None or len(levels) > 1 else None


def _stepped(batches):
    """mapInArrow: segments of captures that go on, with the steps of their nodes -> the poses they tried, and the next try."""
    for b in batches:
        owners, nodes, tried = _owners(b, "nodes"), _flat(b, "nodes"), _flat(b, "tried").reshape(-1, 7)
        at = _found(_owners(b, "at"), _flat(b, "at"), owners, nodes)
        step = np.zeros((len(nodes), 6))
        step[at[at >= 0]] = _flat(b, "x").reshape(-1, 6)[at >= 0]
        moved = graphs.moved7(tried, step * b["scale"].to_numpy()[owners][:, None])
        sizes = pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(b["tried"]).to_numpy(zero_copy_only=False)))), pa.int32())
        yield pa.RecordBatch.from_arrays([*[b[c] for c in ("capture", "segment", "nodes", "border")], *[pa.ListArray.from_arrays(sizes, pa.array(p.reshape(-1))) for p in (tried, moved)]], names=["capture", "segment", "nodes", "border", "pose", "tried"])


def _closed(batches):
    """mapInArrow: segments -> the pose of each node, its quaternion of length one and not behind."""
    for b in batches:
        p = _flat(b, "pose").reshape(-1, 7)
        q = p[:, 3:] / np.linalg.norm(p[:, 3:], axis=1, keepdims=True)
        p = np.concatenate([p[:, :3], np.where(q[:, 3:] < 0, -q, q)], axis=1)
        yield pa.RecordBatch.from_arrays([b["capture"].take(pa.array(_owners(b, "nodes"))), b["nodes"].flatten(), *[pa.array(p[:, i]) for i in range(7)]], names=["capture", "node", *graphs.POSE])


def solve_graphs(frames: DataFrame, edges: DataFrame, capture: str, rounds: int = 15, huber: float = 0.30, loop_weight: float = 2.0, damping: float = 1e-4, most: float = 0.25, segment: int = SEGMENT) -> DataFrame:
    """capture, node, the solved pose, cost0, cost1. frames: capture, node (0, 1, ...; 0 stays), POSE. edges: capture, a, b, POSE of
    Z, loop (boolean). Each capture has its own steps, cut to `most`, and its own end: a step that raises its cost is not
    taken and ends it, as does one that changes hardly anything. Every round is a few jobs over all captures that go on.

    Nodes and edges lie in rows of segments, which meet in sorted joins: poses pack so well in files that Spark, left to itself, takes
    those of a whole job for small and gathers them in the driver. Those of captures go to all tasks if there are at most FEW.
    Captures that have ended leave the tables, and what a round has written goes with it."""
    spark, kind, key = frames.sparkSession, frames.schema[capture].dataType.simpleString(), ["capture", "segment"]
    packed, part = F.array(*[F.col(p).cast("double") for p in graphs.POSE]), lambda c: F.floor(c / segment).cast("long")
    places = frames.select(F.col(capture).alias("capture"), F.col("node").cast("long").alias("node"), packed.alias("p")).where("capture IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    links = edges.select(F.col(capture).alias("capture"), a.cast("long").alias("a"), b.cast("long").alias("b"), packed.alias("z"), "loop").where("capture IS NOT NULL")
    low, high = F.when(a <= 0, b).when(b <= 0, a).otherwise(F.least(a, b)), F.when(a <= 0, b).when(b <= 0, a).otherwise(F.greatest(a, b))
    links = links.withColumn("segment", F.when(part(low) == part(high), part(low)))
    across, joining = stash_counted(links.where("segment IS NULL").drop("segment"), "across")
    border = F.lit(False)
    if joining:
        touched = across.select("capture", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("border", F.lit(True))
        places, border = places.join(touched.hint("merge"), ["capture", "node"], "left"), F.coalesce("border", F.lit(False))
    # Lists here are bounded by a segment: its nodes, and the edges inside it.
    listed = places.groupBy("capture", part(F.col("node")).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("node", border.alias("border"), "p"))).alias("l"))
    flat = F.flatten("l.p")
    nodes = stash(listed.select(*key, F.col("l.node").alias("nodes"), F.col("l.border").alias("border"), flat.alias("pose"), flat.alias("tried")), "nodes")
    listed = links.where("segment IS NOT NULL").groupBy(*key).agg(F.collect_list(F.struct("a", "b", "z", "loop")).alias("l"))
    listed = listed.select(*key, F.col("l.a").alias("a"), F.col("l.b").alias("b"), F.flatten("l.z").alias("z"), F.col("l.loop").alias("loop"))
    firsts = nodes.where("segment = 0 AND nodes[0] = 0").select("capture", F.slice("pose", 1, 7).alias("fixed"))
    away = (F.col("segment") > 0) & ((F.array_min("a") <= 0) | (F.array_min("b") <= 0))
    here = listed.where(~away).withColumn("fixed", F.lit(None).cast("array<double>"))
    links = stash(here.unionByName(listed.where(away).join(firsts.hint("merge"), "capture", "left")), "links")
    zero = F.lit(0.0)
    state = nodes.select("capture").distinct().select("capture", zero.alias("cost0"), zero.alias("cost"), F.lit(True).alias("open"), F.lit(False).alias("taken"), zero.alias("biggest"))
    state, captures = stash_counted(state, "captures")
    told = F.broadcast if captures <= FEW else lambda t: t.hint("merge")
    calls = max(1, -(-(joining + (links.agg(F.sum(F.size("a"))).first()[0] or 0)) // TOGETHER))
    held, going, ended = captures, captures, []
    for n in range(rounds + 1):
        free = [state]
        joined = nodes.select(*key, "nodes", "border", "tried").join(links.hint("merge"), key)
        done = stash(joined.mapInArrow(_segments(huber, loop_weight, damping, n == rounds), _level(kind)), "level")
        free.append(done)
        costs = done.where(F.col("kind") == COST).select("capture", F.get("f", F.lit(0)).alias("cost"))
        lines = done.select("capture", "nodes", "k", "f").limit(0)
        if joining:
            each = F.transform("nodes", lambda v, i: F.struct(v.alias("node"), F.get("border", i).alias("border"), F.slice("tried", 7 * i + 1, 7).alias("p")))
            tips = nodes.select("capture", F.explode(each).alias("e")).where("e.border")
            ends = [tips.select("capture", F.col("e.node").alias(c), F.col("e.p").alias(f"p{c}")) for c in "ab"]
            met = across.join(ends[0].hint("merge"), ["capture", "a"]).join(ends[1].hint("merge"), ["capture", "b"]).select("capture", "a", "b", "z", "loop", "pa", "pb")
            lines = stash(met.mapInArrow(_linear(huber, loop_weight), f"capture {kind}, nodes array<long>, k array<double>, f array<double>, cost double"), "lines")
            free.append(lines)
            costs = costs.unionByName(lines.select("capture", "cost"))
        reached = costs.groupBy("capture").agg(F.sum("cost").alias("reached"))
        good = F.col("open") & (F.lit(n == 0) | (F.col("reached") <= F.col("cost")))
        settled = F.lit(n > 0) & ((F.col("biggest") < 1e-7) | (F.col("cost") - F.col("reached") <= 1e-8 * F.col("cost")))
        marked = state.drop("taken").join(reached.hint("merge"), "capture", "left").withColumn("taken", good & F.col("reached").isNotNull())
        marked = marked.select(
            "capture", F.when(F.lit(n == 0), F.coalesce("reached", zero)).otherwise(F.col("cost0")).alias("cost0"), F.when(F.col("taken"), F.col("reached")).otherwise(F.col("cost")).alias("cost"),
            (F.col("taken") & ~settled & F.lit(n < rounds)).alias("open"), "taken",
        )
        state = stash(marked, "captures")
        before, going = going, state.where("open").count()
        if going < before:
            last = nodes.join(told(state.where("NOT open").select("capture", "taken")), "capture")
            ended.append(stash(last.select("capture", "nodes", F.when(F.col("taken"), F.col("tried")).otherwise(F.col("pose")).alias("pose")), "ended"))
        free.append(nodes)
        if going:
            steps = done.where(F.col("kind") == SOLVED).select(*key, F.col("nodes").alias("at"), F.col("f").alias("x"))
            others = solve_elements(lines.select("capture", "nodes", "k", "f"), damping, segment, calls, done, free)
            if others is not None:
                listed = others.groupBy("capture", part(F.col("node")).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("node", "x"))).alias("l"))
                steps = stash(steps.unionByName(listed.select(*key, F.col("l.node").alias("at"), F.flatten("l.x").alias("x"))), "steps")
                free.append(steps)
            biggest = steps.groupBy("capture").agg(F.max(F.aggregate("x", zero, lambda m, v: F.greatest(m, F.abs(v)))).alias("biggest"))
            free.append(state)
            state = stash(state.join(biggest.hint("merge"), "capture", "left").withColumn("biggest", F.coalesce("biggest", zero)), "captures")
            scale = F.least(F.lit(1.0), most / F.greatest("biggest", F.lit(1e-12)))
            with settings(spark, DEALT):
                # A capture that goes on has taken its try.
                moved = nodes.select(*key, "nodes", "border", "tried").join(told(state.where("open").select("capture", scale.alias("scale"))), "capture").join(steps.hint("merge"), key, "left")
                moved = moved.withColumn("at", F.coalesce("at", F.array().cast("array<long>"))).withColumn("x", F.coalesce("x", F.array().cast("array<double>")))
                nodes = stash(moved.mapInArrow(_stepped, f"capture {kind}, segment long, nodes array<long>, border array<boolean>, pose array<double>, tried array<double>"), "nodes")
            if 2 * going < held:
                fewer = stash(links.join(told(state.where("open").select("capture")), "capture", "left_semi"), "links")
                free.append(links)
                links, held = fewer, going
        unstash(*free)
        if not going:
            break
    unstash(links, across)
    solved = ended[0] if ended else nodes.select("capture", "nodes", "pose").limit(0)
    for some in ended[1:]:
        solved = solved.unionByName(some)
    solved = solved.mapInArrow(_closed, f"capture {kind}, node long, {', '.join(f'{p} double' for p in graphs.POSE)}")
    return solved.join(told(state.select("capture", "cost0", F.col("cost").alias("cost1"))), "capture").withColumnRenamed("capture", capture)
