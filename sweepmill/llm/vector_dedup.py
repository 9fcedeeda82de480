"""Embedding near-dedup by NN-descent.

Every distinct unit vector is a node with a list of its k nearest known neighbours. Lists begin with the best of a
few random-hyperplane buckets and are refined in rounds: around each node its neighbours and a bounded number of those
that have it as a neighbour are compared with one another (neighbours of neighbours), and each list keeps the k
best. Only nodes that gained something are joined again.

Edges of at least the threshold, measured in double precision, join nodes to components. A list that is full of such
edges is saturated; it is enlarged to its node's whole component, held not as ids but as blocks of vectors with a
centre and a radius. Two blocks so close that the angles prove every pair, or so far that they rule out every pair,
are counted as a whole; other pairs of blocks are compared vector by vector. So n_links is exact within a component,
while rows stay in proportion to vectors and blocks. A saturated list may also hide links to other components, so the
saturated nodes of each component are packed to blocks, whose centres look for blocks of other components by
NN-descent in turn; close blocks are compared vector by vector, joined components are searched again, and a block whose
list does not prove that it ends beyond reach is held against all blocks. Recall is audited: for a fixed number of
vectors all links are counted by brute force against all vectors, its own rows left out; if the mean share found of a vector that has links
(or of those in groups of like size) is below `recall`, lists are doubled and refined further, three times at most; if it still is, all vectors are compared with all (quadratic, exact).

Defined results: vectors that are null, empty, zero or hold a null or non-finite component have no links and are their
own component, kept; equal vectors are one node of several rows and link (cosine 1); vectors of different length do
not link; a null id is counted like others but names no component; labels and further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, graph

_SLACK = 1e-4  # of cosines in single precision, which only choose candidates


def _unit_rows(batches):
    for pdf in batches:
        out = []
        for key, v in zip(pdf["id"].tolist(), pdf["v"].tolist(), strict=True):
            x = None if v is None else np.array([np.nan if c is None else c for c in v], dtype=np.float64)
            size = 0.0
            if x is not None and len(x) and np.isfinite(x).all():
                x = x / max(np.abs(x).max(), 1e-300)
                size = float(np.linalg.norm(x))
            out.append((key, (x / size).tobytes() if size > 0 else None))
        yield pd.DataFrame(out, columns=["id", "unit"])


def _segments(by: str, work, names: list[str], types: list):
    """A mapInArrow function over rows sorted by `by` within partitions: calls work(key column, dict of columns, offsets)
    for runs of whole groups and yields the columns that it returns."""

    def emit(table):
        cols = {n: table.column(n) for n in table.column_names}
        key = np.asarray(cols[by].to_numpy())
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        result = work(cols, np.concatenate((starts, [len(key)])))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(result, types, strict=True)], names=names)

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column(by).to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if len(key) >= 4096 and len(change):
                cut = int(change[-1]) + 1
                yield emit(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield emit(held.combine_chunks())

    return run


def _matrix(column, dtype) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1)


def _best_in_groups(most: int):
    """For each row of a group the `most` nearest others of the group, none of its own team: node, nbr, sim."""

    def work(cols, at):
        nodes, vectors = cols["node"].to_numpy(), cols["vec"].to_pylist()
        fresh = cols["fresh"].to_numpy(zero_copy_only=False) if "fresh" in cols else None
        team = cols["team"].to_numpy() if "team" in cols else None
        a, b, s = [], [], []
        for begin, end in zip(at[:-1], at[1:], strict=True):
            if end - begin < 2:
                continue
            x = np.frombuffer(b"".join(vectors[begin:end]), dtype=np.float32).reshape(end - begin, -1)
            own = nodes[begin:end]
            sims = x @ x.T
            sims[own[:, None] == own[None, :]] = -2
            if team is not None:
                sims[team[begin:end, None] == team[None, begin:end]] = -2
            if fresh is not None:
                new = fresh[begin:end]
                sims[~(new[:, None] | new[None, :])] = -2
            m = min(most, end - begin - 1)
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            value = np.take_along_axis(sims, top, axis=1)
            ok = value > -1.5
            a.append(np.repeat(own, ok.sum(axis=1)))
            b.append(own[top][ok])
            s.append(value[ok])
        if not a:
            return [[], [], []]
        return [np.concatenate(a), np.concatenate(b), np.concatenate(s)]

    return work


_EDGE = "node long, nbr long, sim float"
_EDGE_TYPES = [pa.int64(), pa.int64(), pa.float32()]


def _top(edges: DataFrame, k: int, by: str = "node") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col("sim").desc(), "nbr" if by == "node" else "node")
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _held(vectors: DataFrame) -> list[str]:
    return [c for c in ("node", "vec", "team") if c in vectors.columns]


def _first_lists(vectors: DataFrame, count: int, k: int, tables: int, block: int, first: int) -> DataFrame:
    """Lists from buckets of random hyperplanes; a bucket of more than `block` nodes is dealt into several by hash."""
    bits = max(0, math.ceil(math.log2(max(1, count) / (block / 2))))

    def coded(batches):
        planes = {}
        for pdf in batches:
            rows = []
            for u in pdf["vec"]:
                x = np.frombuffer(u, dtype=np.float32)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([5, len(x), first]).standard_normal((tables * max(bits, 1), len(x)), dtype=np.float32)
                sign = (planes[len(x)] @ x > 0).reshape(tables, -1)[:, :bits].astype(np.int64)
                rows.append((sign << np.arange(bits)).sum(axis=1))
            yield pd.DataFrame({"node": pdf["node"], "length": pdf["vec"].map(len), "codes": rows})

    coded_rows = vectors.select("node", "vec").mapInPandas(coded, "node long, length long, codes array<long>")
    rows = common.stash(coded_rows.select("node", "length", F.posexplode("codes").alias("t", "code")), "codes")
    sizes = rows.groupBy("t", "code", "length").agg(F.count("*").alias("m"))
    dealt = rows.join(sizes, ["t", "code", "length"]).select("node", F.xxhash64("t", "code", "length", F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("m") / block).cast("long"))).alias("bucket"))
    held = _held(vectors)
    grouped = dealt.join(vectors.select(held), "node").repartition("bucket").sortWithinPartitions("bucket", "node").select("bucket", *held)
    edges = grouped.mapInArrow(_segments("bucket", _best_in_groups(k), ["node", "nbr", "sim"], _EDGE_TYPES), _EDGE)
    return _top(edges.dropDuplicates(["node", "nbr"]), k)


def _round(lists: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """One round of local joins: lists of node, nbr, sim, fresh after it."""
    forward = lists.select(F.col("node").alias("centre"), F.col("nbr").alias("node"), "fresh")
    backward = _top(lists, k, by="nbr").select(F.col("nbr").alias("centre"), "node", "fresh")
    around = forward.unionByName(backward).groupBy("centre", "node").agg(F.max("fresh").alias("fresh"))
    # A node whose neighbourhood brought nothing new has been joined before.
    live = around.where("fresh").select("centre").distinct()
    held = _held(vectors)
    grouped = around.join(live, "centre", "left_semi").join(vectors.select(held), "node")
    grouped = grouped.repartition("centre").sortWithinPartitions("centre", "node").select("centre", *held, "fresh")
    met = grouped.mapInArrow(_segments("centre", _best_in_groups(max(2, k // 2)), ["node", "nbr", "sim"], _EDGE_TYPES), _EDGE)
    both = lists.select("node", "nbr", "sim", F.lit(False).alias("fresh")).unionByName(met.withColumn("fresh", F.lit(True)))
    return _top(both.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh")), k)


def _exact_edges(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    near = lists.where(F.col("sim") >= threshold - _SLACK).select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()

    def check(batches):
        for pdf in batches:
            ok = [float(np.frombuffer(x) @ np.frombuffer(y)) >= threshold for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    left = vectors.select(F.col("node").alias("a"), F.col("unit").alias("x"))
    right = vectors.select(F.col("node").alias("b"), F.col("unit").alias("y"))
    return near.join(left, "a").join(right, "b").mapInPandas(check, "a long, b long")


def _angle(c):
    return np.arccos(np.clip(c, -1, 1))


def _pack(threshold: float):
    """Blocks of a component: centre, radius, nodes, vectors, rows, and the links of each node inside the block."""

    def work(cols, at):
        nodes, weight, comp = cols["node"].to_numpy(), cols["rows"].to_numpy(), cols["component"].to_numpy()
        part, units, out = cols["part"].to_numpy(), cols["unit"].to_pylist(), []
        for begin, end in zip(at[:-1], at[1:], strict=True):
            x = np.frombuffer(b"".join(units[begin:end])).reshape(end - begin, -1)
            own = weight[begin:end]
            linked = ((x @ x.T >= threshold) | np.eye(end - begin, dtype=bool)).astype(np.float64) @ own
            centre = x.mean(axis=0)
            centre = centre / max(np.linalg.norm(centre), 1e-300)
            radius = float(_angle(x @ centre).max())
            out.append((comp[begin], part[begin], centre.tobytes(), radius, int(own.sum()), nodes[begin:end].astype(np.int64), x.tobytes(), own.astype(np.int64), linked.astype(np.int64)))
        return list(zip(*out, strict=True)) if out else [[]] * 9

    return work


def _component_links(comps: DataFrame, vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """node, linked: rows linked with each node of a component, its own included."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("m"))
    member = comps.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / block).cast("long")))
    member = member.join(vectors.select("node", "unit", "rows"), "node").withColumn("place", F.xxhash64("component", "part"))
    names = ["component", "part", "centre", "radius", "total", "nodes", "units", "weights", "linked"]
    kinds = "component long, part long, centre binary, radius double, total long, nodes array<long>, units binary, weights array<long>, linked array<long>"
    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64(), longs, pa.binary(), longs, longs]
    sorted_rows = member.repartition("place").sortWithinPartitions("place", "node").select("place", "component", "part", "node", "unit", "rows")
    blocks = common.stash(sorted_rows.mapInArrow(_segments("place", _pack(threshold), names, types), kinds), "blocks")

    # Blocks of one component, against one another: first by centre and radius alone.
    limit = math.acos(threshold)
    brief = blocks.select("component", "part", "centre", "radius", "total")
    other = brief.select("component", F.col("part").alias("part2"), F.col("centre").alias("centre2"), F.col("radius").alias("radius2"), F.col("total").alias("total2"))

    @F.pandas_udf("int")
    def verdict(c1: pd.Series, c2: pd.Series, r1: pd.Series, r2: pd.Series) -> pd.Series:
        angle = np.array([_angle(float(np.frombuffer(a) @ np.frombuffer(b))) for a, b in zip(c1, c2, strict=True)])
        return pd.Series(np.where(angle + r1 + r2 < limit - 1e-7, 1, np.where(angle - r1 - r2 > limit + 1e-7, 0, -1)).astype(np.int32))

    # A component that lies in so small a ball that all its vectors link needs no pairs.
    @F.pandas_udf("double")
    def apart(c1: pd.Series, c2: pd.Series) -> pd.Series:
        return pd.Series([float(_angle(np.frombuffer(a) @ np.frombuffer(b))) for a, b in zip(c1, c2, strict=True)], dtype=float)

    first = brief.groupBy("component").agg(F.min_by("centre", "part").alias("_c"), F.sum("total").alias("linked"))
    reach = brief.join(first, "component").groupBy("component").agg(F.max(apart("centre", "_c") + F.col("radius")).alias("reach"), F.first("linked").alias("linked"))
    tight = common.stash(reach.where(2 * F.col("reach") < limit - 1e-7).select("component", "linked"), "tight")
    all_linked = blocks.join(tight.withColumnRenamed("linked", "_l"), "component").select(F.explode("nodes").alias("node"), F.col("_l").alias("linked"))
    loose = brief.join(tight, "component", "left_anti")
    inside = blocks.join(tight, "component", "left_anti").select(F.explode(F.arrays_zip("nodes", "linked")).alias("z")).select(F.col("z.nodes").alias("node"), F.col("z.linked").alias("linked"))

    pairs = loose.join(other, "component").where("part <> part2").withColumn("all", verdict("centre", "centre2", "radius", "radius2"))
    pairs = common.stash(pairs.where("`all` <> 0").select("component", "part", "part2", "all", "total2"), "pairs")
    whole = pairs.where("`all` = 1").groupBy("component", "part").agg(F.sum("total2").alias("linked"))
    whole = blocks.join(whole.withColumnRenamed("linked", "_l"), ["component", "part"]).select(F.explode("nodes").alias("node"), F.col("_l").alias("linked"))

    def compare(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, y = np.frombuffer(row.units).reshape(len(row.nodes), -1), np.frombuffer(row.units2).reshape(len(row.weights2), -1)
                yield pd.DataFrame({"node": row.nodes, "linked": ((x @ y.T >= threshold).astype(np.float64) @ np.asarray(row.weights2)).astype(np.int64)})

    mine = blocks.select("component", "part", "nodes", "units")
    theirs = blocks.select("component", F.col("part").alias("part2"), F.col("units").alias("units2"), F.col("weights").alias("weights2"))
    close = pairs.where("`all` = -1").select("component", "part", "part2").join(mine, ["component", "part"]).join(theirs, ["component", "part2"])
    across = close.select("nodes", "units", "units2", "weights2").mapInPandas(compare, "node long, linked long")
    return inside.unionByName(all_linked).unionByName(whole).unionByName(across).groupBy("node").agg(F.sum("linked").alias("linked"))


def _merged(comps: DataFrame, pairs: DataFrame) -> DataFrame:
    """comps after components a and b of each pair are one; a node that is in no component is its own."""
    roots = graph.components(pairs)
    known = comps.join(roots.select(F.col("node").alias("component"), F.col("component").alias("_new")), "component", "left")
    known = known.select("node", F.coalesce("_new", "component").alias("component"))
    return common.stash(known.unionByName(roots.join(comps, "node", "left_anti").select("node", "component")), "merged")


def _join_saturated(comps: DataFrame, lists: DataFrame, vectors: DataFrame, threshold: float, k: int, tables: int, rounds: int, block: int) -> DataFrame:
    """comps, joined where nodes whose lists hold nothing but edges have links to other components."""
    full = lists.groupBy("node").agg(F.count("*").alias("m"), F.min("sim").alias("sim")).where((F.col("m") >= k) & (F.col("sim") >= threshold - _SLACK))
    member = common.stash(full.select("node").join(comps, "node"), "saturated")
    if member.select("component").distinct().limit(2).count() < 2:
        return comps
    sizes = member.groupBy("component").agg(F.count("*").alias("m"))
    member = member.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / 256).cast("long")))
    member = member.join(vectors.select("node", "unit"), "node").withColumn("place", F.xxhash64("component", "part"))

    def pack(cols, at):
        comp, part, units, out = cols["component"].to_numpy(), cols["part"].to_numpy(), cols["unit"].to_pylist(), []
        for begin, end in zip(at[:-1], at[1:], strict=True):
            x = np.frombuffer(b"".join(units[begin:end])).reshape(end - begin, -1)
            centre = x.mean(axis=0)
            centre = centre / max(np.linalg.norm(centre), 1e-300)
            out.append((comp[begin], part[begin], centre.tobytes(), centre.astype(np.float32).tobytes(), float(_angle(x @ centre).max()), x.tobytes()))
        return list(zip(*out, strict=True)) if out else [[]] * 6

    names, types = ["origin", "part", "centre", "vec", "radius", "units"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.binary()]
    rows = member.repartition("place").sortWithinPartitions("place", "node").select("place", "component", "part", "unit")
    blocks = rows.mapInArrow(_segments("place", pack, names, types), "origin long, part long, centre binary, vec binary, radius double, units binary")
    blocks = common.stash(blocks.withColumn("node", F.xxhash64("origin", "part")), "blocks")
    limit = math.acos(threshold)

    @F.pandas_udf("boolean")
    def near(c1: pd.Series, c2: pd.Series, r1: pd.Series, r2: pd.Series) -> pd.Series:
        angle = np.array([_angle(float(np.frombuffer(a) @ np.frombuffer(b))) if len(a) == len(b) else np.inf for a, b in zip(c1, c2, strict=True)])
        return pd.Series(angle - r1.to_numpy() - r2.to_numpy() <= limit + 1e-7)

    def linked(batches):
        for pdf in batches:
            ok = []
            for x, y, c in zip(pdf["x"], pdf["y"], pdf["size"], strict=True):
                ok.append(bool((np.frombuffer(x).reshape(-1, c) @ np.frombuffer(y).reshape(-1, c).T >= threshold).any()))
            yield pdf.loc[ok, ["a", "b"]]

    def joined(asked: DataFrame, teams: DataFrame) -> DataFrame:
        """Components that a link joins, of pairs of blocks (node, nbr)."""
        brief = teams.select("node", "team", "centre", "radius")
        other = brief.select(F.col("node").alias("nbr"), F.col("team").alias("team2"), F.col("centre").alias("centre2"), F.col("radius").alias("radius2"))
        close = asked.join(brief, "node").join(other, "nbr").where("team <> team2").where(near("centre", "centre2", "radius", "radius2"))
        close = close.select(F.least("node", "nbr").alias("node"), F.greatest("node", "nbr").alias("nbr")).distinct()
        left = teams.select("node", F.col("team").alias("a"), F.col("units").alias("x"), (F.length("centre") / 8).cast("int").alias("size"))
        right = teams.select(F.col("node").alias("nbr"), F.col("team").alias("b"), F.col("units").alias("y"))
        return common.stash(close.join(left, "node").join(right, "nbr").mapInPandas(linked, "a long, b long").distinct(), "joined")

    while True:
        now = comps.select(F.col("node").alias("origin"), F.col("component").alias("team"))
        teams = common.stash(blocks.join(now, "origin"), "teams")
        n, widest = teams.agg(F.count("*"), F.max("radius")).first()
        found = common.stash(_first_lists(teams, n, k, tables, block, 0).withColumn("fresh", F.lit(True)), "lists")
        for _ in range(rounds):
            if not found.where("fresh").take(1):
                break
            found = common.stash(_round(found, teams, k), "lists")
        pairs = joined(found.select("node", "nbr"), teams)
        if pairs.take(1):
            comps = _merged(comps, pairs)
            continue
        # What a list that ends within reach (or too early) leaves out is looked for among all blocks.
        ends = found.groupBy("node").agg(F.count("*").alias("m"), F.min("sim").alias("sim"))
        same = teams.groupBy("team").agg(F.count("*").alias("own"))
        reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sim") + _SLACK))) - F.col("radius") - widest > limit
        proven = F.when(F.col("m") >= k, reach).otherwise(F.coalesce("m", F.lit(0)) >= n - F.col("own"))
        rest = common.stash(teams.join(same, "team").join(ends, "node", "left").where(~proven).select("node", "team", "centre", "radius"), "rest")
        chunks, pairs = -(-rest.count() // 2048), None
        for c in range(chunks):
            asked = rest.where(F.pmod(F.xxhash64("node"), F.lit(chunks)) == c).collect()  # about 2048 centres
            some = joined(_reached(asked, teams, limit), teams)
            pairs = some if pairs is None else pairs.unionByName(some)
        return _merged(comps, pairs) if pairs is not None and pairs.take(1) else comps


def _reached(asked: list, teams: DataFrame, limit: float) -> DataFrame:
    """node, nbr: the blocks (nbr) of other teams so near to the asked ones (node) that they may link."""
    held = teams.sparkSession.sparkContext.broadcast([(r["node"], r["team"], bytes(r["centre"]), r["radius"]) for r in asked])

    def run(batches):
        groups: dict[int, list] = {}
        for row in held.value:
            groups.setdefault(len(row[2]), []).append(row)
        stacked = {n: (np.array([r[0] for r in g]), np.array([r[1] for r in g]), np.stack([np.frombuffer(r[2]) for r in g]), np.array([r[3] for r in g])) for n, g in groups.items()}
        for pdf in batches:
            out = []
            for node, team, centre, radius in zip(pdf["node"], pdf["team"], pdf["centre"], pdf["radius"], strict=True):
                if len(centre) in stacked:
                    nodes, theirs, centres, radii = stacked[len(centre)]
                    near = (theirs != team) & (_angle(centres @ np.frombuffer(centre)) - radii - radius <= limit + 1e-7)
                    out.append(pd.DataFrame({"node": nodes[near], "nbr": np.full(int(near.sum()), node)}))
            yield pd.concat(out) if out else pd.DataFrame({"node": [], "nbr": []}, dtype="int64")

    return teams.select("node", "team", "centre", "radius").mapInPandas(run, "node long, nbr long")


def _compare_all(comps: DataFrame, vectors: DataFrame, threshold: float, count: int, chunk: int = 2048) -> DataFrame:
    """comps after every vector was compared with every other."""
    parts = max(1, math.ceil(count / chunk))
    rows = vectors.select("node", "unit").join(comps, "node", "left").select("unit", F.coalesce("component", "node").alias("component"), F.length("unit").alias("size"), F.pmod(F.xxhash64("node", F.lit("all")), F.lit(parts)).alias("part"))

    def pack(cols, at):
        comp, size, part, units, out = cols["component"].to_numpy(), cols["size"].to_numpy(), cols["part"].to_numpy(), cols["unit"].to_pylist(), []
        for begin, end in zip(at[:-1], at[1:], strict=True):
            out.append((size[begin], part[begin], comp[begin:end].astype(np.int64), b"".join(units[begin:end])))
        return list(zip(*out, strict=True)) if out else [[]] * 4

    names, types = ["size", "part", "comps", "units"], [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    placed = rows.withColumn("place", F.xxhash64("size", "part")).repartition("place").sortWithinPartitions("place").select("place", "size", "part", "component", "unit")
    chunks = common.stash(placed.mapInArrow(_segments("place", pack, names, types), "size int, part long, comps array<long>, units binary"), "chunks")
    other = chunks.select("size", F.col("part").alias("part2"), F.col("comps").alias("comps2"), F.col("units").alias("units2"))
    asked = chunks.select("size", "part").join(chunks.select("size", F.col("part").alias("part2")), "size").where("part <= part2")
    asked = asked.join(chunks, ["size", "part"]).join(other, ["size", "part2"])

    def compare(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, y = np.frombuffer(row.units).reshape(len(row.comps), -1), np.frombuffer(row.units2).reshape(len(row.comps2), -1)
                a, b = np.asarray(row.comps), np.asarray(row.comps2)
                i, j = np.nonzero((x @ y.T >= threshold) & (a[:, None] != b[None, :]))
                pairs = np.unique(np.stack([a[i], b[j]], axis=1), axis=0)
                yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    pairs = common.stash(asked.select("comps", "comps2", "units", "units2").mapInPandas(compare, "a long, b long").distinct(), "pairs")
    return _merged(comps, pairs) if pairs.take(1) else comps


def _recall(counts: list[tuple[int, int]], least: int = 64) -> float:
    """Of (found, true) links of audited vectors: the mean share found, each vector that has links counting once, or
    that of a class of groups by size (1, 2 to 7, 8 to 31, ... links) with at least `least` such vectors, if lower."""
    classes: dict[int, list[float]] = {}
    for found, true in counts:
        if true > 0:
            classes.setdefault(true.bit_length() // 2, []).append(min(found, true) / true)
    shares = [x for c in classes.values() for x in c]
    return min((float(np.mean(c)) for c in [shares, *classes.values()] if c and (c is shares or len(c) >= least)), default=1.0)


def _audit(vectors: DataFrame, linked: DataFrame, threshold: float, audited: int, enough: int = 256) -> float:
    """The recall of links, without a vector's own rows, of a fixed number of nodes; of eight times as many if fewer than
    `enough` of them have links."""
    share, counts = _audited(vectors, linked, threshold, audited)
    if sum(true > 0 for _, true in counts) < enough and len(counts) == audited:
        share, counts = _audited(vectors, linked, threshold, 8 * audited)
    return share


def _audited(vectors: DataFrame, linked: DataFrame, threshold: float, audited: int) -> tuple[float, list[tuple[int, int]]]:
    chosen = vectors.select("node", "unit", "rows").orderBy(F.xxhash64("unit", F.lit("audit")), "node").limit(audited)
    rows = chosen.join(linked, "node", "left").select("node", "unit", "rows", F.coalesce("linked", "rows").alias("found")).collect()
    held = vectors.sparkSession.sparkContext.broadcast([(r["node"], bytes(r["unit"])) for r in rows])

    def count(batches):
        groups: dict[int, list] = {}
        for node, unit in held.value:
            groups.setdefault(len(unit), []).append((node, np.frombuffer(unit)))
        total: dict[int, int] = {}
        for pdf in batches:
            units, weight = pdf["unit"].tolist(), pdf["rows"].to_numpy()
            size = np.array([len(u) for u in units])
            for length, asked in groups.items():
                mine = np.flatnonzero(size == length)
                for at in range(0, len(mine), 1024):
                    some = mine[at : at + 1024]
                    x = np.frombuffer(b"".join(units[i] for i in some)).reshape(len(some), -1)
                    hits = (np.stack([v for _, v in asked]) @ x.T >= threshold) @ weight[some]
                    for (node, _), n in zip(asked, hits.tolist(), strict=True):
                        total[node] = total.get(node, 0) + n
        yield pd.DataFrame({"node": list(total), "n": list(total.values())}, dtype="int64")

    true = {r["node"]: r["n"] for r in vectors.select("unit", "rows").mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    # Rounding may put a vector's cosine with itself below a threshold of 1.
    counts = [(r["found"] - r["rows"], max(0, true.get(r["node"], 0) - r["rows"])) for r in rows]
    return _recall(counts), counts


def near_vectors(table: DataFrame, threshold: float = 0.95, k: int = 8, tables: int = 8, rounds: int = 3, block: int = 64, recall: float = 0.98, audited: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept, and audit_recall (double, of the last audit) for every row."""
    ids = table.schema[id_col].dataType.simpleString()
    units = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(_unit_rows, f"id {ids}, unit binary")
    units = common.stash(units, "units")

    def single(batches):
        for pdf in batches:
            yield pdf.assign(vec=[np.frombuffer(u).astype(np.float32).tobytes() for u in pdf["unit"]])

    # Equal vectors are one node, told apart by all their bytes; it has a number of its own.
    nodes = units.where("unit IS NOT NULL").groupBy("unit").agg(F.count("*").alias("rows"), F.min("id").alias("root"))
    kinds = f"unit binary, rows long, root {ids}, vec binary"
    vectors = common.stash(nodes.mapInPandas(single, kinds).withColumn("node", F.monotonically_increasing_id()), "vectors")
    count, share, attempt = vectors.count(), 1.0, 0
    lists = None
    while True:
        start = _first_lists(vectors, count, k, tables, block, attempt).withColumn("fresh", F.lit(True))
        if lists is not None:
            start = _top(start.unionByName(lists).groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh")), k)
        lists = common.stash(start, "lists")
        for _ in range(rounds):
            new = common.stash(_round(lists, vectors, k), "lists")
            common.unstash(lists)
            lists = new
            if not lists.where("fresh").take(1):
                break
        comps = graph.components(_exact_edges(lists, vectors, threshold))
        comps = _join_saturated(comps, lists, vectors, threshold, k, tables, rounds, block)
        linked = common.stash(_component_links(comps, vectors, threshold, 256), "linked")
        share = _audit(vectors, linked, threshold, audited)
        if share >= recall:
            break
        if attempt == 3:
            comps = _compare_all(comps, vectors, threshold, count)
            linked = common.stash(_component_links(comps, vectors, threshold, 256), "linked")
            share = _audit(vectors, linked, threshold, audited)
            break
        attempt, k = attempt + 1, 2 * k
    named = vectors.select("node", "root", "rows").join(comps, "node", "left").join(linked, "node", "left")
    named = named.select("node", "root", F.coalesce("component", "node").alias("component"), (F.coalesce("linked", "rows") - 1).alias("n_links"))
    least = named.groupBy("component").agg(F.min("root").alias("component_id"))
    per_node = named.join(least, "component").join(vectors.select("node", "unit"), "node").select("unit", "n_links", "component_id")
    out = units.join(per_node, "unit", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))).withColumn("audit_recall", F.lit(share))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
