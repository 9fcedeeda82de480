"""Connected components of an edge table by alternating stars, with every step on disk in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """node, component (the smallest node id reachable) of every node that has an edge; ids are long.

    Kiveris and others' alternation: the large star hangs each node's larger neighbours on its smallest, the small
    star hangs the rest of the smaller ones. Both shrink paths, so rounds grow with the logarithm of a component's
    size. Neighbours are never gathered into a row: a star is a minimum by key and a join, which Spark can split
    where one node has very many edges."""
    now = common.stash(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(most):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        new = common.stash(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "star")
        common.unstash(now)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = common.stash(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    common.unstash(now)
    return out
