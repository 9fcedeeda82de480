"""Mixing sources to target weights by pivotal dependent rounding.

Each document gets a fractional number of copies, its source's target over its source's size. The whole part is taken
as it stands; the fractions are rounded dependently. A pivot step takes two documents with fractions and moves
words - not probabilities - between them, in a random direction chosen so that neither expectation changes, until one
of the two is whole. The words of a source are thereby kept exactly, step by step, and only the very last fraction of
a source is drawn for itself, so a source misses its target by less than that one document and every document keeps
its expected number of copies.

Steps run as a reduction tree. At each level the open documents of a source are dealt by hash into buckets of about
`bucket` rows; one task folds a bucket, largest first, and leaves at most one open document for the next level. Where all
fractions of a bucket are equal, as they are at first, a document is balanced by all smaller ones together, which
give or take words alike, as long as they can: large documents are settled by the many small ones, so what remains is
small. A document that outweighs the rest of its bucket waits, so that it never decides over all of them. A source with a third of all rows is many buckets. All draws come from hashes of ids and the seed: reruns agree.

Targets. Sources in code-point order, null last, weigh `weights`, repeating. They share `share` of all sizes by
weight; a target stops at `most` times its source's size and the excess is shared again by weight until none is above.
This is min(most * size, level * weight) for one common level, found in one pass over the sources in the order in which a
rising level caps them.

Defined results: a null or empty text has size 0, is never open and takes 0 words; rows with equal id, source and
text are one document of their joint size, so they are taken together; a null id is an id like others; if all sizes
are 0, so are all targets. Columns named like a result column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_RESULTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text):
    """Number of white-space separated words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target, n_docs from a table of source, size (one row a document, or sums of several)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # One row for each source: the only ordering of all of them, over their names alone.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    table = common.stash(totals.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")), "sources")
    wanted = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    capped = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(capped.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.lit(float(wanted)) - before) / F.sum("weight").over(capped.rowsBetween(0, Window.unboundedFollowing))
    # The first source that its level does not cap; without one, all are capped.
    row = table.select(level.alias("level"), (F.col("cap") / F.col("weight")).alias("reach")).where("level < reach").agg(F.min_by("level", "reach")).first()
    top = F.col("cap") if row[0] is None else F.least("cap", F.lit(row[0]) * F.col("weight"))
    return table.select("source", "source_size", top.alias("target"), "n_docs")


def _draw(a: np.ndarray, seed: int) -> float:
    """A number in [0, 1) from two ids."""
    with np.errstate(over="ignore"):
        x = common.mix64(a * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64))
        return float(int(common.mix64(x[:1] ^ (x[1:] + np.uint64(seed)))[0] >> np.uint64(11)) / 2**53)


def fold(keys, sizes, parts, seed: int, last: bool):
    """Pivot steps over documents in the given order; the fractions afterwards: 0 or 1 for all but at most one, or, the
    last one drawn, for all if `last`."""
    x, keys = list(map(float, parts)), np.asarray(keys, dtype=np.uint64)
    if len(set(x)) == 1:
        _fold_equal(x, keys, sizes, seed)
    held = None
    for i in range(len(x)):
        if not 0.0 < x[i] < 1.0:
            continue
        if held is None:
            held = i
            continue
        h, sh, si = held, float(sizes[held]), float(sizes[i])
        up = min((1.0 - x[h]) * sh, x[i] * si)  # words that h may gain and i may give
        down = min(x[h] * sh, (1.0 - x[i]) * si)
        if _draw(keys[[h, i]], seed) * (up + down) < down:
            x[h], x[i], full_h, empty_i = x[h] + up / sh, x[i] - up / si, up == (1.0 - x[h]) * sh, up == x[i] * si
            x[h], x[i] = (1.0 if full_h else x[h]), (0.0 if empty_i else x[i])
        else:
            x[h], x[i], empty_h, full_i = x[h] - down / sh, x[i] + down / si, down == x[h] * sh, down == (1.0 - x[i]) * si
            x[h], x[i] = (0.0 if empty_h else x[h]), (1.0 if full_i else x[i])
        x[h], x[i] = _snap(x[h]), _snap(x[i])
        held = h if 0.0 < x[h] < 1.0 else i if 0.0 < x[i] < 1.0 else None
    if last and held is not None:
        x[held] = float(_draw(keys[[held, held]], seed) < x[held])
    return x


def _fold_equal(x: list, keys: np.ndarray, sizes, seed: int) -> None:
    """Pivot steps between each document and all that follow it, which share one fraction, where these can balance it
    without being settled themselves. A document that outweighs the rest is left open: it would take or drop all of them
    at once. What is left open is then paired one with one, and goes on up the tree to documents of its kind."""
    part, rest = x[0], np.concatenate((np.cumsum(np.asarray(sizes, dtype=float)[::-1])[::-1], [0.0])).tolist()
    for i in range(len(x) if 0.0 < part < 1.0 else 0):
        size, words = float(sizes[i]), rest[i + 1]
        up, down = (1.0 - part) * size, part * size
        if up >= part * words or down >= (1.0 - part) * words:
            x[i] = part
        elif _draw(keys[[i, i + 1]], seed) * (up + down) < down:
            x[i], part = 1.0, part - up / words
        else:
            x[i], part = 0.0, part + down / words


def _snap(v: float) -> float:
    return 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v


def _fold_bucket(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mass", "key"], ascending=[False, True], kind="stable")
        last = bool(pdf["last"].iloc[0])
        pdf["part"] = fold(pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["mass"].to_numpy(), pdf["part"].to_numpy(), seed, last)
        return pdf[["key", "src", "mass", "part"]]

    return run


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 7, bucket: int = 4096, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with size, source_size (long), target (double, of the source), copies (int) and taken (long: size times
    copies). No document is taken more than ceil(most) times."""
    docs = common.without(docs, *_RESULTS)
    names = {c: f"_column{i}" for i, c in enumerate(docs.columns)}
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    text_key = F.xxhash64(names[text_col])
    narrow = docs.select(F.col(names[id_col]).alias("_id"), F.col(names[source_col]).alias("source"), text_key.alias("_text"), word_count(F.col(names[text_col])).alias("size"))
    items = common.stash(narrow.groupBy("_id", "source", "_text").agg(F.first("size").alias("size"), F.count("*").alias("rows")), "items")
    targets = common.stash(source_targets(items.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, most), "targets")
    mine = targets.withColumnRenamed("source", "_s").where("source_size > 0")
    ratio = F.col("target") / F.col("source_size")
    named = items.join(mine, F.col("source").eqNullSafe(F.col("_s"))).select(
        "_id", "source", "_text", "size", "source_size", "target", F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("part"),
        (F.col("size") * F.col("rows")).alias("mass"), F.xxhash64("_id", "source", "_text").alias("key"), F.xxhash64("source").alias("src"),
    )
    named = common.stash(named, "named")
    live = named.where("mass > 0 AND part > 0 AND part < 1").select("key", "src", "mass", "part")
    count, settled, level, levels = targets.agg(F.max("n_docs")).first()[0] or 0, None, 0, []
    while count:
        parts = math.ceil(count / bucket)
        dealt = live.withColumn("_bucket", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(parts))).withColumn("last", F.lit(parts == 1))
        done = common.stash(dealt.groupBy("src", "_bucket").applyInPandas(_fold_bucket(seed + level), "key long, src long, mass long, part double"), f"level{level}")
        levels.append(done)
        whole = done.where("part = 1").select("key", "src")
        settled = whole if settled is None else settled.unionByName(whole)
        live, count, level = done.where("part > 0 AND part < 1"), parts if parts > 1 else 0, level + 1
    settled = common.stash((named.select("key", "src").limit(0) if settled is None else settled).distinct(), "settled")
    common.unstash(*levels)
    copies = named.join(settled.withColumn("_one", F.lit(1)), ["key", "src"], "left")
    copies = copies.select(
        F.col("_id").alias("_i"), F.col("source").alias("_s"), F.col("_text").alias("_t"), "size", "source_size", "target",
        (F.col("whole") + F.coalesce("_one", F.lit(0))).cast("int").alias("copies"),
    )
    keyed = docs.withColumn("_text", text_key)
    same = keyed[names[id_col]].eqNullSafe(copies["_i"]) & keyed[names[source_col]].eqNullSafe(copies["_s"]) & (keyed["_text"] == copies["_t"])
    zero = F.lit(0)
    # Documents of a source without words are in no bucket and not among the copies.
    return keyed.join(copies, same, "left").select(
        *[F.col(n).alias(c) for c, n in names.items()], F.coalesce("size", zero).cast("long").alias("size"), F.coalesce("source_size", zero).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("copies", zero).cast("int").alias("copies"),
        F.coalesce(F.col("size") * F.col("copies"), zero).cast("long").alias("taken"),
    )


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
