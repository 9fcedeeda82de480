"""Time alignment: nearest and interpolating joins as a union and two windows over one sort, linear in the rows.

Spark has no as-of join. Both sides are laid on one time line for each key; windows carry the last row of the right
side forward and the next one backward. With `bucket`, a key's line is cut into pieces of that length, which are tasks
of their own: what a piece hands on to those after and before it is one row, carried over in a table of pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _neighbours(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], bucket: int | None) -> DataFrame:
    """left with prev and next: structs (at, values...) of the right rows at or before, and at or after."""
    row = F.struct(F.col(at).alias("at"), *values)
    empty = F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType)
    piece = (F.lit(0) if bucket is None else F.floor(F.col(at) / bucket)).cast("long").alias("_piece")
    ours = left.select(*by, piece, F.col(at).alias("_t"), F.struct(*left.columns).alias("_left"), empty.alias("_right"))
    theirs = right.select(*by, piece, F.col(at).alias("_t"), F.lit(None).cast(ours.schema["_left"].dataType).alias("_left"), row.alias("_right"))
    line = ours.unionByName(theirs)
    # Ties: right rows of the same time come first going forward, and last coming backward.
    first = F.col("_left").isNotNull().cast("int")
    keys = by if bucket is None else [*by, "_piece"]
    back = Window.partitionBy(*keys).orderBy("_t", first, F.col("_right")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), first, F.col("_right").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("_prev", F.last("_right", ignorenulls=True).over(back)).withColumn("_next", F.last("_right", ignorenulls=True).over(ahead))
    seen = seen.where("_left IS NOT NULL")
    if bucket is not None:
        ends = line.groupBy(*keys).agg(F.min("_right").alias("_first"), F.max("_right").alias("_last"))
        pieces = Window.partitionBy(*by).orderBy("_piece")
        ends = ends.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.last("_last", ignorenulls=True).over(pieces.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.first("_first", ignorenulls=True).over(pieces.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        )
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        seen = seen.join(ends, same, "left").withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
    return seen.select("_left.*", F.col("_prev").alias("prev"), F.col("_next").alias("next"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], tie: str = "earlier", tolerance: int | None = None, bucket: int | None = None) -> DataFrame:
    """left with `match`, the right row nearest in time, or null where none lies within the tolerance (which is
    included). tie: which of two equally near rows, "earlier" or "later"; among rows of one time, the first by value
    going back and the last going forward. bucket: the length of pieces of time (see above)."""
    seen = _neighbours(left, right, by, at, values, bucket)
    before, after = F.col(at) - F.col("prev.at"), F.col("next.at") - F.col(at)
    closer = (after < before) if tie == "earlier" else (after <= before)
    match = F.when(F.col("prev").isNull() | (F.col("next").isNotNull() & closer), F.col("next")).otherwise(F.col("prev"))
    out = seen.withColumn("match", match).drop("prev", "next")
    if tolerance is not None:
        out = out.withColumn("match", F.when(F.abs(F.col(at) - F.col("match.at")) <= tolerance, F.col("match")))
    return out


def interpolated(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, bucket: int | None = None) -> DataFrame:
    """left with the right side's `value` interpolated linearly at its time; held beyond the first and last row."""
    seen = _neighbours(left, right, by, at, [value], bucket)
    p, n = F.col("prev"), F.col("next")
    share = (F.col(at) - p["at"]) / (n["at"] - p["at"]).cast("double")
    lerp = (1.0 - share) * p[value] + share * n[value]
    inside = F.when(p["at"] == n["at"], p[value]).otherwise(lerp)
    return seen.withColumn(f"{value}_at", F.when(p.isNull(), n[value]).when(n.isNull(), p[value]).otherwise(inside)).drop("prev", "next")


def bracketed(points: DataFrame, knots: DataFrame, by: list[str], at: str, value: str, bucket: int) -> DataFrame:
    """points with the knots' `value` interpolated linearly at their time, held beyond the ends: for very many points
    and few knots. Every pair of consecutive knots is listed in each bucket of time that it touches, so a point meets
    the few pairs of its bucket in one equi-join and is never sorted. Knots have distinct times within a key; a gap
    between knots lists its pair once a bucket, so buckets should be no shorter than gaps allow."""
    w = Window.partitionBy(*by).orderBy("_t0")
    ends = knots.select(*by, F.col(at).alias("_t0"), F.col(value).alias("_v0"))
    pairs = ends.select("*", F.lead("_t0").over(w).alias("_t1"), F.lead("_v0").over(w).alias("_v1")).where("_t1 IS NOT NULL")
    spread = pairs.select("*", F.explode(F.sequence(F.floor(F.col("_t0") / bucket), F.floor(F.col("_t1") / bucket))).alias("_b"))
    listed = spread.groupBy(*by, "_b").agg(F.collect_list(F.struct("_t0", "_v0", "_t1", "_v1")).alias("_pairs"))
    bounds = ends.groupBy(*by).agg(F.min("_t0").alias("_lo"), F.min_by("_v0", "_t0").alias("_first"), F.max("_t0").alias("_hi"), F.max_by("_v0", "_t0").alias("_last"))
    met = points.withColumn("_b", F.floor(F.col(at) / bucket)).join(listed, [*by, "_b"], "left").join(bounds, by, "left")
    t = F.col(at)
    hit = F.try_element_at(F.filter("_pairs", lambda p: (p["_t0"] <= t) & (t < p["_t1"])), F.lit(1))
    share = (t - hit["_t0"]) / (hit["_t1"] - hit["_t0"]).cast("double")
    inside = (1.0 - share) * hit["_v0"] + share * hit["_v1"]
    out = F.when(t <= F.col("_lo"), F.col("_first")).when(t >= F.col("_hi"), F.col("_last")).otherwise(inside)
    return met.select(*points.columns, out.alias(f"{value}_at"))
