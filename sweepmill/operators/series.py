"""Ordered series: gaps, robust means, runs, frames, thinning. Runs, frames, paths and strides go by pieces of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pieces


def positive_gaps(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """by, gap: positive differences of consecutive times."""
    w = Window.partitionBy(*by).orderBy(at)
    return df.select(*by, (F.col(at) - F.lag(at).over(w)).alias("gap")).where("gap > 0")


_FINE, _SLIP = 10_000, 3e-4  # accuracy of approximate percentiles, and a little more than their error in rank


def _nth(df: DataFrame, by: list[str], value: str, rank, about: tuple[float, float]) -> DataFrame:
    """by, nth, n: the rank-th smallest value (from 1; a function of a column n) of each key's n values, exactly.

    Approximate percentiles enclose it; rows below are counted and only those between are ranked, so no key is sorted
    whole. about: shares of n between which the rank lies for all n; if n is large, near the second."""
    lowest, highest = about
    parts = [max(0.0, lowest - _SLIP), max(0.0, highest - 2 * _SLIP), min(1.0, highest + _SLIP)]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    bounds = rows.groupBy(*by).agg(F.count("*").alias("n"), F.approx_percentile("_v", F.array(*[F.lit(p) for p in parts]), F.lit(_FINE)).alias("_p"))
    bounds = bounds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "n", F.when(F.col("n") < _FINE, F.col("_p")[0]).otherwise(F.col("_p")[1]).alias("_lo"), F.col("_p")[2].alias("_hi"))
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = rows.join(bounds, same)
    below = near.groupBy(*by).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
    between = near.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    ranked = between.select(*by, "_v", "n", F.row_number().over(Window.partitionBy(*by).orderBy("_v")).alias("_r"))
    below = below.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_below")
    return ranked.join(below, same).where(F.col("_r") + F.col("_below") == rank(F.col("n"))).select(*by, F.col("_v").alias("nth"), "n")


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median (the element n div 2 of the sorted values: the upper one of two), n. Nulls are no values."""
    return _nth(df, by, value, lambda n: F.floor(n / 2) + 1, (0.5, 0.5)).select(*by, F.col("nth").alias("median"), "n")


def trimmed_mean(df: DataFrame, by: list[str], value: str, few: int = 20, share: int = 10) -> DataFrame:
    """by, mean, n: the mean without the n div share smallest and largest values, where n is at least few. Nulls are no values.

    Approximate percentiles enclose the two cuts; values between and beyond are summed and counted, and only those near a
    cut are put in order, equal ones as one row. Keys of few values are ordered whole and added up one by one from the
    smallest, as a window over sorted rows does, so that means that lie on the edge of a rounding agree."""
    cut = 1.0 / share
    parts = [max(0.0, cut - 2 * _SLIP), min(1.0, cut + _SLIP), max(0.0, 1 - cut - _SLIP), min(1.0, 1 - cut + 2 * _SLIP)]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    keys, same = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    bounds = rows.groupBy(*by).agg(F.count("*").alias("n"), F.approx_percentile("_v", F.array(*[F.lit(p) for p in parts]), F.lit(_FINE)).alias("_p")).select(*keys, "n", "_p")
    p = F.col("_p")
    zone = F.when(F.col("n") < _FINE, 1).when(F.col("_v") < p[0], 0).when(F.col("_v") <= p[1], 1).when(F.col("_v") < p[2], 2).when(F.col("_v") <= p[3], 3).otherwise(4)
    near = F.col("_zone").isin(1, 3)
    zoned = rows.join(bounds, same).select(*by, "n", "_v", zone.alias("_zone"))
    sums = zoned.groupBy(*by, "n", "_zone", F.when(near, F.col("_v")).alias("_at")).agg(F.count("*").alias("_m"), F.sum("_v").alias("_sum"))
    # Rows of a key are now its distinct values near the cuts and three sums.
    upto = F.sum("_m").over(Window.partitionBy(*by).orderBy("_zone", "_at").rowsBetween(Window.unboundedPreceding, 0))
    trim = F.when(F.col("n") >= few, F.floor(F.col("n") / share)).otherwise(0)
    kept = F.greatest(F.lit(0), F.least(F.col("_upto"), F.col("n") - trim) - F.greatest(F.col("_upto") - F.col("_m"), trim))
    part = F.when(near, kept * F.col("_at")).when(F.col("_zone") == 2, F.col("_sum")).otherwise(0.0)
    counted = F.when(near, kept).when(F.col("_zone") == 2, F.col("_m")).otherwise(0)
    # Fewer than _FINE values.
    listed = F.array_sort(F.collect_list(F.when((F.col("n") < _FINE) & (kept > 0), F.struct("_at", kept.cast("int").alias("_kept")))))
    means = sums.withColumn("_upto", upto).groupBy(*by).agg(F.sum(part).alias("_sum"), F.sum(counted).alias("_m"), F.first("n").alias("n"), listed.alias("_listed"))
    again = F.flatten(F.transform("_listed", lambda v: F.array_repeat(v["_at"], v["_kept"])))
    one_by_one = F.aggregate(again, F.lit(0.0), lambda total, v: total + v)
    return means.select(*by, (F.when(F.col("n") < _FINE, one_by_one).otherwise(F.col("_sum")) / F.col("_m")).alias("mean"), "n")


def static_window(df: DataFrame, by: list[str], at: str, span: int) -> DataFrame:
    """The rows of the first `span` time units of each key."""
    first = F.min(at).over(Window.partitionBy(*by))
    return df.withColumn("_first", first).where(F.col(at) <= F.col("_first") + span).drop("_first")


def sustained_runs(df: DataFrame, by: list[str], at: str, moving, confirm: int, width: int) -> DataFrame:
    """by, start: the start of the first run of consecutive moving rows that lasts at least `confirm`. width: see pieces."""
    marked = df.select(*by, F.col(at).alias("_t"), moving.alias("_m"))
    moved = F.when(F.col("_m"), F.col("_t"))
    runs = pieces.edge_runs(marked, by, ["_t"], width, F.col("_m"), lambda: [F.min(moved).alias("start"), F.max(moved).alias("stop")])
    first = lambda c: F.max(F.when(F.col("_run") == 0, F.col(c)))
    lasts = (F.col("_run") > 0) & (F.col("stop") - F.col("start") >= confirm)
    ends = runs.groupBy(pieces.AT).agg(
        F.max("_run").alias("_runs"), first("start").alias("_head"), first("stop").alias("_stop"), F.max_by("start", "_run").alias("_tail"), F.min(F.when(lasts, F.col("start"))).alias("_inner")
    )
    met = pieces.joined_runs(ends, by, F.col("_runs") == 0, F.col("_tail"), F.min)
    begun = F.coalesce("_entering", "_head")
    found = F.when(F.col("_stop") - begun >= confirm, begun)
    return met.groupBy(*pieces.keys(by)).agg(F.min(F.least(found, "_inner")).alias("start")).where("start IS NOT NULL")


def longest_streak(df: DataFrame, by: list[str], order: list[str], bad, width: int) -> DataFrame:
    """by, longest, current: the longest run of consecutive bad rows and the one at the end (0 without). width: see pieces."""
    runs = pieces.edge_runs(df.select(*by, *order, bad.alias("_b")), by, order, width, F.col("_b"), list)
    head = F.sum(F.when(F.col("_run") == 0, F.col("_n")).otherwise(0))
    ends = runs.groupBy(pieces.AT).agg(F.max("_run").alias("_runs"), head.alias("_head"), F.max_by("_n", "_run").alias("_tail"), F.max("_n").alias("_inner"))
    met = pieces.joined_runs(ends, by, F.col("_runs") == 0, F.col("_tail"), F.sum)
    longest = F.greatest("_inner", "_open", F.coalesce("_entering", F.lit(0)) + F.col("_head"))
    return met.groupBy(*pieces.keys(by)).agg(F.max(longest).alias("longest"), F.max_by("_open", f"{pieces.AT}._piece").alias("current"))


def sliding_frame(df: DataFrame, by: list[str], order: list[str], value: str, rows: int, width: int) -> DataFrame:
    """df with frame_sum and frame_n over each row and the rows - 1 before it. width: see pieces."""
    w = pieces.inside(order)
    placed = pieces.cut(df, by, order, width).withColumn("_i", F.row_number().over(w) - 1)
    ends = placed.withColumn("_back", F.row_number().over(Window.partitionBy(pieces.AT).orderBy(*[F.col(c).desc() for c in order]))).where(F.col("_back") < rows)
    # Each piece has a row, so that the frame of the first one reaches at most rows - 1 pieces back.
    tails = ends.groupBy(pieces.AT).agg(F.sort_array(F.collect_list(F.struct("_i", F.col(value).alias("v")))).alias("_tail"))
    past = F.flatten(F.collect_list("_tail").over(pieces.line(by).rowsBetween(1 - rows, -1)))
    met = pieces.told(placed, tails, _past=F.slice(past, F.greatest(F.lit(1), F.size(past) - rows + 2), F.lit(rows)))
    here, more = w.rowsBetween(1 - rows, 0), F.greatest(F.lit(0), F.least(F.lit(rows - 1) - F.col("_i"), F.size("_past")))
    came = F.filter(F.slice("_past", F.size("_past") - more + 1, more)["v"], lambda v: v.isNotNull())
    inner = F.sum(value).over(here)
    kind = df.select(F.sum(value)).schema[0].dataType
    total = F.when(F.size(came) == 0, inner).otherwise(F.aggregate(came, F.lit(0).cast(kind), lambda a, v: (a + v).cast(kind)) + F.coalesce(inner, F.lit(0).cast(kind)))
    return met.withColumn("frame_sum", total).withColumn("frame_n", F.count("*").over(here) + more).select(*df.columns, "frame_sum", "frame_n")


def path(df: DataFrame, by: list[str], order: list[str], axes: list[str], width: int) -> DataFrame:
    """by, bounds (<axis>_min, <axis>_max) and the length of the polyline through the rows in order. width: see pieces."""
    w, place = pieces.inside(order), F.struct(*axes)
    far = lambda a, b: F.sqrt(sum((F.pow(a[c] - b[c], 2) for c in axes[1:]), F.pow(a[axes[0]] - b[axes[0]], 2)))
    stepped = pieces.cut(df, by, order, width).withColumn("_own", place)
    stepped = stepped.withColumn("_step", far(F.col("_own"), F.lag("_own").over(w)))
    bounds = [f(a).alias(f"{a}_{n}") for a in axes for f, n in ((F.min, "min"), (F.max, "max"))]
    ends = stepped.groupBy(pieces.AT).agg(*bounds, F.sum("_step").alias("_steps"), *[f("_own", F.struct(*order)).alias(n) for f, n in ((F.min_by, "_first"), (F.max_by, "_last"))])
    gaps = ends.withColumn("_gap", far(F.col("_first"), F.lag("_last").over(pieces.line(by))))
    bounds = [f(f"{a}_{n}").alias(f"{a}_{n}") for a in axes for f, n in ((F.min, "min"), (F.max, "max"))]
    return gaps.groupBy(*pieces.keys(by)).agg(*bounds, F.sum(F.coalesce("_steps", F.lit(0.0)) + F.coalesce("_gap", F.lit(0.0))).alias("length"))


def thinned(df: DataFrame, by: list[str], order: list[str], most: int, width: int) -> DataFrame:
    """Every stride-th row of each key, and its last; the stride keeps about `most` rows of a key. width: see pieces."""
    ranked = pieces.placed(df, by, order, width)
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    return ranked.where((F.col("_i") % stride == 0) | (F.col("_i") == F.col("_n") - 1)).select(*df.columns)


def keyframes(df: DataFrame, by: list[str], order: list[str], stride: int, most: int, width: int) -> DataFrame:
    """Keyframes: rows whose place is a multiple of max(stride, ceil(n / most)), with place and the next row's time. width:
    see pieces."""
    w = pieces.inside(order)
    rows = pieces.cut(df, by, order, width)
    ends = rows.groupBy(pieces.AT).agg(F.count("*").alias("_c"), F.min(order[0]).alias("_first"))
    inner = rows.select("*", (F.row_number().over(w) - 1).alias("_i"), F.lead(F.struct(F.col(order[0]).alias("at"))).over(w).alias("_next"))
    met = pieces.told(inner, ends, _shift=F.coalesce(F.sum("_c").over(pieces.before(by)), F.lit(0)), _n=F.sum("_c").over(pieces.whole(by)), _first=F.lead("_first").over(pieces.line(by)))
    following = F.when(F.col("_next").isNull(), F.col("_first")).otherwise(F.col("_next.at"))
    ranked = met.select(*df.columns, (F.col("_i") + F.col("_shift")).cast("long").alias("place"), "_n", following.alias("following"))
    return ranked.where(F.col("place") % F.greatest(F.lit(stride), F.ceil(F.col("_n") / most)) == 0).drop("_n")


def linspace_rows(df: DataFrame, by: list[str], order: list[str], most: int, width: int) -> DataFrame:
    """At most `most` rows of each key at evenly spaced places, the first and last among them. width: see pieces."""
    ranked = pieces.placed(df, by, order, width)
    # Place i is drawn when some j has floor(j * (n - 1) / (most - 1)) = i.
    j = F.ceil(F.col("_i") * (most - 1) / (F.col("_n") - 1))
    drawn = (F.col("_n") <= most) | ((j < most) & (F.floor(j * (F.col("_n") - 1) / (most - 1)) == F.col("_i")))
    return ranked.where(drawn).select(*df.columns)


def stratum_middles(df: DataFrame, by: list[str], order: list[str], most: int, width: int) -> DataFrame:
    """The middle row of each of at most `most` equal strata of each key's rows; all rows where there are fewer. width: see
    pieces."""
    ranked = pieces.placed(df, by, order, width)
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / most)).cast("long")
    begin = F.floor(F.col("_i") / stride) * stride
    middle = begin + F.floor((F.least(F.col("_n"), begin + stride) - begin - 1) / 2)
    return ranked.where(F.col("_i") == middle).select(*df.columns)


def numbered(df: DataFrame, part: str, order: list, name: str) -> DataFrame:
    """df with a dense number from 0 in order of part, then of `order`: each part is numbered by itself and shifted by
    the counts of those before it, of which there is one row a part."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(F.col(part).alias("_part")).agg(F.count("*").alias("_c"))
    shift = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return df.withColumn(name, inside).join(shift, F.col(part).eqNullSafe(F.col("_part"))).withColumn(name, (F.col(name) + F.col("_shift")).cast("long")).drop("_part", "_shift")


def thinned_line(df: DataFrame, index: str, most: int, width: int = 100_000) -> DataFrame:
    """Every stride-th row of one long line in order of its whole-number index, and the last row; the stride keeps about
    `most`. The line is numbered by pieces of `width` indices, so no task holds it whole."""
    placed = numbered(df.withColumn("_piece", F.floor(F.col(index) / width)), "_piece", [index], "_i")
    n = df.count()
    stride = max(1, -(-n // most))
    return placed.where((F.col("_i") % stride == 0) | (F.col("_i") == n - 1)).drop("_i", "_piece")


def frame_interval(df: DataFrame, by: list[str], at: str, other: str, most_ns: int = 160_000_000) -> DataFrame:
    """by, median, passes: the upper median of the positive gaps of `at`, or of `other` where fewer than half of the rows
    have such a gap; and whether frames come often enough."""
    n = df.groupBy(*by).agg(F.count("*").alias("_all"))
    first, second = (upper_median(positive_gaps(df, by, c), by, "gap").select(*by, F.col("median").alias(f"_m{i}"), F.col("n").alias(f"_n{i}")) for i, c in enumerate((at, other)))
    both = n.join(first, by, "left").join(second, by, "left")
    median = F.when(F.coalesce("_n0", F.lit(0)) * 2 < F.col("_all"), F.col("_m1")).otherwise(F.col("_m0"))
    return both.select(*by, median.alias("median")).withColumn("passes", F.coalesce(F.col("median") <= most_ns, F.lit(False)))


def static_imu(samples: DataFrame, by: list[str], at: str, second: int = 1_000_000_000, seconds: float = 10.0, least_seconds: float = 8.0, least: int = 1000) -> DataFrame:
    """Biases and gravity of the first seconds of each key, when the sensor should stand still. samples: by, at, gx gy gz
    (rad/s), ax ay az (m/s2, or g, which the norm tells). Result: by, n, seconds, bx by bz, mx my mz (trimmed means; of
    the accelerations in m/s2), scale, gyro_std, accel_norm, accel_std and valid."""
    rows = static_window(samples, by, at, int(seconds * second))
    # All axes in one pass, a row for each.
    axes = dict(zip(("gx", "gy", "gz", "ax", "ay", "az"), ("bx", "by", "bz", "mx", "my", "mz"), strict=True))
    stacked = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("_axis"), F.col(axis).cast("double").alias("_value")) for axis, name in axes.items()])).alias("_r")).select(*by, "_r.*")
    means = trimmed_mean(stacked, [*by, "_axis"], "_value").groupBy(*by).agg(*[F.max(F.when(F.col("_axis") == name, F.col("mean"))).alias(name) for name in axes.values()])
    square = lambda *names: F.sqrt(sum((F.col(c) * F.col(c) for c in names[1:]), F.col(names[0]) * F.col(names[0])))
    means = means.withColumn("scale", F.when(square("mx", "my", "mz") < 3.0, 9.80665).otherwise(1.0))
    seen = rows.join(means, by)
    off = sum((F.pow(F.col(f"g{a}") - F.col(f"b{a}"), 2) for a in "yz"), F.pow(F.col("gx") - F.col("bx"), 2))
    spread = seen.groupBy(*by).agg(
        F.count("*").alias("n"), ((F.max(at) - F.min(at)) / second).alias("seconds"), F.sqrt(F.avg(off)).alias("gyro_std"),
        F.avg(F.col("scale") * square("ax", "ay", "az")).alias("accel_norm"), F.stddev_pop(F.col("scale") * square("ax", "ay", "az")).alias("accel_std"),
    )
    valid = (
        (F.col("seconds") >= least_seconds) & (F.col("n") >= least) & (square("bx", "by", "bz") < 0.25) & (F.col("gyro_std") < 0.08)
        & (F.col("accel_norm") > 8.0) & (F.col("accel_norm") < 11.5) & (F.col("accel_std") < 0.50)
    )
    scaled = [(F.col(c) * F.col("scale")).alias(c) for c in ("mx", "my", "mz")]
    return spread.join(means, by).select(*by, "n", "seconds", "bx", "by", "bz", *scaled, "scale", "gyro_std", "accel_norm", "accel_std", valid.alias("valid"))


def stationary_mean(samples: DataFrame, windows: DataFrame, by: list[str], at: str, span: int = 2_000_000_000, least: int = 10) -> DataFrame:
    """windows (by, start) with the means gx .. az of the samples of [start, start + span] and whether these are the
    readings of a sensor at rest. Null means without enough samples."""
    axes = ("gx", "gy", "gz", "ax", "ay", "az")
    bucket = lambda c: F.floor(c / span)
    w = windows.select(*by, "start", F.explode(F.array(bucket(F.col("start")), bucket(F.col("start")) + 1)).alias("_b"))
    met = w.join(samples.select(*by, F.col(at).alias("_t"), bucket(F.col(at)).alias("_b"), *axes), [*by, "_b"]).where((F.col("_t") >= F.col("start")) & (F.col("_t") <= F.col("start") + span))
    means = met.groupBy(*by, "start").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in axes]).where(F.col("n") >= least)
    norm = lambda k: F.sqrt(F.col(f"{k}x") * F.col(f"{k}x") + F.col(f"{k}y") * F.col(f"{k}y") + F.col(f"{k}z") * F.col(f"{k}z"))
    rest = (norm("g") < 0.25) & (((norm("a") > 0.5) & (norm("a") < 1.5)) | ((norm("a") > 8.0) & (norm("a") < 12.0)))
    return windows.join(means.withColumn("valid", rest), [*by, "start"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
