"""Ordered work by pieces, against the same by hand; pieces are narrow, so that everything crosses them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sweepmill.operators import loops, motion, pieces, series

WIDTHS = (1, 7, 50, 10_000)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    out, i = [], 0
    for key in ("a", "b", None, "one", "hot"):
        for _ in range({"one": 1, "hot": 400}.get(key, 90)):
            i += 1
            t = draw.randrange(-200, 200)
            out.append((key, t, i, draw.random() < 0.8 if key != "b" else True, draw.choice([None, 1.5, 2.0, -4.25, 8.0]), draw.random(), draw.random()))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key string, t long, i long, bad boolean, v double, x double, y double").cache()


@pytest.fixture(scope="module")
def lines(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[1:3]) for k, v in out.items()}


@pytest.mark.parametrize("width", WIDTHS)
def test_streaks(df, lines, width):
    expected = {}
    for k, line in lines.items():
        longest = current = 0
        for r in line:
            current = current + 1 if r[3] else 0
            longest = max(longest, current)
        expected[k] = (longest, current)
    assert {r["key"]: (r["longest"], r["current"]) for r in series.longest_streak(df, ["key"], ["t", "i"], F.col("bad"), width).collect()} == expected


@pytest.mark.parametrize("width", WIDTHS)
def test_sustained_runs(spark, rows, width):
    # Times are told apart, since a run's rows come in order of time alone.
    timed = [(r[0], n * 3, r[3]) for n, r in enumerate(rows)]
    df = spark.createDataFrame(timed, "key string, t long, moving boolean")
    for confirm in (0, 9, 40, 100_000):
        expected = {}
        for k in {r[0] for r in timed}:
            start = last = None
            for _, t, moving in [r for r in timed if r[0] == k]:
                start, last = ((t if start is None else start), t) if moving else (None, None)
                if start is not None and last - start >= confirm:
                    expected.setdefault(k, start)
        assert {r["key"]: r["start"] for r in series.sustained_runs(df, ["key"], "t", F.col("moving"), confirm, width).collect()} == expected


@pytest.mark.parametrize("width", WIDTHS)
def test_frames_and_paths(df, lines, width):
    frames = {r["i"]: (r["frame_sum"], r["frame_n"]) for r in series.sliding_frame(df, ["key"], ["t", "i"], "v", 12, width).collect()}
    paths = {r["key"]: r for r in series.path(df, ["key"], ["t", "i"], ["x", "y"], width).collect()}
    assert len(frames) == sum(map(len, lines.values())) and set(paths) == set(lines)
    for k, line in lines.items():
        for j, r in enumerate(line):
            window = line[max(0, j - 11) : j + 1]
            known = [w[4] for w in window if w[4] is not None]
            assert frames[r[2]] == (sum(known) if known else None, len(window))
        assert paths[k]["length"] == pytest.approx(sum(math.dist(a[5:], b[5:]) for a, b in zip(line, line[1:], strict=False)))
        assert (paths[k]["x_min"], paths[k]["y_max"]) == (min(r[5] for r in line), max(r[6] for r in line))


@pytest.mark.parametrize("width", WIDTHS)
def test_strides_and_rows_before(df, lines, width):
    thin = {r["i"] for r in series.thinned(df, ["key"], ["t", "i"], 10, width).collect()}
    frames = {r["i"]: (r["place"], r["following"]) for r in series.keyframes(df, ["key"], ["t", "i"], 3, 20, width).collect()}
    lagged = {r["i"]: (r["pi"], r["pv"]) for r in pieces.lagged(df, ["key"], ["t", "i"], width, {"pi": "i", "pv": F.col("v") * 2}).collect()}
    even = {r["i"] for r in series.linspace_rows(df, ["key"], ["t", "i"], 16, width).collect()}
    middles = {r["i"] for r in series.stratum_middles(df, ["key"], ["t", "i"], 16, width).collect()}
    spaced, middle = set(), set()
    for line in lines.values():
        n, stride = len(line), max(1, -(-len(line) // 16))
        spaced |= {line[j * (n - 1) // 15][2] for j in range(16)} if n > 16 else {r[2] for r in line}
        middle |= {line[a + (min(n, a + stride) - a - 1) // 2][2] for a in range(0, n, stride)}
    assert even == spaced and middles == middle
    drawn, strode, before = set(), {}, {}
    for line in lines.values():
        n = len(line)
        for j, r in enumerate(line):
            if j % max(1, -(-n // 10)) == 0 or j == n - 1:
                drawn.add(r[2])
            if j % max(3, -(-n // 20)) == 0:
                strode[r[2]] = (j, line[j + 1][1] if j + 1 < n else None)
            before[r[2]] = (None, None) if j == 0 else (line[j - 1][2], None if line[j - 1][4] is None else line[j - 1][4] * 2)
    assert thin == drawn and frames == strode and lagged == before


def test_torn_graphs_across_pieces(spark):
    poses = spark.range(40).select(F.lit(None).cast("int").alias("capture"), F.col("id").alias("frame"), *[F.lit(0.0).alias(f"{c}0") for c in ("x", "y", "z", "heading")], (F.col("id") >= 20).cast("double").alias("x1"), *[F.lit(0.0).alias(f"{c}1") for c in ("y", "z", "heading")])
    for width in (1, 20, 100):
        torn = loops.jumps(poses, "capture", "frame", width=width).where("reason IS NOT NULL").collect()
        assert [(r["frame"], r["jump"], r["reason"]) for r in torn] == [(20, 1.0, "correction discontinuity")]


def test_no_rows(df):
    none = df.limit(0)
    for got in (series.thinned(none, ["key"], ["t", "i"], 3, 5), series.longest_streak(none, ["key"], ["t"], F.col("bad"), 5), series.path(none, ["key"], ["t"], ["x", "y"], 5), series.sliding_frame(none, ["key"], ["t"], "v", 3, 5)):
        assert got.count() == 0


def test_corrections_reach_across_pieces(spark):
    """Keyframes 10 and 30 of 0 .. 49 are shifted by 1 and 3 along x: held outside, blended between."""
    pose = lambda x: F.struct(x.alias("x"), *[F.lit(v).alias(n) for n, v in (("y", 0.0), ("z", 0.0), ("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))])
    scans = spark.range(50).select(F.lit("c").alias("capture"), F.col("id").alias("at_scan"), pose(F.col("id") * 1.0).alias("pose"))
    keys = scans.where("at_scan IN (10, 30)").select("capture", "at_scan", pose(F.col("pose.x") + F.col("at_scan") / 10).alias("solved"))
    for width in (1, 8, 1000):
        got = motion.corrected(scans, keys, "capture", "at_scan", width).orderBy("at_scan").select("at_scan", "corrected.x").collect()
        assert [r["x"] - r["at_scan"] for r in got] == pytest.approx([min(3.0, max(1.0, i / 10)) for i in range(50)])
        assert motion.corrected(scans, keys.limit(0), "capture", "at_scan", width).where("corrected IS NOT NULL").count() == 0
