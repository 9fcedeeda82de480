"""Votes of frames that share all their keys, without rows of those that share one."""

import numpy as np
from plans import most_rows

from sweepmill.operators import triangles as t


def test_votes_of_blocks_are_those_of_all_and_no_rows_meet(spark):
    rng = np.random.default_rng(7)
    sides = np.sort(rng.integers(0, 4, (300, 3)) / 10 + rng.uniform(0, 0.1, (300, 3)), axis=1)
    frames = np.repeat(np.arange(100), 3) * 2
    shapes = spark.createDataFrame([("c", int(f), s.tolist()) for f, s in zip(frames, sides, strict=True)], "capture string, frame int, sides array<double>")
    mine, theirs = {}, {}
    for f, s in zip(frames.tolist(), sides, strict=True):
        q = s / 0.1
        of = mine.setdefault(f, {})
        of[tuple(np.floor(q))] = of.get(tuple(np.floor(q)), 0) + 1
        for k in {(a, b, c): 0 for a in np.floor(q[0] + [-0.5, 0.5]) for b in np.floor(q[1] + [-0.5, 0.5]) for c in np.floor(q[2] + [-0.5, 0.5])}:
            of = theirs.setdefault(f, {})
            of[k] = of.get(k, 0) + 1
    want = {(a, b): sum(min(n, theirs[b].get(k, 0)) for k, n in mine[a].items()) for a in mine for b in theirs if b + 10 <= a}
    want = {k: v for k, v in want.items() if v}
    for block in (512, 30, 1):
        df = t.votes(shapes, "capture", "frame", 0.1, 10, block)
        assert {(r["target"], r["source"]): r["votes"] for r in df.collect()} == want
    df = t.votes(shapes, "capture", "frame", 0.1, 10, most=2)
    got = {(r["target"], r["source"]): r["votes"] for r in df.collect()}
    # Of thousands of pairs only the two best sources of a target are rows.
    assert most_rows(df) <= 600 < len(want)
    assert got == {(a, b): v for a in mine for v, b in [(-v, b) for v, b in sorted((-want[a, b], b) for b in theirs if (a, b) in want)[:2]]}
