"""Scans against a loop, however the rows are dealt."""

import random

import numpy as np
import pytest

from sweepmill.operators import scans
from sweepmill.session import settings


def operations():
    """Local, so that Spark sends them to its workers as they are."""

    def affine(a, b):
        # x -> m x + c, one after the other: associative, not commutative.
        return np.stack([a[:, 0] * b[:, 0], b[:, 0] * a[:, 1] + b[:, 1]], axis=1)

    def element(before, now):
        return np.stack([np.where(now["v"] % 2 == 0, 0.5, 1.0), now["v"] - before["v"] + 1.0], axis=1)

    return element, affine


def looped(rows):
    out = {}
    for key in {r[:2] for r in rows}:
        state, last = None, None
        for _, _, t, v in sorted(r for r in rows if r[:2] == key):
            m, c = (0.5 if v % 2 == 0 else 1.0), v - (v if last is None else last) + 1.0
            state = (m, c) if state is None else (state[0] * m, m * state[1] + c)
            out[(*key, t)] = state
            last = v
    return out


def test_segments():
    begin = np.array([0, 0, 0, 3, 4, 4, 4, 4])
    got = scans.segmented(np.arange(1.0, 9.0)[:, None], begin, lambda a, b: a + b)
    assert got[:, 0].tolist() == [1, 3, 6, 4, 5, 11, 18, 26]


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (1, 1), (7, 3), (23, 10_000), (40, 2)])
def test_scan_against_a_loop(spark, parts, batch):
    rng = random.Random(parts)
    rows = [("a", None, t, float(rng.randrange(9))) for t in range(150)] + [("b", k, t, float(rng.randrange(9))) for k in range(12) for t in range(rng.choice((1, 2, 5)))] + [(None, 1, 3, 4.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, t long, v double")
    with settings(spark, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}), settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}):
        from sweepmill import session

        old = dict(session.STASHING)
        session.STASHING["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch)
        try:
            got = scans.scan(df, ["k", "n"], ["t"], ["v"], *operations(), ["m", "c"]).collect()
        finally:
            session.STASHING.update(old)
    want = looped([r for r in rows if r[0] is not None and r[1] is not None] + [("a", -1, t, v) for k, n, t, v in rows if n is None] + [("", 1, t, v) for k, n, t, v in rows if k is None])
    assert len(got) == len(rows)
    for r in got:
        key = ("a", -1, r["t"]) if r["n"] is None else (r["k"] or "", r["n"], r["t"])
        assert np.allclose((r["m"], r["c"]), want[key])


def test_scan_of_nothing(spark):
    assert scans.scan(spark.createDataFrame([], "k int, t long, v double"), ["k"], ["t"], ["v"], *operations(), ["m", "c"]).collect() == []
