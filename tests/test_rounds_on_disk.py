"""What the rounds of a pose graph write, and what stays of it."""

import os

import numpy as np
from pyspark.sql import functions as F

from sweepmill.operators import graphs, substructure
from test_substructure import chain, frames_of


def test_elements_inside_segments_are_written_nowhere(spark, monkeypatch):
    some = {f"c{i}": chain(12, i, [(11, 0)]) for i in range(6)} | {"long": chain(40, 9, [(0, 39), (5, 30)])}
    frames, edges = frames_of(spark, some)
    made, kept = [], substructure.stash

    def stash(df, label):
        out = kept(df, label)
        blocks = out.where("capture <> 'long'").agg(F.sum(F.size("k"))).first()[0] if "k" in out.columns else 0
        made.append((label, out, blocks or 0))
        return out

    monkeypatch.setattr(substructure, "stash", stash)
    out = substructure.solve_graphs(frames, edges, "capture", 2, segment=16)
    assert out.count() == 6 * 12 + 40
    # Blocks of captures that lie in one segment, then tables of which the result reads none.
    assert sum(blocks for _, _, blocks in made) == 0
    left = [label for label, df, _ in made if os.path.exists(df.stash_path)]
    assert set(left) == {"ended", "captures"} and left.count("captures") == 1 and len(made) > 10


def test_ends_that_are_missing(spark):
    """Edges to nodes that do not exist, and captures that are null or have no edges of their own, as joins leave them out."""
    some = {"a": chain(20, 1, [(0, 19), (3, 11)]), "b": chain(3, 2)}
    frames, edges = frames_of(spark, some)
    seven = [F.lit(x).cast("double").alias(p) for x, p in zip((1, 0, 0, 0, 0, 0, 1), graphs.POSE, strict=True)]
    more = [("a", 3, 99), ("a", 99, 4), ("a", 99, 100), ("b", 1, 77), ("nowhere", 0, 1), (None, 0, 1)]
    extra = spark.createDataFrame(more, "capture string, a long, b long").select("*", *seven, F.lit(True).alias("loop"))
    alone = spark.createDataFrame([(None, 0), (None, 1), ("c", 0), ("c", 9)], "capture string, node long").select("*", *seven)
    rows = [sorted(map(tuple, substructure.solve_graphs(f, e, "capture", 2, segment=8).where("capture <> 'c'").collect())) for f, e in ((frames, edges), (frames.unionByName(alone), edges.unionByName(extra)))]
    assert [r[:2] for r in rows[0]] == [r[:2] for r in rows[1]] and len(rows[0]) == 23
    assert np.allclose([r[2:] for r in rows[0]], [r[2:] for r in rows[1]], atol=1e-9)


def test_steps_of_seven_numbers():
    rng = np.random.default_rng(3)
    poses = rng.normal(size=(50, 7))
    poses[:, 3:] /= np.linalg.norm(poses[:, 3:], axis=1, keepdims=True)
    steps = rng.normal(size=(50, 6)) * np.array([1e-12, 1e-6, 0.1, 1.0, 3.0])[np.arange(50) % 5][:, None]
    assert np.allclose(graphs.matrices(graphs.moved7(poses, steps)), graphs.moved(graphs.matrices(poses), steps), atol=1e-12)
