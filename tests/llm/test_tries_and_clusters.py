"""Prefix tries and centroid clustering: brute force, SQL, odd rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from compare import DATA, assert_same
from sweepmill.llm import centroids, prefix_trie
from sweepmill.session import settings

SMALL = f"{DATA}/sf0.001"
F = prefix_trie.F
COLUMNS = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def trie(df, **kw):
    rows = prefix_trie.prefix_trie(df, base=lambda c: c - c % 20, head=lambda c: F.crc32(c.cast("string").cast("binary")) % 4, **kw).collect()
    got = {(r["conv_id"], r["depth"]): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("query, sql", [(prefix_trie.op11_prefix_trie, prefix_trie.OP11_SQL), (centroids.op12_centroid_clustering, centroids.OP12_SQL)])
def test_matches_sql(spark, query, sql):
    assert_same(query(spark, SMALL), sql, SMALL)


# ---------------------------------------------------------------- tries


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in (*range(-3, 60), 2**40 + 20, 2**40 + 21):
        n = rng.choice((1, 1, 2, 3, 5, 9))
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(("user", None, "")), rng.choice(("a b", "c", None, "", "d  e\nf"))) for t in range(n)]
    # A long conversation, one that ends where another goes on, copies, and ties that texts alone order.
    rows += [(60, t, "user", f"turn {t % 7}") for t in range(700)] + [(61, t, "user", f"turn {t % 7}") for t in range(650)]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 190) for t in range(4)] + [(300, 5, "x", w) for w in "zyxab"] + [(None, 0, "user", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [4096, 40, 1])
def test_trie_against_brute_force(spark, most):
    rows = conversations(most)
    want = brute.prefix_trie(rows)
    # Many tasks, so that the long conversations span several of them.
    with settings(spark, {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "'x' AS ends", "2 AS c")
        assert trie(df, most=most) == want


def test_one_conversation_is_split(spark):
    df = spark.createDataFrame([(7, t, "user", f"t{t}") for t in range(3000)], TURNS)
    with settings(spark, {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        rows = prefix_trie.placed(df, "conv_id", "turn", "role", "text")
        assert sorted(r["pos"] for r in rows.collect()) == list(range(3000))
        whole = spark.read.parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
        assert whole.select("task").distinct().count() == 8
        assert prefix_trie.prefix_trie(df, most=100).where("n_convs = 1 AND n_leaves = 1").count() == 3001


def test_trie_of_nothing(spark):
    assert trie(spark.createDataFrame([], TURNS)) == {}
    assert trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)) == {}
    lone = [(21, 0, None, None)]
    assert trie(spark.createDataFrame(lone, TURNS)) == brute.prefix_trie(lone)


# ---------------------------------------------------------------- clusters


def test_abandoned_centroids_change_nothing():
    rng = np.random.default_rng(3)
    rows, centres = rng.integers(-40, 40, (3000, 64)), rng.integers(-40, 40, (40, 64))
    rows[:500, 20:] = 0
    centres[7] = centres[3]
    rows[5] = centres[7]
    whole = np.square(rows[:, None] - centres[None]).sum(axis=2)
    got, distance = centroids.nearest(rows, centres)
    assert (got == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all() and got[5] == 3
    assert (centroids.nearest(rows, centres[::-1].copy())[0] == whole[:, ::-1].argmin(axis=1)).all()


def test_odd_vectors(spark):
    good = [float(i) for i in range(64)]
    rows = [(1, good), (2, None), (3, []), (4, good[:63]), (5, [*good[:63], None]), (6, [*good[:63], math.nan]), (7, [*good[:63], math.inf]), (8, [1e30] * 64), (1, good), (None, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'x' AS _cluster", "2 AS q")
    out, centres = centroids.cluster_vectors(df, clusters=3)
    got = sorted(((r["vec_id"] is None, r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()), key=str)
    assert len(got) == 4 and sum(g[1] == 1 for g in got) == 2 and all(g[3] == 0 for g in got if g[1] in (1, 8)) and len(centres) == 3
    empty, none = centroids.cluster_vectors(df.where("vec_id = 2"))
    assert empty.count() == 0 and none == []
    assert set(out.columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}


def test_integers():
    at, q = centroids.integers(pa.array([None, [0.0] * 64, [-0.001, 0.999, *[1e9] * 62]], pa.list_(pa.float32())))
    assert at.tolist() == [1, 2] and q[1][:3].tolist() == [-1, 255, centroids.MOST]
