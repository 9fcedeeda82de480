from collections import defaultdict

import numpy as np
import pytest

import brute
from sweepmill.llm import source_mix

SCHEMA = "doc_id long, source string, text string, size string"


def rows_of(spark, rows, **kw):
    return source_mix.mix_sources(spark.createDataFrame(rows, SCHEMA), **kw).collect()


def test_targets_and_totals(spark):
    rows = [(i, f"s{i % 7}" if i % 7 else None, " ".join(["w"] * (1 + i * 37 % 90)), "x") for i in range(900)]
    rows += [(1000 + i, "s1", "big " * 500, "x") for i in range(300)]
    got = rows_of(spark, rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for (_, s, t, _), _r in zip(rows, rows):
        sizes[s] += len(brute.words(t))
    want = brute.mix_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 20
    again = rows_of(spark, rows)
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_edges(spark):
    rows = [(1, "a", None, "x"), (2, "a", "", "x"), (3, None, "one two", "x"), (3, None, "one two", "x"), (None, "b", "w", "x"), (4, "a", " \t\n", None)]
    got = rows_of(spark, rows)
    assert len(got) == 6 and {r["doc_id"] for r in got if r["size"] == 0} == {1, 2, 4}
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert len({r["taken"] for r in got if r["doc_id"] == 3}) == 1
    assert rows_of(spark, []) == []
    assert all(r["target"] == 0 for r in rows_of(spark, [(1, "a", None, "x")]))


def test_fold_is_whole_and_keeps_the_words():
    sizes, parts = [900, 500, 40, 30, 20, 10, 5, 1, 1], [0.3, 0.7, 0.5, 0.5, 0.1, 0.9, 0.4, 0.5, 0.5]
    for seed in range(50):
        x = source_mix.fold(list(range(1, 10)), sizes, parts, seed, False)
        assert sum(0 < v < 1 for v in x) <= 1
        assert sum(a * b for a, b in zip(x, sizes)) == pytest.approx(sum(a * b for a, b in zip(parts, sizes)))
    ups = [source_mix.fold([1, 2], [10, 10], [0.3, 0.3], s, False) for s in range(2000)]
    assert sum(u[0] for u in ups) / 2000 == pytest.approx(0.3, abs=0.03)


def test_fold_of_equal_fractions():
    sizes = [5000, 900, 500, 40, 40, 30, 20, 10, 5, 3, 2, 1, 1]
    total = [0.0] * len(sizes)
    for seed in range(3000):
        x = source_mix.fold(list(range(1, 14)), sizes, [0.3] * 13, seed, False)
        assert sum(0 < v < 1 for v in x) <= 1 and sum(a * b for a, b in zip(x, sizes)) == pytest.approx(0.3 * sum(sizes))
        x = source_mix.fold(list(range(1, 14)), sizes, [0.3] * 13, seed, True)
        assert set(x) <= {0.0, 1.0}
        total = [a + b for a, b in zip(total, x)]
    assert [t / 3000 for t in total] == pytest.approx([0.3] * 13, abs=0.04)
    rng = np.random.default_rng(1)
    many = sorted(rng.pareto(1.2, 3000) * 50 + 1, reverse=True)
    for seed in range(20):
        x = source_mix.fold(list(range(3000)), many, [0.7] * 3000, seed, True)
        assert abs(sum(a * b for a, b in zip(x, many)) - 0.7 * sum(many)) < 10  # what is left open at last is small


def test_one_giant_does_not_decide_over_the_rest():
    sizes, counts, giants = [10_000] + [1] * 1000, [], 0
    for seed in range(400):
        x = source_mix.fold(list(range(1, 1002)), sizes, [0.3] * 1001, seed, True)
        counts.append(sum(x[1:]))
        giants += x[0]
    assert np.mean(counts) == pytest.approx(300, abs=3) and np.std(counts) < 40 and giants / 400 == pytest.approx(0.3, abs=0.07)


def test_last_draw_keeps_expectations():
    sizes, parts = [900, 500, 40, 30, 20, 10, 5, 1, 1], [0.3, 0.7, 0.5, 0.5, 0.1, 0.9, 0.4, 0.5, 0.5]
    total = [0.0] * 9
    for seed in range(4000):
        x = source_mix.fold(list(range(1, 10)), sizes, parts, seed, True)
        assert set(x) <= {0.0, 1.0}
        total = [a + b for a, b in zip(total, x)]
    assert [t / 4000 for t in total] == pytest.approx(parts, abs=0.04)


def test_targets_of_many_sources(spark):
    sizes = {f"s{i:04d}": (i * 7919) % 1000 for i in range(1500)} | {None: 5}
    got = source_mix.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = brute.mix_targets(sizes)
    assert len(got) == 1501 and all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_long_text_and_clashing_names(spark):
    rows = [(1, "a", "w " * 2_000_000), (2, "a", "one"), (3, "b", "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'q' AS _text", "'r' AS key", "1 AS copies", "2 AS rows")
    got = {r["doc_id"]: r for r in source_mix.mix_sources(df).collect()}
    assert got[1]["size"] == 2_000_000 and got[2]["_text"] == "q" and got[3]["key"] == "r" and got[3]["size"] == 3


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = source_mix.op1_source_mix(spark, d).collect()
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sizes = defaultdict(int)
    for r in texts.values():
        sizes[r["source"]] += len(brute.words(r["text"]))
    want, taken = brute.mix_targets(sizes), defaultdict(int)
    assert len(got) == len(texts)
    for r in got:
        s = texts[r["doc_id"]]["source"]
        assert r["size"] == len(brute.words(texts[r["doc_id"]]["text"])) and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 20
