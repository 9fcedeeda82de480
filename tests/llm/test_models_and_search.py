"""Quality, language ID, decontamination and vector dedup: brute force, held-out accuracy and edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from compare import DATA
from sweepmill.llm import decontaminate, language_id, quality, vector_dedup

BIG = f"{DATA}/sf0.1"


# ---------------------------------------------------------------- quality


def test_trees_learn_and_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.grow(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    one = quality.grow(x, np.ones(2000))
    assert np.allclose(one.score(x), 2001 / 2002)
    assert quality.grow(np.zeros((0, 6)), np.zeros(0)).score(x[:3]).tolist() == [0.5] * 3


ODD_TEXTS = [
    None, "", " ", "\u3000\u2003", "\n\n", "a", "One two, THREE!\n\none two\n", "x" * 5000, "Ünïcode ĀĒ 漢字 ٣٤ ½ 😀\u00a0end", "a b\tc\x0bd\u2028e " * 40,
    "same line here\n" * 30 + "#!{}<>", "9" * 40 + " $%&", "\u3000 \u3000 word",
]


def test_statistics_against_brute_force(monkeypatch):
    for segment in (1 << 20, 64):
        monkeypatch.setattr(quality.common, "_SEGMENT", segment)
        quality.common._powers.clear()
        for some in (ODD_TEXTS, *([t] for t in ODD_TEXTS)):
            got = quality.statistics(pa.array(some, pa.string()))
            assert np.isfinite(got).all()
            assert np.allclose(got, [brute.text_statistics(t, quality.FEATURES) for t in some])
    quality.common._powers.clear()


def test_quality_against_brute_force(spark):
    """Scores of the query by the plain features and a walk through each tree, node by node."""
    small = f"{DATA}/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)

    def walked(x):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in quality.op6_quality(spark, small).collect()}
    want = {i: walked(brute.text_statistics(t, quality.FEATURES)) for i, t in texts.items()}
    assert got.keys() == want.keys() and np.mean([abs(got[i] - want[i]) < 1e-6 for i in want]) > 0.99  # rounding at a threshold


def test_blank_text_spoils_no_bins(spark):
    rows = [(i, "good words in a row " * 9 if i % 2 else "$$ ## 11 " * 9, i % 2) for i in range(1, 200)]
    docs = spark.createDataFrame([*[r[:2] for r in rows], (0, "\u3000")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, y) for i, _, y in rows], (0, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.99


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in quality.op6_quality(spark, BIG).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()]
    assert all(r["held_out"] == brute.held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    asked = [(got[i]["score"], y) for i, y in labels if i in got and brute.held_out(i)]
    good, bad = [s for s, y in asked if y == 1], [s for s, y in asked if y == 0]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert area > 0.85, area


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (1, "w " * 100_000), (3, "ok")], "doc_id long, text string").selectExpr("*", "'s' AS score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (4, 1), (6, 1)], "doc_id long, quality int")
    for labels in (none, odd):
        rows = quality.score(docs, quality.fit(docs, labels)).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs.limit(0), quality.fit(docs, none)).collect() == []


# ---------------------------------------------------------------- language


def test_language_held_out(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = language_id.op8_language_id(spark, BIG).collect()
    assert len(got) == len(docs)
    asked = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in asked]) > 0.95
    for r in got:
        text = docs[r["doc_id"]]["text"]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r["score"] <= 1 and r["held_out"] == brute.held_out(r["doc_id"])


def test_language_against_brute_force(spark, monkeypatch):
    def number(c):
        return ord(c) if c.isalpha() else 0

    class Letters(dict):
        shape = (0, language_id.DIMENSION)

        def __missing__(self, symbol):
            return self.setdefault(symbol, language_id.letter_vectors(np.array([symbol]))[0].astype(float))

    letters = Letters()
    for segment in (1 << 20, 64):
        monkeypatch.setattr(language_id.common, "_SEGMENT", segment)
        for some in (ODD_TEXTS, *([t] for t in ODD_TEXTS)):
            got, extent = language_id.bundle(pa.array(some, pa.string()))
            counts = [list(brute.trigrams(t).values()) for t in some]
            assert np.allclose(got, [brute.hyper_bundle(t, letters, number) for t in some], atol=1e-5)
            assert np.allclose(extent, [sum(c) ** 2 / max(1, sum(x * x for x in c)) for c in counts])
    monkeypatch.undo()
    small = f"{DATA}/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sums = {}
    for i, r in docs.items():  # at most 1000 of a language here, so no sample
        if r["lang"] is not None and r["text"] is not None and not brute.held_out(i):
            sums[r["lang"]] = sums.get(r["lang"], 0) + brute.hyper_bundle(r["text"], letters, number)
    models = {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items())}
    for r in language_id.op8_language_id(spark, small).collect():
        v = brute.hyper_bundle(docs[r["doc_id"]]["text"], letters, number)
        cosines = {lang: float(v @ m) for lang, m in models.items()}
        best = max(cosines, key=cosines.get) if v.any() else "und"
        assert r["score"] == pytest.approx(max(0, *cosines.values()) if v.any() else 0, abs=1e-4)
        assert r["lang_pred"] == best or abs(cosines[r["lang_pred"]] - cosines[best]) < 1e-4


def test_letters_of_all_scripts_differ():
    points = np.array([0, *range(97, 123), *range(0x430, 0x4FF), *range(0x4E00, 0x5200)])
    vectors = language_id.letter_vectors(points)
    cosines = vectors @ vectors.T / language_id.DIMENSION
    np.fill_diagonal(cosines, 0)
    assert set(np.unique(vectors)) == {-1, 1} and np.abs(cosines).max() < 0.2


def test_two_languages_of_one_script(spark):
    rng = random.Random(3)
    parts = {"ru": "ко то ра не на по во ли ст ни за ет ый ого".split(), "uk": "що ти ра не на по ви лі ст ні за ється ій ого".split(), "zh": list("的一是不了人我在有他"), "ja": list("の一は日を人年大出会")}
    rows = [(i, lang, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.choice((1, 2, 3)))) for _ in range(40))) for i, lang in enumerate(list(parts) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    held = [(i, lang) for i, lang, _ in rows if brute.held_out(i)]
    assert len(held) > 30 and np.mean([got[i] == lang for i, lang in held]) > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (None, "the cat"), (3, "ok " * 300_000)], "doc_id long, text string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    known = spark.createDataFrame([(7, "the cat and the dog", "en"), (8, "le chat et le chien", "fr"), (9, None, "en"), (11, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(known)
    rows = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, model).collect()]
    assert len(rows) == 5 and rows[:3] == [(1, "und"), (2, "und"), (3, "und")] and (None, "en") in rows
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).collect() == [] and language_id.fit(known.limit(0)) == {}


# ---------------------------------------------------------------- decontamination


def test_contained(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((4, 5, 6, 8, 9, 17, 33, 60, 120, 700, 1, 2, 3))]
    docs = []
    for d in range(80):
        own = [rng.choice(vocab) for _ in range(rng.choice((3, 30, 300, 6000)))]
        i, text = items[d % len(items)]
        words = text.split()
        for _ in range(rng.choice((0, 0, 1, len(words) // 25))):
            words[rng.randrange(len(words))] = "changed"
        if d % 3:
            at = rng.randrange(len(own) + 1)
            own[at:at] = words
        docs.append((d, " ".join(own).upper()))
    want = brute.contained(docs, items, 5, 80, 100)
    docs += [(100, None), (101, ""), (None, items[6][1]), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    for chars in (4_000_000, 2_000):
        got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontaminate.find_contained(df, bench, block_chars=chars).collect()}
        assert got == want | {(None, 6): (29, 29)}
    named = bench.selectExpr("cast(item_id AS smallint) AS item_id", "text")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contained(df, named).collect()} == got.keys()
    keyed = df.selectExpr("struct(doc_id AS a, 'x' AS b) AS doc_id", "text")
    assert {(r["doc_id"]["a"], r["item_id"]) for r in decontaminate.find_contained(keyed, named).collect()} == got.keys()
    assert decontaminate.find_contained(df.limit(0), bench).collect() == []
    assert decontaminate.find_contained(df, bench.limit(0)).collect() == []


# ---------------------------------------------------------------- vectors


def vectors(seed=2, groups=40, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.normal(size=dim)
        for _ in range(1 + g % 7 if g else 300):
            rows.append((len(rows), (base + rng.normal(size=dim) * (0.05, 0.15, 0.24)[g % 3]).tolist(), "x"))
    return rows


def test_vectors_against_brute_force(spark):
    rows = vectors()
    rows += [(900, rows[5][1], "x"), (901, [2 * c for c in rows[5][1]], "x"), (902, None, "x"), (903, [], "x"), (904, [0.0] * 24, "x"), (905, [float("nan")] * 24, "x"), (906, [None] * 24, "x"), (907, [1.0, 2.0], "x"), (908, [2.0, 4.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(df).collect()}
    want = brute.vector_links([r[:2] for r in rows], 0.95)
    assert len(got) == len(rows)
    found, links = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert links > 80_000 and links >= found >= 0.98 * links
    assert np.mean([got[i]["component_id"] == c for i, (_, c) in want.items()]) > 0.98
    for i in (902, 903, 904, 905, 906):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[907]["component_id"] == got[908]["component_id"] == 907 and not got[908]["kept"]
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_vectors_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, None), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in vector_dedup.near_vectors(df).collect())
    assert got == [(0, 0, 0), (0, 1, 4), (4, 0, 4), (4, 1, 4)]
    assert vector_dedup.near_vectors(df.limit(0)).collect() == []


def test_vectors_of_lengths_that_agree_modulo_4096(spark):
    rows = [(i, [1.0, i % 3 * 2.0]) for i in range(6)] + [(10 + i, [1.0 + i % 3, *([0.5] * 4097)]) for i in range(6)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute.vector_links(rows, 0.95)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_vectors_of_the_table(spark, sf):
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.op9_vector_dedup(spark, f"{DATA}/{sf}").collect()}
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").collect()]
    want = brute.vector_links(rows, 0.95)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert np.mean([got[i] == want[i] for i in want]) > 0.98


def test_saturated_clusters_are_joined(spark):
    rng = np.random.default_rng(8)
    far = [1.0, (1 / 0.966**2 - 1) ** 0.5] + [0.0] * 22
    rows = [(i, (np.array(([1.0] + [0.0] * 23, far)[i % 2]) + rng.normal(size=24) * 0.001).tolist()) for i in range(200)]
    rows += [(200 + i, rng.normal(size=24).tolist()) for i in range(20)]
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0).collect()}
    want = brute.vector_links(rows, 0.95)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert sum(r["kept"] for r in got.values()) == 21 and got[0]["n_links"] == 199


def test_tight_group_and_unproven_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base, other = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.001).tolist()) for i in range(700)] + [(700 + i, (other + rng.normal(size=16) * 0.2).tolist()) for i in range(60)]
    asked = []
    original = vector_dedup._reached
    monkeypatch.setattr(vector_dedup, "_reached", lambda some, *rest: asked.extend(some) or original(some, *rest))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(df, k=4).collect()}
    assert got == brute.vector_links(rows, 0.95) and got[0][0] == 699
    # Whatever blocks are asked about, those in reach are found.
    vectors = [(i, np.eye(3)[i % 3] + 0.01 * i) for i in range(6)]
    units = [(i, i % 3, (v / np.linalg.norm(v)).tobytes(), 0.05) for i, v in vectors]
    teams = spark.createDataFrame(units, "node long, team long, centre binary, radius double")
    found = {(r["node"], r["nbr"]) for r in original(teams.where("node < 2").collect(), teams, 1.55).collect()}
    angle = lambda a, b: np.arccos(np.clip(np.frombuffer(units[a][2]) @ np.frombuffer(units[b][2]), -1, 1))
    assert found == {(a, b) for a in (0, 1) for b in range(6) if units[a][1] != units[b][1] and angle(a, b) - 0.1 <= 1.55}


def test_vectors_are_compared_exactly_at_last(spark, monkeypatch):
    # Lists find nothing, so that only the exact comparison is left.
    monkeypatch.setattr(vector_dedup, "_exact_edges", lambda lists, vectors, threshold: lists.limit(0).selectExpr("node AS a", "nbr AS b"))
    rows = [r[:2] for r in vectors(groups=12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["audit_recall"]) for r in vector_dedup.near_vectors(df, k=2, tables=1, rounds=0).collect()}
    assert got == {i: (*x, 1.0) for i, x in brute.vector_links(rows, 0.95).items()}


def test_audit_sees_lost_links_of_small_groups(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=24)
    units = [base + rng.normal(size=24) * 0.01 for _ in range(300)]
    for _ in range(100):
        x = rng.normal(size=24)
        units += [x, x + rng.normal(size=24) * 0.01]
    units += [rng.normal(size=24) for _ in range(400)]
    rows = [(i, (x / np.linalg.norm(x)).tobytes(), 3) for i, x in enumerate(units)]
    nodes = spark.createDataFrame(rows, "node long, unit binary, rows long")
    large = [(i, 900) for i in range(300)]
    whole = spark.createDataFrame(large + [(i, 6) for i in range(300, 500)], "node long, linked long")
    assert vector_dedup._audit(nodes, whole, 0.95, 100) == 1.0
    # All pairs are lost, and then a third of them.
    assert vector_dedup._audit(nodes, spark.createDataFrame(large, "node long, linked long"), 0.95, 100) == 0.0
    some = spark.createDataFrame(large + [(i, 6) for i in range(300, 432)], "node long, linked long")
    assert 0.5 < vector_dedup._audit(nodes, some, 0.95, 100) < 0.8
