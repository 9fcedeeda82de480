"""The pipeline's stages against brute force on their own inputs."""

from collections import defaultdict

import pytest

import brute
from compare import DATA

pipeline = pytest.importorskip("corpus_pipeline")
SF = f"{DATA}/sf0.001"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs = []
    for name, stage in pipeline.STAGES:
        inputs.append(by_id(docs))
        out = stage(spark, docs, SF)
        assert name == "source_mix" or out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    inputs.append(by_id(docs))
    raw, spoken, lines, single, clean, mixed = inputs

    gone = raw.keys() - spoken.keys()
    assert len(gone) <= 0.05 * len(raw) and all(raw[i] == spoken[i] for i in spoken)

    holders = defaultdict(set)
    for i, r in spoken.items():
        for line in (r["text"] or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(brute.FOLD)
            if len(key) >= 40:
                holders[key].add(i)
    assert lines.keys() == spoken.keys()
    for i, r in spoken.items():
        kept = [x for x in (r["text"] or "").split("\n") if len(h := holders.get(x.strip(" \t\n\x0b\x0c\r").translate(brute.FOLD), ())) < 5 or i == max(h)]
        assert lines[i]["text"] == "\n".join(kept)

    groups = brute.jaccard_components([(i, r["text"]) for i, r in lines.items()], 5, 80, 100)
    assert single.keys() == {i for i, (_, c) in groups.items() if c == i}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, _ in brute.contained([(i, r["text"]) for i, r in single.items()], items, 5, 80, 100)}
    assert dirty and clean.keys() == single.keys() - dirty

    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in clean.values():
        n = len(brute.words(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in mixed.values():
        assert r["copies"] > 0 and r["taken"] == r["copies"] * len(brute.words(r["text"]))
        taken[r["source"]] += r["taken"]
    for s, t in brute.mix_targets({s: n for s, n in sizes.items() if n}).items():
        assert abs(taken[s] - t) < largest[s] + 1e-6  # the last draw


def test_run(spark):
    got = pipeline.run(spark, SF)
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "text", "copies", "taken"}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " end", " ".join(f"v{i}" for i in range(60))
    rows = [(5, text, "a"), (5, other, "b"), (None, near, "c"), (7, near, "d"), (None, other + " x", "e"), (8, "", "f"), (9, None, "g"), (4, "lone words of a text", "h"), (4, "lone words of a text", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string").selectExpr("*", "1 AS component_id", "2 AS _tkey")
    got = sorted(r["h1"] for r in pipeline.keep_one_of_group(spark, df, SF).collect())
    assert got == ["a", "b", "f", "g", "h", "i"]


def test_names_do_not_clash(spark):
    """Columns named like what operators make pass through every stage; a long text does too."""
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(i, f"The quick brown fox number {i} jumps over the lazy dog of house {i * i}.", "en", "a", 60) for i in range(8)] + [(50, long, "en", "a", len(long))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["score", "lang_pred", "extent", "n_lines", "n_dropped", "_text_key", "_found", "_lost", "_kept", "component_id", "key", "h1", "item_id"]
    df = df.selectExpr("*", *[f"'{c}' AS {c}" for c in extra])
    for name, stage in pipeline.STAGES:
        got = stage(spark, df, SF)
        assert name == "source_mix" or got.columns == df.columns
        got = got.collect()
        assert got and all(r[c] == c for r in got for c in extra)
        assert name == "source_mix" or 50 in {r["doc_id"] for r in got}


def test_stages_take_empty_and_odd_rows(spark):
    raw = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "some words of text here", "en", "a", 23), (3, "some words of text here", "en", "a", 23), (None, "other words of text here", "en", "b", 24)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (raw, []):
        for _, stage in pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(rows, schema), SF)
            assert out.count() <= len(rows)


def test_language_keeps_short_prose(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    kept = {r["doc_id"] for r in pipeline.identify_language(spark, docs, f"{DATA}/sf0.1").select("doc_id").collect()}
    gone = [r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] not in kept]
    assert [t for t in gone if any(c.isalpha() for c in t or "")] == []
    # Labelled texts teach the prototypes; long junk of single letters is unlike them all, and signs are no language.
    junk = "".join(chr(97 + (i * i * 7 + i * 11 + i // 5) % 26) for i in range(600))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(-1, junk, None, "a", 600), (-2, "12 %", None, "a", 4), (-3, "Avec.", None, "a", 5)], schema)
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)
    left = {r["doc_id"] for r in pipeline.identify_language(spark, both, "").where("doc_id < 0").select("doc_id").collect()}
    assert left == {-3}
