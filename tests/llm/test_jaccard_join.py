import random

import brute
from sweepmill.llm import jaccard_join


def got_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    return jaccard_join.jaccard_groups(df, **kw).collect()


def planted(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice((4, 6, 12, 40, 160, 700)))] for _ in range(60)]
    common = [rng.choice(vocab) for _ in range(60)]
    rows, n = [], 0
    for b in base:
        for _ in range(rng.choice((1, 1, 2, 5, 12))):
            own = list(b)
            for _ in range(rng.choice((0, 1, 2, max(1, len(b) // 25)))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            if rng.random() < 0.3:
                own = own + common
            n += 1
            rows.append((n, " ".join(own).upper() if rng.random() < 0.2 else "\n".join(own), "x"))
    return rows


def test_against_brute_force(spark):
    for k, num, den in ((4, 85, 100), (5, 80, 100), (3, 1, 2)):
        rows = planted(k)
        want = brute.jaccard_components([r[:2] for r in rows], k, num, den)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got_of(spark, rows, k=k, num=num, den=den)}
        assert got == want


def test_frequent_tokens(spark):
    """Many documents share their passages, so rare tokens run out and pairs decide."""
    rng = random.Random(9)
    parts = [" ".join(f"p{j}w{rng.randrange(50)}" for _ in range(30)) for j in range(12)]
    rows = [(i, " ".join(rng.sample(parts, 6)) + f" end{i % 9}", "x") for i in range(150)]
    want = brute.jaccard_components([r[:2] for r in rows], 4, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got_of(spark, rows, k=4, num=85, den=100, rare_max=2)}
    assert got == want


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a b", "x"), (5, "A  b", None), (6, long, "x"), (7, long + " tail", "x"), (None, "a b", "x"), (6, long, "x"), (None, "lone text", "x")]
    got = got_of(spark, rows, k=5, num=80, den=100)
    assert len(got) == len(rows)
    comp = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert comp[1, 0] == 1 and comp[2, 0] == 2 and comp[3, 0] == 3
    assert comp[4, 1] == comp[5, 1] == 4 and comp[7, 59_997] == comp[6, 59_996] == 6
    assert got_of(spark, []) == []


def test_null_ids_and_repeated_ids_link(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(None, " ".join(base), "x"), (7, " ".join([*base[:200], "new", *base[201:]]), "x"), (9, " ".join(base[:-1]), "x"), (9, "something else entirely here", "x"), (None, "alone with words here", "x")]
    got = sorted((r["n_shingles"], r["doc_id"] or -1, r["component_id"] or -1) for r in got_of(spark, rows, k=4, num=85, den=100))
    assert got == [(1, -1, -1), (1, 9, 9), (396, 9, 7), (397, -1, 7), (397, 7, 7)]


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.jaccard_components(docs, 4, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op3_jaccard_join(spark, d).collect()}
    assert got == want
