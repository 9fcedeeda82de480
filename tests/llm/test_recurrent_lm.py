"""Language-model scoring: counts by brute force, gradients by differences, the whole document's probability step by step."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

import brute
from compare import DATA
from sweepmill.llm import recurrent_lm as lm

SMALL = f"{DATA}/sf0.001"
ODD = ["One two TWO  one\x0bé", None, "", " \n\t", "a", "x" * 3000, "Ünï code one", "one " * 400]


def base_scores(docs):
    train = Counter()
    for i, text in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            train.update([*brute.words(text), None])
    total, kinds = sum(train.values()), len(train)
    norm = math.log10(total + 0.1 * (kinds + 1))
    out = []
    for i, text in docs:
        own = [*brute.words(text), None]
        held = i is None or zlib.crc32(str(i).encode()) % 10 == 0
        out.append((i, held, len(own), sum(train[w] > 0 for w in own), total, sum(math.log10(train[w] + 0.1) - norm for w in own)))
    return out


def same(rows, want):
    got = sorted((tuple(r)[:6] for r in rows), key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_scores_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = lm.op13_lm_scoring(spark, SMALL).collect()
    same(rows, base_scores(docs))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in rows)
    # A table too small for the words: the rest comes by the join.
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    far = lm.score_documents(frame, table=lm.WORDS).collect()
    same(far, base_scores(docs))
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert all(abs(r["score"] - scores[r["doc_id"]]) < 1e-6 * abs(r["score"]) for r in far)


def test_odd_documents(spark):
    docs = [*enumerate(ODD), (None, "one"), (3, "one two"), (3, "one two")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS far", "'x' AS held_out")
    rows = lm.score_documents(frame).collect()
    same(rows, base_scores(docs))
    assert all(math.isfinite(r["score"]) for r in rows) and len({r["score"] for r in rows if r["doc_id"] == 3 and r["n_tokens"] == 3}) == 1
    assert lm.score_documents(frame.limit(0)).collect() == []
    alone = lm.score_documents(frame.where("doc_id IS NULL")).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in alone] == [(0, 0, 0.0)]


def vocabulary_of(texts):
    hashes, kind, begin = lm.tokens(pa.array(texts))
    some, first, n = np.unique(hashes, return_index=True, return_counts=True)
    words = some != lm.END
    mass, size = np.bincount(kind[first][words], n[words], lm.REST), np.bincount(kind[first][words], minlength=lm.REST)
    order = np.lexsort((some, -n))
    return lm.Vocabulary(some[order], n[order], kind[first][order], int(n.sum()), len(some), mass, size), hashes, kind, begin


def weights(words):
    rng, w = np.random.default_rng(1), lm.untrained(words)
    return {n: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for n, v in w.items()}


def stepwise(w, symbols):
    """Natural log probabilities of one document, a token at a time."""
    h, last, out = np.zeros(lm.HIDDEN), 0, []
    for s in symbols:
        g, a = w["x"][last].astype(float), h @ w["u"]
        z, r = (1 / (1 + np.exp(-(g[k * lm.HIDDEN :][: lm.HIDDEN] + a[k * lm.HIDDEN :][: lm.HIDDEN]))) for k in (0, 1))
        new = np.tanh(g[2 * lm.HIDDEN :] + r * a[2 * lm.HIDDEN :])
        h = (1 - z) * new + z * h
        c = h @ w["wc"] + w["bc"]
        cls = s // lm.CLASS if s < lm.WORDS else lm.COMMON_CLASSES + s - lm.WORDS
        p = c[cls] - np.log(np.exp(c).sum())
        if s < lm.WORDS:
            inside = h @ w["wo"][cls] + w["bo"][cls]
            p += inside[s % lm.CLASS] - np.log(np.exp(inside).sum())
        out.append(p)
        last = s
    return out


def test_state_is_carried_through_whole_documents():
    """Windows and lanes do not show in the result."""
    texts = [*ODD, *(f"word{i % 40} and {i} more " * (i % 23) for i in range(300))]
    words, hashes, kind, begin = vocabulary_of(texts)
    symbols, w = words.look_up(hashes, kind)[0], weights(words)
    got = lm.log_likelihood(w, symbols, begin)
    for d in (0, 1, 2, 5, 7, 30, 100, 307):
        assert np.allclose(got[begin[d] : begin[d + 1]], stepwise(w, symbols[begin[d] : begin[d + 1]].tolist()), atol=1e-3)


def test_probabilities_sum_to_one():
    texts = [f"w{i % 3000} w{i % 7}" for i in range(9000)]
    words, hashes, kind, begin = vocabulary_of(texts)
    w = weights(words)
    h = np.random.default_rng(0).normal(size=lm.HIDDEN)
    c = h @ w["wc"] + w["bc"]
    p = np.exp(c - np.log(np.exp(c).sum()))
    inside = [np.exp(h @ w["wo"][k] + w["bo"][k]) for k in range(lm.COMMON_CLASSES)]
    common_words = sum(p[k] * (x / x.sum()).sum() for k, x in enumerate(inside))
    symbol, count = words.look_up(words.hashes, np.array([dict(zip(hashes.tolist(), kind.tolist(), strict=True))[x] for x in words.hashes.tolist()]))
    rest = symbol >= lm.WORDS
    of = symbol[rest] - lm.WORDS
    others = np.bincount(of, count[rest] + 0.1, lm.REST) + 0.1  # and an unknown word in each class
    assert np.isclose(common_words + (p[lm.COMMON_CLASSES :] * others / words.rest).sum(), 1)


def test_gradients_against_differences():
    words, hashes, kind, begin = vocabulary_of([f"a{i % 5} b c{i} " * 3 for i in range(40)])
    w = {n: v.astype(np.float64) for n, v in weights(words).items()}
    rng = np.random.default_rng(2)
    symbols = words.look_up(hashes, kind)[0]
    inputs, targets = rng.choice(symbols, (6, 3)), rng.choice([*symbols, -1], (6, 3))
    fresh, h = rng.random((6, 3)) < 0.3, rng.normal(size=(3, lm.HIDDEN))

    def loss(w):
        states = lm._forward(w, inputs, fresh, h).reshape(-1, lm.HIDDEN).astype(float)
        return -sum(_one(w, states[i], t) for i, t in enumerate(targets.reshape(-1)) if t >= 0)

    def _one(w, state, t):
        c = state @ w["wc"] + w["bc"]
        p = c[lm._classes(np.array([t]))[0]] - np.log(np.exp(c).sum())
        if t < lm.WORDS:
            inside = state @ w["wo"][t // lm.CLASS] + w["bo"][t // lm.CLASS]
            p += inside[t % lm.CLASS] - np.log(np.exp(inside).sum())
        return p

    total = {n: np.zeros(v.shape) for n, v in w.items()}
    for name, at, g in lm._gradients(w, inputs, fresh, targets, h)[0]:
        total[name][at] += g
    for name in w:
        for k in np.argsort(-np.abs(total[name].reshape(-1)))[:5]:
            step, old = 1e-3, w[name].reshape(-1)[k]
            values = []
            for sign in (1, -1):
                w[name].reshape(-1)[k] = old + sign * step
                values.append(loss(w))
            w[name].reshape(-1)[k] = old
            assert np.isclose((values[0] - values[1]) / (2 * step), total[name].reshape(-1)[k], rtol=0.02, atol=1e-3), name


def test_learns_from_every_document(spark):
    for i in range(4):
        docs = spark.createDataFrame([(i, "one two three two one " * 40)], "doc_id long, text string")
        words = lm.vocabulary(lm.word_counts(docs, "text"))
        start, learnt = lm.untrained(words), lm.fit(docs, words)
        assert any((start[name] != learnt[name]).any() for name in start), i


def test_look_up_by_the_beginning_of_a_hash():
    """Words whose hashes begin alike, the ends of the range, and words that are not there."""
    rng = np.random.default_rng(4)
    near = (np.uint64(77) << np.uint64(40)) + np.arange(0, 60, 2, dtype=np.uint64)
    held = np.unique(np.concatenate((near, rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2), np.array([0, 2**64 - 1, int(lm.END)], dtype=np.uint64))))
    counts = rng.integers(1, 90, len(held))
    order = np.lexsort((held, -counts))
    words = lm.Vocabulary(held[order], counts[order], np.zeros(len(held), np.int64), int(counts.sum()), len(held), np.zeros(lm.REST), np.zeros(lm.REST))
    asked = np.concatenate((held, near + np.uint64(1), rng.integers(0, 2**63, 3000).astype(np.uint64)))
    table = dict(zip(held.tolist(), counts.tolist(), strict=True))
    symbol, got = words.look_up(asked, np.full(len(asked), 3))
    assert got.tolist() == [table.get(h, -1) for h in asked.tolist()]
    own = [int(lm.END), *[h for h in held[order].tolist() if h != int(lm.END)]][: lm.WORDS]
    assert symbol.tolist() == [own.index(h) if h in set(own) else lm.WORDS + 3 for h in asked.tolist()]
    # A table of no other hash than the largest, and one without any.
    for some in (np.array([2**64 - 1], dtype=np.uint64), np.zeros(0, np.uint64)):
        one = lm.Vocabulary(some, np.ones(len(some), np.int64), np.zeros(len(some), np.int64), len(some), len(some), np.zeros(lm.REST), np.zeros(lm.REST))
        assert one.look_up(np.array([5, 2**64 - 1], dtype=np.uint64), np.zeros(2, np.int64))[1].tolist() == [-1, 1 if len(some) else -1]


def test_sums_by_symbol():
    rng = np.random.default_rng(3)
    symbols, d = np.minimum(rng.zipf(1.4, 4096), lm.WORDS + lm.REST) - 1, rng.normal(size=(3, 4096, lm.HIDDEN))
    which, sums = lm._by_symbol(symbols, d)
    want = np.zeros((lm.WORDS + lm.REST, 3 * lm.HIDDEN))
    np.add.at(want, symbols, np.concatenate((d[1], d[2], d[0]), axis=1))
    got = np.zeros_like(want)
    got[which] = sums
    assert sorted(which.tolist()) == sorted(set(symbols.tolist())) and np.allclose(got, want)
    assert {1, lm.MANY} <= set(np.bincount(symbols).tolist()) or np.bincount(symbols).max() > lm.MANY


def test_large_weights_neither_overflow_nor_vanish():
    words, hashes, kind, begin = vocabulary_of([f"w{i % 900} w{i % 7} z" for i in range(600)])
    symbols, w = words.look_up(hashes, kind)[0], weights(words)
    w = {n: v * np.float32(60) for n, v in w.items()}
    got = lm.log_likelihood(w, symbols, begin)
    assert any(np.abs(w[n]).max() > 88 for n in ("wc", "bc", "wo", "bo")) and np.isfinite(got).all()
    for d in (0, 99, 599):
        assert np.allclose(got[begin[d] : begin[d + 1]], stepwise(w, symbols[begin[d] : begin[d + 1]].tolist()), rtol=1e-3, atol=0.05)
    grads, _ = lm._gradients(w, symbols[:40].reshape(10, 4), np.zeros((10, 4), bool), symbols[1:41].reshape(10, 4), np.zeros((4, lm.HIDDEN), np.float32))
    assert all(np.isfinite(g).all() for _, _, g in grads)


def test_memory_of_a_window():
    """Time goes with what a window of training or scoring moves through the cache; unlike time, that is the same on each machine."""
    words, hashes, kind, begin = vocabulary_of([" ".join(f"w{(i * j) % 700}" for j in range(200)) for i in range(128)])
    w, symbols = weights(words), words.look_up(hashes, kind)[0]
    size = lm.STEPS * lm.LANES
    some = symbols[:size].reshape(lm.STEPS, lm.LANES)
    state = np.zeros((lm.LANES, lm.HIDDEN), np.float32)

    def peak(f):
        f()
        tracemalloc.start()
        f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6

    assert peak(lambda: lm._gradients(w, some, np.zeros(some.shape, bool), some, state)) < 9  # 9.8 MB before
    assert peak(lambda: lm.log_likelihood(w, symbols, begin)) < 6  # 7.3 MB before


def test_changes_of_a_block_are_added_up():
    table = pa.table({"block": pa.array([4, 4, 4]), "change": pa.array([[1, 2**53], [2, 1], [-5, 0]], pa.list_(pa.int64()))})
    assert lm._added(table).to_pylist() == [{"block": 4, "change": [-2, 2**53 + 1]}]
