"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Statistics are shares and lengths of characters, words and lines of the whole text (FEATURES). Trees are grown level
by level on histograms of at most 64 quantile bins a statistic, by second-order logistic loss. A model is a few
arrays: complete trees of one depth, with a feature, a threshold and at the leaves a value in each row, so a batch
of texts walks all trees at once with numpy.

Learning uses a bounded sample, at most `sample` labelled rows by hash of the id, none of them held out; every text
is scored whole.

Defined results: a null text scores like an empty one; without labels, or with one label alone, every score is the
(smoothed) share of label 1; a document with several labels counts once for each; rows that repeat are scored alike;
columns named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CUT = 0.3
_MARKS = "!#$%&*@|.,:;=/_<>{}"
FEATURES = (
    "chars", "letters", "upper", "digits", "space", "other", *[f"mark {m}" for m in _MARKS], "words", "word length", "short words",
    "long words", "distinct words", "distinct pairs", "top word", "lines", "line length", "distinct lines", "longest line",
)


def _class_table() -> np.ndarray:
    """Code point -> 0 other, 1 lower letter, 2 upper letter, 3 digit, 4 space, 5... the marks; above 255 letters."""
    table = np.zeros(0x3000, dtype=np.int64)
    for cp in range(len(table)):
        c = chr(cp)
        table[cp] = 3 if c.isdigit() else 4 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 0
    for i, m in enumerate(_MARKS):
        table[ord(m)] = 5 + i
    return table


_CLASSES = _class_table()


def _kinds(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < len(_CLASSES), _CLASSES[np.minimum(points, len(_CLASSES) - 1)], 1)


def _character_counts(texts: pa.Array) -> np.ndarray:
    """Characters of each class for each text. A lone text goes by pieces, however long it is."""
    n, kinds = len(texts), 5 + len(_MARKS)
    if n == 1:
        return sum((np.bincount(_kinds(p), minlength=kinds) for p in common.pieces(texts)), np.zeros(kinds, int))[None, :].astype(np.float64)
    texts = [t or "" for t in texts.to_pylist()]
    owner = np.repeat(np.arange(n), [len(t) for t in texts])
    return np.bincount(owner * kinds + _kinds("".join(texts)), minlength=n * kinds).reshape(n, kinds).astype(np.float64)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text. Words are what stands between ASCII white space, A-Z lower-cased."""
    n = len(texts)
    counts = _character_counts(texts)
    chars = counts.sum(axis=1)
    size, letters = np.maximum(chars, 1), np.maximum(counts[:, 1] + counts[:, 2], 1)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(chars)
    out[:, 1] = (counts[:, 1] + counts[:, 2]) / size
    out[:, 2] = counts[:, 2] / letters
    out[:, 3], out[:, 4], out[:, 5] = counts[:, 3] / size, counts[:, 4] / size, counts[:, 0] / size
    out[:, 6 : 6 + len(_MARKS)] = counts[:, 5:] / size[:, None]
    words, lengths, at = common.word_table(texts)
    lines, extents, begin = common.line_table(texts)
    newlines = common.newlines(texts)
    w = 6 + len(_MARKS)
    for i in range(n):
        own, each = words[at[i] : at[i + 1]], lengths[at[i] : at[i + 1]]
        m = len(own)
        if m:
            _, often = np.unique(own, return_counts=True)
            out[i, w : w + 5] = np.log1p(m), each.mean(), (each <= 3).mean(), (each >= 12).mean(), len(often) / m
            out[i, w + 5] = len(np.unique(common.shingles(own, 2))) / max(1, m - 1)
            out[i, w + 6] = often.max() / m
        long, total = lines[begin[i] : begin[i + 1]], extents[begin[i] : begin[i + 1]]
        size = newlines[i] + 1
        out[i, w + 7 : w + 11] = (
            np.log1p(size), np.log1p((chars[i] - newlines[i]) / size),
            (len(np.unique(long)) + (len(long) < size)) / size, np.log1p(total.max(initial=0)),
        )
    return out


@dataclass(frozen=True)
class Trees:
    """feature, threshold: (trees, 2**depth - 1); leaf: (trees, 2**depth); base: log odds before any tree."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        at = np.zeros((len(x), len(self.leaf)), dtype=np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        total = np.full(len(x), self.base)
        if len(self.leaf):
            total += self.leaf[trees, at - (2**depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees on rows x with labels y of 0 and 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if not 0 < y.sum() < len(y):
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, 2**depth)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    features = x.shape[1]
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    total = np.full(len(y), base)
    cells = binned + np.arange(features) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, at = p - y, p * (1 - p), np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            flat = ((at - first)[:, None] * (features * bins) + cells).ravel()
            shape = (width, features, bins)
            hg = np.bincount(flat, np.repeat(g, features), width * features * bins).reshape(shape).cumsum(axis=2)
            hh = np.bincount(flat, np.repeat(h, features), width * features * bins).reshape(shape).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg**2 / (th + ridge)
            gain = np.where((hh >= least) & (th - hh >= least), gain, 0)
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            flat_gain = gain.reshape(width, -1)
            best = flat_gain.argmax(axis=1)
            split = flat_gain[np.arange(width), best] > 1e-9
            f, b = best // bins, best % bins
            feature[t, first : first + width] = np.where(split, f, 0)
            threshold[t, first : first + width] = [edges[i][j] if s else np.inf for i, j, s in zip(f, b, split, strict=True)]
            own = at - first
            at = 2 * at + 1 + (split[own] & (binned[np.arange(len(y)), f[own]] > b[own]))
        own = at - inner
        leaf[t] = -rate * np.bincount(own, g, 2**depth) / (np.bincount(own, h, 2**depth) + ridge)
        total = total + leaf[t][own]
    return Trees(base, feature, threshold, leaf)


def _measured(texts: pa.Array):
    for part in common.text_chunks(texts, 1 << 18):
        yield part, statistics(texts.slice(part.start, part.stop - part.start))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees learnt from labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isin(0.0, 1.0) & (common.fold_of(F.col("_id")) != 0)
    )
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)

    def measure(batches):
        for batch in batches:
            for part, x in _measured(batch.column("text")):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows.column("y"), rows.column("i"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "i", "x"])

    held = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    texts = held.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(F.col("_y").alias("y"), F.xxhash64("_id").alias("i"), "text")
    rows = texts.mapInArrow(measure, "y double, i long, x array<double>").toPandas()
    if not len(rows):
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(rows["x"].tolist()), rows["y"].to_numpy()
    order = np.lexsort((*x.T, y, rows["i"]))  # whatever order the rows came in
    return grow(x[order], y[order])


def score(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1)."""
    docs = common.without(docs, "score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(held.value.score(x) for _, x in _measured(texts))]))

    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col(text_col)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
