"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its letters' vectors, each permuted (rotated) by
its place, multiplied element by element; a text is the bundle (sum) of its trigrams; a language's prototype is the
bundle of its training texts, each at unit length. A text gets the language whose prototype has the largest cosine
with it; the score is that cosine, at least 0.

Letters are those of Unicode, lower-cased; whatever stands between them is one gap. Every letter has a vector of its own,
whose signs are the bits of a hash of its code point, so none is stored and no two share one. Prototypes are fitted on a bounded sample, at most
`per_language` texts of each language by hash of the id; every text is scored whole. One prototype for each language
value is held by every task, so languages should number thousands, not millions.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if there is nothing to
learn from; equal cosines go to the first language by name; rows that repeat are scored alike; columns named like
a result column are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSION, SEED = 1024, 11
UNKNOWN = "und"


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    """Code point -> 0 for a gap, else the code point of the small letter."""
    table = np.zeros(0x110000, dtype=np.int32)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            table[cp] = ord(chr(cp).lower()[0])
    return table


def letter_vectors(symbols: np.ndarray) -> np.ndarray:
    """The vector of each symbol, +1 and -1: bits of hashes of the symbol and a counter."""
    words = DIMENSION // 64
    with np.errstate(over="ignore"):
        seeds = common.mix64(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
        bits = common.mix64(seeds[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _symbols(text: str) -> np.ndarray:
    return _symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


_BITS, _ONE = 21, (1 << 21) - 1


def _codes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and trigram codes of symbols without runs of gaps: those whose middle is a letter."""
    middle = np.flatnonzero(symbols[1:-1] > 0) + 1
    wide = symbols.astype(np.int64)
    return middle, (wide[middle - 1] << 2 * _BITS) | (wide[middle] << _BITS) | wide[middle + 1]


def _joined_gaps(symbols: np.ndarray) -> np.ndarray:
    return (symbols > 0) | np.concatenate(([True], symbols[:-1] > 0))


def trigram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, trigram code, count) of all texts. A lone text goes by pieces, however long it is."""
    if len(texts) == 1:
        known, counts, tail = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int32)
        for piece in (*common.pieces(texts), " "):
            tail = np.concatenate((tail, _symbols(piece)))
            tail = tail[_joined_gaps(tail)]
            code, n = np.unique(_codes(tail)[1], return_counts=True)
            known, at = np.unique(np.concatenate((known, code)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n)), len(known)).astype(np.int64)
            tail = tail[-2:]
        return np.zeros(len(known), dtype=np.int64), known, counts
    texts = [t or "" for t in texts.to_pylist()]
    symbols = _symbols("".join(f" {t} " for t in texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 2 for t in texts])
    solid = _joined_gaps(symbols)
    symbols, owner = symbols[solid], owner[solid]
    middle, code = _codes(symbols)
    known, at = np.unique(code, return_inverse=True)
    both, count = np.unique(owner[middle] * max(1, len(known)) + at, return_counts=True)
    return both // max(1, len(known)), known[both % max(1, len(known))], count


def bundle(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One vector for each text, of unit length; zero without letters. And how many trigrams of it count: (sum of
    counts)^2 / sum of squared counts, which repetition does not raise."""
    owner, code, count = trigram_counts(texts)
    total, squares = (np.bincount(owner, count.astype(np.float64) ** p, len(texts)) for p in (1, 2))
    known, at = np.unique(code, return_inverse=True)
    places = np.stack([known >> 2 * _BITS, (known >> _BITS) & _ONE, known & _ONE])
    letters = np.unique(places)
    third = letter_vectors(letters)
    first, second = np.roll(third, 2, axis=1), np.roll(third, 1, axis=1)
    a, b, c = np.searchsorted(letters, places)
    out = np.zeros((len(texts), DIMENSION), dtype=np.float32)
    for begin in range(0, len(known), 2048):
        some = slice(begin, min(len(known), begin + 2048))
        bound = first[a[some]] * second[b[some]]
        bound *= third[c[some]]
        mine = (at >= begin) & (at < some.stop)
        dense = np.zeros((len(texts), some.stop - begin), dtype=np.float32)
        dense[owner[mine], at[mine] - begin] = count[mine]
        out += dense @ bound
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), total**2 / np.maximum(squares, 1)


def _chunks(texts: pa.Array):
    """Slices of bounded size in bytes and in texts."""
    for part in common.text_chunks(texts, 1 << 18):
        for begin in range(part.start, part.stop, 256):
            yield slice(begin, min(part.stop, begin + 256))


def fit(docs: DataFrame, per_language: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language, from texts outside the held-out fold."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (common.fold_of(F.col(id_col)) != 0))
    ids = common.bounded_sample(known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang")), "lang", "_id", per_language)
    known = known.select(F.col(id_col).alias("_known"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    texts = known.join(F.broadcast(ids.select("_id").distinct()), F.col("_known") == F.col("_id")).select("lang", "text")

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1)
            for part in _chunks(texts):
                vectors = bundle(texts.slice(part.start, part.stop - part.start))[0].astype(np.float64)
                for lang in set(names[part]):
                    total[lang] = total.get(lang, 0) + vectors[names[part] == lang].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    def add(pdf):
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "vector": [np.sum(np.stack(pdf["vector"].tolist()), axis=0)]})

    sums = texts.mapInArrow(partial, "lang string, vector array<double>")
    rows = sums.groupBy("lang").applyInPandas(add, "lang string, vector array<double>").collect()
    out = {r["lang"]: np.array(r["vector"]) for r in rows}
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", extent: str | None = None) -> DataFrame:
    """docs with lang_pred (string) and score (double); with the number of trigrams that count (double, see bundle) in
    a column of the name `extent` if one is given."""
    docs = common.without(docs, "lang_pred", "score", *([extent] if extent else []))
    names = np.array([*prototypes, UNKNOWN], dtype=object)
    held = docs.sparkSession.sparkContext.broadcast(np.stack(list(prototypes.values())).astype(np.float32) if prototypes else np.zeros((0, DIMENSION), np.float32))

    def run(texts: pa.Array) -> pa.Array:
        best, score, extents = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]
        for part in _chunks(texts):
            vectors, size = bundle(texts.slice(part.start, part.stop - part.start))
            some = vectors.any(axis=1) & bool(len(held.value))
            cosines = vectors @ held.value.T if len(held.value) else np.zeros((len(vectors), 1))
            best.append(np.where(some, cosines.argmax(axis=1), len(names) - 1))
            score.append(np.where(some, np.clip(cosines.max(axis=1), 0, 1), 0.0))
            extents.append(size)
        columns = [pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score).astype(np.float64)), pa.array(np.concatenate(extents))]
        return pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "extent"])

    found = common.unused(docs, "_found")
    out = docs.withColumn(found, F.arrow_udf(run, "struct<lang_pred:string,score:double,extent:double>")(F.col(text_col)))
    return out.select(*docs.columns, f"{found}.lang_pred", f"{found}.score", *([F.col(f"{found}.extent").alias(extent)] if extent else []))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
