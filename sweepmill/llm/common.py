"""Helpers of the training-data operators: shared scratch tables and numpy work on text bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import STASHING, delete, exists, scratch_root, settings, stash, unstash  # noqa: F401  for the operators

#: ASCII white space, as in the class [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names (in any case), which an operator's result replaces."""
    low = {n.lower() for n in names}
    return df.select(*[c for c in df.columns if c.lower() not in low])


def small_batches(spark) -> None:
    """From now on this session hands Python batches of 4 MB at most, unless it has settings of its own: each of an
    executor's Python workers keeps one or two in memory, and batches of whole texts are large by default."""
    for name, default in (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")):
        if spark.conf.get(name) == default:
            spark.conf.set(name, STASHING[name])


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def fold_of(col):
    """crc32 of the id as text, modulo 5; 0 is held out. A null id counts as held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5, F.lit(0))


def bounded_sample(df: DataFrame, group: str, order_by: str, per_group: int) -> DataFrame:
    """At most per_group rows of each group, those of the smallest xxhash64(order_by): the same rows on every run. Counts
    of the groups tell which hashes can be among these, so only about twice as many rows as wanted are ever ranked."""
    from pyspark.sql import Window

    rank = F.xxhash64(F.col(order_by))
    counts = df.groupBy(group).agg((F.lit(2.0 * per_group + 100) / F.count("*")).alias("_share"))
    near = df.withColumn("_rank", rank).join(F.broadcast(counts), group).where(F.col("_rank") / 2.0**64 + 0.5 <= F.col("_share"))
    w = Window.partitionBy(group).orderBy("_rank", order_by)
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_group).drop("_n", "_rank", "_share")


# ---------------------------------------------------------------- words and shingles on raw bytes

_RNG = np.random.default_rng(20240611)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NEWLINE, _SAME = np.arange(256) == 10, np.arange(256, dtype=np.uint8)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(_SEGMENT + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (Steele, Lea and Flood's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: np.ndarray, begin: np.ndarray, gaps: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length (code points) of each word of UTF-8 bytes; texts begin at the offsets `begin`, the last of
    which is the end. gaps: the bytes between words; fold: what each byte counts as.

    Works through segments of fixed size. The last word of a segment waits, as (start, bytes, sum, code points), for the
    piece that may follow in the next one, so memory beyond the result is bounded even for a text that is one word."""
    hashes, starts, lengths, waits = [], [], [], None
    for at in range(int(begin[0]), int(begin[-1]), _SEGMENT):
        seg = raw[at : min(at + _SEGMENT, int(begin[-1]))]
        n, word = len(seg), ~gaps[seg]
        first = np.zeros(n + 1, dtype=bool)  # where a text begins
        first[begin[np.searchsorted(begin, at) : np.searchsorted(begin, at + n, "right")] - at] = True
        s = np.flatnonzero(word & ~(np.concatenate(([False], word[:-1])) & ~first[:n]))
        e = np.flatnonzero(word & ~(np.concatenate((word[1:], [False])) & ~first[1:])) + 1
        up, down = _power_tables(n + 1)
        total, points = np.zeros(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.int32)
        np.cumsum(_BYTE[fold[seg]] * up[:-1], out=total[1:])
        np.cumsum(seg & 0xC0 != 0x80, out=points[1:])
        sums, sizes, chars, s = (total[e] - total[s]) * down[s], e - s, points[e] - points[s], s + at
        if waits is not None:
            if len(s) and s[0] == at and not first[0]:
                sums[:1] = np.array([waits[2]]) + sums[:1] * np.uint64(pow(_BASE, waits[1], 2**64))
                s[0], sizes[0], chars[0] = waits[0], sizes[0] + waits[1], chars[0] + waits[3]
            else:
                s, sizes, sums, chars = (np.concatenate((np.array([x], dtype=y.dtype), y)) for x, y in zip(waits, (s, sizes, sums, chars), strict=True))
        waits = (int(s[-1]), int(sizes[-1]), sums[-1], int(chars[-1])) if len(s) and word[-1] else None
        keep = len(s) - (waits is not None)
        hashes.append(mix64(sums[:keep] + sizes[:keep].astype(np.uint64)))
        starts.append(s[:keep])
        lengths.append(chars[:keep])
    if waits is not None:
        hashes.append(mix64(np.array([waits[2]]) + np.array([waits[1]], dtype=np.uint64)))
        starts.append(np.array([waits[0]]))
        lengths.append(np.array([waits[3]], dtype=np.int32))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(lengths)


def _raw(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (a list or an Arrow string array) and the offsets of each."""
    if not isinstance(texts, pa.Array):
        blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return np.frombuffer(b"".join(blobs), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in blobs]))).astype(np.int64)
    _, offsets, data = texts.buffers()
    if offsets is None or not offsets.size:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    begin = np.frombuffer(offsets, dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8), begin


def word_table(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes and lengths in code points of the white-space separated words of all texts (a list or an Arrow
    string array), A-Z lower-cased, and the offsets of each text's words: those of text i are
    words[offsets[i]:offsets[i + 1]]. Null and empty texts have none."""
    raw, begin = _raw(texts)
    words, where, lengths = _words(raw, begin)
    return words, lengths, np.searchsorted(where, begin)


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and offsets of word_table."""
    words, _, at = word_table(texts)
    return words, at


def line_table(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of lines that are not empty, as they are."""
    raw, begin = _raw(texts)
    lines, where, lengths = _words(raw, begin, _NEWLINE, _SAME)
    return lines, lengths, np.searchsorted(where, begin)


def newlines(texts) -> np.ndarray:
    """Number of newlines of each text."""
    raw, begin = _raw(texts)
    return np.array([np.count_nonzero(raw[a:b] == 10) for a, b in zip(begin[:-1], begin[1:], strict=True)], dtype=np.int64)


def pieces(texts: pa.Array, size: int = _SEGMENT):
    """The one text of an Arrow array in pieces of about `size` bytes."""
    raw, (at, end) = _raw(texts)
    while at < end:
        stop = min(at + size, end)
        while stop < end and raw[stop] & 0xC0 == 0x80:
            stop += 1
        yield raw[at:stop].tobytes().decode("utf-8", "replace")
        at = stop


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words. Fewer words, but at least one, make one shingle of them all."""
    if 0 < len(words) < k:
        return shingles(words, len(words))
    if not len(words):
        return words
    n, out = len(words) - k + 1, np.full(1, k, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix64(out)


def text_chunks(texts, most: int = 1 << 19):
    """Slices of texts (a list or an Arrow string array) of about `most` bytes each; a longer text stands alone."""
    sizes = [len(t) if t else 0 for t in texts] if not isinstance(texts, pa.Array) else np.diff(_raw(texts)[1]).tolist()
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))
