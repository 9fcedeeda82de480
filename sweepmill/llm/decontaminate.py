"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A benchmark item is contained in a document when the document holds at least num/den of the item's distinct k-word
shingles; an item of fewer words is one shingle of them all, held against the document's runs of as many words. MinHash
finds equal-sized sets well and small sets in large ones badly, so items are partitioned by size, each partition with
its own view of the documents: for items of more than u/2 and at most u shingles a document is a row of windows of 2u
shingles, one beginning every u. An item copied into the document lies in one window whole, and its Jaccard similarity
with that window is at least about num/den / 4 whatever the document's length. Windows and items are sketched with
`perms` minima; a window that agrees with an item in any one of them makes the pair a candidate (at similarity 0.19,
the least for num/den = 0.8, 64 minima all miss with probability 1e-6), and the item's shingles are then counted exactly
in the whole document. Items of at most 4 shingles are too small for sketches: each of their shingles is looked up.

The items are the stated query set: they are taken in blocks of bounded size, each block sent to all tasks, and the
documents are searched once for each block. Documents are never shuffled.

Defined results: null and empty texts contain nothing; an item without words is contained in nothing; rows that repeat
an id count as one document with the shingles of the best row; items that repeat an id are items of their own, of
which the best is reported; ids are of any type; columns other than id and text are not carried.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_U = np.uint64
_BITS = 22
#: Items of at most so many shingles are looked up by each of them.
SMALL = 4


def _permutations(perms: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(0, 2**63, perms, dtype=np.uint64), rng.integers(0, 2**62, perms, dtype=np.uint64) * _U(2) + _U(1)


class Block:
    """A block of items: their shingles, and for each size partition the minima of its items, sorted by value. small: by
    the width of a shingle, the shingles of items that have few, sorted, and whose they are."""

    def __init__(self, table: pa.Table, k: int, perms: int):
        self.k, self.perms = k, perms
        rows, self.sets, self.widths, self.parts, self.small = [], [], [], {}, {}
        for row, text in enumerate(table.column("text").to_pylist()):
            words, _ = common.word_hashes([text])
            if len(words):
                rows.append(row)
                self.widths.append(min(k, len(words)))
                self.sets.append(np.unique(common.shingles(words, k)))
        self.ids = table.column("item").combine_chunks().take(pa.array(rows, pa.int64()))
        by_size, few = defaultdict(list), defaultdict(list)
        for i, s in enumerate(self.sets):
            if len(s) <= SMALL:
                few[self.widths[i]].append(i)
            else:
                by_size[(len(s) - 1).bit_length()].append(i)
        salt, odd = _permutations(perms)
        for size, members in by_size.items():
            keys = np.concatenate([((self.sets[i][None, :] ^ salt[:, None]) * odd[:, None]).min(axis=1) for i in members])
            self.parts[1 << size] = self._sorted(keys, np.repeat(np.array(members), perms))
        for width, members in few.items():
            self.small[width] = self._sorted(np.concatenate([self.sets[i] for i in members]), np.repeat(members, [len(self.sets[i]) for i in members]))

    @staticmethod
    def _sorted(keys, owner):
        order = np.argsort(keys, kind="stable")
        table = np.zeros(1 << _BITS, dtype=bool)
        table[keys & _U((1 << _BITS) - 1)] = True
        return keys[order], owner[order], table

    def grams(self, words: np.ndarray, width: int) -> np.ndarray:
        return common.shingles(words, width) if len(words) >= width else words[:0]


def _matches(values: np.ndarray, index) -> list[tuple[int, int]]:
    """(place in values, item) of all values that the index has."""
    keys, owner, table = index
    some = np.flatnonzero(table[values & _U((1 << _BITS) - 1)])
    begin, end = np.searchsorted(keys, values[some], "left"), np.searchsorted(keys, values[some], "right")
    return [(int(some[j]), int(i)) for j in np.flatnonzero(end > begin) for i in owner[begin[j] : end[j]]]


def _candidates(block: Block, grams: np.ndarray, at: np.ndarray) -> set:
    """(document index, item index) pairs that agree in a minimum of some window. at: offsets of the documents."""
    salt, odd = _permutations(block.perms)
    counts = np.diff(at)
    live = np.flatnonzero(counts)
    views = []
    for u, index in block.parts.items():
        pieces = -(-counts[live] // u)
        doc = np.repeat(live, pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        follows = np.concatenate((doc[1:] == doc[:-1], [False]))
        views.append((at[doc] + nth * u, doc, follows, index))
    found = set()
    if not len(grams):
        return found
    for p in range(block.perms):
        value = (grams ^ salt[p]) * odd[p]
        for starts, doc, follows, index in views:
            low = np.minimum.reduceat(value, starts)
            low = np.where(follows, np.minimum(low, np.concatenate((low[1:], low[-1:]))), low)
            found.update((int(doc[j]), i) for j, i in _matches(low, index))
    return found


def _contained(block: Block, texts: pa.Array, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(document, item, shared, size) of the texts' documents."""
    words, at = common.word_hashes(texts)
    each = [words[at[i] : at[i + 1]] for i in range(len(texts))]
    views = {w: [block.grams(x, w) for x in each] for w in {block.k, *block.small}}
    wide = views[block.k]
    offsets = np.concatenate(([0], np.cumsum([len(g) for g in wide]))).astype(np.int64)
    found = _candidates(block, np.concatenate(wide), offsets)
    for w, index in block.small.items():
        owner = np.repeat(np.arange(len(each)), [len(g) for g in views[w]])
        found.update((int(owner[j]), i) for j, i in _matches(np.concatenate(views[w]), index))
    out = []
    for d, i in sorted(found):
        own = block.sets[i]
        shared = int(np.isin(own, views[block.widths[i]][d]).sum())
        if den * shared >= num * len(own):
            out.append((d, i, shared, len(own)))
    return out


def find_contained(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100, perms: int = 64, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, n_shared, n_item (long; the item's shingles in the document and in all) of all contained pairs.
    block_chars: characters of item texts in a block, about."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    blocks = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = f"id {docs.schema['id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, n_shared long, n_item long"
    out = None
    for b in range(blocks):
        held = spark.sparkContext.broadcast(Block(items.where(part == b).toArrow(), k, perms))

        def search(batches, held=held):
            block = held.value
            for batch in batches:
                for part in common.text_chunks(batch.column(1)):
                    rows = batch.slice(part.start, part.stop - part.start)
                    hits = _contained(block, rows.column(1), num, den) if block.sets else []
                    doc, item, shared, size = (pa.array(c, pa.int64()) for c in (zip(*hits, strict=True) if hits else ([],) * 4))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(doc), block.ids.take(item), shared, size], names=["id", "item", "n_shared", "n_item"])

        found = docs.mapInArrow(search, kinds)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("id", "item").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "m.n_shared", "m.n_item")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every benchmark item found in a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
item_grams AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) END) AS gram
  FROM item_words WHERE len(w) >= 1),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_grams GROUP BY item_id),
widths AS (SELECT DISTINCT least(len(w), 5) AS n FROM item_words WHERE len(w) >= 1),
grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i+n-1])) AS gram FROM words, widths WHERE len(w) >= n)
SELECT doc_id, g.item_id, count(*)::BIGINT AS n_shared, any_value(n_item)::BIGINT AS n_item, count(*) / any_value(n_item) AS containment
FROM grams JOIN item_grams g USING (gram) JOIN sizes s ON g.item_id = s.item_id
GROUP BY doc_id, g.item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
