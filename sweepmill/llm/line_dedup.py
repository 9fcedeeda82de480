"""Line deduplication over levelled sorted runs (DataFrame functions only).

A run holds line keys with how many documents of its batch hold them and the largest of their ids. It is a Parquet
table bucketed by the key's 128-bit hash and sorted inside each bucket, so a batch merges with it bucket by bucket while
the run stays where it is. A new batch is anti-joined with the runs by merging: keys that no run holds make the batch's own run, at
level 0; keys that one holds add a row to the list of repeats. When a level has `fanout` runs they are compacted into
one run of the next level, so a key is rewritten only a logarithmic number of times and any number of batches leaves few
runs to merge. No key stands in two runs, so a key's count is that of its run and its repeats.

The runs live in one folder with a small table that lists them, from which LineRuns.open goes on later.

Defined results: a null or empty text is one empty line; a null id never counts as a holder and never loses lines;
rows that repeat an id count as one document; extra columns pass through untouched whatever their names, but for those
named like a result column, which the result replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_H1, _H2 = "_line_h1", "_line_h2"


def line_key(line):
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return common.ascii_lower(F.btrim(line, F.lit(common.ASCII_SPACE)))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """_line_doc, _line_text (a hash of the row's text), _line_pos (from 0) and hashes of each line with a key of min_chars
    or more. The text itself is not carried on."""
    placed = F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    long = F.filter(placed, lambda x: F.length(x["line"]) >= min_chars)
    long = F.filter(long, lambda x: F.length(F.btrim(x["line"], F.lit(common.ASCII_SPACE))) >= min_chars)
    keys = F.transform(F.transform(long, lambda x: F.struct(x["pos"], line_key(x["line"]).alias("key"))), lambda x: F.struct(
        x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("second"), x["key"]).alias("h2")))
    # The text is hashed below the explode: beside it, Spark would carry and hash the whole text for every line.
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_line_doc"), F.xxhash64(text_col).alias("_line_text"), keys.alias("_keys"))
    rows = rows.select("_line_doc", "_line_text", F.explode("_keys").alias("_k"))
    return rows.select("_line_doc", "_line_text", F.col("_k.pos").alias("_line_pos"), F.col("_k.h1").alias(_H1), F.col("_k.h2").alias(_H2))


class LineRuns:
    """The ledger, in a folder of its own under `path`. min_chars: shorter keys are never entered. fanout: runs of a level
    that are compacted. buckets: of each run; for a large corpus about one for each 256 MB of the largest run."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 40, fanout: int = 4, buckets: int | None = None):
        self.spark, self.min_chars, self.fanout = spark, min_chars, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or f"{common.scratch_root(spark)}/sweepmill-{uuid.uuid4().hex}/lines"
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []
        self.kind = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, fanout: int = 4) -> LineRuns:
        """The ledger that `save` left at path."""
        listed = spark.read.parquet(f"{path}/listed").orderBy("version", ascending=False).first()
        runs = cls(spark, path, listed["min_chars"], fanout, listed["buckets"])
        runs.kind, runs.repeats, runs.levels = listed["kind"], list(listed["repeats"]), [list(level) for level in listed["levels"]]
        return runs

    def save(self) -> None:
        """List the runs, for `open`. The lists of earlier calls stay; the last one holds."""
        kinds = "version timestamp, min_chars int, buckets int, kind string, repeats array<string>, levels array<array<string>>"
        row = self.spark.createDataFrame([(None, self.min_chars, self.buckets, self.kind, self.repeats, self.levels)], kinds)
        row.withColumn("version", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/listed")

    def _table(self, name: str) -> DataFrame:
        """A run, which Spark knows to be bucketed and sorted once the session's catalog has it."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({_H1} BIGINT, {_H2} BIGINT, n_docs BIGINT, last_doc {self.kind}) USING parquet "
                f"CLUSTERED BY ({_H1}, {_H2}) SORTED BY ({_H1}, {_H2}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(name)

    def _written(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select(_H1, _H2, "n_docs", "last_doc").repartition(self.buckets, _H1, _H2)
        with common.settings(self.spark, common.STASHING):
            dealt.write.bucketBy(self.buckets, _H1, _H2).sortBy(_H1, _H2).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            common.delete(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys that no run holds: a merge-anti-join with each run in turn."""
        for name in self.runs():
            keys = keys.join(self._table(name).select(_H1, _H2).hint("merge"), [_H1, _H2], "left_anti")
        return keys

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add a batch's run, then compact whatever level is full. Batches must not share ids."""
        self.add_occurrences(occurrences(docs, self.min_chars, id_col, text_col))

    def add_occurrences(self, found: DataFrame) -> None:
        """The same for a batch whose occurrences are at hand."""
        self.kind = self.kind or found.schema["_line_doc"].dataType.simpleString()
        held = found.select(_H1, _H2, "_line_doc").distinct()
        keys = common.stash(held.groupBy(_H1, _H2).agg(F.count("*").alias("n_docs"), F.max("_line_doc").alias("last_doc")), "batch")
        if not self.runs():
            self.levels[0].append(self._written(keys))
        else:
            fresh = self._written(self.unseen(keys))
            known = keys.join(self._table(fresh).select(_H1, _H2).hint("merge"), [_H1, _H2], "left_anti")
            self.repeats.append(self._written(known))
            self.levels[0].append(fresh)
        common.unstash(keys)
        self._compact()

    def _compact(self) -> None:
        for depth, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                merged = self._written(self._union(names))
                self.drop(*names)
                self.levels[depth] = []
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(merged)

    def _union(self, names: list[str]) -> DataFrame:
        schema = f"{_H1} long, {_H2} long, n_docs long, last_doc {self.kind}"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}" for name in names])

    def ledger(self, min_docs: int = 1) -> DataFrame:
        """Hashes, n_docs and last_doc of the keys that at least min_docs documents hold."""
        rows = self._union(self.runs())
        if self.repeats:
            again = self._union(self.repeats)
            # Only keys that repeat, or are frequent in one run, can be frequent.
            if min_docs > 1:
                asked = again.select(_H1, _H2).distinct()
                rows = rows.where(F.col("n_docs") >= min_docs).unionByName(rows.where(F.col("n_docs") < min_docs).join(asked, [_H1, _H2], "left_semi"))
            rows = rows.unionByName(again)
        return rows.groupBy(_H1, _H2).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")).where(F.col("n_docs") >= min_docs)

    def clear(self) -> None:
        self.drop(*self.runs(), *self.repeats)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines removed that at least min_docs documents hold, except in the largest id holding them;
    adds n_lines, n_dropped (long). The documents enter the ledger in `batches` batches of whole documents."""
    docs = common.without(docs, "n_lines", "n_dropped")
    runs = LineRuns(docs.sparkSession, min_chars=min_chars, fanout=fanout)
    found = common.stash(occurrences(docs, min_chars, id_col, text_col), "occurrences")
    part = F.pmod(F.xxhash64("_line_doc", F.lit("batch")), F.lit(batches))
    try:
        for b in range(batches):
            runs.add_occurrences(found.where(part == b))
        frequent = common.stash(runs.ledger(min_docs).select(_H1, _H2, "last_doc"), "frequent")
    finally:
        runs.clear()
    # The places of lines that the runs hold for a larger id, by row.
    lost = (
        found.join(frequent, [_H1, _H2]).where(F.col("_line_doc") < F.col("last_doc"))
        .groupBy("_line_doc", "_line_text").agg(F.array_sort(F.collect_set("_line_pos")).alias("_line_lost"))
    )
    lost = common.stash(lost, "lost")
    common.unstash(found, frequent)
    names = {c: f"_column{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    text = F.col(names[text_col])
    joined = plain.join(lost, (F.col(names[id_col]) == F.col("_line_doc")) & (F.xxhash64(text) == F.col("_line_text")), "left")
    # Each run of lines between two lost ones is sliced out whole, so the work follows the lines.
    lines = joined.withColumn("_lines", _lines(text))
    begins = F.concat(F.array(F.lit(0)), F.transform("_line_lost", lambda x: x + 1))
    ends = F.concat(F.col("_line_lost"), F.array(F.size("_lines")))
    spans = F.arrays_zip(begins.alias("b"), ends.alias("e"))
    kept = F.flatten(F.transform(spans, lambda s: F.slice(F.col("_lines"), s["b"] + 1, s["e"] - s["b"])))
    kept = F.when(F.col("_line_lost").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return lines.select(
        *[(kept if c == text_col else F.col(n)).alias(c) for c, n in names.items()],
        F.size("_lines").cast("long").alias("n_lines"), F.when(F.col("_line_lost").isNull(), 0).otherwise(F.size("_line_lost")).cast("long").alias("n_dropped"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < f.last_doc, FALSE) AS lost
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
