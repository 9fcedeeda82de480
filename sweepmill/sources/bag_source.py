"""SQLite bags as a Spark data source: `spark.read.format("bag")` after `register(spark)`.

A file is read where it lies, through SQLite's own pages, by one task for each range of its message ids (about
`split_bytes` of the file), in batches of bounded size; no file is ever held whole. Filters on stamp, id, topic and file
reach the files: those that cannot hold a wanted message are not planned, and the others look only at the range asked
for. Columns that a query does not need are dropped by Spark after the scan, except payloads: with `payload` false these
are not read.

Options: path (a folder or one bag; folders are searched one level deep, as other bag readers do), kind and preferred (one
topic of each bag: that of the preferred name, else the last whose type contains `kind`; without kind all topics), split_bytes,
payload. SQLite needs random access, so bags must lie in a folder that the operating system of every machine shows
(local on one machine, mounted on a cluster); `bags.messages` reads other stores, file by file."""

from __future__ import annotations

import os
import re
import sqlite3
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

SCHEMA = "file string, id long, stamp long, topic string, data binary"
ARROW = pa.schema([("file", pa.string()), ("id", pa.int64()), ("stamp", pa.int64()), ("topic", pa.string()), ("data", pa.binary())])
SPLIT_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 4 << 20, 4096
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PER_FILE = 1_000_000
#: Columns of the source, as SQLite knows them.
COLUMNS = {"id": "id", "stamp": "timestamp"}
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Range(InputPartition):
    """Messages of one file: SQLite's condition and its values."""

    def __init__(self, file: str, topics: tuple[tuple[int, str], ...], where: str, values: tuple):
        super().__init__(None)
        self.file, self.topics, self.where, self.values = file, topics, where, values


def local_path(path: str) -> str | None:
    """A path of the operating system, or None for another store."""
    found = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):(//[^/]*)?", path)
    if not found:
        return path
    return path[found.end() :] if found[1] == "file" else None


def natural(name: str) -> tuple:
    """Files that end in a number by the number, then those without one, ties by name."""
    stem = re.search(r"(\d+)\.[^./]*$", name)
    return (stem is None, int(stem[1]) if stem else 0, name)


def listed(path: str) -> list[str]:
    place = Path(path)
    found = [place] if place.is_file() else place.glob("*.db3")
    return [str(p) for p in sorted(found, key=lambda p: natural(p.name))]


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(file).absolute().as_uri()}?mode=ro&immutable=1", uri=True)


class BagReader(DataSourceReader):
    def __init__(self, options: dict):
        path = local_path(options["path"])
        if path is None:
            raise ValueError(f"bags are read where the operating system shows them: {options['path']}")
        self.path, self.kind, self.preferred = path, options.get("kind"), options.get("preferred")
        self.split, self.payload = int(options.get("split_bytes", SPLIT_BYTES)), options.get("payload", "true").lower() != "false"
        self.conditions: list[tuple[str, object]] = []
        self.topics: list[set] = []
        self.files: list[set] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if isinstance(f, IsNotNull) and column in ("id", "stamp", "topic", "file"):
                continue  # none of these is ever null
            if column in COLUMNS and type(f) in COMPARISONS and isinstance(f.value, int):
                self.conditions.append((f"{COLUMNS[column]} {COMPARISONS[type(f)]} ?", f.value))
            elif column == "topic" and wanted is not None:
                self.topics.append(wanted)
            elif column == "file" and wanted is not None:
                self.files.append(wanted)
            else:
                yield f

    def _wanted(self, base: sqlite3.Connection) -> tuple[tuple[int, str], ...]:
        known = base.execute("SELECT id, name, type FROM topics ORDER BY id").fetchall()
        if self.kind is not None:
            fits = [(i, n) for i, n, t in known if self.kind in t]
            known = ([x for x in fits if x[1] == self.preferred] or fits)[-1:]
        return tuple((x[0], x[1]) for x in known if all(x[1] in some for some in self.topics))

    def partitions(self):
        out = []
        for file in listed(self.path):
            if not all(shown(file) in some for some in self.files):
                continue
            with opened(file) as base:
                topics = self._wanted(base)
                low, high = base.execute("SELECT min(id), max(id) FROM messages").fetchone()
                times = base.execute("SELECT min(timestamp), max(timestamp) FROM messages").fetchone()
            if not topics or low is None or not self._can_hold({"id": (low, high), "timestamp": times}):
                continue
            where = "".join(f" AND {c}" for c, _ in self.conditions)
            values = tuple(v for _, v in self.conditions)
            parts = max(1, min(high - low + 1, -(-os.path.getsize(file) // self.split)))
            edges = [low + (high - low + 1) * k // parts for k in range(parts + 1)]
            out += [Range(file, topics, f"id >= ? AND id < ?{where}", (a, b, *values)) for a, b in zip(edges, edges[1:], strict=False) if self._can_hold({"id": (a, b - 1)})]
        return out

    def _can_hold(self, bounds: dict) -> bool:
        for condition, value in self.conditions:
            column, sign, _ = condition.split()
            if column in bounds:
                low, high = bounds[column]
                if sign == "=" and not low <= value <= high or sign == ">" and high <= value or sign == ">=" and high < value or sign == "<" and low >= value or sign == "<=" and low > value:
                    return False
        return True

    def read(self, partition: Range | None):
        if partition is None:  # what Spark asks for where there are no partitions
            return
        names = dict(partition.topics)
        marks = ", ".join("?" * len(names))
        data = "data" if self.payload else "NULL"
        with opened(partition.file) as base:
            cursor = base.execute(f"SELECT id, timestamp, topic_id, {data} FROM messages WHERE {partition.where} AND topic_id IN ({marks}) ORDER BY timestamp, id", (*partition.values, *names))
            rows, size = [], 0
            for row in cursor:
                rows.append(row)
                size += sys.getsizeof(row[3])
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield batch(partition.file, names, rows)
                    rows, size = [], 0
            if rows:
                yield batch(partition.file, names, rows)


def shown(file: str) -> str:
    """A file's name as Spark's own sources show it."""
    return f"file:{Path(file).absolute()}"


def batch(file: str, names: dict, rows: list) -> pa.RecordBatch:
    ids, stamps, topics, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([shown(file)] * len(rows)), pa.array(ids, pa.int64()), pa.array(stamps, pa.int64()), pa.array([names[t] for t in topics]), pa.array(data, pa.binary())], schema=ARROW)


class BagSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BagReader:
        return BagReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters through to it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(BagSource)


def load(spark: SparkSession, path: str, kind: str | None = None, preferred: str | None = None, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """file, id, stamp, topic, data of the bags at path."""
    register(spark)
    options = {k: v for k, v in (("path", path), ("kind", kind), ("preferred", preferred)) if v is not None}
    return spark.read.format("bag").options(split_bytes=str(split_bytes), payload=str(payload), **options).load()


def write(rows: DataFrame, path: str, kinds: dict[str, str], files: int = 4, encode=None, per_file: int = PER_FILE) -> None:
    """Bags of rows (stamp, topic, data), one for each range of stamps, named by their number: `files` of them, or as many as keep
    about `per_file` messages in each. kinds: type of each topic. encode: makes such rows of `rows` (with a stamp and anything
    else), as for mapInArrow, in the task that writes them, so that payloads are neither sorted nor shuffled. A file is
    written beside its place and renamed, so a task that is run again leaves one whole file."""
    folder = local_path(path)
    if folder is None:
        raise ValueError(f"bags are written where the operating system shows them: {path}")
    topics = {name: i for i, name in enumerate(sorted(kinds), 1)}

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(folder, exist_ok=True)
        done, beside = os.path.join(folder, f"bag_{task.partitionId()}.db3"), os.path.join(folder, f".bag_{task.partitionId()}_{task.taskAttemptId()}")
        base, n = sqlite3.connect(beside), 0
        base.executescript("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT); CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB); CREATE INDEX timestamp_idx ON messages (timestamp)")
        base.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(i, name, kinds[name]) for name, i in topics.items()])
        for b in batches if encode is None else encode(batches):
            columns = (b[c].to_pylist() for c in ("stamp", "topic", "data"))
            base.executemany("INSERT INTO messages (topic_id, timestamp, data) VALUES (?, ?, ?)", ((topics[t], s, d) for s, t, d in zip(*columns, strict=True)))
            n += b.num_rows
        base.commit()
        base.close()
        os.replace(beside, done)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows = rows.select("stamp", "topic", "data") if encode is None else rows
    # A task sorts and writes one file, so files grow in number, as those of a recorder do.
    files = max(files, -(-rows.count() // per_file))
    dealt = rows.repartitionByRange(files, "stamp").sortWithinPartitions("stamp")
    dealt.mapInArrow(run, "n long").agg({"n": "sum"}).collect()
