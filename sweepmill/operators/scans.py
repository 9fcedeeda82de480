"""Scans over ordered rows of a key: running results of any associative operation, with no key gathered in a task.

Rows are sorted by range of key and order over all tasks. Each task scans what it has, in numpy, many keys to a batch. The
first run of a task may go on from the task before: one row a task says what comes before, and is combined with that run.
So a key may hold any share of the rows, and the number of Python calls grows with the rows, not with the keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash

#: From columns of the rows before and of the rows (equal at the start of a key) to n x width elements.
Element = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]
#: From two n x width arrays, the earlier rows first, to one.
Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def segmented(elements: np.ndarray, begin: np.ndarray, combine: Combine) -> np.ndarray:
    """Inclusive scan of runs: begin is the place of each row's run. By doubling, so log(n) calls of combine."""
    out, far, step = elements.copy(), np.arange(len(elements)) - begin, 1
    while step <= far.max(initial=0):
        late = np.flatnonzero(far >= step)
        out[late] = combine(out[late - step], out[late])
        step *= 2
    return out


def _codes(column) -> np.ndarray:
    """Whole numbers that are equal where the values are; null is a value."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def scan(df: DataFrame, by: list[str], order: list[str], values: list[str], element: Element, combine: Combine, names: list[str]) -> DataFrame:
    """by, order, values and the running result (names, double) of each row, in order within its key. values: columns of
    numbers that element reads. Rows that tie in `order` come in any order."""
    kept = list(dict.fromkeys([*by, *order, *values]))
    kinds = {c: df.schema[c].dataType.simpleString() for c in kept}
    width, state = len(names), [f"_s{i}" for i in range(len(names))]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "_task long, _place long, _head boolean", *(f"{s} double" for s in state)])

    def run(batches):
        last, task, place, head = None, TaskContext.get().partitionId(), 0, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            change = np.ones(n, dtype=bool)
            if n > 1:
                change[1:] = np.any([(c := _codes(b[k]))[1:] != c[:-1] for k in by], axis=0) if by else False
            key = tuple(b[k][0].as_py() for k in by)
            goes_on = last is not None and last[0] == key
            change[0] = not goes_on
            now = {v: b[v].to_numpy(zero_copy_only=False) for v in values}
            before = {v: np.concatenate((last[1][v] if goes_on else x[:1], x[:-1])) for v, x in now.items()}
            before = {v: np.where(change, now[v], x) for v, x in before.items()}
            elements = element(before, now)
            starts = np.where(change, np.arange(n), -1)
            begin = np.maximum.accumulate(starts)
            out = segmented(elements, np.maximum(begin, 0), combine)
            if goes_on:
                run_on = begin < 0
                if last[2] is not None:
                    out[run_on] = combine(np.broadcast_to(last[2], (int(run_on.sum()), width)), out[run_on])
            # The element of a task's first row waits: what it stands on may be in the task before.
            heads = np.zeros(n, dtype=bool)
            if head:
                first_run = begin == (0 if place == 0 else -1)
                heads = first_run
                if place == 0:
                    rest = np.flatnonzero(first_run)[1:]
                    out[rest] = segmented(elements[rest], np.zeros(len(rest), np.int64), combine)
                head = bool(first_run[-1])
            whole = None if head and place == 0 and n == 1 else out[-1]
            last = (tuple(b[k][n - 1].as_py() for k in by), {v: x[-1:] for v, x in now.items()}, whole)
            columns = [*[b[c] for c in kept], pa.array(np.full(n, task)), pa.array(np.arange(place, place + n)), pa.array(heads), *[pa.array(out[:, i]) for i in range(width)]]
            place += n
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "_task", "_place", "_head", *state])

    keys = [*by, *order]
    rows = stash(df.select(*kept).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "scan")
    ends = F.struct(*by, *values, "_head", *state, "_place")
    edges = rows.groupBy("_task").agg(F.min_by(ends, "_place").alias("first"), F.max_by(ends, "_place").alias("last")).orderBy("_task").collect()  # one row a task
    before, previous = [], None
    for task, first, last in edges:
        at = {v: np.array([first[v]]) for v in values}
        same = previous is not None and previous[0] == tuple(first[k] for k in by)
        offset = element(previous[1], at) if same else element(at, at)
        offset = combine(previous[2], offset) if same else offset
        own = np.array([[last[s] for s in state]], dtype=float)
        total = own if not last["_head"] else offset if last["_place"] == 0 else combine(offset, own)
        previous = (tuple(last[k] for k in by), {v: np.array([last[v]]) for v in values}, total)
        before.append((task, *map(float, offset[0])))

    def put_before(batches):
        for b in batches:
            own, offset = (np.stack([b[f"{p}{i}"].to_numpy(zero_copy_only=False) for i in range(width)], axis=1) for p in ("_s", "_o"))
            alone = b["_place"].to_numpy() == 0
            out = np.where(alone[:, None], offset, combine(offset, own)) if b.num_rows else own
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], *[pa.array(out[:, i]) for i in range(width)]], names=[*kept, *names])

    spark = df.sparkSession
    offsets = spark.createDataFrame(before, "_t long, " + ", ".join(f"_o{i} double" for i in range(width)))
    heads = rows.where("_head").join(F.broadcast(offsets), F.col("_task") == F.col("_t"))
    fixed = heads.mapInArrow(put_before, ", ".join([*(f"{c} {kinds[c]}" for c in kept), *(f"{n} double" for n in names)]))
    return rows.where("NOT _head").select(*kept, *[F.col(s).alias(n) for s, n in zip(state, names, strict=True)]).unionByName(fixed)
