"""Ordered work on keys that may hold any share of the rows: each key's line is cut into pieces of a fixed width.

Windows run inside a piece. What a piece means for the others is one row - its size, its ends, the runs at its edges - and
windows over these rows, one a piece, say what comes before and after. Rows of a key must come in order of a number, the
first column of `order`, whose values decide the piece; the other columns settle ties. A piece is as large as the rows
within `width` of that number, so `width` bounds what a task sorts at once. Keys and numbers may be null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Key and piece in one column, which is never null: rows, windows and joins all meet on it.
AT = "_at"


def cut(df: DataFrame, by: list[str], order: list[str], width: int) -> DataFrame:
    return df.withColumn(AT, F.struct(*by, F.floor(F.col(order[0]) / width).alias("_piece")))


def inside(order: list[str]) -> WindowSpec:
    """The rows of a piece in order."""
    return Window.partitionBy(AT).orderBy(*order)


def line(by: list[str]) -> WindowSpec:
    """The pieces of a key in order."""
    return Window.partitionBy(*[F.col(f"{AT}.{k}") for k in by]).orderBy(F.col(f"{AT}._piece"))


def before(by: list[str]) -> WindowSpec:
    return line(by).rowsBetween(Window.unboundedPreceding, -1)


def whole(by: list[str]) -> WindowSpec:
    return line(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def keys(by: list[str]) -> list[Column]:
    return [F.col(f"{AT}.{k}").alias(k) for k in by]


def told(rows: DataFrame, summaries: DataFrame, **columns: Column) -> DataFrame:
    """rows of pieces with columns, which are windows over the summaries of pieces."""
    return rows.join(summaries.select(F.col(AT).alias("_told"), *[c.alias(n) for n, c in columns.items()]), F.col(AT) == F.col("_told")).drop("_told")


def placed(df: DataFrame, by: list[str], order: list[str], width: int) -> DataFrame:
    """df with _i, a row's place in its key from 0, _n, the rows of its key, and the key and piece."""
    rows = cut(df, by, order, width)
    sizes = rows.groupBy(AT).agg(F.count("*").alias("_c"))
    shifted = told(rows.withColumn("_i", F.row_number().over(inside(order)) - 1), sizes, _shift=F.coalesce(F.sum("_c").over(before(by)), F.lit(0)), _n=F.sum("_c").over(whole(by)))
    return shifted.withColumn("_i", (F.col("_i") + F.col("_shift")).cast("long")).drop("_shift")


def lagged(df: DataFrame, by: list[str], order: list[str], width: int, columns: dict[str, str | Column]) -> DataFrame:
    """df with the values that columns (name: column) have in the row before of the same key; null in the first one."""
    rows = cut(df.withColumn("_own", F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])), by, order, width)
    ends = rows.groupBy(AT).agg(F.max_by("_own", F.struct(*order)).alias("_end"))
    met = told(rows.withColumn("_last", F.lag("_own").over(inside(order))), ends, _end=F.lag("_end").over(line(by)))
    last = F.coalesce("_last", "_end")
    return met.select(*df.columns, *[last[n].alias(n) for n in columns])


def edge_runs(df: DataFrame, by: list[str], order: list[str], width: int, flag: Column, run: Callable[[], list[Column]]) -> DataFrame:
    """One row for each run of rows with the flag, and each row without it, of a piece: the piece, _run (0 for a run that
    begins the piece, which may go on from the one before) and the aggregates `run` of its flagged rows."""
    marked = cut(df, by, order, width).withColumn("_flag", F.coalesce(flag, F.lit(False)))
    runs = marked.withColumn("_run", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(inside(order).rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(AT, "_run").agg(F.count_if("_flag").alias("_n"), *run())


def joined_runs(pieces: DataFrame, by: list[str], full: Column, own: Column, combine: Callable[[Column], Column]) -> DataFrame:
    """pieces with _open, what the run that ends a piece amounts to with the pieces it began in, and _entering, that of the piece
    before. full: whether a run fills the piece; own: the piece's part of the run that ends it."""
    grouped = pieces.withColumn("_group", F.sum(F.when(full, 0).otherwise(1)).over(line(by).rowsBetween(Window.unboundedPreceding, 0)))
    # A group is a piece that a run does not fill and the full ones after it.
    together = Window.partitionBy(*[F.col(f"{AT}.{k}") for k in by], "_group").orderBy(F.col(f"{AT}._piece")).rowsBetween(Window.unboundedPreceding, 0)
    opened = grouped.withColumn("_open", combine(own).over(together))
    return opened.withColumn("_entering", F.lag("_open").over(line(by)))
