"""Voxel grids as grouped aggregates; nothing here leaves the JVM but the batched eigen-decomposition of cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions import geometry as g

KEY = ("vx", "vy", "vz")
AXES = ("x", "y", "z")


def with_cells(points: DataFrame, size: float, single: bool = False) -> DataFrame:
    rest = [c for c in points.columns if c not in KEY]
    return points.select(*rest, *[g.cell(F.col(a), size, single).alias(k) for a, k in zip(AXES, KEY, strict=True)])


def centroids(points: DataFrame, size: float, limit: float = 1e7, by: list[str] | None = None) -> DataFrame:
    """(by,) vx, vy, vz, x, y, z (means), n. Points that are not finite or beyond limit go."""
    ok = g.finite(*[F.col(a) for a in AXES])
    for a in AXES:
        ok = ok & (F.abs(F.col(a)) <= limit)
    return with_cells(points.where(ok), size).groupBy(*(by or []), *KEY).agg(*[F.avg(a).alias(a) for a in AXES], F.count("*").alias("n"))


def weighted(points: DataFrame, size: float, values=AXES, weight: str = "w") -> DataFrame:
    """One point for each voxel: means of `values` weighted by `weight`, and the sum of the weights. Cells are cut in
    single precision. The result is such a table again, so parts can be reduced in any order and then once more."""
    w = F.col(weight)
    sums = [(F.sum(F.col(v) * w) / F.sum(w)).alias(v) for v in values]
    return with_cells(points, size, single=True).groupBy(*KEY).agg(*sums, F.sum(w).alias(weight))


def sums_by_cell(points: DataFrame, size: float, values=AXES, weight: str = "w", part=None) -> DataFrame:
    """Weighted sums s_<value> and the weight for each voxel (and part): the mergeable state of `weighted`."""
    keyed = with_cells(points, size, single=True)
    keys = list(KEY) if part is None else [*KEY, part.alias("part")]
    return keyed.groupBy(*keys).agg(*[F.sum(F.col(v) * F.col(weight)).alias(f"s_{v}") for v in values], F.sum(weight).alias(weight))


def merge_sums(state: DataFrame, values=AXES, weight: str = "w") -> DataFrame:
    return state.groupBy(*KEY).agg(*[(F.sum(f"s_{v}") / F.sum(weight)).alias(v) for v in values], F.sum(weight).alias(weight))


def moments(points: DataFrame, size: float, least: int = 8, by: list[str] | None = None) -> DataFrame:
    """(by,) centre (x, y, z), population covariance (xx .. zz) and n of cells with enough points."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    cov = [F.covar_pop(a, b).alias(a + b) for a, b in pairs]
    return with_cells(points, size).groupBy(*(by or []), *KEY).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in AXES], *cov).where(F.col("n") >= least)


_EIGEN = StructType().add("values", ArrayType(DoubleType())).add("normal", ArrayType(DoubleType()))


@F.pandas_udf(_EIGEN)
def eigen(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).astype(float).reshape(-1, 3, 3)
    values, vectors = np.linalg.eigh(m) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
    return pd.DataFrame({"values": list(values), "normal": list(vectors[:, :, 0])})


def planes(points: DataFrame, size: float, threshold: float = 0.0025, flatness: float = 0.08, least: int = 8, sample: bool = False, by: list[str] | None = None) -> DataFrame:
    """Fitted planes of cells (of each key `by`): centre, eigenvalues e0 <= e1 <= e2, normal (nx, ny, nz), radius, variance, valid.
    sample: divide covariances by n - 1 instead of n."""
    m = moments(points, size, least, by)
    scale = F.col("n") / (F.col("n") - 1) if sample else F.lit(1.0)
    cov = [F.col(c) * scale for c in ("xx", "xy", "xz", "yy", "yz", "zz")]
    fit = m.withColumn("_e", eigen(*cov))
    e = [F.element_at("_e.values", i + 1) for i in range(3)]
    largest = F.greatest(e[2], F.lit(1e-9))
    return fit.select(
        *(by or []), *KEY, "n", *AXES, *[v.alias(f"e{i}") for i, v in enumerate(e)], *[F.element_at("_e.normal", i + 1).alias(f"n{a}") for i, a in enumerate(AXES)],
        F.sqrt(largest).alias("radius"), F.greatest(F.lit(1e-6), e[0]).alias("variance"), ((e[0] <= threshold) & (e[0] / largest <= flatness)).alias("valid"),
    )
