"""Queries over point clouds: the first three components of `embeddings`, or `lineitem` scaled to a box."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import fusion, voxel
from ..session import scratch_root, table

# Fixed values of the example pose and camera.
POSE = ((0.9553, -0.2955, 0.0, 0.25), (0.2896, 0.9363, -0.1987, -0.1), (0.0587, 0.1898, 0.9801, 0.4))
CAMERA = g.Camera(fx=400.0, fy=410.0, cx=320.0, cy=240.0, width=640, height=480, k1=-0.12, k2=0.03, p1=0.001, p2=-0.0005, k3=0.002)
SQL_POINTS = "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate("xyz")])


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        "l_suppkey", F.col("l_quantity").alias("x"), (100.0 * F.col("l_discount")).alias("y"), (100.0 * F.col("l_tax")).alias("z"),
        F.col("l_linenumber").cast("long").alias("w"),
    )


SQL_BOX = "SELECT l_suppkey, l_quantity AS x, 100.0::DOUBLE * l_discount AS y, 100.0::DOUBLE * l_tax AS z, l_linenumber::BIGINT AS w FROM lineitem"


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def sql_cells(size: float) -> str:
    return ", ".join(f"floor({a} / {size})::BIGINT AS v{a}" for a in "xyz")


def voxel_centroid(spark, sf_dir):
    out = voxel.centroids(cloud(spark, sf_dir), 0.1)
    return out.select(*voxel.KEY, *[r6(F.col(a), a) for a in "xyz"], "n")


SQL_VOXEL_CENTROID = f"""
SELECT vx, vy, vz, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, count(*)::BIGINT AS n
FROM (SELECT *, {sql_cells(0.1)} FROM ({SQL_POINTS})) GROUP BY vx, vy, vz
"""


def voxel_weighted(spark, sf_dir):
    out = voxel.weighted(box(spark, sf_dir), 5.0)
    return out.select(*voxel.KEY, *[r6(F.col(a), a) for a in "xyz"], "w")


SQL_VOXEL_WEIGHTED = f"""
SELECT floor((x / 5.0::DOUBLE)::FLOAT)::BIGINT AS vx, floor((y / 5.0::DOUBLE)::FLOAT)::BIGINT AS vy, floor((z / 5.0::DOUBLE)::FLOAT)::BIGINT AS vz,
       round(sum(x * w) / sum(w), 6) + 0.0 AS x, round(sum(y * w) / sum(w), 6) + 0.0 AS y, round(sum(z * w) / sum(w), 6) + 0.0 AS z, sum(w)::BIGINT AS w
FROM ({SQL_BOX}) GROUP BY 1, 2, 3
"""


def voxel_two_phase(spark, sf_dir):
    """Partial sums by a part of the suppliers, merged afterwards: what fusion does batch by batch."""
    state = voxel.sums_by_cell(box(spark, sf_dir), 5.0, part=F.col("l_suppkey") % 8)
    return voxel.merge_sums(state).select(*voxel.KEY, *[r6(F.col(a), a) for a in "xyz"], "w")


def fusion_levels(spark, sf_dir):
    """The same map grown in ten batches, of a store that adds up four runs of a level."""
    store = fusion.FusionStore(spark, f"{scratch_root(spark)}/sweepmill-{uuid.uuid4().hex}/map", 5.0, fanout=4)
    points = box(spark, sf_dir)
    for b in range(10):
        store.add(str(b), points.where(F.col("l_suppkey") % 10 == b))
    return store.cloud().select(*voxel.KEY, *[r6(F.col(a), a) for a in "xyz"], "w")


def range_filter(spark, sf_dir):
    x, y, z = (F.col(a) for a in "xyz")
    kept = cloud(spark, sf_dir).where(g.in_range(x, y, z, 0.1, 0.3))
    return kept.select("vec_id", r6(g.norm(x, y, z), "range"))


SQL_RANGE = f"""
SELECT vec_id, round(sqrt(x * x + y * y + z * z), 6) + 0.0 AS range FROM ({SQL_POINTS})
WHERE sqrt(x * x + y * y + z * z) BETWEEN 0.1 AND 0.3
"""


def rigid_transform(spark, sf_dir):
    x, y, z = g.transform(F.col("x"), F.col("y"), F.col("z"), POSE)
    return cloud(spark, sf_dir).select("vec_id", r6(x, "x"), r6(y, "y"), r6(z, "z"))


def _sql_row(i: int) -> str:
    r = POSE[i]
    return f"({r[0]}::DOUBLE * x + {r[1]}::DOUBLE * y + {r[2]}::DOUBLE * z + {r[3]}::DOUBLE)"


SQL_TRANSFORM = f"""
SELECT vec_id, {", ".join(f"round({_sql_row(i)}, 6) + 0.0 AS {a}" for i, a in enumerate("xyz"))} FROM ({SQL_POINTS})
"""


def pinhole_project(spark, sf_dir):
    p = cloud(spark, sf_dir).withColumn("z", F.col("z") + 0.5)
    u, v, inside = g.project(F.col("x"), F.col("y"), F.col("z"), CAMERA)
    return p.where((F.col("z") > CAMERA.nearest) & inside).select("vec_id", r6(u, "u"), r6(v, "v"), r6(F.col("z"), "depth"))


_C = CAMERA
SQL_UV = f"""
SELECT vec_id, z AS depth,
  {_C.fx}::DOUBLE * (a * s + 2.0::DOUBLE * {_C.p1}::DOUBLE * a * b + {_C.p2}::DOUBLE * (r2 + 2.0::DOUBLE * a * a)) + {_C.cx}::DOUBLE AS u,
  {_C.fy}::DOUBLE * (b * s + {_C.p1}::DOUBLE * (r2 + 2.0::DOUBLE * b * b) + 2.0::DOUBLE * {_C.p2}::DOUBLE * a * b) + {_C.cy}::DOUBLE AS v
FROM (SELECT *, 1.0::DOUBLE + {_C.k1}::DOUBLE * r2 + {_C.k2}::DOUBLE * r2 * r2 + {_C.k3}::DOUBLE * r2 * r2 * r2 AS s
  FROM (SELECT *, a * a + b * b AS r2 FROM (SELECT vec_id, z, x / z AS a, y / z AS b
    FROM (SELECT vec_id, x, y, z + 0.5::DOUBLE AS z FROM ({SQL_POINTS})) WHERE z > 0.15)))
"""
SQL_SEEN = f"SELECT * FROM ({SQL_UV}) WHERE u >= 1 AND u < {_C.width - 2} AND v >= 1 AND v < {_C.height - 2}"
SQL_PROJECT = f"SELECT vec_id, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(depth, 6) + 0.0 AS depth FROM ({SQL_SEEN})"


def depth_colour(spark, sf_dir):
    r = F.col("r") * 400.0
    p = cloud(spark, sf_dir).select("vec_id", g.norm(F.col("x"), F.col("y"), F.col("z")).alias("r"))
    return p.select("vec_id", *[F.round(c, 3).alias(n) for c, n in zip(g.depth_colour(r), ("red", "green", "blue"), strict=True)])


def sql_colour(points: str, r: str, keep: str, digits: int = 3) -> str:
    return f"""
SELECT {keep},
  round(255.0 * CASE s WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE 1.0::DOUBLE END, {digits}) AS red,
  round(255.0 * CASE s WHEN 0 THEN t WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN q ELSE p END, {digits}) AS green,
  round(255.0 * CASE s WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN 1.0::DOUBLE WHEN 4 THEN 1.0::DOUBLE ELSE q END, {digits}) AS blue
FROM (SELECT *, 1.0::DOUBLE - 0.92::DOUBLE AS p, 1.0::DOUBLE - 0.92::DOUBLE * (h - s) AS q, 1.0::DOUBLE - 0.92::DOUBLE * (1.0::DOUBLE - (h - s)) AS t
  FROM (SELECT *, least(5, floor(h)::INT) AS s
    FROM (SELECT *, (1.0::DOUBLE - floor(pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({r}) / 180.0::DOUBLE)), 0.62::DOUBLE) * 255 + 0.5::DOUBLE) / 255.0::DOUBLE) * 0.72::DOUBLE * 6.0::DOUBLE AS h
      FROM ({points}))))
"""


SQL_COLOUR = sql_colour(f"SELECT vec_id, sqrt(x * x + y * y + z * z) * 400.0::DOUBLE AS r FROM ({SQL_POINTS})", "r", "vec_id")


def fused_colour_map(spark, sf_dir):
    """Filter by range, move to the world, colour by depth, fuse to weighted voxels: the product map in one plan."""
    x, y, z = (F.col(a) for a in "xyz")
    near = box(spark, sf_dir).where(g.in_range(x, y, z, 0.8, 60.0))
    red, green, blue = g.depth_colour(g.norm(x, y, z))
    wx, wy, wz = g.transform(x, y, z, POSE)
    world = near.select(wx.alias("x"), wy.alias("y"), wz.alias("z"), red.alias("red"), green.alias("green"), blue.alias("blue"), "w")
    fused = voxel.weighted(world, 4.0, values=("x", "y", "z", "red", "green", "blue"))
    return fused.select(*voxel.KEY, *[F.round(c, 4).alias(c) for c in ("x", "y", "z", "red", "green", "blue")], "w")


_COLOURED = sql_colour(f"SELECT *, sqrt(x * x + y * y + z * z) AS r FROM ({SQL_BOX}) WHERE sqrt(x * x + y * y + z * z) BETWEEN 0.8 AND 60.0", "r", "x, y, z, w", 9)
SQL_FUSED = f"""
SELECT floor((x / 4.0::DOUBLE)::FLOAT)::BIGINT AS vx, floor((y / 4.0::DOUBLE)::FLOAT)::BIGINT AS vy, floor((z / 4.0::DOUBLE)::FLOAT)::BIGINT AS vz,
  {", ".join(f"round(sum({c} * w) / sum(w), 4) + 0.0 AS {c}" for c in ("x", "y", "z", "red", "green", "blue"))}, sum(w)::BIGINT AS w
FROM (SELECT {", ".join(f"{_sql_row(i)} AS {a}" for i, a in enumerate("xyz"))}, red, green, blue, w FROM ({_COLOURED})) GROUP BY 1, 2, 3
"""

# Symmetric 3x3 covariances of cells and, for SQL, their eigenvalues in closed form.
SQL_MOMENTS = f"""
SELECT vx, vy, vz, count(*)::BIGINT AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz,
  covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz
FROM (SELECT *, {sql_cells(0.2)} FROM ({SQL_POINTS})) GROUP BY vx, vy, vz HAVING count(*) >= 8
"""
SQL_EIGEN = f"""
SELECT *, q + 2 * p * cos(phi) AS e2, q + 2 * p * cos(phi + 2 * pi() / 3) AS e0, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)) AS e1
FROM (SELECT *, acos(greatest(-1.0, least(1.0, det / (2 * p * p * p)))) / 3 AS phi
  FROM (SELECT *, (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz) AS det
    FROM (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p
      FROM (SELECT *, (xx + yy + zz) / 3 AS q FROM ({SQL_MOMENTS})))))
"""


def plane_moments(spark, sf_dir):
    m = voxel.moments(cloud(spark, sf_dir), 0.2)
    return m.select(*voxel.KEY, "n", *[F.round(c, 8).alias(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")])


SQL_PLANE_MOMENTS = f"SELECT vx, vy, vz, n, {', '.join(f'round({c}, 8) + 0.0 AS {c}' for c in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM ({SQL_MOMENTS})"


def plane_fit(spark, sf_dir):
    fit = voxel.planes(cloud(spark, sf_dir), 0.2, threshold=0.005, flatness=0.6)
    return fit.select(*voxel.KEY, "n", *[F.round(c, 8).alias(c) for c in ("e0", "e1", "e2")], F.round("radius", 6).alias("radius"), "valid")


SQL_PLANE_FIT = f"""
SELECT vx, vy, vz, n, round(e0, 8) + 0.0 AS e0, round(e1, 8) + 0.0 AS e1, round(e2, 8) + 0.0 AS e2, round(sqrt(greatest(e2, 1e-9)), 6) AS radius,
       e0 <= 0.005 AND e0 / greatest(e2, 1e-9) <= 0.6 AS valid FROM ({SQL_EIGEN})
"""

QUERIES = {
    "fused_colour_map": fused_colour_map, "voxel_centroid": voxel_centroid, "voxel_weighted": voxel_weighted, "voxel_two_phase": voxel_two_phase, "fusion_levels": fusion_levels,
    "range_filter": range_filter, "rigid_transform": rigid_transform, "pinhole_project": pinhole_project, "depth_colour": depth_colour,
    "plane_moments": plane_moments, "plane_fit": plane_fit,
}
ORACLE_SQL = {
    "fused_colour_map": SQL_FUSED, "voxel_centroid": SQL_VOXEL_CENTROID, "voxel_weighted": SQL_VOXEL_WEIGHTED, "voxel_two_phase": SQL_VOXEL_WEIGHTED, "fusion_levels": SQL_VOXEL_WEIGHTED,
    "range_filter": SQL_RANGE, "rigid_transform": SQL_TRANSFORM, "pinhole_project": SQL_PROJECT, "depth_colour": SQL_COLOUR,
    "plane_moments": SQL_PLANE_MOMENTS, "plane_fit": SQL_PLANE_FIT,
}
