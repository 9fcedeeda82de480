"""Queries over neighbourhoods of the cloud of `embeddings`: outliers, planes, normals, registration, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, neighbours, registration, series, voxel
from ..session import table
from .clouds import SQL_POINTS, cloud, r6, sql_cells

AXES = ("x", "y", "z")
SIZE = 0.2
SQL_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def points(spark, sf_dir) -> DataFrame:
    return cloud(spark, sf_dir).withColumnRenamed("vec_id", "id")


def sql_fit(moments: str) -> str:
    """Eigenvalues e0 <= e1 <= e2 and the unit vector u of e0 of the covariances xx .. zz of a query's rows."""
    rows = "SELECT *, xx - e0 AS ax, yy - e0 AS by_, zz - e0 AS cz_ FROM eig"
    crosses = (
        ("xy * yz - xz * by_", "xz * xy - ax * yz", "ax * by_ - xy * xy"),
        ("xy * cz_ - xz * yz", "xz * xz - ax * cz_", "ax * yz - xy * xz"),
        ("by_ * cz_ - yz * yz", "yz * xz - xy * cz_", "xy * yz - by_ * xz"),
    )
    parts = ", ".join(f"{e} AS {a}{i}" for i, c in enumerate(crosses) for a, e in zip("pqr", c, strict=True))
    norms = ", ".join(f"p{i} * p{i} + q{i} * q{i} + r{i} * r{i} AS s{i}" for i in range(3))
    pick = ", ".join(f"CASE WHEN s0 >= s1 AND s0 >= s2 THEN {a}0 / sqrt(s0) WHEN s1 >= s2 THEN {a}1 / sqrt(s1) ELSE {a}2 / sqrt(s2) END AS u{b}" for a, b in zip("pqr", AXES, strict=True))
    return f"""
WITH m AS ({moments}),
mean AS (SELECT *, (xx + yy + zz) / 3 AS _q FROM m),
spread AS (SELECT *, sqrt(((xx - _q) ** 2 + (yy - _q) ** 2 + (zz - _q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS _p FROM mean),
deter AS (SELECT *, (xx - _q) * ((yy - _q) * (zz - _q) - yz * yz) - xy * (xy * (zz - _q) - yz * xz) + xz * (xy * yz - (yy - _q) * xz) AS _det FROM spread),
angle AS (SELECT *, acos(greatest(-1.0, least(1.0, _det / (2 * _p * _p * _p)))) / 3 AS _phi FROM deter),
eig AS (SELECT *, _q + 2 * _p * cos(_phi) AS e2, _q + 2 * _p * cos(_phi + 2 * pi() / 3) AS e0,
               3 * _q - (_q + 2 * _p * cos(_phi)) - (_q + 2 * _p * cos(_phi + 2 * pi() / 3)) AS e1 FROM angle),
rowed AS ({rows}), crossed AS (SELECT *, {parts} FROM rowed), normed AS (SELECT *, {norms} FROM crossed)
SELECT *, {pick} FROM normed"""


def sql_moments(rows: str, by: str) -> str:
    cov = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for i, a in enumerate(AXES) for b in AXES[i:])
    return f"SELECT {by}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {cov} FROM ({rows}) GROUP BY {by}"


def radius_outlier(spark, sf_dir):
    return neighbours.radius_inliers(points(spark, sf_dir), 0.05, 2).select(F.col("id").alias("vec_id"), *[r6(F.col(a), a) for a in AXES])


SQL_RADIUS = f"""
WITH p AS ({SQL_POINTS})
SELECT a.vec_id, round(a.x, 6) + 0.0 AS x, round(a.y, 6) + 0.0 AS y, round(a.z, 6) + 0.0 AS z
FROM p a JOIN p b ON a.vec_id <> b.vec_id AND {SQL_D2} <= 0.05 * 0.05 GROUP BY a.vec_id, a.x, a.y, a.z HAVING count(*) >= 2
"""

SQL_KNN = f"""
SELECT a.vec_id AS qid, a.x AS qx, a.y AS qy, a.z AS qz, b.vec_id, b.x, b.y, b.z, {SQL_D2} AS d2,
       row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_D2}, b.vec_id) AS rank
FROM ({SQL_POINTS}) a JOIN ({SQL_POINTS}) b ON a.vec_id <> b.vec_id
"""


def knn_distance(spark, sf_dir):
    near = neighbours.knn(points(spark, sf_dir), 8, 0.05)
    return near.groupBy(F.col("qid").alias("vec_id")).agg(F.count("*").alias("n"), F.round(F.max(F.sqrt("d2")), 6).alias("farthest"), F.round(F.avg(F.sqrt("d2")), 6).alias("mean"))


SQL_KNN_DISTANCE = f"""
SELECT qid AS vec_id, count(*)::BIGINT AS n, round(max(sqrt(d2)), 6) AS farthest, round(avg(sqrt(d2)), 6) AS mean
FROM ({SQL_KNN}) WHERE rank <= 8 GROUP BY qid
"""


def sor_filter(spark, sf_dir):
    kept = neighbours.statistical_inliers(points(spark, sf_dir), k=8, deviations=1.0, tile=0.25, edge=0.05, least=16)
    return kept.select(F.col("id").alias("vec_id"))


SQL_SOR = f"""
WITH m AS (SELECT qid, avg(sqrt(d2)) AS m, any_value(floor(qx / 0.25)) AS tx, any_value(floor(qy / 0.25)) AS ty, any_value(floor(qz / 0.25)) AS tz
           FROM ({SQL_KNN}) WHERE rank <= 8 GROUP BY qid),
s AS (SELECT *, avg(m) OVER w AS mu, stddev_samp(m) OVER w AS sd, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY tx, ty, tz))
SELECT qid AS vec_id FROM s WHERE n < 16 OR m <= mu + 1.0 * coalesce(sd, 0)
"""


def edge_plane_filter(spark, sf_dir):
    kept = neighbours.edge_plane_inliers(points(spark, sf_dir), k=8, residual=0.04, planarity=0.06, tile=0.5, edge=0.05)
    return kept.select(F.col("id").alias("vec_id"))


SQL_EDGE = f"""
WITH f AS ({sql_fit(sql_moments(f"SELECT * FROM ({SQL_KNN}) WHERE rank <= 8", "qid, qx, qy, qz"))}),
b AS (SELECT qid, floor(qx / 0.5) AS tx, floor(qy / 0.5) AS ty, floor(qz / 0.5) AS tz,
             n >= 6 AND e0 + e1 + e2 > 1e-10 AND e0 / (e0 + e1 + e2) <= 0.06 AND abs(ux * (qx - mx) + uy * (qy - my) + uz * (qz - mz)) > 0.04 AS bad FROM f),
t AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE bad) OVER w AS gone FROM b WINDOW w AS (PARTITION BY tx, ty, tz))
SELECT qid AS vec_id FROM t WHERE NOT bad OR n < 32 OR gone > n // 3
"""


def surface_normals(spark, sf_dir):
    out = neighbours.normals(points(spark, sf_dir), 0.12)
    return out.where("n >= 4").select(F.col("id").alias("vec_id"), "n", *[F.round(F.col(f"n{a}"), 4).alias(f"n{a}") for a in AXES])


_FIT_NORMALS = sql_fit(sql_moments(f"SELECT a.vec_id AS qid, a.x AS qx, a.y AS qy, a.z AS qz, b.x, b.y, b.z FROM ({SQL_POINTS}) a JOIN ({SQL_POINTS}) b ON {SQL_D2} <= 0.12 * 0.12", "qid, qx, qy, qz") + " HAVING count(*) >= 4")
SQL_NORMALS = f"""
SELECT qid AS vec_id, n::BIGINT AS n, {", ".join(f"round(CASE WHEN ux * qx + uy * qy + uz * qz > 0 THEN -u{a} ELSE u{a} END, 4) + 0.0 AS n{a}" for a in AXES)}
FROM ({_FIT_NORMALS})
"""


def _planes(spark, sf_dir):
    return voxel.planes(cloud(spark, sf_dir), SIZE, threshold=0.005, flatness=0.6)


def _matched(spark, sf_dir):
    return neighbours.nearest_plane(points(spark, sf_dir), _planes(spark, sf_dir), SIZE, floor=0.05, share=0.3, support=0.6)


def nearest_plane(spark, sf_dir):
    return _matched(spark, sf_dir).where("plane IS NOT NULL").select(F.col("id").alias("vec_id"), F.round(F.abs("distance"), 6).alias("gap"), F.round("plane.radius", 6).alias("radius"))


_CELLED = f"SELECT *, {sql_cells(SIZE)} FROM ({SQL_POINTS})"
SQL_MATCHED = f"""
WITH planes AS (SELECT * FROM ({sql_fit(sql_moments(_CELLED, "vx, vy, vz") + " HAVING count(*) >= 8")}) WHERE e0 <= 0.005 AND e0 / greatest(e2, 1e-9) <= 0.6),
near AS (
  SELECT c.vec_id, c.x, c.y, c.z, p.mx, p.my, p.mz, p.ux, p.uy, p.uz, sqrt(greatest(e2, 1e-9)) AS radius, greatest(1e-6, e0) AS variance,
         p.ux * (c.x - p.mx) + p.uy * (c.y - p.my) + p.uz * (c.z - p.mz) AS distance,
         (c.x - p.mx) ** 2 + (c.y - p.my) ** 2 + (c.z - p.mz) ** 2 AS far2
  FROM ({_CELLED}) c JOIN planes p ON abs(c.vx - p.vx) <= 1 AND abs(c.vy - p.vy) <= 1 AND abs(c.vz - p.vz) <= 1),
fit AS (SELECT * FROM near WHERE abs(distance) <= greatest(0.05, 0.3 * {SIZE}) AND greatest(0.0, far2 - distance * distance) <= greatest(0.6 * {SIZE}, 3.0 * radius) ** 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(distance), mx, my, mz) AS k FROM fit) WHERE k = 1
"""
SQL_NEAREST_PLANE = f"SELECT vec_id, round(abs(distance), 6) + 0.0 AS gap, round(radius, 6) AS radius FROM ({SQL_MATCHED})"


def normal_equations(spark, sf_dir):
    out = registration.normal_equations(_matched(spark, sf_dir))
    return out.select(*[F.round(c, 3).alias(c) for c in (*registration.HESSIAN, *registration.GRADIENT)], F.round("squares", 6).alias("squares"), "inliers")


_J = ("y * uz - z * uy", "z * ux - x * uz", "x * uy - y * ux", "ux", "uy", "uz")
SQL_NORMAL = f"""
SELECT {", ".join(f"round(sum(w * ({_J[i]}) * ({_J[j]})), 3) + 0.0 AS h{i}{j}" for i in range(6) for j in range(i, 6))},
       {", ".join(f"round(sum(w * ({_J[i]}) * distance), 3) + 0.0 AS g{i}" for i in range(6))}, round(sum(distance * distance), 6) AS squares, count(*)::BIGINT AS inliers
FROM (SELECT *, CASE WHEN abs(distance) <= 0.05 THEN 1.0::DOUBLE ELSE 0.05::DOUBLE / abs(distance) END / (0.001::DOUBLE + variance) AS w FROM ({SQL_MATCHED}))
"""


def scan_equations(spark, sf_dir):
    """One iteration of all scans at once: each label is a scan, laid on the same planes."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    out = registration.normal_equations(_matched(spark, sf_dir).join(labels, "id"), ["label"])
    return out.select("label", *[F.round(c, 3).alias(c) for c in (*registration.HESSIAN, *registration.GRADIENT)], F.round("squares", 6).alias("squares"), "inliers")


SQL_SCAN_EQUATIONS = f"""
SELECT label, {", ".join(f"round(sum(w * ({_J[i]}) * ({_J[j]})), 3) + 0.0 AS h{i}{j}" for i in range(6) for j in range(i, 6))},
       {", ".join(f"round(sum(w * ({_J[i]}) * distance), 3) + 0.0 AS g{i}" for i in range(6))}, round(sum(distance * distance), 6) AS squares, count(*)::BIGINT AS inliers
FROM (SELECT m.*, e.label, CASE WHEN abs(distance) <= 0.05 THEN 1.0::DOUBLE ELSE 0.05::DOUBLE / abs(distance) END / (0.001::DOUBLE + variance) AS w
      FROM ({SQL_MATCHED}) m JOIN embeddings e ON m.vec_id = e.vec_id) GROUP BY label
"""


def _surfels(spark, sf_dir):
    """Vectors as points with normals; two labels make a pair of clouds."""
    part = lambda i: F.element_at("embedding", i).cast("double")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("label") / 2).alias("pair"), (F.col("label") % 2).alias("side"), *[part(i + 1).alias(a) for i, a in enumerate(AXES)], *[part(i + 4).alias(f"u{a}") for i, a in enumerate(AXES)])
    size = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))
    return e.select("pair", "side", "id", *AXES, *[(F.col(f"u{a}") / size).alias(f"n{a}") for a in AXES])


def plane_to_plane_sums(spark, sf_dir):
    """The sums of one iteration of all pairs at once: each source point with the nearest target point within reach."""
    e = _surfels(spark, sf_dir)
    source, target = e.where("side = 0").drop("side"), e.where("side = 1").drop("side")
    near = neighbours.within(source, target, 0.12, by=("pair",)).groupBy("pair", "qid").agg(F.min_by("id", F.struct("d2", "id")).alias("tid"))
    partner = target.select("pair", F.col("id").alias("tid"), *[F.col(a).alias(f"t{a}") for a in AXES], *[F.col(f"n{a}").alias(f"m{a}") for a in AXES])
    matched = source.join(near.withColumnRenamed("qid", "id"), ["pair", "id"]).join(partner, ["pair", "tid"])
    out = alignment.plane_to_plane(matched, ["pair"])
    return out.select("pair", *[(F.round(c, 4) + 0.0).alias(c) for c in alignment.SUMS], F.round("squares", 6).alias("squares"), "inliers")


def _sql_sums() -> str:
    """The products of the lever's matrix with the weights, written out entry by entry."""
    m = [[f"m{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    lever = [["0.0::DOUBLE", "-z", "y"], ["z", "0.0::DOUBLE", "-x"], ["-y", "x", "0.0::DOUBLE"]]
    top = [["(" + " + ".join(f"({lever[i][k]}) * {m[k][j]}" for k in range(3)) + ")" for j in range(3)] for i in range(3)]
    turn = [["(" + " + ".join(f"{top[i][k]} * ({lever[j][k]})" for k in range(3)) + ")" for j in range(3)] for i in range(3)]
    force = ["(" + " + ".join(f"{m[i][j]} * d{j}" for j in range(3)) + ")" for i in range(3)]
    side = [f"y * {force[2]} - z * {force[1]}", f"z * {force[0]} - x * {force[2]}", f"x * {force[1]} - y * {force[0]}", *force]
    entry = lambda i, j: turn[i][j] if j < 3 else top[i][j - 3] if i < 3 else m[i - 3][j - 3]
    h = [f"round(sum({entry(i, j)}), 4) + 0.0 AS h{i}{j}" for i in range(6) for j in range(i, 6)]
    return ", ".join(h + [f"round(sum({c}), 4) + 0.0 AS g{i}" for i, c in enumerate(side)])


_S = [[f"s{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_MINOR = lambda i, j: f"({_S[(i + 1) % 3][(j + 1) % 3]} * {_S[(i + 2) % 3][(j + 2) % 3]} - {_S[(i + 1) % 3][(j + 2) % 3]} * {_S[(i + 2) % 3][(j + 1) % 3]})"
_NORMAL = ", ".join(f"u{a} / sqrt(ux * ux + uy * uy + uz * uz) AS n{a}" for a in AXES)
_SPREAD = ", ".join(f"{2.0 if i == j else 0.0}::DOUBLE - 0.999::DOUBLE * (a.n{AXES[i]} * a.n{AXES[j]} + b.n{AXES[i]} * b.n{AXES[j]}) AS s{i}{j}" for i in range(3) for j in range(i, 3))
SQL_PLANE_TO_PLANE = f"""
WITH e AS (SELECT *, {_NORMAL} FROM (SELECT vec_id, label // 2 AS pair, label % 2 AS side, {", ".join(f"embedding[{i + 1}]::DOUBLE AS {a}" for i, a in enumerate(AXES))}, {", ".join(f"embedding[{i + 4}]::DOUBLE AS u{a}" for i, a in enumerate(AXES))} FROM embeddings)),
near AS (
  SELECT a.pair, a.vec_id AS p, b.vec_id AS q, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_D2}, b.vec_id) AS k
  FROM (SELECT * FROM e WHERE side = 0) a JOIN (SELECT * FROM e WHERE side = 1) b ON a.pair = b.pair AND {SQL_D2} <= 0.12::DOUBLE * 0.12::DOUBLE),
met AS (SELECT a.pair, a.x, a.y, a.z, b.x - a.x AS d0, b.y - a.y AS d1, b.z - a.z AS d2, {_SPREAD} FROM near JOIN e a ON a.vec_id = p JOIN e b ON b.vec_id = q WHERE k = 1),
weighted AS (SELECT *, {", ".join(f"{_MINOR(i, j)} / det AS m{i}{j}" for i in range(3) for j in range(i, 3))}
  FROM (SELECT *, s00 * {_MINOR(0, 0)} + s01 * {_MINOR(0, 1)} + s02 * {_MINOR(0, 2)} AS det FROM met))
SELECT pair::BIGINT AS pair, {_sql_sums()}, round(sum(d0 * d0 + d1 * d1 + d2 * d2), 6) AS squares, count(*)::BIGINT AS inliers FROM weighted GROUP BY pair
"""


def gated_nn_score(spark, sf_dir):
    """How well the points of each even label lie on those of odd labels."""
    labelled = points(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    source, target = labelled.where("label % 2 = 0"), labelled.where("label % 2 = 1")
    out = neighbours.nearest_score(source, target, 0.06, by=["label"])
    return out.select("label", "n", "inliers", r6(F.col("fitness"), "fitness"), r6(F.col("rmse"), "rmse"))


SQL_LABELLED = "SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"
SQL_SCORE = f"""
WITH near AS (SELECT a.vec_id, a.label, min({SQL_D2}) AS d2 FROM (SELECT * FROM ({SQL_LABELLED}) WHERE label % 2 = 0) a
              LEFT JOIN (SELECT * FROM ({SQL_LABELLED}) WHERE label % 2 = 1) b ON {SQL_D2} <= 0.06 * 0.06 GROUP BY a.vec_id, a.label)
SELECT label, count(*)::BIGINT AS n, count(d2)::BIGINT AS inliers, round(count(d2) / count(*), 6) AS fitness, round(sqrt(avg(d2)), 6) AS rmse FROM near GROUP BY label
"""


def tile_halo(spark, sf_dir):
    tiled = neighbours.with_halo(points(spark, sf_dir), 0.1, 0.02)
    return tiled.groupBy(*neighbours.TILE).agg(F.count_if("core").alias("core"), F.count_if(~F.col("core")).alias("halo"), F.sum("id").alias("ids"))


_RANGE = "generate_series(floor(({a} - 0.02) / 0.1)::BIGINT, floor(({a} + 0.02) / 0.1)::BIGINT)"
SQL_HALO = f"""
SELECT tx, ty, tz, count(*) FILTER (WHERE core)::BIGINT AS core, count(*) FILTER (WHERE NOT core)::BIGINT AS halo, sum(vec_id)::BIGINT AS ids FROM (
  SELECT *, tx = floor(x / 0.1) AND ty = floor(y / 0.1) AND tz = floor(z / 0.1) AS core FROM (
    SELECT *, unnest({_RANGE.format(a="z")}) AS tz FROM (SELECT *, unnest({_RANGE.format(a="y")}) AS ty FROM (
      SELECT *, unnest({_RANGE.format(a="x")}) AS tx FROM ({SQL_POINTS}))))) GROUP BY tx, ty, tz
"""


def stratified_sample(spark, sf_dir):
    """The middle row of each of at most 16 equal strata of a label's points, in order of their cells."""
    labelled = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate(AXES)])
    celled = voxel.with_cells(labelled, 0.1)
    return series.stratum_middles(celled, ["label"], [*voxel.KEY, *AXES, "vec_id"], 16, 2).select("label", "vec_id")


SQL_STRATA = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vx, vy, vz, x, y, z, vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n
           FROM (SELECT *, {sql_cells(0.1)} FROM ({SQL_LABELLED}))),
s AS (SELECT *, greatest(1, ceil(n / 16.0)::BIGINT) AS stride FROM r)
SELECT label, vec_id FROM s WHERE i % stride = (least(n, (i // stride + 1) * stride) - (i // stride) * stride - 1) // 2
"""


def icp_register(spark, sf_dir):
    """The cloud, moved by a known small motion, is laid back on itself."""
    import math

    p = points(spark, sf_dir)
    c, s = math.cos(0.03), math.sin(0.03)
    pose = ((c, -s, 0.0, 0.01), (s, c, 0.0, -0.008), (0.0, 0.0, 1.0, 0.005))
    from ..functions import geometry as g

    moved = p.select("id", *[v.alias(a) for v, a in zip(g.transform(*[F.col(a) for a in AXES], pose), AXES, strict=True)])
    found, fitness, rmse = neighbours.register(moved, p, 0.15, rounds=30)
    rows = [(i, j, round(float(found[i, j]), 4) + 0.0, round(fitness, 4), round(rmse, 4)) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "i int, j int, value double, fitness double, rmse double")


QUERIES = {f.__name__: f for f in (
    radius_outlier, knn_distance, sor_filter, edge_plane_filter, surface_normals, nearest_plane, normal_equations, scan_equations, plane_to_plane_sums, gated_nn_score, tile_halo,
    stratified_sample, icp_register)}
ORACLE_SQL = {
    "radius_outlier": SQL_RADIUS, "knn_distance": SQL_KNN_DISTANCE, "sor_filter": SQL_SOR, "edge_plane_filter": SQL_EDGE, "surface_normals": SQL_NORMALS,
    "nearest_plane": SQL_NEAREST_PLANE, "normal_equations": SQL_NORMAL, "scan_equations": SQL_SCAN_EQUATIONS, "plane_to_plane_sums": SQL_PLANE_TO_PLANE, "gated_nn_score": SQL_SCORE, "tile_halo": SQL_HALO, "stratified_sample": SQL_STRATA,
}
