"""Queries over images, place recognition, gates and pose graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graphs, imaging, loops, registration, substructure, triangles
from ..session import table
from .clouds import CAMERA, SQL_POINTS, cloud, r6
from .timelines import SECOND, SQL_EVENTS, events

SMALL = g.Camera(fx=30.0, fy=30.0, cx=24.0, cy=18.0, width=48, height=36)
RINGS = SECTORS = 8


def zbuffer_visible(spark, sf_dir):
    p = cloud(spark, sf_dir).withColumn("z", F.col("z") + 1.0)
    return imaging.visible(p, SMALL).select("vec_id", r6(F.col("depth"), "depth"))


_C = SMALL
SQL_VISIBLE = f"""
WITH p AS (SELECT vec_id, z AS depth, {_C.fx}::DOUBLE * (x / z) + {_C.cx} AS u, {_C.fy}::DOUBLE * (y / z) + {_C.cy} AS v
           FROM (SELECT vec_id, x, y, z + 1.0::DOUBLE AS z FROM ({SQL_POINTS})) WHERE z > {_C.nearest}),
s AS (SELECT *, floor(u + 0.5)::INT AS px, floor(v + 0.5)::INT AS py FROM p WHERE u >= 1 AND u < {_C.width - 2} AND v >= 1 AND v < {_C.height - 2}),
splat AS (SELECT px + dx AS px, py + dy AS py, min(depth::FLOAT) AS near FROM s, generate_series(-1, 1) a(dx), generate_series(-1, 1) b(dy)
          WHERE px + dx BETWEEN 0 AND {_C.width - 1} AND py + dy BETWEEN 0 AND {_C.height - 1} GROUP BY 1, 2)
SELECT s.vec_id, round(any_value(s.depth), 6) AS depth FROM s JOIN splat t ON abs(s.px - t.px) <= 1 AND abs(s.py - t.py) <= 1
GROUP BY s.vec_id HAVING any_value(s.depth) <= min(t.near) + greatest(0.06, any_value(s.depth) * 0.015)
"""


def _grid(spark) -> DataFrame:
    """Three images of 64 x 48 pixels whose bands are fixed functions of the place."""
    i = spark.range(3 * 64 * 48).select((F.col("id") % 3).alias("image"), (F.floor(F.col("id") / 3) % 64).cast("int").alias("px"), F.floor(F.col("id") / 192).cast("int").alias("py"))
    x, y, k = F.col("px"), F.col("py"), F.col("image").cast("int")
    return i.select("image", "px", "py", ((x * 7 + y * 3 + k * 11) % 256).alias("r"), ((x * y + k) % 256).alias("g"), ((x * x + y * 5) % 256).alias("b"))


SQL_GRID = """
SELECT image, px, py, (px * 7 + py * 3 + image * 11) % 256 AS r, (px * py + image) % 256 AS g, (px * px + py * 5) % 256 AS b
FROM (SELECT i % 3 AS image, (i // 3) % 64 AS px, i // 192 AS py FROM range(9216) t(i))
"""


def bilinear_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("image"), ((F.col("event_id") * 37 % 620) / 10.0).alias("u"), ((F.col("event_id") * 13 % 460) / 10.0).alias("v"))
    return imaging.bilinear(e, _grid(spark), ["image"]).select("event_id", "r", "g", "b")


_BANDS = ", ".join(f"least(255, greatest(0, floor(sum({c} * w) + 0.5)))::INT AS {c}" for c in "rgb")
SQL_BILINEAR = f"""
WITH e AS (SELECT event_id, event_id % 3 AS image, (event_id * 37 % 620) / 10.0::DOUBLE AS u, (event_id * 13 % 460) / 10.0::DOUBLE AS v FROM events),
c AS (SELECT *, floor(u)::BIGINT + i AS px, floor(v)::BIGINT + j AS py,
             (CASE i WHEN 1 THEN u - floor(u) ELSE 1.0::DOUBLE - (u - floor(u)) END) * (CASE j WHEN 1 THEN v - floor(v) ELSE 1.0::DOUBLE - (v - floor(v)) END) AS w
      FROM e, range(2) a(i), range(2) b(j))
SELECT event_id, {_BANDS} FROM c JOIN ({SQL_GRID}) p USING (image, px, py) GROUP BY event_id
"""


def _sheets(spark, sf_dir) -> DataFrame:
    """Vectors as lines of images of 128 x 96 pixels: two vectors to a line, 192 to an image."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    grey = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("v").cast("double") * 256 + 128))).cast("int")
    at = e.select(F.floor(F.col("vec_id") / 192).alias("image"), (F.col("vec_id") % 2 * 64 + F.col("i")).alias("px"), F.floor(F.col("vec_id") % 192 / 2).alias("py"), grey.alias("r"))
    return at.select("image", "px", "py", "r", (255 - F.col("r")).alias("g"), (F.col("px") * F.col("py") % 256).cast("int").alias("b"))


def tile_sample(spark, sf_dir):
    """Events as places in the images that the vectors make, by tiles; those outside or in gaps get null."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", (k % 5).alias("image"), (k * 37 % 1040 / 8.0).alias("u"), (k * 13 % 780 / 8.0).alias("v"))
    return imaging.bilinear_tiles(e, imaging.tiled(_sheets(spark, sf_dir), ["image"]), ["image"]).select("event_id", "r", "g", "b")


SQL_TILES = f"""
WITH e AS (SELECT event_id, event_id % 5 AS image, (event_id * 37 % 1040) / 8.0::DOUBLE AS u, (event_id * 13 % 780) / 8.0::DOUBLE AS v FROM events),
d AS (SELECT vec_id // 192 AS image, vec_id % 2 * 64 + i AS px, vec_id % 192 // 2 AS py, least(255, greatest(0, floor(v::DOUBLE * 256 + 128)))::BIGINT AS r
      FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)),
p AS (SELECT *, 255 - r AS g, px * py % 256 AS b FROM d),
c AS (SELECT *, floor(u)::BIGINT + i AS px, floor(v)::BIGINT + j AS py,
             (CASE i WHEN 1 THEN u - floor(u) ELSE 1.0::DOUBLE - (u - floor(u)) END) * (CASE j WHEN 1 THEN v - floor(v) ELSE 1.0::DOUBLE - (v - floor(v)) END) AS w
      FROM e, range(2) a(i), range(2) b(j)),
s AS (SELECT event_id, {_BANDS} FROM c JOIN p USING (image, px, py) GROUP BY event_id HAVING count(*) = 4)
SELECT event_id, r, g, b FROM events LEFT JOIN s USING (event_id)
"""


def laplacian_sharpness(spark, sf_dir):
    """Vectors as images of 8 x 8 pixels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    grey = e.select("vec_id", (F.col("i") % 8).alias("px"), F.floor(F.col("i") / 8).cast("int").alias("py"), F.floor(F.col("v").cast("double") * 256 + 128).cast("long").alias("grey"))
    return imaging.laplacian_variance(grey, ["vec_id"]).select("vec_id", r6(F.col("sharpness"), "sharpness"))


SQL_SHARPNESS = """
WITH p AS (SELECT vec_id, i % 8 AS px, i // 8 AS py, floor(v::DOUBLE * 256 + 128)::BIGINT AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)),
l AS (SELECT vec_id, 4 * v - lag(v) OVER h - lead(v) OVER h - lag(v) OVER d - lead(v) OVER d AS lap FROM p
      WINDOW h AS (PARTITION BY vec_id, py ORDER BY px), d AS (PARTITION BY vec_id, px ORDER BY py))
SELECT vec_id, round(var_pop(lap), 6) AS sharpness FROM l WHERE lap IS NOT NULL GROUP BY vec_id
"""


def _frames(spark, sf_dir) -> DataFrame:
    """Embeddings as keyframes of the captures `label`: 8 rings of 8 sectors."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("descriptor"))
    key = F.transform(F.sequence(F.lit(0), F.lit(RINGS - 1)), lambda r: F.aggregate(F.slice("descriptor", r * SECTORS + 1, SECTORS), F.lit(0.0), lambda a, v: a + v) / SECTORS)
    return e.select("label", "frame", *[F.element_at("descriptor", i + 1).alias(a) for i, a in enumerate("xyz")], "descriptor", key.alias("ring_key"))


SQL_FRAMES = """
SELECT label, vec_id AS frame, e[1] AS x, e[2] AS y, e[3] AS z, e, list_transform(range(8), lambda r: list_sum(e[r * 8 + 1 : r * 8 + 8]) / 8) AS k
FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings)
"""


def sql_distance(pairs: str, keys: str) -> str:
    return f"""
SELECT {keys}, coalesce(min(d), 1.0) AS score FROM (
  SELECT {keys}, shift, avg(CASE WHEN na > 1e-9 AND nb > 1e-9 THEN 1 - dot / sqrt(na * nb) END) AS d FROM (
    SELECT {keys}, shift, list_sum(list_transform(range(8), lambda r: a[r * 8 + c + 1] * b[r * 8 + (c + shift) % 8 + 1])) AS dot,
           list_sum(list_transform(range(8), lambda r: a[r * 8 + c + 1] ** 2)) AS na, list_sum(list_transform(range(8), lambda r: b[r * 8 + (c + shift) % 8 + 1] ** 2)) AS nb
    FROM ({pairs}), range(8) s(shift), range(8) t(c)) GROUP BY {keys}, shift) GROUP BY {keys}"""


def descriptor_distance(spark, sf_dir):
    """Each keyframe against the one after it."""
    f = _frames(spark, sf_dir)
    b = f.select((F.col("frame") - 1).alias("frame"), F.col("descriptor").alias("next"))
    score = loops.descriptor_distance(F.col("descriptor"), F.col("next"), RINGS, SECTORS)
    return f.join(b, "frame").select("frame", F.round(score, 6).alias("score"))


SQL_DISTANCE = f"""
SELECT frame, round(score, 6) AS score FROM ({sql_distance(f"SELECT x.frame, x.e AS a, y.e AS b FROM ({SQL_FRAMES}) x JOIN ({SQL_FRAMES}) y ON y.frame = x.frame + 1", "frame")})
"""


def loop_topk(spark, sf_dir):
    out = loops.candidates(_frames(spark, sf_dir), "label", separation=10, radius=0.1, most=4, ring_limit=0.12, rings=RINGS, sectors=SECTORS)
    return out.select("label", "target", "source", F.round("score", 6).alias("score"), "rank")


_PAIRS = f"""
SELECT label, target, source, a, b FROM (
  SELECT *, row_number() OVER (PARTITION BY label, target ORDER BY ring + 0.2::DOUBLE * least(1.0, far / 0.1), source) AS n FROM (
    SELECT s.label, t.frame AS target, s.frame AS source, s.e AS a, t.e AS b,
           sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2) AS far, sqrt(list_sum(list_transform(range(1, 9), lambda i: (s.k[i] - t.k[i]) ** 2))) AS ring
    FROM ({SQL_FRAMES}) s JOIN ({SQL_FRAMES}) t ON s.label = t.label AND s.frame + 10 <= t.frame) WHERE far <= 0.1 OR ring <= 0.12) WHERE n <= 24
"""
SQL_TOPK = f"""
SELECT label, target, source, round(score, 6) AS score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label, target ORDER BY score, source) AS rank FROM ({sql_distance(_PAIRS, "label, target, source")})) WHERE rank <= 4
"""


def polar_descriptor(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", *[F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate("xyz")])
    cells = loops.polar_cells(e, ["label"], rings=8, sectors=12, reach=0.4, height=0.3)
    keys = loops.ring_keys(cells, ["label"], 12)
    return cells.join(keys, ["label", "ring"]).select("label", "ring", "sector", r6(F.col("value"), "value"), r6(F.col("key"), "ring_key"))


SQL_POLAR = """
WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
c AS (SELECT label, least(7, floor(sqrt(x * x + y * y) / 0.4 * 8)::INT) AS ring, least(11, greatest(0, floor((atan2(y, x) + pi()) / (2 * pi()) * 12)::INT)) AS sector,
             (max(greatest(-0.3, least(0.3, z)) + 0.3)) / 0.6 AS value
      FROM p WHERE sqrt(x * x + y * y) >= 0.1::DOUBLE * 0.4 / 60 AND sqrt(x * x + y * y) < 0.4 GROUP BY 1, 2, 3)
SELECT label, ring, sector, round(value, 6) AS value, round(sum(value) OVER (PARTITION BY label, ring) / 12, 6) AS ring_key FROM c
"""


def _proposals(spark, sf_dir):
    e = events(spark, sf_dir)
    k = F.col("event_id")
    return e.select(
        k.alias("id"), "user_id", (k * 7 % 60).alias("source"), F.floor(F.col("t") / (6 * 3600 * SECOND)).alias("target"), ((k % 20) / 20.0).alias("fitness"),
        ((k % 13) / 100.0).alias("rmse"), (k % 9).alias("matches"), (F.col("value") / 10.0).alias("cx"), ((k % 3) / 2.0).alias("cy"), F.lit(0.0).alias("cz"), (k % 40).cast("double").alias("angle"),
    )


SQL_PROPOSALS = f"""
SELECT event_id AS id, user_id, event_id * 7 % 60 AS source, floor(t / {6 * 3600 * SECOND}.0::DOUBLE)::BIGINT AS target, (event_id % 20) / 20.0::DOUBLE AS fitness,
       (event_id % 13) / 100.0::DOUBLE AS rmse, event_id % 9 AS matches, value / 10.0::DOUBLE AS cx, (event_id % 3) / 2.0::DOUBLE AS cy, (event_id % 40)::DOUBLE AS angle FROM ({SQL_EVENTS})
"""


def temporal_support(spark, sf_dir):
    return loops.supported(_proposals(spark, sf_dir), "user_id").select("id", "user_id", "source", "target")


SQL_SUPPORT = f"""
WITH p AS ({SQL_PROPOSALS})
SELECT id, user_id, source, target FROM p a WHERE (fitness >= 0.90 AND rmse <= 0.05 AND matches >= 6) OR EXISTS (
  SELECT 1 FROM p b WHERE a.user_id = b.user_id AND abs(a.target - b.target) BETWEEN 1 AND 12 AND abs(a.source - b.source) <= 12
  AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 1.0 AND abs(a.angle - b.angle) <= 12.0)
"""


def greedy_suppress(spark, sf_dir):
    return loops.suppressed(_proposals(spark, sf_dir), "user_id", "target", 6)


SQL_SUPPRESS = f"""
WITH RECURSIVE p AS (SELECT DISTINCT user_id, target FROM ({SQL_PROPOSALS})),
taken AS (
  SELECT user_id, min(target) AS target FROM p GROUP BY user_id
  UNION ALL
  SELECT user_id, target FROM (
    SELECT t.user_id, p.target, row_number() OVER (PARTITION BY t.user_id ORDER BY p.target) AS n FROM taken t JOIN p ON p.user_id = t.user_id AND p.target >= t.target + 6) WHERE n = 1)
SELECT user_id, target FROM taken
"""


def gate_reasons(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    reason = registration.gate_reason((k % 53 / 50.0 + 0.5), (F.col("o_custkey") % 23 / 100.0), F.round(F.col("o_totalprice") / 400000.0, 3), (k % 31).cast("double"), (k % 5 / 10.0))
    return o.select("o_orderkey", reason.alias("reason"))


SQL_GATES = """
WITH o AS (SELECT o_orderkey, o_orderkey % 53 / 50.0::DOUBLE + 0.5::DOUBLE AS fitness, o_custkey % 23 / 100.0::DOUBLE AS rmse, round(o_totalprice / 400000.0::DOUBLE, 3) AS moved,
                  (o_orderkey % 31)::DOUBLE AS turned, o_orderkey % 5 / 10.0::DOUBLE AS s FROM orders),
e AS (SELECT *, CASE WHEN fitness < 0.80 OR rmse > 0.18 * 0.45 THEN 0.15::DOUBLE + 2.5::DOUBLE * s ELSE 0.35::DOUBLE + 4.0::DOUBLE * s END AS reach,
             CASE WHEN fitness < 0.80 OR rmse > 0.18 * 0.45 THEN 7.0::DOUBLE + 75.0::DOUBLE * s ELSE 12.0::DOUBLE + 120.0::DOUBLE * s END AS arc FROM o)
SELECT o_orderkey, CASE WHEN fitness < 0.70 THEN printf('fitness %.3f below %.3f', fitness, 0.70::DOUBLE) WHEN rmse > 0.18 THEN printf('rmse %.3f m above %.3f m', rmse, 0.18::DOUBLE)
  WHEN moved > reach THEN printf('translation %.3f m above %.3f m', moved, reach) WHEN turned > arc THEN printf('rotation %.3f deg above %.3f deg', turned, arc) ELSE 'accepted' END AS reason FROM e
"""


def graph_sanity(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", (k % 17 / 4.0).alias("x0"), (k % 11 / 8.0).alias("y0"), F.lit(0.0).alias("z0"), (k % 90).cast("double").alias("heading0"),
        (k % 17 / 4.0 + k % 5 / 16.0).alias("x1"), (k % 11 / 8.0 + k % 3 / 16.0).alias("y1"), (k % 7 / 32.0).alias("z1"), (k % 90 + k % 8).cast("double").alias("heading1"),
    )
    out = loops.jumps(o, "o_custkey", "o_orderkey")
    return out.select("o_orderkey", r6(F.coalesce("jump", F.lit(0.0)), "jump"), r6(F.coalesce("stretched", F.lit(0.0)), "stretched"), "reason")


SQL_SANITY = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 17 / 4.0::DOUBLE AS x0, o_orderkey % 11 / 8.0::DOUBLE AS y0, o_orderkey % 17 / 4.0::DOUBLE + o_orderkey % 5 / 16.0::DOUBLE AS x1,
                  o_orderkey % 11 / 8.0::DOUBLE + o_orderkey % 3 / 16.0::DOUBLE AS y1, o_orderkey % 7 / 32.0::DOUBLE AS z1, (o_orderkey % 8)::DOUBLE AS dh FROM orders),
s AS (SELECT o_orderkey, sqrt((x1 - x0 - lag(x1 - x0) OVER w) ** 2 + (y1 - y0 - lag(y1 - y0) OVER w) ** 2 + (z1 - lag(z1) OVER w) ** 2) AS jump, abs(dh - lag(dh) OVER w) AS turned,
             abs(sqrt((x1 - lag(x1) OVER w) ** 2 + (y1 - lag(y1) OVER w) ** 2 + (z1 - lag(z1) OVER w) ** 2) - sqrt((x0 - lag(x0) OVER w) ** 2 + (y0 - lag(y0) OVER w) ** 2)) AS stretched
      FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, round(coalesce(jump, 0.0), 6) + 0.0 AS jump, round(coalesce(stretched, 0.0), 6) + 0.0 AS stretched,
  CASE WHEN jump > 0.30 OR turned > 6 THEN 'correction discontinuity' WHEN stretched > 0.20 OR turned > 4 THEN 'local odometry deformation' END AS reason FROM s
"""


def pose_graph(spark, sf_dir):
    """Each customer's orders as a drifting chain on a circle, closed by a loop from the last to the first."""
    w, whole = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.row_number().over(w) - 1).cast("long").alias("node"), F.count("*").over(whole).alias("n"))
    turn = 2 * 3.141592653589793 * F.col("node") / F.col("n")
    drift = 0.002 * F.col("node")
    frames = o.select(
        "o_custkey", "node", (2.0 * F.cos(turn) + drift).alias("x"), (2.0 * F.sin(turn)).alias("y"), drift.alias("z"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(turn / 2).alias("qz"), F.cos(turn / 2).alias("qw"), "n",
    )
    step = 2 * 3.141592653589793 / F.col("n")
    # The closing loop measures the circle without its drift: the last node as seen from the first.
    closing = frames.where("node = n - 1 AND n > 2").select(
        "o_custkey", F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), (2.0 * F.cos(step) - 2.0).alias("x"), (-2.0 * F.sin(step)).alias("y"), F.lit(0.0).alias("z"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), (-F.sin(step / 2)).alias("qz"), F.cos(step / 2).alias("qw"), F.lit(True).alias("loop"),
    )
    frames = frames.drop("n")
    solved = substructure.solve_graphs(frames, graphs.chain_edges(frames, "o_custkey").unionByName(closing), "o_custkey")
    return solved.groupBy("o_custkey").agg(F.count("*").alias("nodes"), F.round(F.first("cost0"), 6).alias("cost0"), F.round(F.first("cost1"), 6).alias("cost1"))


_BIN = 0.02


def _stars(spark, sf_dir):
    """Vectors as keypoints: each label's in frames of sixteen, and the same places seen after a quarter turn as later frames."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    axes = [F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate("xyz")]
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.floor(place / 16).cast("int").alias("frame"), *axes)
    turned = e.select("label", "id", (F.col("frame") + 1000).alias("frame"), (-F.col("y")).alias("x"), F.col("x").alias("y"), "z")
    return triangles.triangles(e.unionByName(turned), ["label", "frame"], near=5)


SQL_STARS = f"""
WITH e AS (SELECT label, vec_id AS id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS frame, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
k AS (SELECT * FROM e UNION ALL SELECT label, id, frame + 1000, -y, x, z FROM e),
near AS (
  SELECT p.label, p.frame, p.id AS p, q.id AS q, row_number() OVER (PARTITION BY p.label, p.frame, p.id ORDER BY (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2, q.id) AS n
  FROM k p JOIN k q ON p.label = q.label AND p.frame = q.frame AND p.id <> q.id),
sets AS (SELECT DISTINCT a.label, a.frame, list_sort([a.p, a.q, b.q]) AS ids FROM near a JOIN near b ON a.label = b.label AND a.frame = b.frame AND a.p = b.p AND a.q < b.q WHERE a.n <= 5 AND b.n <= 5),
side AS (
  SELECT s.label, s.frame, s.ids, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS side
  FROM sets s JOIN k p ON p.label = s.label AND p.frame = s.frame AND list_contains(s.ids, p.id) JOIN k q ON q.label = s.label AND q.frame = s.frame AND list_contains(s.ids, q.id) AND p.id < q.id),
shapes AS (SELECT label, frame, ids, list(side ORDER BY side) AS sides FROM side GROUP BY label, frame, ids)
"""


def triangle_keys(spark, sf_dir):
    shapes = _stars(spark, sf_dir).withColumn("key", triangles.side_bins(_BIN))
    return shapes.groupBy("label", "frame", *[F.element_at("key", i + 1).alias(f"k{i}") for i in range(3)]).agg(F.count("*").alias("n"))


SQL_TRIANGLE_KEYS = f"""{SQL_STARS}
SELECT label, frame::INTEGER AS frame, {", ".join(f"floor(sides[{i + 1}] / {_BIN}::DOUBLE)::INTEGER AS k{i}" for i in range(3))}, count(*) AS n FROM shapes GROUP BY ALL
"""


def triangle_loops(spark, sf_dir):
    """The two earlier frames of each that share most triangles with it."""
    return triangles.best_frames(triangles.votes(_stars(spark, sf_dir), "label", "frame", _BIN, 100, most=2), "label", 2)


_TWO = [[f"floor(sides[{i}] / {_BIN}::DOUBLE + {d}::DOUBLE)::INTEGER" for d in (-0.5, 0.5)] for i in (1, 2, 3)]
_PROBES = ", ".join(f"[{a}, {b}, {c}]" for a in _TWO[0] for b in _TWO[1] for c in _TWO[2])
SQL_TRIANGLE_LOOPS = f"""{SQL_STARS},
mine AS (SELECT label, frame AS target, list_transform(sides, lambda s: floor(s / {_BIN}::DOUBLE)::INTEGER) AS key, count(*) AS n FROM shapes GROUP BY ALL),
theirs AS (SELECT label, source, key, count(*) AS m FROM (SELECT label, frame AS source, unnest([{_PROBES}]) AS key FROM shapes) GROUP BY ALL),
votes AS (SELECT label, target, source, sum(least(n, m))::BIGINT AS votes FROM mine JOIN theirs USING (label, key) WHERE source + 100 <= target GROUP BY ALL)
SELECT label, target::INTEGER AS target, source::INTEGER AS source, votes, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY label, target ORDER BY votes DESC, source) AS rank FROM votes) WHERE rank <= 2
"""


QUERIES = {f.__name__: f for f in (
    triangle_keys, triangle_loops, zbuffer_visible, bilinear_sample, tile_sample, laplacian_sharpness, polar_descriptor, descriptor_distance, loop_topk, temporal_support, greedy_suppress,
    gate_reasons, graph_sanity, pose_graph)}
ORACLE_SQL = {
    "triangle_keys": SQL_TRIANGLE_KEYS, "triangle_loops": SQL_TRIANGLE_LOOPS,
    "zbuffer_visible": SQL_VISIBLE, "bilinear_sample": SQL_BILINEAR, "tile_sample": SQL_TILES, "laplacian_sharpness": SQL_SHARPNESS, "polar_descriptor": SQL_POLAR,
    "descriptor_distance": SQL_DISTANCE, "loop_topk": SQL_TOPK, "temporal_support": SQL_SUPPORT, "greedy_suppress": SQL_SUPPRESS,
    "gate_reasons": SQL_GATES, "graph_sanity": SQL_SANITY,
}
