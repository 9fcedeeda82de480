"""Queries over poses: orders as the scans of the capture `customer`, with poses that are fixed functions of their keys.

Rotations are compared by where they turn the x axis, which q and -q do alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rotations as r
from ..operators import imaging, motion, voxel
from ..session import table
from .clouds import SQL_POINTS, cloud, r6, sql_cells, sql_colour
from .places import SMALL, SQL_GRID, SQL_VISIBLE, _grid

_ORDER = "o_orderkey"


def _pose(k, yaw: float = 1.0, shift: float = 0.0) -> r.Pose:
    """A pose from a key: headings and rolls in degrees, whole numbers of eighths for positions."""
    heading, roll = F.radians(k % 90 * yaw) / 2, F.radians((k % 13).cast("double")) / 2
    s, c, p, q = F.sin(heading), F.cos(heading), F.sin(roll), F.cos(roll)
    return r.Pose(k % 17 / 4.0 + shift, k % 11 / 8.0, k % 7 / 32.0, p * c, p * s, q * s, q * c)


def sql_pose(k: str, name: str, yaw: float = 1.0, shift: float = 0.0) -> str:
    h, p = f"radians({k} % 90 * {yaw}::DOUBLE) / 2", f"radians(({k} % 13)::DOUBLE) / 2"
    return (
        f"{{'x': {k} % 17 / 4.0::DOUBLE + {shift}::DOUBLE, 'y': {k} % 11 / 8.0::DOUBLE, 'z': {k} % 7 / 32.0::DOUBLE, 'qx': sin({p}) * cos({h}), 'qy': sin({p}) * sin({h}), "
        f"'qz': cos({p}) * sin({h}), 'qw': cos({p}) * cos({h})}} AS {name}"
    )


# The same algebra as macros of DuckDB: the oracle's SQL begins with a query that carries them as lambdas would be
# repeated too often. Each takes and gives structs; a pose applied to a point is `turned` plus its position.
def sql_multiply(a: str, b: str) -> str:
    """Fields of the rotation b, then a."""
    return (
        f"'qx': {a}.qw * {b}.qx + {a}.qx * {b}.qw + {a}.qy * {b}.qz - {a}.qz * {b}.qy, 'qy': {a}.qw * {b}.qy - {a}.qx * {b}.qz + {a}.qy * {b}.qw + {a}.qz * {b}.qx, "
        f"'qz': {a}.qw * {b}.qz + {a}.qx * {b}.qy - {a}.qy * {b}.qx + {a}.qz * {b}.qw, 'qw': {a}.qw * {b}.qw - {a}.qx * {b}.qx - {a}.qy * {b}.qy - {a}.qz * {b}.qz"
    )


def sql_turned(q: str, v: str) -> list[str]:
    """Where the rotation of q takes v, by its matrix."""
    x, y, z, w = (f"{q}.{n}" for n in ("qx", "qy", "qz", "qw"))
    rows = (
        (f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {z} * {w})", f"2 * ({x} * {z} + {y} * {w})"),
        (f"2 * ({x} * {y} + {z} * {w})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {x} * {w})"),
        (f"2 * ({x} * {z} - {y} * {w})", f"2 * ({y} * {z} + {x} * {w})", f"1 - 2 * ({x} * {x} + {y} * {y})"),
    )
    return [f"(({m[0]}) * {v}.x + ({m[1]}) * {v}.y + ({m[2]}) * {v}.z)" for m in rows]


def sql_back(q: str) -> str:
    return f"{{'qx': -{q}.qx, 'qy': -{q}.qy, 'qz': -{q}.qz, 'qw': {q}.qw}}"


def sql_compose(a: str, b: str, name: str) -> str:
    x, y, z = sql_turned(a, b)
    return f"{{'x': {x} + {a}.x, 'y': {y} + {a}.y, 'z': {z} + {a}.z, {sql_multiply(a, b)}}} AS {name}"


def sql_invert(a: str, name: str) -> str:
    x, y, z = sql_turned(sql_back(a), a)
    return f"{{'x': -{x}, 'y': -{y}, 'z': -{z}, 'qx': -{a}.qx, 'qy': -{a}.qy, 'qz': -{a}.qz, 'qw': {a}.qw}} AS {name}"


def sql_degrees(q: str) -> str:
    return f"degrees(2 * atan2(sqrt({q}.qx * {q}.qx + {q}.qy * {q}.qy + {q}.qz * {q}.qz), abs({q}.qw)))"


def sql_power(q: str, share: str) -> str:
    s = f"sqrt({q}.qx * {q}.qx + {q}.qy * {q}.qy + {q}.qz * {q}.qz)"
    h = f"(atan2({s}, abs({q}.qw)) * ({share}))"
    scale = f"(CASE WHEN {s} > 1e-12 THEN (CASE WHEN {q}.qw < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * sin({h}) / {s} ELSE 0.0::DOUBLE END)"
    return f"{{'qx': {q}.qx * {scale}, 'qy': {q}.qy * {scale}, 'qz': {q}.qz * {scale}, 'qw': cos({h})}}"


def _shown(p: r.Pose) -> list:
    """The pose as six rounded numbers: its position and where it turns the x axis."""
    axis = r.rotate(p.rotation, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return [(F.round(c, 5) + 0.0).alias(n) for c, n in zip((*p.position, *axis), ("x", "y", "z", "ax", "ay", "az"), strict=True)]


def sql_shown(p: str) -> str:
    axis = (f"1 - 2 * ({p}.qy * {p}.qy + {p}.qz * {p}.qz)", f"2 * ({p}.qx * {p}.qy + {p}.qz * {p}.qw)", f"2 * ({p}.qx * {p}.qz - {p}.qy * {p}.qw)")
    return ", ".join(f"round({c}, 5) + 0.0 AS {n}" for c, n in zip((f"{p}.x", f"{p}.y", f"{p}.z", *axis), ("x", "y", "z", "ax", "ay", "az"), strict=True))


def _scans(spark, sf_dir) -> DataFrame:
    """Orders with their pose and those of the two before them."""
    w = Window.partitionBy("o_custkey").orderBy(_ORDER)
    o = table(spark, sf_dir, "orders").select("o_custkey", _ORDER, _pose(F.col(_ORDER)).packed().alias("pose"))
    return o.select("*", F.lag("pose").over(w).alias("last"), F.lag("pose", 2).over(w).alias("before"))


_SCANS = f"""
SELECT *, lag(pose) OVER w AS last, lag(pose, 2) OVER w AS before FROM (SELECT o_custkey, o_orderkey, {sql_pose("o_orderkey", "pose")} FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
"""


def pose_predict(spark, sf_dir):
    """Each scan as its two predecessors foretell it; where the key is even, turned as a gyro measured."""
    s = _scans(spark, sf_dir).where("before IS NOT NULL")
    k = F.col(_ORDER)
    seed = motion.constant_velocity(r.pose_of("before"), r.pose_of("last"), k % 9 / 2.0 - 0.5)
    mounting = (F.lit(0.0), F.lit(0.0), F.lit(0.6), F.lit(0.8))
    gyro = motion.gyro_seed(seed, r.pose_of("last"), _pose(k * 3).rotation, mounting)
    even = k % 2 == 0
    return s.select(_ORDER, F.when(even, gyro).otherwise(seed).alias("p")).select(_ORDER, *_shown(r.pose_of("p")))


SQL_PREDICT = f"""
WITH s AS (SELECT *, least(3.0::DOUBLE, greatest(0.0::DOUBLE, o_orderkey % 9 / 2.0::DOUBLE - 0.5)) AS a, {sql_back("before")} AS b0, {sql_pose("(o_orderkey * 3)", "gyro")},
                  {{'qx': 0.0::DOUBLE, 'qy': 0.0::DOUBLE, 'qz': 0.6::DOUBLE, 'qw': 0.8::DOUBLE}} AS m FROM ({_SCANS}) WHERE before IS NOT NULL),
t AS (SELECT *, {{{sql_multiply("last", "b0")}}} AS rel, {sql_back("m")} AS m0 FROM s),
u AS (SELECT *, {sql_power("rel", "a")} AS turn, {{{sql_multiply("m0", "gyro")}}} AS g0 FROM t),
v AS (SELECT *, {{{sql_multiply("turn", "last")}}} AS q, {{{sql_multiply("g0", "m")}}} AS g1 FROM u),
w AS (SELECT *, {{{sql_multiply("last", "g1")}}} AS g2 FROM v),
p AS (SELECT o_orderkey, {{'x': last.x + a * (last.x - before.x), 'y': last.y + a * (last.y - before.y), 'z': last.z + a * (last.z - before.z),
             {", ".join(f"'{n}': CASE WHEN o_orderkey % 2 = 0 THEN g2.{n} ELSE q.{n} END" for n in ("qx", "qy", "qz", "qw"))}}} AS p FROM w)
SELECT o_orderkey, {sql_shown("p")} FROM p
"""


def turn_gate(spark, sf_dir):
    """Scans against a pose a little off: the gate on turns, and the one on lost scans."""
    s = _scans(spark, sf_dir)
    k = F.col(_ORDER)
    other = _pose(k, yaw=0.9, shift=0.0)
    moved = r.Pose(other.x + k % 5 / 2.0, *other[1:])
    found = r.pose_of("pose")
    turn = r.degrees(r.multiply(found.rotation, r.conjugate(moved.rotation)))
    return s.select(_ORDER, r6(turn, "turn"), (motion.turn_reason(found, moved) == "accepted").alias("accepted"), motion.recovered(found, moved, turn=5.0).alias("recovered"))


SQL_TURN_GATE = f"""
WITH s AS (SELECT o_orderkey, pose, {sql_pose("o_orderkey", "other", 0.9)} FROM ({_SCANS})),
t AS (SELECT o_orderkey, {{{sql_multiply("pose", "back")}}} AS d FROM (SELECT *, {sql_back("other")} AS back FROM s))
SELECT o_orderkey, round({sql_degrees("d")}, 6) + 0.0 AS turn, {sql_degrees("d")} <= 8.0 AS accepted, o_orderkey % 5 / 2.0::DOUBLE <= 2.0 AND {sql_degrees("d")} <= 5.0 AS recovered FROM t
"""


def _solved(k) -> r.Pose:
    """What a solved graph makes of the pose of a key: a little more heading and a shift."""
    p = _pose(k, yaw=1.04)
    return r.Pose(p.x + k % 3 / 16.0, p.y + k % 5 / 32.0, *p[2:])


_SQL_SOLVED = sql_pose("o_orderkey", "solved0", 1.04)


def graph_sanity_turns(spark, sf_dir):
    """The gates on a solved graph with whole rotations."""
    s = _scans(spark, sf_dir).select("o_custkey", _ORDER, F.col("pose").alias("before"), _solved(F.col(_ORDER)).packed().alias("after"))
    out = motion.graph_reasons(s, "o_custkey", _ORDER)
    return out.select(_ORDER, *[(F.round(F.coalesce(c, F.lit(0.0)), 5) + 0.0).alias(c) for c in ("jump", "jump_turn", "change", "change_turn")], "reason")


SQL_SANITY_TURNS = f"""
WITH s AS (SELECT o_custkey, o_orderkey, pose, {_SQL_SOLVED} FROM ({_SCANS})),
a AS (SELECT o_custkey, o_orderkey, pose, struct_pack(x := solved0.x + o_orderkey % 3 / 16.0::DOUBLE, y := solved0.y + o_orderkey % 5 / 32.0::DOUBLE, z := solved0.z,
             qx := solved0.qx, qy := solved0.qy, qz := solved0.qz, qw := solved0.qw) AS solved FROM s),
b AS (SELECT *, {sql_invert("pose", "pose_back")}, {sql_invert("solved", "solved_back")} FROM a),
c AS (SELECT *, {sql_compose("solved", "pose_back", "fix")} FROM b),
d AS (SELECT *, lag(fix) OVER w AS fix1, lag(pose) OVER w AS pose1, lag(solved) OVER w AS solved1 FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT *, {sql_invert("fix1", "fix_back")}, {sql_compose("pose_back", "pose1", "step")}, {sql_compose("solved_back", "solved1", "step1")} FROM d),
f AS (SELECT *, {sql_invert("step", "step_back")} FROM e),
h AS (SELECT o_orderkey, fix1 IS NOT NULL AS later, {sql_compose("fix", "fix_back", "j")}, {sql_compose("step_back", "step1", "l")} FROM f),
m AS (SELECT o_orderkey, later, sqrt(j.x * j.x + j.y * j.y + j.z * j.z) AS jump, {sql_degrees("j")} AS jump_turn, sqrt(l.x * l.x + l.y * l.y + l.z * l.z) AS change, {sql_degrees("l")} AS change_turn FROM h)
SELECT o_orderkey, {", ".join(f"round(coalesce({c}, 0.0::DOUBLE), 5) + 0.0 AS {c}" for c in ("jump", "jump_turn", "change", "change_turn"))},
  CASE WHEN NOT later THEN NULL WHEN jump > 0.30 OR jump_turn > 6 THEN 'correction discontinuity' WHEN change > 0.20 OR change_turn > 4 THEN 'local odometry deformation' END AS reason FROM m
"""


def correction_interp(spark, sf_dir):
    """Every third scan is a keyframe of a solved graph; the others take the corrections around them."""
    s = _scans(spark, sf_dir).select("o_custkey", _ORDER, "pose")
    keys = s.where(F.col(_ORDER) % 3 == 0).select("o_custkey", _ORDER, _solved(F.col(_ORDER)).packed().alias("solved"))
    out = motion.corrected(s, keys, "o_custkey", _ORDER)
    return out.where("corrected.x IS NOT NULL").select(_ORDER, *_shown(r.pose_of("corrected")))


SQL_CORRECTION = f"""
WITH s AS (SELECT o_custkey, o_orderkey, pose, {_SQL_SOLVED} FROM ({_SCANS})),
k AS (SELECT o_custkey, o_orderkey, struct_pack(x := solved0.x + o_orderkey % 3 / 16.0::DOUBLE, y := solved0.y + o_orderkey % 5 / 32.0::DOUBLE, z := solved0.z,
             qx := solved0.qx, qy := solved0.qy, qz := solved0.qz, qw := solved0.qw) AS solved, {sql_invert("pose", "pose_back")} FROM s WHERE o_orderkey % 3 = 0),
c AS (SELECT o_custkey, o_orderkey AS at, {sql_compose("solved", "pose_back", "fix")} FROM k),
near AS (SELECT s.o_orderkey, any_value(s.pose) AS pose, max(l.at) FILTER (WHERE l.at <= s.o_orderkey) AS t0, min(l.at) FILTER (WHERE l.at >= s.o_orderkey) AS t1, any_value(s.o_custkey) AS o_custkey
         FROM s JOIN c l ON s.o_custkey = l.o_custkey GROUP BY s.o_orderkey),
paired AS (SELECT n.*, a.fix AS a, b.fix AS b, CASE WHEN t1 > t0 THEN (n.o_orderkey - t0) / (t1 - t0)::DOUBLE ELSE 0.0::DOUBLE END AS share
         FROM near n JOIN c a ON a.o_custkey = n.o_custkey AND a.at = coalesce(t0, t1) JOIN c b ON b.o_custkey = n.o_custkey AND b.at = coalesce(t1, t0)),
d AS (SELECT *, {sql_back("a")} AS back FROM paired), e AS (SELECT *, {{{sql_multiply("b", "back")}}} AS rel FROM d), f AS (SELECT *, {sql_power("rel", "share")} AS part FROM e),
h AS (SELECT o_orderkey, pose, {{'x': a.x + share * (b.x - a.x), 'y': a.y + share * (b.y - a.y), 'z': a.z + share * (b.z - a.z), {sql_multiply("part", "a")}}} AS fix FROM f),
p AS (SELECT o_orderkey, {sql_compose("fix", "pose", "p")} FROM h)
SELECT o_orderkey, {sql_shown("p")} FROM p
"""


def deskewed_points(spark, sf_dir):
    """Lineitems as points of their order's scan, which lasts from the pose of the order before to its own: into the
    frame of the scan's end, and by the turn alone into that of its start."""
    s = _scans(spark, sf_dir).where("last IS NOT NULL").select(_ORDER, "last", "pose")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(_ORDER), "l_linenumber", "l_quantity", "l_discount", "l_tax")
    p = l.join(s, _ORDER)
    share = (F.col("l_linenumber") - 1) / 6.0
    v = F.col("l_quantity"), 100.0 * F.col("l_discount"), 100.0 * F.col("l_tax")
    poses = [r.Pose(*[F.col(f"{n}.{f}") for f in r.Pose._fields]) for n in ("last", "pose")]
    p = p.select(_ORDER, "l_linenumber", share.alias("share"), *[c.alias(f"v{n}") for n, c in zip("xyz", v, strict=True)], *poses[0].named("a"), *poses[1].named("b"))
    mounting, moved = (0.1, -0.2, 0.05, 0.0, 0.0, 0.6, 0.8), (0.5, 0.0, -0.25)
    out = motion.deskewed(p, r.pose_of(prefix="a"), r.pose_of(prefix="b"), F.col("share"), [F.col(f"v{n}") for n in "xyz"], mounting, moved, [_ORDER, "l_linenumber"])
    return out.select(_ORDER, "l_linenumber", *[(F.round(F.col(k + a), 4) + 0.0).alias(k + a) for k in "es" for a in "xyz"])


SQL_DESKEW = f"""
WITH p AS (SELECT l.l_orderkey AS o_orderkey, l_linenumber, (l_linenumber - 1) / 6.0::DOUBLE AS share, last, pose, {sql_back("last")} AS last_back, {sql_invert("pose", "pose_back")},
                  {{'x': l_quantity, 'y': 100.0::DOUBLE * l_discount, 'z': 100.0::DOUBLE * l_tax}} AS v,
                  {{'x': 0.1::DOUBLE, 'y': -0.2::DOUBLE, 'z': 0.05::DOUBLE, 'qx': 0.0::DOUBLE, 'qy': 0.0::DOUBLE, 'qz': 0.6::DOUBLE, 'qw': 0.8::DOUBLE}} AS m
           FROM lineitem l JOIN ({_SCANS}) s ON l.l_orderkey = s.o_orderkey WHERE last IS NOT NULL),
a AS (SELECT *, {{{sql_multiply("pose", "last_back")}}} AS rel, {sql_back("m")} AS m0, {{'x': {sql_turned("m", "v")[0]} + m.x, 'y': {sql_turned("m", "v")[1]} + m.y, 'z': {sql_turned("m", "v")[2]} + m.z}} AS i FROM p),
b AS (SELECT *, {sql_power("rel", "share")} AS part FROM a),
c AS (SELECT *, {{'x': last.x + share * (pose.x - last.x), 'y': last.y + share * (pose.y - last.y), 'z': last.z + share * (pose.z - last.z), {sql_multiply("part", "last")}}} AS here FROM b),
d AS (SELECT *, {{'x': {sql_turned("here", "i")[0]} + here.x, 'y': {sql_turned("here", "i")[1]} + here.y, 'z': {sql_turned("here", "i")[2]} + here.z}} AS w, {{{sql_multiply("last_back", "here")}}} AS t FROM c),
e AS (SELECT *, {{'x': {sql_turned("pose_back", "w")[0]} + pose_back.x - m.x, 'y': {sql_turned("pose_back", "w")[1]} + pose_back.y - m.y, 'z': {sql_turned("pose_back", "w")[2]} + pose_back.z - m.z}} AS u,
             {{'x': {sql_turned("t", "i")[0]} - m.x, 'y': {sql_turned("t", "i")[1]} - m.y, 'z': {sql_turned("t", "i")[2]} - m.z}} AS n FROM d)
SELECT o_orderkey, l_linenumber, {", ".join(f"round({c}, 4) + 0.0 AS e{n}" for c, n in zip(sql_turned("m0", "u"), "xyz", strict=True))},
  {", ".join(f"round({c} + {k} * least(1.0::DOUBLE, share), 4) + 0.0 AS s{n}" for c, n, k in zip(sql_turned("m0", "n"), "xyz", ("0.5::DOUBLE", "0.0::DOUBLE", "-0.25::DOUBLE"), strict=True))} FROM e
"""


def gyro_attitude(spark, sf_dir):
    """Events as gyro samples of their user, a day as twelve seconds."""
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    s = e.groupBy(F.col("user_id").alias("capture"), t.alias("t")).agg(F.max("value").alias("v"), F.max("event_id").alias("k"))
    s = s.select("capture", F.floor(F.col("t") / 7.2).alias("stamp"), (F.col("v") / 10.0).alias("gx"), (F.col("k") % 7 - 3.0).alias("gy"), (F.col("k") % 5 - 2.0).alias("gz"))
    s = s.groupBy("capture", "stamp").agg(*[F.max(c).alias(c) for c in ("gx", "gy", "gz")])
    out = motion.integrate_gyro(s, "capture")
    axis = r.rotate([F.col(n) for n in ("qx", "qy", "qz", "qw")], (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return out.select("capture", "stamp", *[(F.round(c, 5) + 0.0).alias(n) for c, n in zip(axis, ("ax", "ay", "az"), strict=True)])


SQL_GYRO = f"""
WITH RECURSIVE e AS (SELECT user_id AS capture, epoch_us(ts)::BIGINT AS t, max(value) AS v, max(event_id) AS k FROM events GROUP BY 1, 2),
s AS (SELECT capture, floor(t / 7.2::DOUBLE)::BIGINT AS stamp, max(v / 10.0::DOUBLE) AS gx, max(k % 7 - 3.0::DOUBLE) AS gy, max(k % 5 - 2.0::DOUBLE) AS gz FROM e GROUP BY 1, 2),
d AS (SELECT capture, stamp, row_number() OVER w AS i, least(0.05::DOUBLE, coalesce((stamp - lag(stamp) OVER w) / 1e9::DOUBLE, 0.0::DOUBLE)) AS dt,
             {", ".join(f"({c} + coalesce(lag({c}) OVER w, {c})) / 2 AS {c}" for c in ("gx", "gy", "gz"))} FROM s WINDOW w AS (PARTITION BY capture ORDER BY stamp)),
a AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) * dt AS angle FROM d),
q AS (SELECT capture, stamp, i, {{'qx': gx * dt * k, 'qy': gy * dt * k, 'qz': gz * dt * k, 'qw': cos(angle / 2)}} AS q FROM (SELECT *, CASE WHEN angle > 1e-12 THEN sin(angle / 2) / angle ELSE 0.5::DOUBLE END AS k FROM a)),
f AS (SELECT capture, stamp, i, q AS p FROM q WHERE i = 1 UNION ALL
      SELECT q.capture, q.stamp, q.i, {{{sql_multiply("f.p", "q.q")}}} AS p FROM f JOIN q ON q.capture = f.capture AND q.i = f.i + 1)
SELECT capture, stamp, {", ".join(f"round({c}, 5) + 0.0 AS a{n}" for c, n in zip(("1 - 2 * (p.qy * p.qy + p.qz * p.qz)", "2 * (p.qx * p.qy + p.qz * p.qw)", "2 * (p.qx * p.qz - p.qy * p.qw)"), "xyz", strict=True))} FROM f
"""


def colour_fanout(spark, sf_dir):
    """One cloud as three products: mixed (image colours where seen, depth colours elsewhere), lidar and rgb."""
    p = cloud(spark, sf_dir).withColumn("z", F.col("z") + 1.0)
    out = imaging.fan_out(p, _grid(spark).where("image = 0"), SMALL, reach=g.norm(*[F.col(a) * 40.0 for a in "xyz"]), key="vec_id")
    return out.select("vec_id", "product", "red", "green", "blue")


_DEPTH = sql_colour(f"SELECT vec_id, sqrt(x * x + y * y + (z + 1.0::DOUBLE) * (z + 1.0::DOUBLE)) * 40.0::DOUBLE AS r FROM ({SQL_POINTS})", "r", "vec_id", 9)
_S = SMALL
SQL_FANOUT = f"""
WITH seen AS ({SQL_VISIBLE}),
uv AS (SELECT vec_id, {_S.fx}::DOUBLE * (x / (z + 1.0::DOUBLE)) + {_S.cx} AS u, {_S.fy}::DOUBLE * (y / (z + 1.0::DOUBLE)) + {_S.cy} AS v FROM ({SQL_POINTS}) WHERE vec_id IN (SELECT vec_id FROM seen)),
c AS (SELECT *, floor(u)::BIGINT + i AS px, floor(v)::BIGINT + j AS py,
             (CASE i WHEN 1 THEN u - floor(u) ELSE 1.0::DOUBLE - (u - floor(u)) END) * (CASE j WHEN 1 THEN v - floor(v) ELSE 1.0::DOUBLE - (v - floor(v)) END) AS w FROM uv, range(2) a(i), range(2) b(j)),
rgb AS (SELECT vec_id, {", ".join(f"least(255, greatest(0, floor(sum({k} * w) + 0.5)))::DOUBLE AS {n}" for k, n in zip("rgb", ("red", "green", "blue"), strict=True))} FROM c JOIN ({SQL_GRID}) p ON p.image = 0 AND p.px = c.px AND p.py = c.py GROUP BY vec_id HAVING count(*) = 4),
depth AS (SELECT vec_id, red, green, blue FROM ({_DEPTH}))
SELECT vec_id, 'lidar' AS product, round(red, 3) AS red, round(green, 3) AS green, round(blue, 3) AS blue FROM depth
UNION ALL SELECT vec_id, 'rgb', red, green, blue FROM rgb
UNION ALL SELECT d.vec_id, 'mixed', {", ".join(f"coalesce(r.{n}, floor(d.{n} + 0.5))" for n in ("red", "green", "blue"))} FROM depth d LEFT JOIN rgb r ON d.vec_id = r.vec_id
"""


def recent_map(spark, sf_dir):
    """The last twelve frames of each label as one cloud, thinned by voxels."""
    p = cloud(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 2).alias("frame")), "vec_id")
    kept = motion.last_frames(p, ["label"], "frame", 12)
    return voxel.centroids(kept, 0.2, by=["label"]).select("label", *voxel.KEY, *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"], "n")


SQL_RECENT = f"""
WITH p AS (SELECT e.label, c.vec_id // 2 AS frame, x, y, z FROM ({SQL_POINTS}) c JOIN embeddings e ON e.vec_id = c.vec_id),
k AS (SELECT label, frame FROM (SELECT label, frame, row_number() OVER (PARTITION BY label ORDER BY frame DESC) AS r FROM (SELECT DISTINCT label, frame FROM p)) WHERE r <= 12)
SELECT label, vx, vy, vz, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, count(*)::BIGINT AS n
FROM (SELECT p.*, {sql_cells(0.2)} FROM p JOIN k USING (label, frame)) GROUP BY label, vx, vy, vz
"""


def final_refinement(spark, sf_dir):
    """Scans that take the pose of a second registration where that one is good."""
    from ..operators import registration

    s, k = _scans(spark, sf_dir), F.col(_ORDER)
    scans = s.select(_ORDER, "pose", (k % 10 / 10.0).alias("fitness"), (k % 8 / 40.0).alias("rmse"))
    found = s.select(_ORDER, _solved(k).packed().alias("pose"), (k % 4 / 10.0 + 0.5).alias("fitness"), (k % 9 / 100.0).alias("rmse"), (k % 6 / 40.0).alias("moved"), (k % 7 / 2.0).alias("turned"))
    good = registration.good_refinement(*[F.col(c) for c in ("fitness", "rmse", "moved", "turned")])
    out = motion.refined(scans, found, [_ORDER], good)
    return out.select(_ORDER, r6(F.col("pose.x"), "x"), "fitness", "rmse", "refined")


SQL_REFINED = """
SELECT o_orderkey, round(CASE WHEN ok THEN o_orderkey % 17 / 4.0::DOUBLE + o_orderkey % 3 / 16.0::DOUBLE ELSE o_orderkey % 17 / 4.0::DOUBLE END, 6) AS x,
  CASE WHEN ok THEN f1 ELSE o_orderkey % 10 / 10.0::DOUBLE END AS fitness, CASE WHEN ok THEN r1 ELSE o_orderkey % 8 / 40.0::DOUBLE END AS rmse, ok AS refined
FROM (SELECT *, f1 >= 0.70::DOUBLE AND r1 <= 0.06::DOUBLE AND o_orderkey % 6 / 40.0::DOUBLE <= 0.10::DOUBLE AND o_orderkey % 7 / 2.0::DOUBLE <= 2.5 AS ok
      FROM (SELECT o_orderkey, o_orderkey % 4 / 10.0::DOUBLE + 0.5::DOUBLE AS f1, o_orderkey % 9 / 100.0::DOUBLE AS r1 FROM orders))
"""

QUERIES = {f.__name__: f for f in (
    pose_predict, turn_gate, graph_sanity_turns, correction_interp, deskewed_points, gyro_attitude, colour_fanout, recent_map, final_refinement)}
ORACLE_SQL = {
    "pose_predict": SQL_PREDICT, "turn_gate": SQL_TURN_GATE, "graph_sanity_turns": SQL_SANITY_TURNS, "correction_interp": SQL_CORRECTION, "deskewed_points": SQL_DESKEW,
    "gyro_attitude": SQL_GYRO, "colour_fanout": SQL_FANOUT, "recent_map": SQL_RECENT, "final_refinement": SQL_REFINED,
}
