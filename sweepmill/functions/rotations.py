"""Poses as column expressions: a position and a unit quaternion (x y z, qx qy qz qw).

Products of products grow fast as expressions, each factor being written out several times; `let` names a value for what
follows, so long chains stay as short as they read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Pose(NamedTuple):
    x: Column
    y: Column
    z: Column
    qx: Column
    qy: Column
    qz: Column
    qw: Column

    @property
    def position(self) -> tuple[Column, Column, Column]:
        return self[:3]

    @property
    def rotation(self) -> tuple[Column, Column, Column, Column]:
        return self[3:]

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self, self._fields, strict=True)]

    def packed(self) -> Column:
        return F.struct(*self.named())


def pose_of(struct: Column | str | None = None, prefix: str = "") -> Pose:
    """The pose in a struct column, or in columns of these names after a prefix."""
    if struct is None:
        return Pose(*[F.col(prefix + n) for n in Pose._fields])
    struct = F.col(struct) if isinstance(struct, str) else struct
    return Pose(*[struct[n] for n in Pose._fields])


def let(value: Column, of) -> Column:
    """of(value), where the value is computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def turn(q) -> Column:
    """A rotation as a struct."""
    return F.struct(*[c.alias(n) for c, n in zip(q, Pose._fields[3:], strict=True)])


def turn_of(struct: Column) -> tuple[Column, ...]:
    return tuple(struct[n] for n in Pose._fields[3:])


def multiply(a, b) -> tuple[Column, ...]:
    """The rotation b, then a."""
    (x, y, z, w), (p, q, r, s) = a, b
    return (w * p + x * s + y * r - z * q, w * q - x * r + y * s + z * p, w * r + x * q - y * p + z * s, w * s - x * p - y * q - z * r)


def conjugate(q) -> tuple[Column, ...]:
    return (-q[0], -q[1], -q[2], q[3])


def rotate(q, v) -> tuple[Column, Column, Column]:
    x, y, z, w = q
    a, b, c = v
    # v + 2 w (q x v) + 2 q x (q x v)
    s, t, u = y * c - z * b, z * a - x * c, x * b - y * a
    return (a + 2.0 * (w * s + y * u - z * t), b + 2.0 * (w * t + z * s - x * u), c + 2.0 * (w * u + x * t - y * s))


def compose(a: Pose, b: Pose) -> Pose:
    """The pose b, then a: the product A B of their matrices."""
    moved = rotate(a.rotation, b.position)
    return Pose(*[m + p for m, p in zip(moved, a.position, strict=True)], *multiply(a.rotation, b.rotation))


def invert(a: Pose) -> Pose:
    back = conjugate(a.rotation)
    return Pose(*[-c for c in rotate(back, a.position)], *back)


def length(v) -> Column:
    return F.sqrt(sum((c * c for c in v[1:]), v[0] * v[0]))


def degrees(q) -> Column:
    """The angle of a rotation, 0 to 180."""
    return F.degrees(2.0 * F.atan2(length(q[:3]), F.abs(q[3])))


def power(q, share: Column) -> tuple[Column, ...]:
    """The rotation about the same axis by `share` times the angle, taken the shorter way round."""
    side = F.when(q[3] < 0, -1.0).otherwise(1.0)
    sine = length(q[:3])
    half = F.atan2(sine, F.abs(q[3])) * share
    scale = F.when(sine > 1e-12, side * F.sin(half) / sine).otherwise(0.0)
    return (q[0] * scale, q[1] * scale, q[2] * scale, F.cos(half))


def between(a: Pose, b: Pose, share: Column) -> Column:
    """The pose a part of the way from a to b, as a struct: positions straight, rotations along the shorter arc."""
    place = [p + share * (q - p) for p, q in zip(a.position, b.position, strict=True)]
    whole = turn(multiply(b.rotation, conjugate(a.rotation)))
    part = let(whole, lambda w: turn(power(turn_of(w), share)))
    return let(part, lambda t: Pose(*place, *multiply(turn_of(t), a.rotation)).packed())


def point(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def outward(pose: Pose, v: Column) -> Column:
    """The point v (a struct) of the pose's own frame in the frame that the pose is given in."""
    return let(v, lambda p: point(*[a + b for a, b in zip(rotate(pose.rotation, (p["x"], p["y"], p["z"])), pose.position, strict=True)]))


def inward(pose: Pose, v: Column) -> Column:
    """The reverse of outward."""
    return let(v, lambda p: point(*rotate(conjugate(pose.rotation), [p[n] - c for n, c in zip("xyz", pose.position, strict=True)])))
