"""Column expressions of points, poses, cameras and colours; all stay inside whole-stage code generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(v: Column, size: float, single: bool = False) -> Column:
    """Index of the cell of edge `size` that holds v. single: divide in single precision, as fusion does."""
    q = v / F.lit(size)
    return F.floor(q.cast("float") if single else q).cast("long")


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def finite(*parts: Column) -> Column:
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    return ok


def in_range(x: Column, y: Column, z: Column, blind: float = 0.8, reach: float = 60.0) -> Column:
    """Finite and neither closer than blind nor farther than reach."""
    r = norm(x, y, z)
    return finite(x, y, z) & (r >= blind) & (r <= reach)


def transform(x: Column, y: Column, z: Column, pose) -> tuple[Column, Column, Column]:
    """R p + t. pose: 3 or 4 rows of 4, of numbers or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return tuple(lit(r[0]) * x + lit(r[1]) * y + lit(r[2]) * z + lit(r[3]) for r in pose[:3])


def rotation_degrees(trace: Column) -> Column:
    """Angle of a rotation from the trace of its matrix."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1.0) / 2.0))))


@dataclass(frozen=True)
class Camera:
    """Pinhole with radial (k1, k2, k3) and tangential (p1, p2) distortion."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    k1: float = 0.0
    k2: float = 0.0
    p1: float = 0.0
    p2: float = 0.0
    k3: float = 0.0
    nearest: float = 0.15


def project(x: Column, y: Column, z: Column, camera: Camera) -> tuple[Column, Column, Column]:
    """Pixel coordinates u, v of a point in the camera's frame, and whether it falls inside the usable image: deeper
    than `nearest`, at least one pixel from the left and top border and two from the others."""
    a, b = x / z, y / z
    r2 = a * a + b * b
    stretch = 1.0 + camera.k1 * r2 + camera.k2 * r2 * r2 + camera.k3 * r2 * r2 * r2
    u = camera.fx * (a * stretch + 2.0 * camera.p1 * a * b + camera.p2 * (r2 + 2.0 * a * a)) + camera.cx
    v = camera.fy * (b * stretch + camera.p1 * (r2 + 2.0 * b * b) + 2.0 * camera.p2 * a * b) + camera.cy
    inside = (z > camera.nearest) & (u >= 1.0) & (u < camera.width - 2.0) & (v >= 1.0) & (v < camera.height - 2.0)
    return u, v, inside


def depth_colour(r: Column, near: float = 0.0, far: float = 180.0, gamma: float = 0.62, bands: int = 256) -> list[Column]:
    """Red, green, blue (0 to 255, double) of a range: near violet-blue, far red, in `bands` steps of hue."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r - near) / max(0.001, far - near)))
    t = F.pow(t, F.lit(min(2.0, max(0.15, gamma))))
    if bands > 1:
        t = F.floor(t * (bands - 1) + 0.5) / F.lit(float(bands - 1))
    h = (1.0 - t) * 0.72 * 6.0
    sector = F.least(F.lit(5), F.floor(h).cast("int"))
    f, low = h - sector, 1.0 - 0.92
    falling, rising = 1.0 - 0.92 * f, 1.0 - 0.92 * (1.0 - f)
    pick = lambda *six: F.element_at(F.array(*[s if isinstance(s, Column) else F.lit(s) for s in six]), sector + 1) * 255.0
    return [
        pick(1.0, falling, low, low, rising, 1.0),
        pick(rising, 1.0, 1.0, falling, low, low),
        pick(low, low, rising, 1.0, 1.0, falling),
    ]


def view_rotation(x: Column, y: Column, z: Column, degrees_x: float, degrees_y: float, degrees_z: float):
    """A cloud turned about the z, then the x, then the y axis, for an orthographic view."""
    import math

    c, s = [math.cos(math.radians(d)) for d in (degrees_x, degrees_y, degrees_z)], [math.sin(math.radians(d)) for d in (degrees_x, degrees_y, degrees_z)]
    x, y = c[2] * x - s[2] * y, s[2] * x + c[2] * y
    y, z = c[0] * y - s[0] * z, s[0] * y + c[0] * z
    x, z = c[1] * x + s[1] * z, -s[1] * x + c[1] * z
    return x, y, z
