"""Images and visibility: z-buffers, bilinear samples and sharpness over pixel tables, without leaving the JVM.

A pixel table has an image key and one row for each pixel; Spark's `image` source unpacks to one with `pixels_of`. Whole
photographs are better kept as tiles (`tiles_of`): a row holds 64 x 64 pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import stash


def _nearby(df: DataFrame, column: str, reach: int, most: int) -> DataFrame:
    """df once for each value within reach of `column`, inside 0 .. most - 1."""
    steps = F.sequence(F.greatest(F.lit(0), F.col(column) - reach), F.least(F.lit(most - 1), F.col(column) + reach))
    return df.withColumn(column, F.explode(steps))


def visible(points: DataFrame, camera: g.Camera, by: list[str] | None = None, slack: float = 0.06, share: float = 0.015) -> DataFrame:
    """The points in the camera's frame (by, x, y, z) that no nearer point hides, with u, v, depth.

    Each point covers the 3x3 pixels around its own and is compared with the nearest depth over the 3x3 around it,
    which together are 5x5. Depths are first reduced to one a pixel, then widened along rows and along columns."""
    by = by or []
    u, v, inside = g.project(F.col("x"), F.col("y"), F.col("z"), camera)
    seen = points.where((F.col("z") > camera.nearest) & inside).select("*", u.alias("u"), v.alias("v"), F.col("z").alias("depth"))

    def pixel(c, most):
        return F.least(F.lit(most - 1), F.greatest(F.lit(0), F.floor(F.col(c) + 0.5).cast("int")))

    seen = seen.withColumns({"_px": pixel("u", camera.width), "_py": pixel("v", camera.height)})
    keys = [*by, "_px", "_py"]
    least = lambda df: df.groupBy(*keys).agg(F.min("_near").alias("_near"))
    buffer = least(seen.select(*keys, F.col("depth").cast("float").alias("_near")))
    for column, most in (("_px", camera.width), ("_py", camera.height)):
        buffer = least(_nearby(buffer, column, 2, most))
    shown = seen.join(buffer, keys).where(F.col("depth") <= F.col("_near") + F.greatest(F.lit(slack), F.col("depth") * share))
    return shown.drop("_px", "_py", "_near")


def bilinear(points: DataFrame, pixels: DataFrame, by: list[str] | None = None, bands=("r", "g", "b")) -> DataFrame:
    """points (by, u, v) with the bands blended from the four pixels (by, px, py, bands) around, rounded, 0 to 255.
    Points without four pixels get null."""
    by = by or []
    x0, y0 = F.floor("u").cast("int"), F.floor("v").cast("int")
    dx, dy = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    corners = F.array(*[
        F.struct((x0 + i).alias("px"), (y0 + j).alias("py"), ((dx if i else 1.0 - dx) * (dy if j else 1.0 - dy)).alias("share")) for j in (0, 1) for i in (0, 1)
    ])
    # Equal places of one image get equal colours, so they are sampled once.
    places = points.select(*by, "u", "v").distinct()
    asked = places.select(*by, "u", "v", F.explode(corners).alias("c")).select(*by, "u", "v", "c.*")
    found = asked.join(pixels.select(*by, "px", "py", *bands), [*by, "px", "py"])
    blended = found.groupBy(*by, "u", "v").agg(F.count("*").alias("_n"), *[F.sum(F.col(b) * F.col("share")).alias(b) for b in bands]).where("_n = 4")
    byte = [F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col(b) + 0.5).cast("int"))).alias(b) for b in bands]
    return points.join(blended.select(*by, "u", "v", *byte), [*by, "u", "v"], "left")


TILE = 64
PLACES = 4096  # of a tile that are sampled together
_SIDE = TILE + 1


def tiles_of(images: DataFrame) -> DataFrame:
    """origin, tx, ty, data of rows of Spark's image source: 64 x 64 pixels a tile and one more column and row, those of the
    neighbours, so that every blend of four pixels lies in one tile. data: 65 x 65 x (r, g, b, 255 where the image has a pixel)."""

    def run(batches):
        for pdf in batches:
            for im in pdf["image"]:
                high, wide = im["height"], im["width"]
                raw = np.frombuffer(im["data"], np.uint8).reshape(high, wide, im["nChannels"])
                for ty in range(-(-high // TILE)):
                    band, out = raw[ty * TILE : ty * TILE + _SIDE], []
                    for tx in range(-(-wide // TILE)):
                        part = band[:, tx * TILE : tx * TILE + _SIDE]
                        tile = np.zeros((_SIDE, _SIDE, 4), np.uint8)
                        tile[: part.shape[0], : part.shape[1], :3] = part[:, :, 2::-1] if part.shape[2] >= 3 else part[:, :, :1]
                        tile[: part.shape[0], : part.shape[1], 3] = 255
                        out.append((im["origin"], tx, ty, tile.tobytes()))
                    yield pd.DataFrame(out, columns=["origin", "tx", "ty", "data"])

    return images.select("image").mapInPandas(run, "origin string, tx int, ty int, data binary")


def tiled(pixels: DataFrame, by: list[str] | None = None, bands=("r", "g", "b")) -> DataFrame:
    """by, tx, ty, data (see tiles_of) of a pixel table (by, px, py, bands from 0 to 255), which may have gaps. Pixels left
    of or above the image are left out, as are repeats of a pixel."""
    by = by or []
    tile = lambda c: F.floor(F.col(c) / TILE)
    # The first column and row of a tile are the last ones of the tile before, too.
    sides = lambda c: F.when((F.col(c) % TILE == 0) & (F.col(c) > 0), F.array(tile(c), tile(c) - 1)).otherwise(F.array(tile(c)))
    known = pixels.where((F.col("px") >= 0) & (F.col("py") >= 0) & F.greatest(*[F.col(b).isNull().cast("int") for b in bands]).eqNullSafe(0))
    spread = known.withColumn("tx", F.explode(sides("px"))).withColumn("ty", F.explode(sides("py")))
    place = (F.col("py") - F.col("ty") * TILE) * _SIDE + F.col("px") - F.col("tx") * TILE
    at = F.struct(place.cast("int").alias("at"), *[F.col(b).cast("int").alias(b) for b in bands])
    kinds = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in by)
    grouped = spread.groupBy(*by, F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty")).agg(F.collect_set(at).alias("pixels"))

    def run(batches):
        for b in batches:
            lists = b.column("pixels")
            data = []
            for i in range(b.num_rows):
                cells = lists[i].values
                tile = np.zeros((_SIDE * _SIDE, 4), np.uint8)
                columns = cells.flatten()
                where = columns[0].to_numpy()
                for k in range(3):
                    tile[where, k] = columns[1 + k].to_numpy()
                tile[where, 3] = 255
                data.append(tile.tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in (*by, "tx", "ty")], pa.array(data, pa.binary())], names=[*by, "tx", "ty", "data"])

    return grouped.mapInArrow(run, ", ".join(filter(None, [kinds, "tx int, ty int, data binary"])))


def blended(tile: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 3 bytes, which of them are known) of places inside a tile."""
    x, y = np.floor(u), np.floor(v)
    dx, dy, x, y = u - x, v - y, x.astype(np.int64) % TILE, y.astype(np.int64) % TILE
    shares = ((1 - dx) * (1 - dy), dx * (1 - dy), (1 - dx) * dy, dx * dy)
    corners = [tile[y + j, x + i] for j in (0, 1) for i in (0, 1)]
    total = sum(c[:, :3] * s[:, None] for c, s in zip(corners, shares, strict=True))
    return np.clip(np.floor(total + 0.5), 0, 255).astype(np.int32), np.all([c[:, 3] == 255 for c in corners], axis=0)


def bilinear_tiles(points: DataFrame, tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What `bilinear` gives with the pixels of tiles (by, tx, ty, data). Points without place or without four pixels get null.

    Equal places of one image are sampled once, and up to some 4096 of a tile are one row of arrays that meets the tile; a
    tile that many points fall on is met by as many rows, so none gathers them all."""
    by = by or []
    places = points.select(*by, "u", "v").where("u >= 0 AND v >= 0 AND NOT isnan(u) AND NOT isnan(v)").distinct()
    placed = places.select(*by, F.floor(F.col("u") / TILE).cast("int").alias("tx"), F.floor(F.col("v") / TILE).cast("int").alias("ty"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    keys = [*by, "tx", "ty"]
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("_n") / PLACES)).alias("_part")
    rows = placed.join(sizes, keys).select(*keys, part, "u", "v").groupBy(*keys, "_part").agg(F.collect_list(F.struct("u", "v")).alias("at"))
    kinds = "".join(f"`{k}` {points.schema[k].dataType.simpleString()}, " for k in by)

    def run(batches):
        for b in batches:
            ats, data = b.column("at"), b.column("data")
            for i in range(b.num_rows):
                u, v = (c.to_numpy() for c in ats[i].values.flatten())
                rgb, known = blended(np.frombuffer(data[i].as_buffer(), np.uint8).reshape(_SIDE, _SIDE, 4), u, v)
                which = pa.array(np.full(int(known.sum()), i))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k).take(which) for k in by], pa.array(u[known]), pa.array(v[known]), *[pa.array(rgb[known, k]) for k in range(3)]], names=[*by, "u", "v", "r", "g", "b"]
                )

    sampled = rows.join(tiles.select(*keys, "data"), keys).select(*by, "data", "at").mapInArrow(run, f"{kinds}u double, v double, r int, g int, b int")
    # Stashing hands Python small batches, so few tiles are in memory at a time.
    return points.join(stash(sampled, "sampled"), [*by, "u", "v"], "left")


COLOURS = ("red", "green", "blue")


def fan_out(points: DataFrame, pixels: DataFrame, camera: g.Camera, reach: Column, by: list[str] | None = None, usable: Column | None = None, key: str | None = None, near: float = 0.0, far: float = 180.0, gamma: float = 0.62, bands: int = 256) -> DataFrame:
    """Each point (by, x, y, z in the camera's frame, other columns) in up to three products: `lidar`, coloured by its
    range `reach`; `rgb`, where its image (by, px, py, r, g, b, or its tiles, see tiles_of) shows it; and `mixed`, by its image where that shows
    it, else by its range in whole numbers. usable: a condition of points whose image may be used (see usable_image); key:
    a column that tells points apart; without one, the points are numbered and written to the shared folder."""
    by = by or []
    tinted = points.select("*", *[c.alias(f"_{n}") for c, n in zip(g.depth_colour(reach, near, far, gamma, bands), COLOURS, strict=True)])
    tinted = tinted.withColumn("_use", F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)))
    keyed = tinted.withColumn("_point", F.col(key)) if key else stash(tinted.withColumn("_point", F.monotonically_increasing_id()), "points")
    seen = visible(keyed.where("_use").select(*by, "x", "y", "z", "_point"), camera, by)
    sample = bilinear_tiles if "data" in pixels.columns else bilinear
    coloured = sample(seen.select(*by, "u", "v", "_point"), pixels, by).where("r IS NOT NULL").select(F.col("_point").alias("_p"), "r", "g", "b")
    joined = keyed.join(coloured, F.col("_point") == F.col("_p"), "left")
    whole = [F.coalesce(F.col(c), F.floor(F.col(f"_{n}") + 0.5)).cast("double").alias(n) for c, n in zip("rgb", COLOURS, strict=True)]
    one = lambda name, cols, when: F.when(when, F.struct(F.lit(name).alias("product"), *cols))
    image = [F.col(c).cast("double").alias(n) for c, n in zip("rgb", COLOURS, strict=True)]
    outputs = F.filter(F.array(
        one("mixed", whole, F.lit(True)), one("lidar", [F.round(f"_{n}", 3).alias(n) for n in COLOURS], F.lit(True)), one("rgb", image, F.col("r").isNotNull())
    ), lambda o: o.isNotNull())
    return joined.select(*points.columns, F.explode(outputs).alias("_o")).select(*points.columns, "_o.*")


def laplacian_variance(pixels: DataFrame, by: list[str], value: str = "grey") -> DataFrame:
    """by, sharpness: the population variance of the 4-neighbour Laplacian over the inner pixels. Every pixel sends its
    share to itself and its neighbours; whoever gets all five is inner. One shuffle, no sort."""
    v = F.col(value)
    shares = F.array(*[F.struct((F.col("px") + i).alias("px"), (F.col("py") + j).alias("py"), (v * w).alias("w")) for i, j, w in ((0, 0, 4), (1, 0, -1), (-1, 0, -1), (0, 1, -1), (0, -1, -1))])
    sums = pixels.select(*by, F.explode(shares).alias("s")).groupBy(*by, F.col("s.px"), F.col("s.py")).agg(F.sum("s.w").alias("_lap"), F.count("*").alias("_n"))
    return sums.where("_n = 5").groupBy(*by).agg(F.when(F.count("*") < 2, 0.0).otherwise(F.var_pop("_lap")).alias("sharpness"))


def image_sharpness(images: DataFrame, wide: int = 320, high: int = 240) -> DataFrame:
    """origin, width, height, sharpness of rows of Spark's image source, each scaled down by whole strides to at most
    wide x high grey pixels; 0 where fewer than 5 remain along a side. One image is one row, so this is a map."""

    def run(batches):
        for pdf in batches:
            out = []
            for im in pdf["image"]:
                raw = np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"], im["nChannels"])[:, :, :3].astype(np.int32)
                step = max(1, -(-im["width"] // wide), -(-im["height"] // high))
                bgr = raw[::step, ::step]
                grey = (bgr[:, :, -1] * 11 + bgr[:, :, bgr.shape[2] // 2] * 16 + bgr[:, :, 0] * 5) // 32
                score = 0.0
                if min(grey.shape) >= 5:
                    lap = 4 * grey[1:-1, 1:-1] - grey[1:-1, :-2] - grey[1:-1, 2:] - grey[:-2, 1:-1] - grey[2:, 1:-1]
                    score = float(lap.var())
                out.append((im["origin"], im["width"], im["height"], score))
            yield pd.DataFrame(out, columns=["origin", "width", "height", "sharpness"])

    return images.select("image").mapInPandas(run, "origin string, width int, height int, sharpness double")


def pixels_of(images: DataFrame) -> DataFrame:
    """origin, px, py, r, g, b of rows of Spark's image source, unpacked inside the JVM."""
    im, n = F.col("image"), F.col("image.nChannels")
    at = images.select(im, F.explode(F.sequence(F.lit(0), F.col("image.width") * F.col("image.height") - 1)).alias("i"))

    def byte(k: Column):
        return F.conv(F.hex(F.substring(F.col("image.data"), (F.col("i") * n + k + 1), F.lit(1))), 16, 10).cast("int")

    three = n >= 3
    return at.select(
        F.col("image.origin").alias("origin"), (F.col("i") % F.col("image.width")).alias("px"), F.floor(F.col("i") / F.col("image.width")).cast("int").alias("py"),
        byte(F.when(three, 2).otherwise(0)).alias("r"), byte(F.when(three, 1).otherwise(0)).alias("g"), byte(F.lit(0)).alias("b"),
    )


def usable_image(gap_ns: Column, exists: Column, sharpness: Column, most_ns: int = 300_000_000, least: float = 12.0) -> Column:
    """Whether a scan may be coloured by its image."""
    return F.coalesce((F.abs(gap_ns) <= most_ns) & exists & (sharpness >= least), F.lit(False))
