"""Images as tiles: the colours that pixel tables give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepmill.functions import geometry as g
from sweepmill.operators import imaging

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def image(origin, high, wide, channels, seed):
    raw = np.random.default_rng(seed).integers(0, 256, (high, wide, channels), np.uint8)
    return ((origin, high, wide, channels, 16, bytearray(raw.tobytes())),)


def same(a, b):
    order = lambda df: sorted(tuple(r) for r in df.fillna({c: -1 for c in "rgb"}).collect())
    return order(a) == order(b)


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame([image("a", 70, 131, 3, 1), image("grey", 64, 64, 1, 2), image("alpha", 2, 200, 4, 3), image("dot", 1, 1, 3, 4)], IMAGE)


def test_tiles_give_the_colours_of_pixels(spark, images):
    # Eighths, so that no order of sums matters; edges of tiles and of images, and places outside.
    k = F.col("id")
    spots = spark.range(6000).select(F.element_at(F.array(*map(F.lit, ("a", "grey", "alpha", "dot", "none"))), (k % 5 + 1).cast("int")).alias("origin"), (k * 7 % 1100 / 8.0 - 1).alias("u"), (k * 11 % 600 / 8.0 - 1).alias("v"))
    edges = spark.createDataFrame([("a", u, v) for u in (0.0, 62.5, 63.0, 63.5, 64.0, 127.5, 129.0, 129.875, 130.0) for v in (0.0, 63.25, 64.0, 68.5, 69.0)], "origin string, u double, v double")
    points = spots.unionByName(edges).unionByName(edges)
    pixels = imaging.pixels_of(images)
    expected = imaging.bilinear(points, pixels, ["origin"])
    assert expected.where("r IS NOT NULL").count() > 1000
    assert same(imaging.bilinear_tiles(points, imaging.tiles_of(images), ["origin"]), expected)
    assert same(imaging.bilinear_tiles(points, imaging.tiled(pixels, ["origin"]), ["origin"]), expected)


def test_gaps_and_missing_places(spark, images):
    pixels = imaging.pixels_of(images).where("NOT (origin = 'a' AND px = 64 AND py = 10)")
    points = spark.createDataFrame([("a", u, 9.5) for u in (62.5, 63.5, 64.5, 65.5, None, math.nan, -0.5)] + [(None, 1.0, 1.0)], "origin string, u double, v double")
    got = imaging.bilinear_tiles(points, imaging.tiled(pixels, ["origin"]), ["origin"]).where("origin IS NOT NULL AND u > 0 AND NOT isnan(u)").orderBy("u").collect()
    assert [r["r"] is None for r in got] == [False, True, True, False]
    assert imaging.bilinear_tiles(points, imaging.tiled(pixels, ["origin"]), ["origin"]).count() == 8
    assert imaging.bilinear_tiles(points.limit(0), imaging.tiles_of(images), ["origin"]).count() == 0


def test_twelve_megapixels_are_three_thousand_rows(spark):
    tiles = imaging.tiles_of(spark.createDataFrame([image("big", 3000, 4000, 3, 5)], IMAGE))
    assert tiles.agg(F.count("*"), F.max(F.length("data"))).first()[:] == (63 * 47, 65 * 65 * 4)


def test_a_tile_that_all_points_fall_on(spark, images):
    points = spark.range(50_000).select(F.lit("a").alias("origin"), (F.col("id") % 250 / 8.0).alias("u"), (F.floor(F.col("id") / 250) / 8.0).alias("v"))
    assert same(imaging.bilinear_tiles(points, imaging.tiles_of(images), ["origin"]), imaging.bilinear(points, imaging.pixels_of(images), ["origin"]))


def test_products_from_tiles(spark, images):
    camera = g.Camera(fx=30.0, fy=30.0, cx=60.0, cy=30.0, width=131, height=70)
    points = spark.range(400).select(F.lit("a").alias("origin"), F.col("id"), (F.col("id") % 20 / 16.0 - 0.5).alias("x"), (F.floor(F.col("id") / 20) / 16.0 - 0.5).alias("y"), F.lit(2.0).alias("z"))
    made = [sorted(tuple(r) for r in imaging.fan_out(points, p, camera, F.col("z"), ["origin"], key="id").collect()) for p in (imaging.pixels_of(images), imaging.tiles_of(images))]
    assert made[0] == made[1] and len(made[0]) > 1000
