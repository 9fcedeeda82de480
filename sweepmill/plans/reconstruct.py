"""From a decoded, posed capture to its products: one lazy plan from points to filtered, coloured voxel maps.

    python -m sweepmill.plans.reconstruct POINTS POSES OUT [--map-voxel 0.01 ...]

POINTS (Parquet): capture, scan_index, stamp (ns), x, y, z in the sensor's frame. POSES (Parquet): capture, stamp,
x, y, z, qx, qy, qz, qw of the sensor in the world, at least at every sweep's ends. Each point is moved by the pose
interpolated at its own time, which also undoes the motion within a sweep.

With images there are three products: `mixed`, coloured by the images where these show a point and by range elsewhere,
`lidar`, by range alone, and `rgb`, only what the images show."""

from __future__ import annotations

import argparse
import dataclasses
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import fusion, graphs, imaging, motion, neighbours, voxel
from ..session import exists, stash, stash_counted, unstash
from ..sources import files

POSE = graphs.POSE


@dataclass(frozen=True)
class Options:
    """Settings of the products. The defaults."""

    map_voxel: float = 0.01
    lidar_map_voxel: float = 0.015
    blind: float = 0.8
    max_range: float = 60.0
    lidar_color_near: float = 0.0
    lidar_color_far: float = 180.0
    lidar_color_gamma: float = 0.62
    lidar_color_bands: int = 256
    isolation_radius: float = 0.08
    isolation_min_neighbors: int = 2
    edge_plane_denoise: bool = True
    edge_plane_k: int = 20
    edge_plane_residual: float = 0.025
    edge_planarity_ratio: float = 0.08
    denoise_std: float = 1.8
    denoise_mean_k: int = 20
    denoise_tile_size: float = 4.0
    export_normals: bool = False
    normal_radius: float = 0.08
    max_scans: int = 0
    least_points: int = 100
    min_image_sharpness: float = 12.0
    fusion_batch_scans: int = 0

    def __post_init__(self):
        positive = ("map_voxel", "lidar_map_voxel", "max_range", "denoise_tile_size", "normal_radius")
        for name in positive:
            if not 0 < getattr(self, name) < float("inf"):
                raise ValueError(f"{name} must be positive")
        for name in ("blind", "isolation_radius", "denoise_std", "max_scans", "isolation_min_neighbors", "least_points", "min_image_sharpness"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.blind >= self.max_range or self.lidar_color_near >= self.lidar_color_far:
            raise ValueError("ranges must not be empty")
        if not 1 <= self.lidar_color_bands <= 4096 or self.edge_plane_k < 6 or self.denoise_mean_k < 1:
            raise ValueError("bands, edge_plane_k or denoise_mean_k out of range")


def posed(points: DataFrame, poses: DataFrame, bucket_ns: int = 1_000_000_000) -> DataFrame:
    """points with wx, wy, wz in the world; a point before the first or after the last pose of its capture is moved by
    that one, and a capture without poses has no points. Pairs of consecutive poses are listed by second, so points meet
    them in one equi-join and are never sorted."""
    w = Window.partitionBy("capture").orderBy("_t0")
    at = poses.select("capture", F.col("stamp").alias("_t0"), F.struct(*POSE).alias("_p0"))
    pairs = at.select("*", F.lead("_t0").over(w).alias("_t1"), F.lead("_p0").over(w).alias("_p1")).where("_t1 > _t0")
    spread = pairs.select("*", F.explode(F.sequence(F.floor(F.col("_t0") / bucket_ns), F.floor(F.col("_t1") / bucket_ns))).alias("_b"))
    listed = spread.groupBy("capture", "_b").agg(F.collect_list(F.struct("_t0", "_p0", "_t1", "_p1")).alias("_pairs"))
    ends = at.groupBy("capture").agg(F.min(F.struct("_t0", "_p0")).alias("_lo"), F.max(F.struct("_t0", "_p0")).alias("_hi"))
    t = F.col("stamp")
    # The last pose closes its pair.
    hit = F.try_element_at(F.filter("_pairs", lambda p: (p["_t0"] <= t) & (t <= p["_t1"])), F.lit(1))
    # One end stands for both of a pair: any time between gives its pose.
    held = lambda e: F.struct((t - 1).alias("_t0"), F.col(f"{e}._p0").alias("_p0"), t.alias("_t1"), F.col(f"{e}._p0").alias("_p1"))
    clamped = F.coalesce(hit, F.when(t <= F.col("_lo._t0"), held("_lo")).when(t >= F.col("_hi._t0"), held("_hi")))
    met = points.withColumn("_b", F.floor(t / bucket_ns)).join(listed, ["capture", "_b"], "left").join(ends, "capture").withColumn("_h", clamped).where("_h IS NOT NULL")
    share = (t - F.col("_h._t0")) / (F.col("_h._t1") - F.col("_h._t0")).cast("double")
    turned = met.withColumns({"_s": share, "_q": graphs.slerp(F.col("_h._p0"), F.col("_h._p1"), share)})
    q, p = {n: F.col(f"_q.{n}") for n in POSE[3:]}, [F.col(a) for a in "xyz"]
    x, y, z, w4 = (q[n] for n in POSE[3:])
    rows = (
        (1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - z * w4), 2.0 * (x * z + y * w4)),
        (2.0 * (x * y + z * w4), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - x * w4)),
        (2.0 * (x * z - y * w4), 2.0 * (y * z + x * w4), 1.0 - 2.0 * (x * x + y * y)),
    )
    shift = [(1.0 - F.col("_s")) * F.col(f"_h._p0.{a}") + F.col("_s") * F.col(f"_h._p1.{a}") for a in "xyz"]
    world = [(r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + s).alias(f"w{a}") for r, s, a in zip(rows, shift, "xyz", strict=True)]
    return turned.select(*points.columns, *world)


def accepted_points(points: DataFrame, o: Options, accepted: DataFrame | None = None) -> DataFrame:
    """The points in range of the first `max_scans` scans and, given a table of accepted ones (capture, scan_index), of
    those alone; scans with fewer than `least_points` such points are left out."""
    p = points if not o.max_scans else points.where(F.col("scan_index") < o.max_scans)
    p = p if accepted is None else p.join(accepted.select("capture", "scan_index").distinct(), ["capture", "scan_index"], "left_semi")
    near = p.where(g.in_range(F.col("x"), F.col("y"), F.col("z"), o.blind, o.max_range))
    return motion.enough_points(near, ["capture", "scan_index"], o.least_points) if o.least_points > 1 else near


def lidar_points(points: DataFrame, poses: DataFrame, o: Options, accepted: DataFrame | None = None) -> DataFrame:
    """wx, wy, wz and colours by range of the points that count."""
    near = accepted_points(points, o, accepted)
    colours = g.depth_colour(g.norm(F.col("x"), F.col("y"), F.col("z")), o.lidar_color_near, o.lidar_color_far, o.lidar_color_gamma, o.lidar_color_bands)
    return posed(near.select("capture", "stamp", "x", "y", "z", *[c.alias(n) for c, n in zip(colours, imaging.COLOURS, strict=True)]), poses)


def lidar_map(points: DataFrame, poses: DataFrame, o: Options, accepted: DataFrame | None = None) -> DataFrame:
    """The fused cloud, coloured by range: x, y, z, red, green, blue and the weight w of each voxel."""
    return fused(lidar_points(points, poses, o, accepted), o.lidar_map_voxel)


FUSED = ("x", "y", "z", *imaging.COLOURS)


def weighed(placed: DataFrame) -> DataFrame:
    return placed.select(*[F.col(f"w{a}").alias(a) for a in "xyz"], *imaging.COLOURS, F.lit(1).cast("long").alias("w"))


def fused(placed: DataFrame, size: float) -> DataFrame:
    return voxel.weighted(weighed(placed), size, values=FUSED)


def fuse_in_batches(spark: SparkSession, points: DataFrame, poses: DataFrame, path: str, o: Options, accepted: DataFrame | None = None) -> DataFrame:
    """lidar_map, fused `fusion_batch_scans` scans of each capture at a time into the store at path; a run that was stopped
    goes on from its last batch."""
    store, size = fusion.FusionStore(spark, path, o.lidar_map_voxel, FUSED), o.fusion_batch_scans
    last = points.agg(F.max("scan_index")).first()[0]
    for first in range(0, (last + 1) if last is not None else 0, size):
        some = points.where((F.col("scan_index") >= first) & (F.col("scan_index") < first + size))
        store.add(f"scans {first} to {first + size - 1}", weighed(lidar_points(some, poses, o, accepted)))
    return store.cloud()


@dataclass(frozen=True)
class Images:
    """scans: capture, scan_index, image, gap_ns, sharpness; pixels: image, px, py, r, g, b; the camera, and the 3 or 4 rows
    of 4 that take LiDAR coordinates to the camera's."""

    scans: DataFrame
    pixels: DataFrame
    camera: g.Camera
    camera_from_lidar: tuple


def coloured_points(points: DataFrame, poses: DataFrame, images: Images, o: Options, accepted: DataFrame | None = None) -> DataFrame:
    """product, wx, wy, wz, red, green, blue: every point in the products that show it."""
    near = accepted_points(points, o, accepted).join(F.broadcast(images.scans) if images.scans.limit(100_001).count() <= 100_000 else images.scans, ["capture", "scan_index"], "left")
    world = stash(posed(near, poses).withColumn("_point", F.monotonically_increasing_id()), "posed")
    camera = g.transform(*[F.col(a) for a in "xyz"], images.camera_from_lidar)
    usable = imaging.usable_image(F.col("gap_ns"), F.col("image").isNotNull(), F.col("sharpness"), least=o.min_image_sharpness)
    local = world.select(*world.columns[:-1], "_point", g.norm(F.col("wx"), F.col("wy"), F.col("wz")).alias("_reach"), usable.alias("_usable"), *[c.alias(f"_c{a}") for c, a in zip(camera, "xyz", strict=True)])
    local = local.select("image", "_point", "_reach", "_usable", "wx", "wy", "wz", *[F.col(f"_c{a}").alias(a) for a in "xyz"])
    out = imaging.fan_out(local.withColumnRenamed("_point", "point"), images.pixels, images.camera, F.col("_reach"), ["image"], F.col("_usable"), "point", o.lidar_color_near, o.lidar_color_far, o.lidar_color_gamma, o.lidar_color_bands)
    return out.select("product", "wx", "wy", "wz", *imaging.COLOURS)


def filtered(cloud: DataFrame, o: Options, counts: dict | None = None) -> DataFrame:
    """Without isolated points, points off their planes and statistical outliers; with normals if asked for. counts: gets
    the number of points after each step."""
    counts = {} if counts is None else counts
    out = cloud.withColumn("id", F.xxhash64(*voxel.KEY))
    before = []

    def kept(rows: DataFrame, name: str) -> DataFrame:
        out, counts[f"after_{name}"] = stash_counted(rows, name)
        before.append(out)
        return out

    if o.isolation_radius > 0 and o.isolation_min_neighbors > 0:
        out = kept(neighbours.radius_inliers(out, o.isolation_radius, o.isolation_min_neighbors), "isolation")
    if o.edge_plane_denoise:
        out = kept(neighbours.edge_plane_inliers(out, o.edge_plane_k, o.edge_plane_residual, o.edge_planarity_ratio, o.denoise_tile_size, 4 * o.lidar_map_voxel), "edge_plane")
    if o.denoise_std > 0 and o.denoise_mean_k >= 2:
        out = kept(neighbours.statistical_inliers(out, o.denoise_mean_k, o.denoise_std, o.denoise_tile_size, 4 * o.lidar_map_voxel), "denoise")
    unstash(*before[:-1])
    if o.export_normals:
        out = out.join(neighbours.normals(out, o.normal_radius).select("id", "nx", "ny", "nz"), "id", "left")
    tiles = [F.floor(F.col(a) / o.denoise_tile_size).cast("long").alias(t) for a, t in zip("xyz", neighbours.TILE, strict=True)]
    return out.select("*", *tiles)


def reconstruct(spark: SparkSession, points: DataFrame, poses: DataFrame, out: str, options: Options | None = None, images: Images | None = None, accepted: DataFrame | None = None) -> dict:
    """Write the products below `out`: for each the fused map (Parquet, by which filters can be run again) and the
    filtered cloud, and a report of them all. Returns the report."""
    o = options or Options()
    if images is None and o.fusion_batch_scans > 0:
        fuse_in_batches(spark, points, poses, f"{out}/store/lidar", o, accepted).write.mode("overwrite").parquet(f"{out}/fused/lidar")
    elif images is None:
        lidar_map(points, poses, o, accepted).write.mode("overwrite").parquet(f"{out}/fused/lidar")
    else:
        rows = stash(coloured_points(points, poses, images, o, accepted), "products")
        for name, size in (("mixed", o.map_voxel), ("lidar", o.lidar_map_voxel), ("rgb", o.map_voxel)):
            fused(rows.where(F.col("product") == name), size).write.mode("overwrite").parquet(f"{out}/fused/{name}")
        unstash(rows)
    return finish(spark, out, o, accepted=accepted)


PRODUCTS = ("lidar", "mixed", "rgb")


def finish(spark: SparkSession, out: str, o: Options, accepted: DataFrame | None = None) -> dict:
    """The products from the fused maps written before."""
    report = dataclasses.asdict(o) | ({} if accepted is None else {"accepted_scans": accepted.count()})
    for name in PRODUCTS:
        if not exists(spark, f"{out}/fused/{name}"):
            continue
        cloud, counts = spark.read.parquet(f"{out}/fused/{name}"), {}
        box = cloud.agg(F.count("*").alias("voxels"), F.sum("w").alias("points"), *[f(a).alias(f"{a}_{k}") for a in "xyz" for f, k in ((F.min, "min"), (F.max, "max"))]).first().asDict()
        kept = stash(filtered(cloud, o, counts), "filtered")
        counts |= {"kept": files.write_cloud(kept, f"{out}/{name}_map"), "tiles": kept.select(*neighbours.TILE).distinct().count()}
        unstash(kept)
        report |= {f"{name}_{k}": v for k, v in (box | counts).items()}
    report |= {"voxels": report.get("lidar_voxels", 0), "kept": report.get("lidar_kept", 0)}
    files.write_text(spark, f"{out}/stats.json", json.dumps(report, indent=2, sort_keys=True))
    return report


def main(args: list[str] | None = None) -> None:
    from ..session import local_session

    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("points", "poses", "out"):
        parser.add_argument(name)
    parser.add_argument("--resume-fusion", action="store_true", help="start from the fused map in OUT")
    for f in dataclasses.fields(Options):
        flag = f"--{f.name.replace('_', '-')}"
        parser.add_argument(flag, dest=f.name, default=f.default, **({"action": argparse.BooleanOptionalAction} if isinstance(f.default, bool) else {"type": type(f.default)}))
    given = vars(parser.parse_args(args))
    paths = [given.pop(k) for k in ("points", "poses", "out")]
    resume, options = given.pop("resume_fusion"), Options(**given)
    spark = SparkSession.getActiveSession() or local_session()
    if resume:
        print(finish(spark, paths[2], options))
    else:
        print(reconstruct(spark, spark.read.parquet(paths[0]), spark.read.parquet(paths[1]), paths[2], options))


if __name__ == "__main__":
    main()
