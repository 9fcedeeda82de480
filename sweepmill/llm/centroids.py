"""Centroid clustering of vectors by partial-distance search, in exact integers.

Vectors become integers once (floor(scale * x)). A distance is summed over blocks of dimensions, those of the largest
variance first: after each block the centroids whose sum is already strictly above the best whole distance known for
the vector are abandoned, and the survivors finish all dimensions. What is abandoned can be neither nearest nor tied, so
the result is that of a full search, whatever the order of dimensions.

Vectors are never shuffled. Each task sends back sums for each (cluster, dimension), at most clusters * dimensions rows,
so a cluster that holds most vectors costs no more than others; centroids are collected, that many numbers in all. Every
round reads the integers again from the shared folder, so a lost executor costs a part of one round.

Defined results: a vector counts if it has exactly `dimensions` components, none null or non-finite; all others have no
row. Integers beyond 2^27 in size (|x| of 2^19 and more for the scale of 256) count as 2^27, so that squares fit. Rows that
repeat an id, or a null id, are vectors of their own; equal hashes of ids are ordered by the components, a null id comes
last. Fewer vectors than clusters make as many clusters as vectors; an empty table gives an empty result. An inertia
beyond a long is null. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, MOST = 64, 256, 40, 5, 1 << 27
#: Dimensions that are added up between two looks at the bound, and vectors that are compared at once.
BLOCK, AT_ONCE = 8, 2048


def integers(lists: pa.Array, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that count, and their integer components."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), dimensions), False).to_numpy(zero_copy_only=False))
    values = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    good = np.isfinite(values).all(axis=1)
    return at[good], np.clip(np.floor(values[good] * scale), -MOST, MOST).astype(np.int64)


def nearest(rows: np.ndarray, centres: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, the smaller of equals, and its squared distance."""
    first = np.square(rows[:, None, :block] - centres[None, :, :block]).sum(axis=2)
    best = np.square(rows - centres[first.argmin(axis=1)]).sum(axis=1)
    who, which = np.nonzero(first <= best[:, None])
    sums = first[who, which]
    for at in range(block, rows.shape[1], block):
        sums = sums + np.square(rows[who, at : at + block] - centres[which, at : at + block]).sum(axis=1)
        alive = sums <= best[who]
        who, which, sums = who[alive], which[alive], sums[alive]
    order = np.lexsort((which, sums, who))
    lead = order[np.concatenate(([True], who[order][1:] != who[order][:-1]))] if len(order) else order
    return which[lead], sums[lead]


def _assigned(matrix: np.ndarray, centres: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, centres = matrix[:, order], centres[:, order]
    found = [nearest(rows[i : i + AT_ONCE], centres) for i in range(0, len(rows), AT_ONCE)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2", dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """id, cluster (int), distance (long), cluster_inertia, inertia (long) and centroid_sha256 of each vector, and the
    final centroids. They start as the vectors whose SHA-256 of `<seed>:<id>` is smallest."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()

    def quantise(batches):
        for batch in batches:
            at, q = integers(batch.column(1), dimensions, scale)
            flat = pa.array(q.reshape(-1).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * dimensions), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists], names=["id", "q"])

    kept = common.stash(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(quantise, f"id {kind}, q array<int>"), "integers")

    def spread(batches):
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            q = _matrix(batch.column(0), dimensions).astype(np.float64)
            n, total, squares = n + len(q), total + q.sum(axis=0), squares + np.square(q).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array([float(n)] * dimensions), pa.array(total), pa.array(squares)], names=["dim", "n", "total", "squares"])

    # The order of dimensions only saves work, so the rounding of these sums cannot show in a result.
    moments = kept.select("q").mapInArrow(spread, "dim int, n double, total double, squares double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]).collect()
    variance = {r["dim"]: r["squares"] / max(r["n"], 1) - (r["total"] / max(r["n"], 1)) ** 2 for r in moments}
    order = np.array(sorted(range(dimensions), key=lambda d: (-variance.get(d, 0), d)))

    chosen = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(chosen.alias("hash"), "q").orderBy(F.asc_nulls_last("hash"), "q").limit(clusters).collect()
    centres = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, dimensions)

    def sums_with(centres):
        def sums(batches):
            total, count = np.zeros(centres.shape, dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    q = _matrix(batch.column(0), dimensions)
                    mine = _assigned(q, centres, order)[0]
                    by = np.argsort(mine, kind="stable")
                    held, begin = np.unique(mine[by], return_index=True)
                    total[held] += np.add.reduceat(q[by], begin, axis=0)
                    count += np.bincount(mine, minlength=len(centres))
            some = np.flatnonzero(count)
            cells = [np.repeat(some, dimensions), np.tile(np.arange(dimensions), len(some)), total[some].reshape(-1), np.repeat(count[some], dimensions)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["cluster", "dim", "total", "n"])

        return sums

    for _ in range(rounds if len(centres) else 0):
        wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
        cells = kept.select("q").mapInArrow(sums_with(centres), "cluster long, dim long, total long, n long").groupBy("cluster", "dim").agg(*wide).collect()
        centres = centres.copy()
        for r in cells:
            centres[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                mine, distance = _assigned(_matrix(batch.column(1), dimensions), centres, order)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mine.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    assigned = common.stash(kept.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned")
    common.unstash(kept)
    each = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    facts = [(c, long(s), long(sum(each.values())), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in each.items()]
    # One row a cluster: at most `clusters` rows are broadcast.
    table = spark.createDataFrame(facts, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(table), F.col("cluster") == F.col("_cluster"), "left")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centres.tolist()


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))[0]


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(k.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY hash, q) - 1 AS cluster, q
  FROM (SELECT sha256('2:' || vec_id) AS hash, q FROM kept ORDER BY 1, 2 LIMIT {CLUSTERS}))""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT k.rid, any_value(k.vec_id) AS vec_id, any_value(k.q) AS q, min(struct_pack(d := {distance}, c := c.cluster)) AS near
  FROM kept k CROSS JOIN c{i} c GROUP BY k.rid)""")
        if i < ROUNDS:
            # s // n rounds towards zero, so the remainder is taken off first.
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS q FROM (
      SELECT cluster, dim, sum(x)::BIGINT AS s, count(*) AS n FROM (
        SELECT near.c AS cluster, unnest(q) AS x, unnest(range(1, {DIMENSIONS} + 1)) AS dim FROM a{i})
      GROUP BY cluster, dim) GROUP BY cluster) m ON c.cluster = m.cluster)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, near.c::INTEGER AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia,
       (sum(near.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON near.c = c.cluster
"""


OP12_SQL = _sql()
