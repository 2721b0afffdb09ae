"""Centroid clustering whose bounds are tightened by the geometry of the drift.

A vector keeps its exact distance to its own centroid and a lower bound on the distance to all others. When centroids
move, the bound has to give way by what another centroid may have come nearer. That is not its whole drift: the vectors
of a cluster lie in a sphere around their centroid, and in the plane through the sphere's centre and the old and new
place of the other centroid no vector sees it come nearer by more than

    drift * cos(the least angle between the move and the sphere, seen from the middle of the move),

as vectors that see it come nearer by s lie within a branch of a hyperbola with its foci at both places, and a branch
lies between its asymptotes, whose angle has the cosine s / drift. Where the sphere lies wholly on the old place's side
of the plane midway, all its vectors see the centroid go away, and the bound even grows. Vectors whose own distance isn't below the bound are ambiguous and are compared with all centroids.

Components are whole numbers, so distances, sums and ties are exact; the bounds have room for rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import dropped, last_written, written

#: Components, centroids, rounds that move them, what a component is multiplied by, and the seed of the first centroids.
DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components below this in size keep a sum of 64 squared differences exact in 64 bits.
LARGEST = 1 << 26
#: Up to this size the same sums are exact as doubles, so that products of matrices give them.
_EXACT = 1 << 22
#: Relative room for rounding in bounds, far above what a few operations on doubles lose; and that of angles, which an arc cosine near 1 has to 1e-8 only.
_ROOM, _TURN = 1e-9, 1e-7
#: Rows compared at a time.
_BLOCK = 1 << 12


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of vectors with the right number of components, none null or not finite; v holds floor(scale * x)."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda a: a.cast("double"))
    fine = F.coalesce(F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))), F.lit(False)) & (F.size(x) == dimensions)
    small = F.forall(x, lambda a: F.abs(a) * scale < LARGEST - 1)
    whole = F.transform(x, lambda a: F.floor(a * scale).cast("int"))
    said = F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more, whose squares don't fit")))
    return vectors.where(fine).select(F.col(f"`{id_col}`").alias("vec_id"), said.alias("v"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the least hashes of the seed and their ids, in that order; fewer if there are fewer."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from those of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster what the lower bound of its vectors gives way by at most: no other centroid comes nearer to a vector within radius of the cluster's old centroid by more. May be negative."""
    a, b = old.astype(float), new.astype(float)
    drift = np.sqrt(((b - a) ** 2).sum(1))
    out = np.full(len(a), -np.inf)
    for j in range(len(a)):
        others = np.arange(len(a)) != j
        if drift[j] == 0:
            out[others] = np.maximum(out[others], 0.0)
            continue
        away = a - (a[j] + b[j]) / 2  # spheres' centres from the middle of the move
        far = np.sqrt((away**2).sum(1))
        along = np.clip(away @ (b[j] - a[j]) / np.maximum(far * drift[j], 1e-300), -1.0, 1.0)
        r = radius * (1 + _ROOM)
        wide = r >= far  # the middle lies in the sphere
        angle = np.arccos(along) - np.arcsin(np.where(wide, 1.0, r / np.where(wide, 1.0, far)))
        gain = np.where(wide, drift[j], drift[j] * np.cos(np.clip(angle - _TURN, 0.0, np.pi / 2)))
        # the difference of the distances is that of their squares, drift * 2 * (how far behind the plane), over their sum
        behind = -along * far - r
        gain = np.where(behind > 0, -2 * drift[j] * behind / (2 * (far + r) + drift[j]), gain)
        out[others] = np.maximum(out[others], (gain + drift[j] * _ROOM)[others])
    return out


def _nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of the nearest centroid (the smaller of several), its squared distance, and the distance of the next one."""
    own = d.argmin(1)
    rows = np.arange(len(d))
    least = d[rows, own]
    rest = d.astype(float)
    rest[rows, own] = np.inf
    return own, least, np.sqrt(rest.min(1))


def _assign(now: np.ndarray, gives: np.ndarray | None):
    """For mapInArrow over (vec_id, v) or, with gives, (vec_id, v, cluster, square, bound): the same with the assignment to now."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(start, _BLOCK)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                if gives is None:
                    own, square, bound = _nearest(squares(x, now))
                    scanned = np.ones(len(x), bool)
                else:
                    own = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                    bound = batch.column(4).to_numpy(zero_copy_only=False) - gives[own]
                    bound -= np.abs(bound) * _ROOM
                    square = ((x - now[own]) ** 2).sum(1)
                    scanned = ~(np.sqrt(square.astype(float)) * (1 + _ROOM) < bound)
                    if scanned.any():
                        own, bound = own.copy(), bound.copy()
                        own[scanned], square[scanned], bound[scanned] = _nearest(squares(x[scanned], now))
                columns = [pa.array(own.astype(np.int32)), pa.array(square), pa.array(bound), pa.array(scanned)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["vec_id", "v", "cluster", "square", "bound", "scanned"])

    return task


def _moved(state: DataFrame, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroids moved to the floors of their vectors' means, radius of each cluster). Sums are exact; the driver gets a row for each cluster."""
    n = now.shape[1]
    sums = [F.sum(F.col("v")[i].cast("decimal(28,0)" if now.size and np.abs(now).max() >= _EXACT else "long")).alias(f"s{i}") for i in range(n)]
    new, radius = now.copy(), np.zeros(len(now))
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("square").alias("most"), *sums).collect():
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(n)]
        radius[r["cluster"]] = np.sqrt(float(r["most"]))
    return new, radius


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, told: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, square, bound, scanned) of every vector that is kept, centroids) after the rounds and one more assignment.

    Left out are vectors that are null, of another length, or hold a null or a value that is not finite; a component of
    2^18 or more in size is an error. Ties go to the smaller number. Repeated rows are vectors of their own; a
    null id hashes as no digits; equal hashes start in order of the components. With fewer vectors than k there are as
    many centroids as vectors; an empty table gives an empty one. Other columns are not read. told gets the share of
    vectors that each assignment scanned.

    An assignment writes the vectors with their bounds and drops the table before, so two are there at a time. Nothing is
    shuffled but a row of sums for each task and cluster."""
    names = T.StructType([vectors.schema[id_col]])
    schema = T.StructType([T.StructField("vec_id", names[0].dataType), T.StructField("v", T.ArrayType(T.IntegerType()))])
    for name, kind in (("cluster", "integer"), ("square", "long"), ("bound", "double"), ("scanned", "boolean")):
        schema = schema.add(name, kind)
    kept = kept_vectors(vectors, id_col, vector_col, dimensions, scale)
    now, gives, state, made = first_centroids(kept, k, seed), None, kept, None
    if not len(now):
        return vectors.sparkSession.createDataFrame([], schema), now.reshape(0, dimensions)
    for turn in range(rounds + 1):
        rows = state.select("vec_id", "v") if gives is None else state.select("vec_id", "v", "cluster", "square", "bound")
        state = written(rows.mapInArrow(_assign(now, gives), schema), f"assigned{turn}")
        if made:
            dropped(vectors.sparkSession, made)
        made = last_written()
        if told is not None:
            told.append(state.agg(F.avg(F.col("scanned").cast("double"))).first()[0])
        if turn < rounds:
            new, radius = _moved(state, now)
            gives, now = loosening(now, new, radius), new
    return state, now


def with_inertia(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row for each cluster meets the vectors."""
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    spark = state.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("square").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(i, sums.get(i, 0), sum(sums.values()), h) for i, h in digests]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", F.col("square").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector of embeddings with its cluster; see ``clustered`` for nulls, ties, repeats and other columns."""
    return with_inertia(*clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql() -> str:
    """Rounds as views on each other; distances by inner products of doubles, which hold whole numbers exactly."""
    far = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v)"
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda a: floor({SCALE} * a::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda a: a IS NOT NULL AND isfinite(a))) = {DIMENSIONS})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS m FROM (SELECT x.vec_id, x.v, c.k, {far} AS d FROM kept x, c{i} c) GROUP BY vec_id)")
        if i < ROUNDS:
            parts.append(f"n{i} AS (SELECT k, list(floor((s - (s % n + n) % n) / n) ORDER BY i) AS v FROM (SELECT m.k AS k, i, sum(v[i]::BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY m.k, i) GROUP BY k)")
            parts.append(f"c{i + 1} AS (SELECT k, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (k))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, m.k::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(list_transform(c.v, lambda a: a::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.k = m.k"""


OP13_SQL = _sql()
