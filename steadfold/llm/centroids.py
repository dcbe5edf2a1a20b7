"""Clusters around centroids, in whole numbers, by Drake's adaptive bounds.

Vectors are rounded to integers once, so distances, sums and centroids are
exact, and a clustering doesn't depend on how rows are dealt.  Each vector has
its state: its centroid, an upper bound on the distance to it, the next nearest
centroids in order with a lower bound for each, and one bound for all others.
Centroids that move loosen the bounds by how far they move.  As long as the
upper bound lies below all lower ones the vector stays where it is, without a
distance; if it lies below those from some rank on, the centroids before that
rank are measured and put in order again; otherwise all are.  Bounds are widened
at each step by more than an operation's rounding, and whatever they can't tell
apart, ties included, is measured in whole numbers.

A round is two passes over the state: one that gives each task's sums by
centroid, which are added up in Spark, and one that writes the new state.  The
number of bounds a vector has falls to what the round before needed at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadfold.llm.common import in_slices, new_path
from steadfold.sources import scratch

CLUSTERS, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components, times the scale, may be so large: squared distances of 64 of them are within 62 bits.
LARGEST = 1 << 27
#: Bounds are widened by this share of what was added or subtracted.
SLACK = 1e-12
_STATE = ("cluster", "upper", "near", "lower", "used")


def squared(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, (vectors, centres), of integers."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * v.shape[1] * most * most < 1 << 53:  # then doubles are exact too, and their products quicker
        x, c = v.astype(np.float64), centres.astype(np.float64)
        return np.rint((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centres], axis=1)


@dataclass
class State:
    """Of some vectors: centroid, upper bound, next nearest centroids, their lower bounds and the others', centroids measured."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    used: np.ndarray


def scanned(v: np.ndarray, centres: np.ndarray, bounds: int) -> State:
    """The state of vectors that are measured against all centroids; ties go to the smaller number."""
    d = squared(v, centres)
    order = np.argsort(d, axis=1, kind="stable")
    ranked = np.sqrt(np.take_along_axis(d, order, axis=1))
    lower = np.full((len(v), bounds + 1), np.inf)
    known = min(len(centres), bounds + 2)
    lower[:, : known - 1] = ranked[:, 1:known] * (1 - SLACK)
    return State(order[:, 0].astype(np.int32), ranked[:, 0] * (1 + SLACK), order[:, 1 : bounds + 1].astype(np.int32), lower, np.full(len(v), bounds + 1, np.int32))


def moved(state: State, v: np.ndarray, centres: np.ndarray, drift: np.ndarray, bounds: int) -> State:
    """The state of the same vectors after each centroid has moved by ``drift`` at most; with ``bounds`` bounds each."""
    upper = (state.upper + drift[state.cluster]) * (1 + SLACK)
    by = np.concatenate([drift[state.near], np.full((len(v), 1), drift.max())], axis=1)
    lower = state.lower - by - SLACK * (np.where(np.isfinite(state.lower), state.lower, 0) + by)
    had = state.near.shape[1]
    if bounds < had:
        lower = np.concatenate([lower[:, :bounds], lower[:, bounds:].min(axis=1, keepdims=True)], axis=1)
    near, cluster, used = state.near[:, : min(bounds, had)].copy(), state.cluster.copy(), np.zeros(len(v), np.int32)

    def open_ranks(rows: np.ndarray) -> np.ndarray:
        """How many of the first ranks could be as near: none of those behind has a bound that isn't above."""
        least = np.minimum.accumulate(lower[rows, ::-1], axis=1)[:, ::-1]
        return (least <= upper[rows, None]).sum(axis=1)

    rows = np.flatnonzero(open_ranks(np.arange(len(v))))
    if len(rows):
        upper[rows] = np.sqrt(((v[rows] - centres[cluster[rows]]) ** 2).sum(axis=1)) * (1 + SLACK)
        ranks = open_ranks(rows)
        for z in np.unique(ranks[ranks > 0]):
            some = rows[ranks == z]
            used[some] = z
            if z > near.shape[1]:
                fresh = scanned(v[some], centres, bounds)
                cluster[some], upper[some], near[some], lower[some] = fresh.cluster, fresh.upper, fresh.near, fresh.lower
                continue
            asked = np.sort(np.concatenate([cluster[some, None], near[some, :z]], axis=1), axis=1)
            d = np.stack([((v[some] - centres[asked[:, j]]) ** 2).sum(axis=1) for j in range(z + 1)], axis=1)
            order = np.argsort(d, axis=1, kind="stable")  # the smaller number first of equal ones
            asked, d = np.take_along_axis(asked, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1))
            cluster[some], upper[some] = asked[:, 0], d[:, 0] * (1 + SLACK)
            near[some, :z], lower[some, :z] = asked[:, 1:], d[:, 1:] * (1 - SLACK)
    return State(cluster, upper, near, lower, used)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _passes(centres: np.ndarray, drift: np.ndarray | None, bounds: int):
    """(vec_id, v, state) -> the same after centroids moved; without ``drift`` (vec_id, v) -> the first state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4096):
            n = batch.num_rows
            if not n:
                continue
            v = _matrix(batch.column(1), n).astype(np.int64)
            if drift is None:
                s = scanned(v, centres, bounds)
            else:
                cluster, upper = (batch.column(k).to_numpy() for k in (2, 3))
                s = moved(State(cluster, upper, _matrix(batch.column(4), n), _matrix(batch.column(5), n), cluster), v, centres, drift, bounds)
            made = [pa.array(s.cluster), pa.array(s.upper), _lists(s.near, pa.int32()), _lists(s.lower, pa.float64()), pa.array(s.used)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["vec_id", "v", *_STATE])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, v) -> one row for each cluster that the task has: (cluster, n, sums)."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        v, cluster = _matrix(batch.column(1), batch.num_rows), batch.column(0).to_numpy()
        for c in np.unique(cluster).tolist():
            some = v[cluster == c]
            n, s = sums.get(c, (0, 0))
            sums[c] = (n + len(some), s + some.sum(axis=0, dtype=np.int64))
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([s for _, s in sums.values()], pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _measured(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4096):
            if batch.num_rows:
                v, cluster = _matrix(batch.column(1), batch.num_rows).astype(np.int64), batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(((v - centres[cluster]) ** 2).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return run


def whole_vectors(rows: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of rows with exactly ``dimension`` components, none null or non-finite: integers floor(scale * x).

    Other rows are left out.  A component beyond ``LARGEST`` is an error, since
    distances would no longer be exact.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size("embedding") == dimension) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))), F.lit(False))
    whole = F.transform(x, lambda e: F.when(F.abs(e * scale) < LARGEST, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large to be clustered exactly")).cast("int")))
    return rows.where(fine).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose SHA-256 of seed and vec_id is smallest, in that order; of equal ones the smaller vector first."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.select(hashed.alias("hash"), "v").orderBy("hash", "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def next_centroids(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without any stays.  One row a component comes here."""
    sums = state.select("cluster", "v").mapInArrow(_sums, "cluster int, n long, sums array<long>")
    each = sums.select("cluster", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("sums").alias("pos", "s"))
    totals = each.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = centres.copy()
    for r in totals:
        out[r.cluster, r.pos] = int(r.s) // int(r.n)
    return out


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every whole vector, and the centroids, (k, dimension) integers.

    Needs vec_id and embedding, an array of floats or doubles; other columns
    don't matter.  Rows with another number of components, or one that is null
    or not finite, are left out; repeated rows each get their row; null vec_ids
    take part.  With fewer than ``k`` vectors there are as many centroids, and
    without any both results are empty.  ``distance`` is squared.  Rounds end
    early if no centroid moves, since no later one would change anything.
    """
    spark, ident = rows.sparkSession, rows.schema["vec_id"]
    vectors = whole_vectors(rows, dimension, scale)
    centres = first_centroids(vectors, k, seed)
    kept = T.StructType([ident, T.StructField("v", T.ArrayType(T.IntegerType()))])
    kinds = zip(_STATE, (T.IntegerType(), T.DoubleType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType()), T.IntegerType()), strict=True)
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in kinds)])
    measured = T.StructType([ident, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centres):
        return spark.createDataFrame([], measured), np.empty((0, dimension), np.int64)
    bounds = max(0, min(len(centres) - 1, max(2, len(centres) // 4)))
    path, old = new_path(spark, "clusters"), None
    vectors.mapInArrow(_passes(centres, None, bounds), schema).write.parquet(path)
    for step in range(rounds):
        state = spark.read.schema(schema).parquet(path)
        later = next_centroids(state, centres)
        if (later == centres).all():
            break
        drift = np.sqrt(((later - centres) ** 2).sum(axis=1)) * (1 + SLACK)
        centres = later
        if step:
            needed = state.agg(F.max("used")).first()[0]
            bounds = max(min(bounds, needed), min(1, bounds), len(centres) // 8)
        old, path = path, new_path(spark, "clusters")
        state.mapInArrow(_passes(centres, drift, bounds), schema).write.parquet(path)
        scratch.drop(spark, old)
    state = spark.read.schema(schema).parquet(path)
    return state.select("vec_id", "v", "cluster").mapInArrow(_measured(centres), measured), centres


def centroid_hash(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = found.groupBy(F.col("cluster").alias("c")).agg(F.sum("distance").alias("cluster_inertia"))
    # One row a centroid, so they are summed up in one place.
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    hashes = spark.createDataFrame([(c, centroid_hash(x)) for c, x in enumerate(centres)], "c int, centroid_sha256 string")
    each = sums.join(F.broadcast(hashes), "c")
    return found.join(F.broadcast(each), found["cluster"] == each["c"]).drop("c")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """A round is two parts of one query: the nearest centroid of each vector, and the floors of means."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS c, v FROM kept QUALIFY c < {k})",
    ]
    nearest = "SELECT rid, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c.c)) AS m FROM kept k, c{r} c GROUP BY rid"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, m.c AS c, m.d AS d FROM ({nearest.format(r=r)}))")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT c, list(floor_mean ORDER BY pos) AS v FROM (SELECT c, pos, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_mean FROM (SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS pos FROM a{r} a JOIN kept k USING (rid)) GROUP BY c, pos)) GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    return f"""WITH {", ".join(parts)}
SELECT k.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (rid) JOIN c{rounds} c ON c.c = a.c"""


SQL = _sql()
