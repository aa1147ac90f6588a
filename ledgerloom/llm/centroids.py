"""Operator 13: centroid clustering of quantised vectors, each distinct vector met once with its weight.

Equal quantised vectors become one row with a multiplicity.  Lloyd's rounds run
over the distinct vectors: a task assigns its vectors in numpy and sends, for
each cluster, one row of weighted integer sums; the driver holds the centroids
alone (clusters x components integers).  The assignment of the distinct vectors is then joined back
to the rows.  All arithmetic is in integers, so reruns agree to the last digit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, join_on_hot_key, table

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Quantised components are held to this size either way, so that squared distances fit 64 bits.
LARGEST = 2**27
#: Rows that numpy works on at once.
BLOCK = 4096


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, q) of the vectors with exactly that many components, none null or non-finite; q is their floor(scale * x) as packed 32-bit integers."""
    v = F.col(vector_col).cast("array<double>")
    src = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(
        (F.size("v") == dimensions) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    id_type = src.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False)
            q = np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype("<i4")
            width = 4 * dimensions
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * width), pa.py_buffer(q.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("id"), packed], names=["id", "q"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", id_type), T.StructField("q", T.BinaryType())]))


def unpacked(q: pa.Array) -> np.ndarray:
    """Packed vectors of one length as the rows of an int64 matrix."""
    return np.frombuffer(b"".join(q.to_pylist()), "<i4").reshape(len(q), -1).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equally near ones, the smaller number."""
    distance = np.full(len(x), np.iinfo(np.int64).max)
    number = np.zeros(len(x), np.int64)
    for k, c in enumerate(centroids):
        d = np.square(x - c).sum(axis=1)
        nearer = d < distance
        distance[nearer], number[nearer] = d[nearer], k
    return number, distance


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


def _first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the rows with the smallest sha256 of `seed:id`; rows of one id follow by their vector."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "q")
    return np.array([np.frombuffer(r["q"], "<i4") for r in hashed.orderBy("h", "q").limit(clusters).collect()], np.int64)


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count) of their vectors; those without any stay."""
    clusters, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((clusters, dims), np.int64), np.zeros(clusters, np.int64)
        for b in _blocks(batches):
            x, n = unpacked(b.column("q")), b.column("n").to_numpy()
            own, _ = nearest(x, centroids)
            for k in np.unique(own):
                at = own == k
                sums[k] += (x[at] * n[at, None]).sum(axis=0)
                counts[k] += n[at].sum()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some]), "sums": pa.array(list(sums[some]), pa.list_(pa.int64()))}
        )

    parts = distinct.select("q", "n").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(dims))).alias("sums"))
    out = centroids.copy()
    for r in total.collect():
        out[r["cluster"]] = np.array(r["sums"], np.int64) // r["n"]
    return out


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """(id, cluster, distance, size, cluster_inertia, inertia, centroid), a row for each row of vectors that is kept.

    Null vectors, vectors of another length and those with a null, NaN or infinite component
    are left out.  Repeated rows stay and count each time; a null id stays (its
    hash is that of `seed:`).  Fewer rows than clusters give as many clusters as rows; equal
    first centroids leave the later ones empty.  Components beyond LARGEST / scale
    are taken as that.  size is the cluster's number of rows, centroid its final integers; sums above 64 bits are held at
    the largest long.  Empty input gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(quantised(vectors, id_col, vector_col, dimensions, scale))
    distinct = scratch.keep(rows.groupBy("q").agg(F.count("*").alias("n")))
    centroids = _first_centroids(rows, clusters, seed)
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, t) for n, t in (
            ("cluster", T.IntegerType()), ("distance", T.LongType()), ("size", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid", T.ArrayType(T.LongType())))),
    ])
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        moved = _moved(distinct, centroids)
        if np.array_equal(moved, centroids):  # no later round moves them
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            own, distance = nearest(unpacked(b.column("q")), centroids)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("n"), pa.array(own.astype(np.int32)), pa.array(distance)], names=["q", "n", "cluster", "distance"])

    assigned = scratch.keep(distinct.mapInArrow(assign, "q binary, n long, cluster int, distance long"))
    scratch.drop(distinct)
    weighted = F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)"))
    totals = {r["cluster"]: (r["size"], int(r["s"])) for r in assigned.groupBy("cluster").agg(F.sum("n").alias("size"), weighted.alias("s")).collect()}
    most, inertia = 2**63 - 1, sum(s for _, s in totals.values())
    per_cluster = spark.createDataFrame(
        [(k, size, min(s, most), min(inertia, most), [int(x) for x in centroids[k]]) for k, (size, s) in sorted(totals.items())],
        "cluster int, size long, cluster_inertia long, inertia long, centroid array<long>",
    )
    joined = join_on_hot_key(rows, assigned, ["q"], "n")
    return joined.join(F.broadcast(per_cluster), "cluster").select("id", "cluster", "distance", "size", "cluster_inertia", "inertia", "centroid")


def op13_weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters after ten rounds."""
    out = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES = {"op13_weighted_centroids": op13_weighted_centroids}


def _sql(rounds: int = ROUNDS) -> str:
    """Lloyd's rounds unrolled: c<i> has a row for each centroid and component, a<i> each vector's nearest centroid."""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q AS c FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM kept ORDER BY h, q LIMIT {CLUSTERS}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT r, vec_id, q, k, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            # The remainder is made non-negative first, so that the division is exact whichever way it rounds.
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS m
  FROM (SELECT k, j, sum(x) AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY k, j) GROUP BY k) USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLE_SQL = {"op13_weighted_centroids": _sql()}
