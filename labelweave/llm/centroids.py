"""Centroid clustering on bit planes (operator 11).

A vector of 64 integer components is stored as its bit planes: plane ``p`` is
one 64-bit word that holds bit ``p`` of every component, in two's complement.
The inner product of a vector and a centroid is a weighted sum of popcounts,

    x . c = sum over p, q of w(p) w(q) popcount(X[p] & C[q]),

with ``w(p) = 2^p`` and ``-2^p`` for the top plane (the sign), so products,
norms and squared distances are exact integers. A wider plane set is the
narrower one with its top plane repeated, so batches of different range mix.

The packed table (8 bytes per plane instead of 64 numbers) is written once to
the shared folder and read by each round. A round is map-only but for the sums:
a task adds up its vectors per centroid and emits at most ``k`` rows, which one
aggregate merges; ``k`` rows reach the driver, and the ``k`` new centroids go out
with the next round. No shuffle carries vectors, so a crowded cluster or a
vector that a third of the rows share makes no task larger than another.

Defined cases: rows whose vector is null, has another length than 64 or a null
or non-finite component are left out. Ties go to the smaller cluster number.
Repeated rows count each time; of rows with equal ids the one with the smaller
vector starts first. A null id starts last. With fewer vectors than ``k`` there
are as many centroids as vectors. An empty table gives an empty result. Extra
columns are ignored, whatever their names; an id column named like a result
column is an error, as is a component of 2^19 or more (at scale 256).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from labelweave.llm.common import cut, table
from labelweave.llm.registry import query
from labelweave.llm.vectors import binary, dense

WIDTH = 64          # components of a vector: the bits of one plane
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
_CHUNK = 1024       # vectors compared at a time
_RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def planes_of(x: np.ndarray) -> np.ndarray:
    """Bit planes (n, P) of integers (n, 64); P is what the largest needs, sign included."""
    most = int((x ^ (x >> 63)).max()) if x.size else 0
    out = np.empty((len(x), most.bit_length() + 1), np.uint64)
    for p in range(out.shape[1]):
        bits = ((x >> p) & 1).astype(np.uint8)
        out[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def weights(count: int) -> np.ndarray:
    w = np.int64(1) << np.arange(count, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def integers(planes: np.ndarray) -> np.ndarray:
    """The integers (n, 64) of bit planes."""
    out = np.zeros((len(planes), WIDTH), np.int64)
    for p, w in enumerate(weights(planes.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, p]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += w * bits
    return out


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products (n, k) of two sets of bit planes (n, P) and (k, Q)."""
    wx, wc = weights(x.shape[1]), weights(c.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    for p in range(len(wx)):
        for q in range(len(wc)):
            out += (wx[p] * wc[q]) * np.bitwise_count(x[:, p, None] & c[None, :, q]).astype(np.int64)
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Squared lengths from the planes."""
    w = weights(x.shape[1])
    return sum((w[p] * w[q]) * np.bitwise_count(x[:, p] & x[:, q]).astype(np.int64)
               for p in range(len(w)) for q in range(len(w)))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance."""
    which, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    cc = norms(c)
    for at in range(0, len(x), _CHUNK):
        part = x[at: at + _CHUNK]
        d = norms(part)[:, None] - 2 * products(part, c) + cc[None, :]
        low = d.argmin(axis=1)
        which[at: at + _CHUNK], far[at: at + _CHUNK] = low, d[np.arange(len(part)), low]
    return which, far


def read_planes(col: pa.Array) -> np.ndarray:
    """Planes of a binary column; rows with fewer planes get their top one repeated."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)
    count = np.diff(off) // 8
    out = np.empty((len(col), int(count.max())), np.uint64)
    for n in np.unique(count).tolist():
        rows = np.flatnonzero(count == n)
        got = data[off[rows][:, None] + np.arange(8 * n)].view("<u8")
        out[rows, :n] = got
        out[rows, n:] = got[:, -1:]
    return out


def pack(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(_id, planes) of the usable vectors."""
    df = df.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"))
    out = StructType([df.schema["_id"], *StructType.fromDDL("planes binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.equal(pa.compute.list_value_length(b.column(1)), WIDTH))
            ok, _, x = dense(b.column(1), scale)
            if ok.any():
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).filter(pa.array(ok)), binary(planes_of(x.reshape(-1, WIDTH)))], names=["_id", "planes"])

    return df.mapInArrow(run, out)


def first_centroids(df: DataFrame, id_col: str, vec_col: str, k: int, seed: int, scale: int) -> np.ndarray:
    """The ``k`` usable vectors with the smallest sha256 of ``<seed>:<id>``: k rows come to the driver."""
    v = F.col(vec_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = (df.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("h"), v.alias("v"))
           .filter((F.size("v") == WIDTH) & F.coalesce(usable, F.lit(False)))
           .orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect())
    return np.floor(scale * np.array([r["v"] for r in top], np.float64)).astype(np.int64).reshape(-1, WIDTH)


def _sums(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per centroid: number of its vectors and their componentwise sum."""
    c = planes_of(centroids)
    names = ["cluster", "n", *[f"s{j}" for j in range(WIDTH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), WIDTH), np.int64)
        for b in batches:
            if b.num_rows:
                x = read_planes(b.column(0))
                which, _ = nearest(x, c)
                order = np.argsort(which, kind="stable")
                found, first = np.unique(which[order], return_index=True)
                total[found] += np.add.reduceat(integers(x)[order], first, axis=0)
                n += np.bincount(which, minlength=len(n))
        got = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(got.astype(np.int32)), pa.array(n[got]), *[pa.array(total[got, j]) for j in range(WIDTH)]], names=names)

    parts = packed.select("planes").mapInArrow(run, "cluster int, " + ", ".join(f"{x} long" for x in names[1:]))
    return parts.groupBy("cluster").agg(*[F.sum(x).alias(x) for x in names[1:]])


def fit(packed: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after the given rounds: exact floored means; a centroid without vectors stays."""
    centroids = centroids.copy()
    for _ in range(rounds if len(centroids) else 0):
        for r in _sums(packed, centroids).collect():        # at most k rows
            centroids[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(WIDTH)]
    return centroids


def assign(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(_id, cluster, distance) of every packed vector."""
    c = planes_of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                which, far = nearest(read_planes(b.column(1)), c)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(which.astype(np.int32)), pa.array(far)],
                                                 names=["_id", "cluster", "distance"])

    return packed.mapInArrow(run, StructType([packed.schema["_id"], *StructType.fromDDL("cluster int, distance long").fields]))


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS,
            rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """Every usable vector with its cluster, distance, the inertia of its cluster and of all, and the digest of its centroid."""
    added = StructType.fromDDL(_RESULT)
    if id_col.lower() in [f.name for f in added]:
        raise ValueError(f"the id column has the name of a result column: {id_col}")
    spark = df.sparkSession
    start = first_centroids(df, id_col, vec_col, k, seed, scale)
    if not len(start):
        return spark.createDataFrame([], StructType([StructField(id_col, df.schema[id_col].dataType), *added.fields]))
    packed = cut(pack(df, id_col, vec_col, scale), "planes")
    centroids = fit(packed, start, rounds)
    found = cut(assign(packed, centroids), "assigned")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()      # at most k rows
    every = sum(r["d"] for r in each)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(r["cluster"], r["d"], every, digest[r["cluster"]]) for r in each],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("_id").alias(id_col), *added.names)


def _sql() -> str:
    """Every round as its own materialised step."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, q FROM (
       SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
       WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (
       SELECT sha256('{SEED}:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {CLUSTERS}))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT v.r, min(struct_pack(d := list_sum(list_transform(list_zip(v.q, x.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := x.c)) AS b
       FROM v, c{k} x GROUP BY v.r)""")
        if k < ROUNDS:
            steps.append(f"""
m{k} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM (
       SELECT b.c AS c, j, sum(v.q[j])::HUGEINT AS s, count(*) AS n FROM a{k} JOIN v USING (r), range(1, {WIDTH + 1}) t(j) GROUP BY ALL) GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q)::BIGINT[] AS q FROM c{k} o LEFT JOIN m{k} m USING (c))""")
    last = ROUNDS
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance,
       CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(x.q, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN c{last} x ON x.c = b.c"""


@query("op11_centroids", _sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every usable vector."""
    return cluster(table(spark, sf_dir, "embeddings"))
