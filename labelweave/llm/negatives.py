"""Hard-negative mining with Strassen products and mergeable heaps (operator 13).

For every anchor: its best rows of the same label are its positives; for each
positive the best rows of other labels whose score lies in a window below the
positive's score are its hard negatives. Scores are exact integer inner products.

1. Vectors become integers and are written once to the shared folder, each row
   with a number of its own (so repeated rows stay apart).
2. Anchors are taken in blocks of at most about ``block`` rows; a block is the
   only thing that is sent to all tasks, and its size does not grow with the
   data. Each block meets every row in one map-only pass: a tile of anchors times
   a tile of candidates is multiplied by Strassen's recursion on int64 (odd sides
   and short vectors padded with zeros; sums that wrap around cancel, so results
   are exact). Candidate vectors are never shuffled.
3. A task keeps one bounded heap per anchor (positives) or per anchor and
   positive (window). A heap's weakest score is the floor that later tiles must
   reach, so most products are dropped by one comparison. Heaps of the tasks merge
   in a ranking window per anchor, cut before and after its shuffle.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part. Vectors of different length are compared as if padded
with zeros. Ties go to the smaller id, null ids last; a repeated row is a row
(an anchor's own copy can be its positive). An anchor without positives, or a
positive without rows in its window, has no rows. A table without anchors gives
an empty result. Extra columns are ignored, whatever their names. Ids and labels
are integers; a component of 2^19 or more (at scale 256) is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.llm.common import cut, table
from labelweave.llm.registry import query
from labelweave.llm.vectors import dense

POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)       # percent of the positive's score
SCALE = 256
BLOCK = 16_384          # anchors sent to all tasks at once
TILE = (256, 2048)      # anchors, candidates of one product
LEAF = 16               # sides up to this are multiplied directly

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b on int64 by Strassen's seven products; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best ``size`` entries (higher score first, then smaller id, null ids last) of each of ``slots`` heaps."""

    def __init__(self, slots: int, size: int) -> None:
        self.size = size
        self.floor = np.full(slots, np.iinfo(np.int64).min)
        self.slot = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ids, null = np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score, slot))
        s = slot[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s)
        order, rank = order[rank < self.size], rank[rank < self.size]
        self.slot, self.score, self.id, self.null = slot[order], score[order], ids[order], null[order]
        full = rank == self.size - 1
        self.floor[self.slot[full]] = self.score[full]


def matrix(col: pa.Array, width: int = 0) -> np.ndarray:
    """int32 vectors of a binary column as int64 rows, padded with zeros to the longest (at least ``width``)."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64) // 4
    data = np.frombuffer(col.buffers()[2], "<i4") if off[-1] else np.zeros(0, "<i4")
    size = np.diff(off)
    out = np.zeros((len(col), max(width, int(size.max(initial=0)), 1)), np.int64)
    out[np.repeat(np.arange(len(col)), size), np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size)] = data[off[0]: off[-1]]
    return out


def prepare(df: DataFrame, anchor: Column, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(key, id, label, anchor, x) of the rows that take part; ``x`` holds int32 components."""
    df = (df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("v"))
          .filter("label IS NOT NULL AND v IS NOT NULL")
          .select(F.monotonically_increasing_id().alias("key"), "id", "label", "anchor", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, size, x = dense(b.column(4), scale)
            off = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(x.astype("<i4").tobytes())])
            some = pa.array(ok)
            yield pa.RecordBatch.from_arrays([*[b.column(i).filter(some) for i in range(4)], packed],
                                             names=["key", "id", "label", "anchor", "x"])

    return df.mapInArrow(run, "key long, id long, label long, anchor boolean, x binary")


def _scored(batches: Iterator[pa.RecordBatch], keys: np.ndarray, labels: np.ndarray, x: np.ndarray,
            slots: int, size: int, choose) -> Iterator[pa.RecordBatch]:
    """Multiply every batch with the anchors, tile by tile; ``choose`` names the entries that reach the heaps."""
    high, wide = TILE
    heaps = [Heaps(len(x[at: at + high]) * slots, size) for at in range(0, len(x), high)]
    reach = int(np.abs(x).max(initial=0))
    for b in batches:
        for to in range(0, b.num_rows, wide):
            part = b.slice(to, wide)
            c = matrix(part.column("x"), x.shape[1])
            if reach * int(np.abs(c).max(initial=0)) * c.shape[1] >= 1 << 62:
                raise ValueError("inner products do not fit 63 bits")
            key, label = part.column("key").to_numpy(), part.column("label").to_numpy()
            null = np.asarray(part.column("id").is_null())
            ids = part.column("id").fill_null(0).to_numpy()
            for h, at in zip(heaps, range(0, len(x), high), strict=True):
                a = x[at: at + high]
                s = strassen(np.pad(a, ((0, 0), (0, c.shape[1] - a.shape[1]))), c.T)
                same = labels[at: at + high, None] == label[None, :]
                own = keys[at: at + high, None] == key[None, :]
                for k in range(slots):
                    row, col = np.nonzero(choose(s, same, own, at, at + len(a), k) & (s >= h.floor[k::slots, None]))
                    h.add(row * slots + k, s[row, col], ids[col], null[col])
    for h, at in zip(heaps, range(0, len(x), high), strict=True):
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[at + h.slot // slots]), pa.array((h.slot % slots).astype(np.int32)), pa.array(h.score),
             pa.array(h.id, pa.int64(), mask=h.null)], names=["anchor_key", "slot", "score", "id"])


_HEAP = "anchor_key long, slot int, score long, id long"


def _merged(heaps: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("anchor_key", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def _positives(rows: DataFrame, held, count: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, x = held.value
        yield from _scored(batches, keys, labels, x, 1, count, lambda s, same, own, *_: same & ~own)

    return _merged(rows.select("key", "id", "label", "x").mapInArrow(run, _HEAP), count)


def _negatives(rows: DataFrame, held, windows, count: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, x = held.value
        low, high = windows.value

        def choose(s, same, own, at, to, k):
            return ~same & (s >= low[at:to, k, None]) & (s <= high[at:to, k, None])

        yield from _scored(batches, keys, labels, x, low.shape[1], count, choose)

    return _merged(rows.select("key", "id", "label", "x").mapInArrow(run, _HEAP), count)


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
         scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor``: a condition on ``df``."""
    spark = df.sparkSession
    rows = cut(prepare(df, anchor, id_col, label_col, vec_col, scale), "vectors")
    anchors = rows.filter("anchor").select("key", "id", "label", "x")
    blocks = -(-anchors.count() // block)
    out = None
    for k in range(blocks):     # a block of anchors and its positives: a bounded number of rows on the driver
        mine_ = anchors.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).orderBy("key").toArrow().combine_chunks()
        if not mine_.num_rows:
            continue
        keys, labels = mine_.column("key").to_numpy(), mine_.column("label").to_numpy()
        held = spark.sparkContext.broadcast((keys, labels, matrix(mine_.column("x").chunk(0))))
        best = cut(_positives(rows, held, positives), "positives")
        low = np.full((len(keys), positives), 1, np.int64)      # no positive: no score fits
        high = np.zeros((len(keys), positives), np.int64)
        for r in best.select("anchor_key", "rank", "score").toLocalIterator():
            at = np.searchsorted(keys, r["anchor_key"]), r["rank"] - 1
            low[at], high[at] = -(-window[0] * r["score"] // 100), window[1] * r["score"] // 100
        found = _negatives(rows, held, spark.sparkContext.broadcast((low, high)), negatives)
        pairs = (found.withColumn("pos", F.col("slot") + 1)
                 .select("anchor_key", "pos", F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
                 .join(best.select("anchor_key", F.col("rank").alias("pos"), F.col("id").alias("positive_id"),
                                   F.col("score").alias("positive_score")), ["anchor_key", "pos"])
                 .join(anchors.select(F.col("key").alias("anchor_key"), F.col("id").alias("anchor_id")), "anchor_key")
                 .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        out = pairs if out is None else out.unionByName(pairs)
    return spark.createDataFrame([], _RESULT) if out is None else out


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.k AS ak, a.id AS anchor_id, r.k, r.id, a.label = r.label AS same,
         list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v r ON a.id % 100 = 0 AND a.k <> r.k),
p AS (SELECT ak, anchor_id, k AS pk, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, id NULLS LAST) <= {POSITIVES})
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.ak, pk ORDER BY score DESC, id NULLS LAST) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.ak = p.ak AND NOT same
  AND {WINDOW[0]} * positive_score <= 100 * score AND 100 * score <= {WINDOW[1]} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.ak, pk ORDER BY score DESC, id NULLS LAST) <= {NEGATIVES}
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, among all rows."""
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine(rows, F.expr("vec_id % 100 = 0"))
