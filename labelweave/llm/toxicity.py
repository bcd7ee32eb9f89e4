"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams (operator 4).

Features of a text are the sets of its words, word pairs and pairs with one word
between (skip-grams), hashed into ``BITS`` bits. Training runs FTRL-proximal, one text at
a time with a learning rate per coordinate and L1 (weights of weak evidence are
exactly 0), over a bounded sample: at most ``TRAIN_ROWS`` labelled texts. ``train`` takes those with the smallest
hash of their text; the query hands it the rows with the smallest hash of their id, chosen among the labels before
any text is read. Neither depends on the order or the partitions of the table. It runs in one task and returns only the
weights that are not 0, which are then broadcast; scoring is one pass.

Defined cases: a null or empty text scores by the bias alone; labelled texts
that are null count as empty; ties of the sample's hash are broken by the text;
repeated rows may be in the sample as often as they occur; without labels of
both kinds the score is the (smoothed) share of label 1; an empty table gives an
empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import textkit as T
from labelweave.llm.common import add_columns, fold_hash, table
from labelweave.llm.registry import query

BITS = 20
TRAIN_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return T.mix(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt))


def features(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of words, word pairs and skip pairs of a slice, with repeats."""
    r, h = T.words(T.flat(col))
    shift = np.uint64(64 - BITS)
    yield r.doc, T.mix(h) >> shift
    for gap in (1, 2):
        if len(h) > gap:
            ok = r.doc[:-gap] == r.doc[gap:]
            yield r.doc[:-gap][ok], _pair(h[:-gap], h[gap:], gap)[ok] >> shift


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) after the given passes over (distinct buckets, label)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)     # the last is the bias, without L1

    def weights(i: np.ndarray) -> np.ndarray:
        zi, lam = z[i], np.where(i == 1 << BITS, 0.0, L1)
        return np.where(np.abs(zi) <= lam, 0.0, -(zi - np.sign(zi) * lam) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in rows:
            i = np.append(at, 1 << BITS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    at = np.flatnonzero(np.abs(z[:-1]) > L1)
    return at, weights(at), float(weights(np.array([1 << BITS]))[0])


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic",
          limit: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learned from at most ``limit`` labelled rows."""
    rows = (labelled.filter(F.col(label_col).isNotNull())
            .select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"))
            .orderBy(F.xxhash64("text"), "text", "label").limit(limit))

    def encode(b: pa.RecordBatch) -> dict[str, pa.Array]:
        parts = list(features(b.column(b.schema.get_field_index("text"))))
        doc, bucket = T.unique_by_doc(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return {"at": T.lists(bucket.astype(np.int32), np.bincount(doc, minlength=b.num_rows), pa.list_(pa.int32()).value_type)}

    coded = add_columns(rows, "at array<int>", "text", encode, ["label"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[tuple[np.ndarray, int]] = []
        for b in batches:
            flat, off = b.column("at").flatten().to_numpy(), b.column("at").offsets.to_numpy()
            off = off - off[0]
            data += [(flat[s:e].astype(np.int64), y) for s, e, y in zip(off[:-1], off[1:], b.column("label").to_pylist(), strict=True)]
        order = np.random.default_rng(4).permutation(len(data))
        data = [data[k] for k in order]
        ones = sum(y for _, y in data)
        if 0 < ones < len(data):
            at, w, bias = ftrl(data, epochs)
        else:
            share = (ones + 0.5) / (len(data) + 1)
            at, w, bias = np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share)))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], names=["at", "w"])

    got = coded.coalesce(1).mapInArrow(fit, "at long, w double").collect()     # at most 2^BITS weights
    bias = next(r["w"] for r in got if r["at"] < 0) if got else 0.0
    kept = sorted((r["at"], r["w"]) for r in got if r["at"] >= 0)
    return np.array([x[0] for x in kept], np.int64), np.array([x[1] for x in kept]), bias


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """Rows with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: list[np.ndarray] = []

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        at, weight, bias = shared.value
        if not cache:
            full = np.zeros(1 << BITS, np.float32)
            full[at] = weight
            cache.append(full)
        w = cache[0]
        docs_, buckets = [], []
        for doc, bucket in features(b.column(b.schema.get_field_index(text_col))):
            hit = w[bucket] != 0
            docs_.append(doc[hit])
            buckets.append(bucket[hit])
        doc, bucket = T.unique_by_doc(np.concatenate(docs_), np.concatenate(buckets))
        total = bias + np.bincount(doc, w[bucket].astype(np.float64), b.num_rows)
        score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return add_columns(docs, "score double, predicted int", text_col, run, keep)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; fold 0 of 5 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    held = F.coalesce(fold_hash(F.col("doc_id"), 5) == 0, F.lit(False))
    # the sample is chosen among labels before the texts are joined to it
    some = labels.filter(~held).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAIN_ROWS)
    model = train(docs.join(F.broadcast(some), "doc_id"))
    return predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
