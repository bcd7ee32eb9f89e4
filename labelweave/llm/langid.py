"""Language identification: naive Bayes over hashed character n-grams (operator 7).

Counts of character 1- to 3-grams, hashed into ``BUCKETS`` columns, are gathered
per language over all labelled texts: each task adds up its own counts, and the
shuffle adds up the tasks' (at most languages x buckets rows each). Texts with
the same content count once per copy. The smoothed log-probability matrix,
languages x buckets, is broadcast with the log prior of each language (its
smoothed share of the labelled texts), and a slice of texts is scored at once:
per n-gram the matrix row is fetched, per text the rows and the prior are summed. ``score`` is
the posterior of the predicted language, tempered by the number of n-grams so
that long texts do not all saturate at 1.

Defined cases: a text that is null or has no letter is ``und`` with score 0; if
nothing can be learned, every text is ``und``; equal posteriors go to the first
language in alphabetical order; repeated rows are treated alike; an empty table
gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import textkit as T
from labelweave.llm.common import add_columns, cut, fold_hash, table
from labelweave.llm.registry import query

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 1000       # the matrix is at most this many rows of BUCKETS floats
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def characters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, and the row of each; a blank ends every text."""
    texts = [(t or "").lower() + " " for t in col.to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    return (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"),
            np.repeat(np.arange(len(texts)), sizes))


def features(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram of a slice, one order after the other."""
    c, doc = characters(col)
    for n in ORDERS:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = np.full(m, np.uint32(n), np.uint32)
        for j in range(n):
            h = (h ^ c[j: j + m]) * _MUL[j]
            h ^= h >> np.uint32(15)
        ok = doc[:m] == doc[n - 1:]
        yield doc[:m][ok], ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 14))[ok]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def count_ngrams(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n): counts of n-grams; bucket BUCKETS counts the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in T.slices(whole, text_col):
                lang = np.array(b.column(b.schema.get_field_index(lang_col)).to_pylist(), object)
                codes, names, texts = np.unique(lang.astype(str), return_inverse=True, return_counts=True)
                for code, k in zip(codes.tolist(), texts.tolist(), strict=True):
                    total.setdefault(code, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += k
                for doc, bucket in features(b.column(b.schema.get_field_index(text_col))):
                    n = np.bincount(names[doc] * BUCKETS + bucket, minlength=len(codes) * BUCKETS)
                    for k, code in enumerate(codes.tolist()):
                        total[code][:BUCKETS] += n[k * BUCKETS: (k + 1) * BUCKETS]
        for code, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([code] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))],
                names=["lang", "bucket", "n"])

    return (labelled.select(text_col, lang_col).mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and the log-probability matrix; its last column is the smoothed log prior."""
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = cut(count_ngrams(labelled, text_col, lang_col), "langid-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: raise MAX_LANGUAGES with the memory of the executors")
    place = {x: i for i, x in enumerate(langs)}
    n = np.zeros((len(langs), BUCKETS + 1))
    for r in counts.toLocalIterator():                        # at most languages x (buckets + 1) rows
        n[place[r["lang"]], r["bucket"]] = r["n"]
    n += SMOOTHING
    if langs:
        n[:, :-1] /= n[:, :-1].sum(axis=1, keepdims=True)
        n[:, -1] /= n[:, -1].sum()
    return langs, np.log(n).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """Rows with ``lang_pred`` and ``score``."""
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))     # buckets x languages

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        col = b.column(b.schema.get_field_index(text_col))
        n, table_ = b.num_rows, shared.value
        known = np.array([_has_letter(t) for t in col.to_pylist()], bool) if langs else np.zeros(n, bool)
        total, grams = np.zeros((n, max(1, len(langs)))), np.zeros(n)
        for doc, bucket in features(col) if langs else ():
            grams += np.bincount(doc, minlength=n)
            for k in range(len(langs)):
                total[:, k] += np.bincount(doc, table_[:, k][bucket], n)
        if langs:
            total += table_[BUCKETS]
        total /= np.sqrt(np.maximum(grams, 1))[:, None]       # temper
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return {"lang_pred": pa.array([langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)], pa.string()),
                "score": pa.array(np.where(known, p[np.arange(n), best], 0.0))}

    return add_columns(docs, "lang_pred string, score double", text_col, run, keep)


@query("op7_langid")
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fold 2 of 4 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold_hash(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.filter(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])
