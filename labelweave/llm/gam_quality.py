"""Quality classifier: additive model with pairwise interactions (operator 9).

Each text becomes a few numeric features. Training cycles over the features
and boosts, for each in turn, a shallow tree on that feature alone (three
leaves), adding it to the feature's lookup table over quantile bins. Then the
feature pairs with the strongest remaining signal get shallow trees on two
features, added to tables over pairs of coarser bins. The model is a handful of
small tables, and a score is the logistic of the sum of the looked-up bins.

Training uses a bounded sample: at most ``TRAIN_ROWS`` labelled texts. ``train`` takes those with the smallest hash of
their text; the query hands it the rows with the smallest hash of their id. Their features travel, not the texts.
Scoring is one pass over all texts.

Defined cases: a null or empty text has features 0 and a score like any other;
ties of the sample's hash are broken by the label; without labels of both kinds the
score is the (smoothed) share of label 1; repeated rows are treated alike; an
empty table gives an empty result; input columns named like a result column are
replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import textkit as T
from labelweave.llm.common import add_columns, fold_hash, table
from labelweave.llm.quality_rules import count_slice
from labelweave.llm.registry import query

FEATURES = ("log_words", "word_len", "symbols", "dup_lines", "repeats", "upper", "digits", "marks",
            "non_ascii", "distinct", "line_words", "stops")
TRAIN_ROWS = 20_000
BINS, PAIR_BINS = 64, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 40, 6
RATE, RIDGE, MIN_LEAF = 0.1, 1.0, 10.0

_BYTE = np.arange(256)
_KINDS = {
    "upper": (_BYTE >= 0x41) & (_BYTE <= 0x5A),
    "digits": (_BYTE >= 0x30) & (_BYTE <= 0x39),
    "marks": np.isin(_BYTE, np.frombuffer(b"!?", np.uint8)),
    "non_ascii": _BYTE >= 0xC0,
    "stops": np.isin(_BYTE, np.frombuffer(b".,;:", np.uint8)),
}


def features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    c = {k: v.to_numpy().astype(float) for k, v in count_slice(col).items()}
    f = T.flat(col)
    doc = np.repeat(np.arange(f.n), np.diff(f.off))
    w, h = T.words(f)
    distinct = np.bincount(T.unique_by_doc(w.doc, h)[0], minlength=f.n)
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    lines = np.maximum(c["n_lines"], 1)
    out = {"log_words": np.log1p(c["n_words"]), "word_len": c["word_chars"] / words, "symbols": c["n_symbols"] / chars,
           "dup_lines": c["n_dup_lines"] / lines, "repeats": c["n_repeat_words"] / words,
           "distinct": distinct / np.maximum(w.counts, 1), "line_words": np.log1p(c["n_words"] / lines)}
    for name, kind in _KINDS.items():
        out[name] = np.bincount(doc[kind[f.data]], minlength=f.n) / chars
    return np.stack([out[n] for n in FEATURES], axis=1).astype(np.float64)


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], "right")]
        if self.pairs:
            b = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
            for i, j, t in self.pairs:
                total += t[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.zeros(0)


def _best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, bins on the left) of the best split of consecutive bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(nl < MIN_LEAF) | (nr < MIN_LEAF)] = 0.0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a shallow tree on one feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_best_split(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 0:
            break
        _, k, a, b = best
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per cell: one split of the first feature, then one of the second on each side."""
    _, k = _best_split(g.sum(1), h.sum(1), n.sum(1))
    out = np.zeros_like(g)
    for a, b in ((0, k), (k, len(g))) if k else ((0, len(g)),):
        out[a:b] = _tree(g[a:b].sum(0), h[a:b].sum(0), n[a:b].sum(0), 2)[None, :]
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on a sample."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Model(bias, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    m = Model(bias, edges, [np.zeros(len(e) + 1) for e in edges])
    total = np.full(len(y), bias)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(at):
            g, h = gradient()
            size = len(edges[j]) + 1
            t = _tree(np.bincount(b, g, size), np.bincount(b, h, size), np.bincount(b, minlength=size), 3)
            m.tables[j] += t
            total += t[b]
    m.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.pair_edges)]

    def cells(i: int, j: int, v: np.ndarray | None) -> np.ndarray:
        a, b = len(m.pair_edges[i]) + 1, len(m.pair_edges[j]) + 1
        return np.bincount(coarse[i] * b + coarse[j], v, a * b).reshape(a, b)

    g, h = gradient()
    strength = {(i, j): float((cells(i, j, g) ** 2 / (cells(i, j, h) + RIDGE)).sum()) for i, j in combinations(range(len(edges)), 2)}
    chosen = sorted(strength, key=lambda p: (-strength[p], p))[:PAIRS]
    m.pairs = [(i, j, np.zeros_like(cells(i, j, g))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in m.pairs:
            g, h = gradient()
            add = _pair_tree(cells(i, j, g), cells(i, j, h), cells(i, j, None))
            t += add
            total += add[coarse[i], coarse[j]]
    return m


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_ROWS) -> Model:
    """Model from at most ``limit`` labelled rows."""
    rows = (labelled.filter(F.col(label_col).isNotNull())
            .select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(text_col).alias("key")))

    def encode(b: pa.RecordBatch) -> dict[str, pa.Array]:
        x = features(b.column(b.schema.get_field_index("text")))
        return {"x": T.lists(x.ravel(), np.full(len(x), len(FEATURES)), pa.float64())}

    coded = add_columns(rows, "x array<double>", "text", encode, ["label", "key"])
    got = coded.orderBy("key", "label").limit(limit).select("x", "label").collect()    # at most limit x FEATURES numbers
    got.sort(key=lambda r: (r["x"], r["label"]))
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got], float))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))      # plain arrays

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        score = Model(**shared.value).score(features(b.column(b.schema.get_field_index(text_col))))
        return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return add_columns(docs, "score double, predicted int", text_col, run, keep)


@query("op9_gam_quality")
def op9_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; fold 1 of 3 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    held = F.coalesce(fold_hash(F.col("doc_id"), 3) == 1, F.lit(False))
    some = labels.filter(~held).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAIN_ROWS)
    model = train(docs.join(F.broadcast(some), "doc_id"))
    return predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
