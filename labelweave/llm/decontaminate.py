"""Benchmark decontamination by winnowing (operator 3).

Both sides are cut into k-grams of words; of every ``w`` consecutive k-gram
hashes the smallest is kept as a fingerprint. With ``k + w - 1 = window`` any
shared run of ``window`` words holds a fingerprint that both sides keep, so
joining the fingerprints misses none. Each match is extended word by word in
both directions, and runs of at least ``window`` words are hits. A test item
shorter than the window is one window of its own length and is looked up by
the hash of all its words.

The test set is the small side. It is read in blocks whose size is measured
beforehand (``BLOCK_BYTES`` of item text each); every block is broadcast and
joined against all documents inside the scan, so documents are never shuffled
and a test set of any size fits. Between blocks the hits so far are written to
the shared folder.

Defined cases: a null or empty text has no words and no hits; an item without
words is never found; repeated documents are judged row by row; repeated items
(same id) count once per distinct item id; an item whose id is null takes part
in hits but not in the list of ids; an empty table gives an empty result; input
columns named like a result column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import textkit as T
from labelweave.llm.common import WORD_RE, add_columns, cut, table, without
from labelweave.llm.registry import query

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20


def _slide(a: np.ndarray, w: int, fn) -> np.ndarray:
    out = a[: len(a) - w + 1].copy()
    for j in range(1, w):
        fn(out, a[j: j + len(out)], out=out)
    return out


def fingerprints(h: np.ndarray, doc: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are the smallest of some w consecutive ones of their text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = T.grams(h, k)
    if len(g) < w:
        return none
    low = _slide(g, w, np.minimum)
    low[~T.inside(doc, k + w - 1)] = 0          # windows that cross texts choose nothing
    pad = np.zeros(w - 1, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), w, np.maximum)
    at = np.flatnonzero((high == g) & (g > 0))
    at = at[T.inside(doc, k)[at]]
    return at, g[at]


class Items:
    """One block of the test set: word hashes, fingerprints and short items."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int, k: int) -> None:
        f = T.flat(pa.array(texts, pa.string()))
        r, self.words = T.words(f)
        self.ids, self.doc, self.window, self.k = ids, r.doc, window, k
        self.w = window - k + 1
        n = r.counts
        long_word = n[self.doc] >= window
        at, g = fingerprints(self.words, self.doc, k, self.w)
        keep = long_word[at]
        at, g = at[keep], g[keep]
        order = np.argsort(g, kind="stable")
        self.fp, self.at = g[order], at[order]
        self.short = {}
        for size in range(1, window):
            which = np.flatnonzero(n == size)
            if len(which):
                full = T.grams(self.words, size)[r.first[which]] if size > 1 else T.mix(
                    self.words[r.first[which]] + np.uint64(1))
                order = np.argsort(full, kind="stable")
                self.short[size] = full[order], which[order]


def _matches(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (index into keys, index into sorted_keys) with equal values."""
    lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = hi - lo
    left = np.repeat(np.arange(len(keys)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return left, np.repeat(lo, n) + step


def _extend(h, doc, dpos, items: Items, ipos, step: int) -> np.ndarray:
    """Equal words beyond the match in one direction, up to window - 1 of them."""
    n = np.zeros(len(dpos), np.int64)
    live = np.arange(len(dpos))
    for j in range(1, items.window):
        d, i = dpos[live] + step * j, ipos[live] + step * j
        ok = (d >= 0) & (d < len(h)) & (i >= 0) & (i < len(items.words))
        live, d, i = live[ok], d[ok], i[ok]
        ok = ((h[d] == items.words[i]) & (doc[d] == doc[dpos[live]])
              & (items.doc[i] == items.doc[ipos[live]]))
        live = live[ok]
        n[live] += 1
        if not len(live):
            break
    return n


def find(h: np.ndarray, doc: np.ndarray, items: Items):
    """Hits of a slice: start word, end word (exclusive) and item index of each."""
    at, g = fingerprints(h, doc, items.k, items.w)
    a, b = _matches(items.fp, g)
    dpos, ipos = at[a], items.at[b]
    left = _extend(h, doc, dpos, items, ipos, -1)
    right = _extend(h, doc, dpos + items.k - 1, items, ipos + items.k - 1, 1)
    ok = left + items.k + right >= items.window
    out = [(dpos[ok] - left[ok], dpos[ok] + items.k + right[ok], items.doc[ipos[ok]])]
    for size, (keys, which) in items.short.items():
        g = T.grams(h, size) if size > 1 else T.mix(h + np.uint64(1))
        ok = np.flatnonzero(T.inside(doc, size))
        a, b = _matches(keys, g[ok])
        out.append((ok[a], ok[a] + size, which[b]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _slice_fn(items_of, text_col: str):
    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        items: Items = items_of()
        col = lambda c: b.column(b.schema.get_field_index(c))
        r, h = T.words(T.flat(col(text_col)))
        start, end, item = find(h, r.doc, items)
        spans = col("_spans").flatten().to_numpy() if "_spans" in b.schema.names else np.zeros(0, np.int64)
        delta = np.zeros(len(h) + 1, np.int64)
        np.add.at(delta, start, 1)
        np.add.at(delta, end, -1)
        if len(spans):  # hits of earlier blocks, as word positions of their text
            n = np.diff(col("_spans").offsets.to_numpy()) // 2
            base = np.repeat(r.first[:-1], n)
            np.add.at(delta, spans[0::2] + base, 1)
            np.add.at(delta, spans[1::2] + base, -1)
        cover = np.cumsum(delta)[:-1] > 0
        first = np.zeros(len(h) + 1, bool)
        first[r.first] = True
        new = cover.copy()
        new[1:] &= ~(cover[:-1] & ~first[1:-1])
        last = cover.copy()
        last[:-1] &= ~(cover[1:] & ~first[1:-1])
        s, e = np.flatnonzero(new), np.flatnonzero(last) + 1
        owner = r.doc[s]
        flat = np.empty(2 * len(s), np.int64)
        flat[0::2], flat[1::2] = s - r.first[owner], e - r.first[owner]
        d, i = T.unique_by_doc(r.doc[start], item)
        ids: list[set[str]] = [set(x) for x in col("item_ids").to_pylist()] if "item_ids" in b.schema.names \
            else [set() for _ in range(b.num_rows)]
        for x, y in zip(d.tolist(), i.tolist(), strict=True):
            if items.ids[y] is not None:
                ids[x].add(items.ids[y])
        return {"n_words": pa.array(r.counts.astype(np.int64)),
                "_spans": T.lists(flat, 2 * np.bincount(owner, minlength=b.num_rows), pa.int64()),
                "item_ids": pa.array([sorted(x) for x in ids], pa.list_(pa.string()))}

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW,
                  gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows with ``n_words``, ``hit_spans`` (array of first and end word), ``n_hit``, ``item_ids`` and ``contaminated``."""
    spark = docs.sparkSession
    cols = keep if keep is not None else docs.columns
    docs = without(docs, ["n_words", "hit_spans", "n_hit", "item_ids", "contaminated", "_spans"], [text_col])
    cols = [c for c in cols if c in docs.columns]
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        rows = part.collect()                        # one block of measured size
        shared = spark.sparkContext.broadcast(([r["id"] for r in rows], [r["text"] for r in rows]))
        cache: list[Items] = []

        def items_of(shared=shared, cache=cache) -> Items:
            if not cache:
                cache.append(Items(*shared.value, window, gram))
            return cache[0]

        src = out if k == 0 else cut(out, "decontaminate")
        names = cols if k == blocks - 1 else list(dict.fromkeys([*cols, text_col]))
        out = _with_state(src, names, text_col, items_of)
    spans = F.transform(F.sequence(F.lit(0), F.size("_spans") - 2, F.lit(2)),
                        lambda i: F.struct(F.get("_spans", i).alias("start"), F.get("_spans", i + 1).alias("end")))
    spans = F.when(F.size("_spans") > 0, spans).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return (out.withColumn("hit_spans", spans).drop("_spans")
            .withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
            .withColumn("contaminated", F.col("n_hit") > 0))


def _with_state(df: DataFrame, names: list[str], text_col: str, items_of) -> DataFrame:
    ddl = "n_words long, _spans array<long>, item_ids array<string>"
    if "_spans" not in df.columns:
        return add_columns(df, ddl, text_col, _slice_fn(items_of, text_col), names)
    # carry the state under its own names past the column replacement
    held = df.withColumnsRenamed({"_spans": "_held_spans", "item_ids": "_held_ids"})
    fn = _slice_fn(items_of, text_col)

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        back = {"_held_spans": "_spans", "_held_ids": "item_ids"}
        return fn(b.rename_columns([back.get(n, n) for n in b.schema.names]))

    return add_columns(held, ddl, text_col, run, [*names, "_held_spans", "_held_ids"]).drop("_held_spans", "_held_ids")


_DUCK_RE = WORD_RE
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_DUCK_RE}') AS ws
           FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_DUCK_RE}') AS ws
      FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS gram
       FROM (SELECT item_id, ws, least(len(ws), {WINDOW}) AS size,
                    unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, size, array_to_string(ws[i : i + size - 1], ' ') AS gram
       FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
             FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
h AS (SELECT dw.r, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.gram = bw.gram),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM h GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


@query("op3_decontaminate", SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
