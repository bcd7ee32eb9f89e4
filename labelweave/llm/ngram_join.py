"""N-gram Jaccard self-join with MinHash banding (operator 8).

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is at least 0.8; ``class_id`` is the smallest id among the texts
connected by links, ``n_links`` the number of other rows linked to a row.

1. Each text becomes its shingle set, an id of that set, and one hash per band
   of MinHash rows. Bands and rows follow from the threshold and a target
   recall (``bands_for``). Texts with equal shingle sets are one *set* with a
   multiplicity; everything below works on sets, so copies never make pairs.
2. Sets are shuffled on (band, hash). Bucket sizes come from a pre-aggregated
   count. A small bucket emits its pairs, each pair only from the first band
   that it shares. Large buckets with members in common (one crowd of near copies
   fills a bucket in nearly every band) form a *crowd*, so its sets are sent
   once and not once a band. A crowd is cut into blocks by a hash of the set id;
   each pair of blocks is compared in one task that returns only link counts
   and a spanning forest, so no bucket, however hot, is collected or expanded
   into pairs, and none is capped. A pair counts where its first shared bucket is.
3. Both ways verify on the full shingle sets. Only sets that share a bucket
   send theirs: a fixed-size bit map of their ids is tested in the second pass
   over the texts (false positives only cost traffic), then an exact join.
4. Classes: labels of the smallest set are passed along the links until nothing
   changes, doubling the reach each round; each round is written to the shared
   folder.

Shingles are compared by 48 bits of their hash; a chance equality of two
different shingles within one pair of 600-word texts has odds of about 1e-9.

Defined cases: a text of one to four words has one shingle, all its words. A
null, empty or word-less text has no shingles: no links, a class of its own.
Rows with equal text are linked to each other; repeated rows (same id) count
as rows. A row whose id is null can belong to a class, but gives it no id; if
all ids of a class are null, so is ``class_id``. An empty table gives an empty
result. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import textkit as T
from labelweave.llm.common import add_columns, bare, cut, table
from labelweave.llm.registry import query

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
NOISE = (0.3, 0.05)     # at this similarity, at most this share of pairs become candidates
SMALL_BUCKET = 32
BLOCK_BYTES = 4 << 20   # shingles of one block of a crowd, at most
BLOCK_ROWS = 256        # a smaller crowd is cut into up to EVEN_BLOCKS blocks of about this many sets
EVEN_BLOCKS = 16
BUCKET_ROWS = 256       # entries of a large bucket that meet in one task
BITMAP_BITS = 1 << 25
_SHINGLE_BYTES = 6


def bands_for(threshold: float, recall: float, noise: tuple[float, float] = NOISE) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with the target recall at the threshold and few noise candidates."""
    best = None
    for rows in range(1, 33):
        p = threshold ** rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        if 1 - (1 - noise[0] ** rows) ** bands <= noise[1] and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    return best


def shingles(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) of a slice, sorted."""
    r, h = T.words(T.flat(col))
    ok = T.inside(r.doc, k)
    doc, g = [r.doc[: len(ok)][ok]], [T.grams(h, k)[ok]]
    for size in range(1, k):
        which = np.flatnonzero(r.counts == size)
        if len(which):
            doc.append(which)
            g.append((T.grams(h, size) if size > 1 else T.mix(h + np.uint64(1)))[r.first[which]])
    mask = np.uint64((1 << (8 * _SHINGLE_BYTES)) - 1)
    return T.unique_by_doc(np.concatenate(doc), np.concatenate(g) & mask)


def _set_ids(doc: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """First shingle and number of shingles of each row, and the 16-byte id of its set (None: no shingles)."""
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    ids: list[bytes | None] = [None] * n
    full = np.flatnonzero(count)
    if len(full):
        a = np.add.reduceat(T.mix(g + np.uint64(0x51)), first[full])
        b = np.bitwise_xor.reduceat(T.mix(g * np.uint64(0x9E3779B97F4A7C15)), first[full])
        both = np.empty((len(full), 2), np.uint64)
        both[:, 0], both[:, 1] = T.mix(a + count[full].astype(np.uint64)), T.mix(b ^ a)
        raw = both.tobytes()
        for k, i in enumerate(full.tolist()):
            ids[i] = raw[16 * k: 16 * k + 16]
    return first, count, ids


def _signature_fn(text_col: str, k: int, bands: int, rows: int):
    rng = np.random.default_rng(8)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        doc, g = shingles(b.column(b.schema.get_field_index(text_col)), k)
        first, count, ids = _set_ids(doc, g, b.num_rows)
        full = np.flatnonzero(count)
        out = np.zeros((len(full), bands), np.uint64)
        x = T.mix(g + np.uint64(0xA5))
        for i in range(bands * rows) if len(full) else ():
            low = np.minimum.reduceat(x * mul[i], first[full])
            out[:, i // rows] = T.mix(out[:, i // rows] ^ low) + np.uint64(i)
        return {"sid": pa.array(ids, pa.binary()), "n_shingles": pa.array(count.astype(np.int32)),
                "bands": T.lists(out.view(np.int64).ravel(), np.where(count > 0, bands, 0), pa.int64())}

    return run


def _bit(sid):
    """Position in the bit map: the first four bytes of a set id, from 1 as the bitmap_* functions number bits."""
    return F.conv(F.hex(F.substring(sid, 1, 4)), 16, 10).cast("long") % BITMAP_BITS + 1


def signatures(docs: DataFrame, text_col: str, k: int, bands: int, rows: int, keep: list[str]) -> DataFrame:
    return add_columns(docs, "sid binary, n_shingles int, bands array<long>", text_col,
                       _signature_fn(text_col, k, bands, rows), keep)


def set_ids(docs: DataFrame, text_col: str = "text", k: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Rows with ``sid``, the id of their shingle set (null: no words)."""
    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        doc, g = shingles(b.column(b.schema.get_field_index(text_col)), k)
        return {"sid": pa.array(_set_ids(doc, g, b.num_rows)[2], pa.binary())}

    return add_columns(docs, "sid binary", text_col, run, keep)


def _wanted_shingles(docs: DataFrame, wanted: DataFrame, text_col: str, k: int) -> DataFrame:
    """(sid, shingles) of the wanted sets, one row each."""
    spark = docs.sparkSession
    bits = wanted.select(_bit("sid").alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("m"))
    whole = np.zeros((BITMAP_BITS // 32768 + 1, 4096), np.uint8)   # fixed size, whatever the input
    for row in bits.toLocalIterator():
        whole[row["k"] - 1] = np.frombuffer(bytes(row["m"]), np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = np.frombuffer(shared.value, np.uint8)
        for whole in batches:
            for b in T.slices(whole, text_col):
                doc, g = shingles(b.column(0), k)
                first, count, ids = _set_ids(doc, g, b.num_rows)
                full = np.flatnonzero(count)
                bit = np.frombuffer(b"".join(ids[i][:4] for i in full.tolist()), ">u4").astype(np.int64) % BITMAP_BITS
                hit = full[(want[bit >> 3] >> (bit & 7) & 1).astype(bool)].tolist()
                six = [np.ascontiguousarray(g[first[i]: first[i + 1]]).view(np.uint8).reshape(-1, 8)[:, :_SHINGLE_BYTES].tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], pa.binary()), pa.array(six, pa.binary())],
                                                 names=["sid", "shingles"])

    found = docs.select(text_col).mapInArrow(run, "sid binary, shingles binary")
    one = found.groupBy("sid").agg(F.first("shingles").alias("shingles"))
    return one.join(wanted, "sid", "left_semi")


def unpack(raw: bytes) -> np.ndarray:
    eight = np.zeros((len(raw) // _SHINGLE_BYTES, 8), np.uint8)
    eight[:, :_SHINGLE_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _SHINGLE_BYTES)
    return eight.view(np.uint64).ravel()


def _pairs_equal(threshold: float):
    """Verify pairs on their full shingle sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("xs"), b.column("ys")
            keep = []
            for i in range(b.num_rows):
                s, t = unpack(x[i].as_py()), unpack(y[i].as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= threshold * (len(s) + len(t) - both) - 1e-9)
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _first_shared(bands_a: np.ndarray, bands_b: np.ndarray) -> np.ndarray:
    """Matrix of the first equal band of each pair of rows (number of bands: none)."""
    n = bands_a.shape[1]
    out = np.full((len(bands_a), len(bands_b)), n, np.int16)
    for j in range(n - 1, -1, -1):
        out[bands_a[:, j][:, None] == bands_b[:, j][None, :]] = j
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 512) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set, by products of 0/1 columns."""
    a, b = np.concatenate(left), np.concatenate(right)
    ra = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rb = np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(a, b)
    ia, ib = np.searchsorted(shared, a), np.searchsorted(shared, b)
    oka = (ia < len(shared)) & (shared[np.minimum(ia, max(0, len(shared) - 1))] == a) if len(shared) else np.zeros(len(a), bool)
    okb = (ib < len(shared)) & (shared[np.minimum(ib, max(0, len(shared) - 1))] == b) if len(shared) else np.zeros(len(b), bool)
    ra, ia, rb, ib = ra[oka], ia[oka], rb[okb], ib[okb]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    ra, ia, rb, ib = ra[oa], ia[oa], rb[ob], ib[ob]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), step):
        m, n = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        s, e = np.searchsorted(ia, [at, at + step])
        m[ra[s:e], ia[s:e] - at] = 1
        s, e = np.searchsorted(ib, [at, at + step])
        n[rb[s:e], ib[s:e] - at] = 1
        out += m @ n.T
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flags of the links a-b that connect parts not connected before."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[y] = x
            keep[i] = True
    return keep


_BLOCK_OUT = "x binary, y binary, n long"


def _block_pair(threshold: float):
    """Compare the two blocks of a crowd: rows (x, null, copies linked to x) and (x, y, null) of a spanning forest."""
    def run(key, rows):
        i, j = key[1].as_py(), key[2].as_py()
        sets = [unpack(x) for x in rows["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets])
        bands = np.array(rows["bands"].to_pylist(), np.int64)
        here = np.zeros((len(sets), bands.shape[1] + 1), bool)      # bands whose bucket belongs to the crowd
        for k, some in enumerate(rows["crowd_bands"].to_pylist()):
            here[k, some] = True
        sid, mult, block = rows["sid"].to_pylist(), rows["mult"].to_numpy(), rows["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        total, ends = np.zeros(len(sets), np.int64), []
        for at in range(0, len(left), 1024):
            for to in range(0, len(right), 1024):
                p, q = left[at: at + 1024], right[to: to + 1024]
                ok = here[p[:, None], _first_shared(bands[p], bands[q])]
                if i == j:
                    ok &= p[:, None] < q[None, :]
                if not ok.any():
                    continue
                both = _overlaps([sets[x] for x in p], [sets[x] for x in q])
                ok &= both >= threshold * (size[p][:, None] + size[q][None, :] - both) - 1e-4
                total[p] += ok @ mult[q]
                total[q] += mult[p] @ ok
                a, b = np.nonzero(ok)
                tree = _forest(len(sets), p[a], q[b])
                ends += zip(p[a][tree].tolist(), q[b][tree].tolist(), strict=True)
        hit = np.flatnonzero(total).tolist()
        return pa.table({
            "x": pa.array([sid[k] for k in hit] + [sid[x] for x, _ in ends], pa.binary()),
            "y": pa.array([None] * len(hit) + [sid[y] for _, y in ends], pa.binary()),
            "n": pa.array(total[hit].tolist() + [None] * len(ends), pa.int64())})

    return run


def _crowds(hot: DataFrame) -> DataFrame:
    """(crowd, sid, crowd_bands) of the entries (sid, band, hash, m) of large buckets.

    Every bucket belongs to one crowd: the smallest set that any of its members meets in a large
    bucket. One round of that is enough to bring the buckets of one crowd of near copies together;
    buckets that stay apart only cost traffic."""
    parts = F.ceil(F.col("m") / BUCKET_ROWS).cast("int")     # a bucket's entries are dealt to so many tasks
    hot = hot.withColumn("salt", F.pmod(F.xxhash64("sid", "band"), parts).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")
    bucket = ["band", "hash"]
    low = hot.groupBy(*bucket, "m").agg(F.min("sid").alias("low")).select(*bucket, "low", salts)
    label = hot.join(low, [*bucket, "salt"]).groupBy("sid").agg(F.min("low").alias("label"))
    of = hot.join(label, "sid").groupBy(*bucket, "m").agg(F.min("label").alias("crowd")).select(*bucket, "crowd", salts)
    return hot.join(of, [*bucket, "salt"]).groupBy("crowd", "sid").agg(F.collect_set("band").alias("crowd_bands"))


def _components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(sid, root) for every set with a link: the smallest set id of its component.

    Alternates two steps on the edges: every node links its larger neighbours,
    then its smaller ones, to its smallest neighbour. Each step is written to the
    shared folder; it ends when a step changes nothing."""
    def seen(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    e = cut(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
            .filter("x <> y").distinct(), "links")     # x > y
    before = seen(e)
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.filter("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(
            F.struct(F.col("x").alias("x"), F.col("m").alias("y")),
            F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.x", "e.y")
        e = cut(small.filter("x <> y").distinct(), "links")
        now = seen(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("x").alias("sid"), F.col("y").alias("root"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
         threshold: float = THRESHOLD, recall: float = RECALL, small_bucket: int = SMALL_BUCKET,
         block_bytes: int = BLOCK_BYTES) -> dict[str, DataFrame]:
    """``rows``: one row per input row (id, sid, class_id, n_links, n_copies); ``sets``: (sid, class_sid, class_id, ...)."""
    bands, rows = bands_for(threshold, recall)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sig = cut(signatures(docs, "_text", k, bands, rows, ["_id"]), "signatures")
    sets = cut(sig.filter("sid IS NOT NULL").groupBy("sid").agg(
        F.count(F.lit(1)).alias("mult"), F.min("_id").alias("low_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands")), "sets")

    entries = sets.select("sid", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    crowd = entries.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("n_shingles").cast("long") * _SHINGLE_BYTES).alias("bytes")).filter("m > 1")
    entries = cut(entries.join(crowd, ["band", "hash"]).select("sid", "band", "hash", "m", "bytes"), "buckets")
    wanted = entries.select("sid").distinct()
    full = cut(_wanted_shingles(docs, wanted, "_text", k), "shingles", compression="none")

    # small buckets: pairs, each from the first band that it shares
    small = entries.filter(F.col("m") <= small_bucket).select("sid", "band", "hash").join(
        sets.select("sid", "bands"), "sid")
    a = small.select("band", "hash", F.col("sid").alias("x"), F.col("bands").alias("xb"))
    b = small.select("band", "hash", F.col("sid").alias("y"), F.col("bands").alias("yb"))
    pairs = a.join(b, ["band", "hash"]).filter("x < y").filter(
        "NOT exists(slice(zip_with(xb, yb, (p, q) -> p = q), 1, band), s -> s)").select("x", "y")
    pairs = (pairs.join(full.select(F.col("sid").alias("x"), F.col("shingles").alias("xs")), "x")
             .join(full.select(F.col("sid").alias("y"), F.col("shingles").alias("ys")), "y"))
    pairs = cut(pairs.select("x", "y", "xs", "ys").mapInArrow(_pairs_equal(threshold), "x binary, y binary"), "pairs")

    # large buckets: pairs of blocks of their crowds
    crowds = cut(_crowds(entries.filter(F.col("m") > small_bucket).select("sid", "band", "hash", "m")), "crowds")
    sizes = crowds.join(sets.select("sid", "n_shingles"), "sid").groupBy("crowd").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("n_shingles").cast("long") * _SHINGLE_BYTES).alias("bytes"))
    sizes = sizes.select("crowd", F.greatest(F.ceil(F.col("bytes") / block_bytes), F.ceil(F.col("m") / 4096), F.least(
        F.lit(EVEN_BLOCKS), F.ceil(F.col("m") / BLOCK_ROWS))).cast("int").alias("blocks"))
    hot = crowds.join(sizes, "crowd").join(sets.select("sid", "bands", "mult"), "sid").join(full, "sid")
    hot = hot.withColumn("block", F.pmod(F.xxhash64("sid", "crowd"), F.col("blocks")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = hot.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "sid", "mult", "bands", "crowd_bands", "shingles")
    blocks = cut(hot.groupBy("crowd", "i", "j").applyInArrow(_block_pair(threshold), _BLOCK_OUT), "blocks")

    mult = sets.select("sid", "mult")
    ends = pairs.select(F.col("x").alias("a"), F.col("y").alias("sid")).unionByName(
        pairs.select(F.col("y").alias("a"), F.col("x").alias("sid")))
    linked = (ends.join(mult, "sid").select(F.col("a").alias("sid"), F.col("mult").alias("n"))
              .unionByName(blocks.filter("y IS NULL").select(F.col("x").alias("sid"), "n"))
              .groupBy("sid").agg(F.sum("n").alias("linked")))
    roots = _components(pairs.unionByName(blocks.filter("y IS NOT NULL").select("x", "y")))
    known = sets.select("sid", "mult", "low_id").join(roots, "sid", "left").join(linked, "sid", "left")
    known = known.withColumn("class_sid", F.coalesce("root", "sid"))
    lows = known.groupBy("class_sid").agg(F.min("low_id").alias("class_id"))
    known = cut(known.join(lows, "class_sid").select(
        "sid", "class_sid", "class_id", "low_id", F.col("mult").alias("n_copies"),
        (F.col("mult") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "classes")
    out = sig.filter("sid IS NOT NULL").select("_id", "sid").join(known.drop("low_id", "class_sid"), "sid")
    out = out.select("_id", "sid", "class_id", "n_links", "n_copies").unionByName(
        sig.filter("sid IS NULL").selectExpr("_id", "sid", "_id AS class_id", "0L AS n_links", "1L AS n_copies"))
    out = out.withColumnRenamed("_id", id_col)
    return {"rows": out, "sets": known}


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest id stays (null ids last).

    Of rows with one id and one shingle set the first by its JSON text stays."""
    cols = docs.columns
    plain, (key, text) = bare(docs, id_col, text_col)
    own = plain.columns
    sets = join(plain, key, text, **options)["sets"]
    best = sets.groupBy("class_sid").agg(F.min(F.struct(F.col("low_id").isNull(), "low_id", "sid")).alias("b"))
    best = best.select(F.col("b.low_id").alias("_low"), F.col("b.sid").alias("_sid"))
    tagged = set_ids(plain, text)
    same = (F.col("sid") == F.col("_sid")) & F.col(key).eqNullSafe(F.col("_low"))
    row = F.struct(*own)
    kept = tagged.join(best, same, "left_semi").groupBy("sid", F.col(key).alias("_id")).agg(
        F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    return kept.unionByName(tagged.filter("sid IS NULL").select(*own)).toDF(*cols)


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join(docs)["rows"].select("doc_id", "class_id", "n_links", "n_copies")
