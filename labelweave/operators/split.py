"""Deterministic stratified train/val split with per-cell caps (E1: P5–P8,
P19, W1–W4, A1, A2, JN5).

Plan shape (one lazy plan, no intermediate tables):

  scan -> project/filter (P6–P8) -> bucket columns (P19)
       -> cell counts: groupBy(cells).count()          partial agg, <= 12 rows
       -> rank 1: row_number() over (partition by cells, salt order by md5 key)
                filtered to rn <= train_cap + val_cap  -> WindowGroupLimit:
                each map task keeps only its top-k before the shuffle (for
                caps within the session's limit), and a cell holding a third
                of all rows is spread over RANK_SALTS tasks either way
       -> rank 2: the same over the cells alone, on at most RANK_SALTS x k rows
       -> broadcast join of the (bounded) cell counts -> allocation (W3)
       -> slice (W4)

The cell count is deliberately NOT a window aggregate over the same
partition: with ``count(*) over`` in the window the group-limit rule does
not fire and the whole cell would land in one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.text import bucketize, resolve_column, yn_bucket

OUT_COLS = ["meta_id", "china_stance_score", "sensitive", "collective_action",
            "english", "mandarin", "spanish", "other_lang", "no_language"]
LABEL_COLS = OUT_COLS[2:]
CELLS = ["stance_bucket", "sensitive_bucket", "collective_bucket"]
# parts of a cell that are ranked apart before the cell is
RANK_SALTS = 256
ID_PATTERN = r"([0-9]{10,})\.mp4"


def prepare_labels(df: DataFrame, video_col: str = "video", stance_col: str | None = None) -> DataFrame:
    """Resolve the stance column, extract the item id from the path,
    cast labels to double, keep rows with a path, an id and a stance.
    A path without an id gives '' (not null) and is dropped."""
    stance = resolve_column(df.columns, [stance_col, "china_stance_score", "pol"])
    missing = [c for c in [video_col, *LABEL_COLS] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    mid = F.regexp_extract(F.col(video_col), ID_PATTERN, 1)
    return (df.filter(F.col(video_col).isNotNull() & (mid != "") & F.col(stance).isNotNull())
              .select(mid.alias("meta_id"),
                      F.col(stance).cast("double").alias("china_stance_score"),
                      *[F.col(c).cast("double").alias(c) for c in LABEL_COLS]))


def with_buckets(df: DataFrame, yn_thresh: float = 0.5, cut1: float = -0.33,
                 cut2: float = 0.33) -> DataFrame:
    """Balancing buckets (used only to stratify; outputs stay raw)."""
    return df.select("*",
                     bucketize("china_stance_score", cut1, cut2).alias("stance_bucket"),
                     yn_bucket("sensitive", yn_thresh).alias("sensitive_bucket"),
                     yn_bucket("collective_action", yn_thresh).alias("collective_bucket"))


def split_key(meta_id, seed: int):
    """W1 order key: md5 of '<id>-SPLIT-<seed>' (portable across engines),
    id as tie-break."""
    return F.md5(F.concat(meta_id, F.lit(f"-SPLIT-{int(seed)}")))


def allocate(c, train_cap: int, val_cap: int, train_frac: float):
    """train_n = least(cap, c<=2 ? 1 : greatest(1, round(c*frac)), c>=2 ? c-1 : 1),
    val_n = least(vcap, greatest(0, c - train_n)). The fraction is a DECIMAL
    literal so round() is exact (45 * 0.7 rounds to 32)."""
    frac = F.lit(Decimal(str(train_frac)))
    by_frac = F.greatest(F.lit(1), F.round(c * frac).cast("int"))
    train_n = F.least(F.lit(int(train_cap)),
                      F.when(c <= 2, F.lit(1)).otherwise(by_frac),
                      F.when(c >= 2, (c - 1).cast("int")).otherwise(F.lit(1)))
    val_n = F.least(F.lit(int(val_cap)), F.greatest(F.lit(0), (c - train_n).cast("int")))
    return train_n, val_n


def stratified_split(labels: DataFrame, video_col: str = "video", stance_col: str | None = None,
                     train_frac: float = 0.7, train_cap: int = 100, val_cap: int = 50,
                     yn_thresh: float = 0.5, cut1: float = -0.33, cut2: float = 0.33,
                     seed: int = 7, keep_work_cols: bool = False, dedupe: bool = False) -> DataFrame:
    """Rows that land in a split, with a ``split`` column ('train'/'val').
    ``dedupe``: one row per id first, so that no id can be in both."""
    k = int(train_cap) + int(val_cap)
    rows = prepare_labels(labels, video_col, stance_col)
    b = with_buckets(dedupe_ids(rows) if dedupe else rows, yn_thresh, cut1, cut2)
    counts = b.groupBy(*CELLS).agg(F.count(F.lit(1)).alias("c"))
    order = [split_key(F.col("meta_id"), seed), F.col("meta_id")]
    salted = b.withColumn("_salt", F.pmod(F.xxhash64("meta_id"), F.lit(RANK_SALTS)))
    first = Window.partitionBy(*CELLS, "_salt").orderBy(*order)
    some = salted.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= F.lit(k)).drop("rn", "_salt")
    ranked = some.withColumn("rn", F.row_number().over(Window.partitionBy(*CELLS).orderBy(*order))
                             ).filter(F.col("rn") <= F.lit(k))
    train_n, val_n = allocate(F.col("c"), train_cap, val_cap, train_frac)
    alloc = (ranked.join(F.broadcast(counts), CELLS)       # 3 x 2 x 2 cells at most
             .withColumn("train_n", train_n).withColumn("val_n", val_n))
    out = (alloc.filter(F.col("rn") <= F.col("train_n") + F.col("val_n"))
           .withColumn("split", F.when(F.col("rn") <= F.col("train_n"), F.lit("train"))
                       .otherwise(F.lit("val"))))
    if keep_work_cols:
        return out
    return out.select(*OUT_COLS, "split")


def dedupe_ids(labels: DataFrame, id_col: str = "meta_id") -> DataFrame:
    """One row per id: the smallest by its other columns (nulls first), in column order.
    A partial aggregate, so a repeated id never gathers in one task."""
    rest = [c for c in labels.columns if c != id_col]
    return (labels.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("_r"))
            .select(*[F.col(id_col) if c == id_col else F.col(f"_r.{c}").alias(c) for c in labels.columns]))


def leak_audit(split_df: DataFrame) -> DataFrame:
    """Ids that are in train and in val, with their numbers of rows there."""
    return (split_df.groupBy("meta_id").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
        .filter("n_train > 0 AND n_val > 0"))


def split_summary(split_df: DataFrame) -> DataFrame:
    """A1: per split: rows, stance range, label means."""
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("china_stance_score").alias("stance_min"),
        F.max("china_stance_score").alias("stance_max"),
        *[F.avg(c).alias(f"mean_{c}") for c in LABEL_COLS])


def starved_cells(labels: DataFrame, **kw) -> DataFrame:
    """A2 + JN5: cells with c >= 2 whose val share came out empty, largest first."""
    rows = prepare_labels(labels, kw.get("video_col", "video"), kw.get("stance_col"))
    b = with_buckets(dedupe_ids(rows) if kw.get("dedupe") else rows,
                     kw.get("yn_thresh", 0.5), kw.get("cut1", -0.33), kw.get("cut2", 0.33))
    c = b.groupBy(*CELLS).agg(F.count(F.lit(1)).alias("c"))
    sp = stratified_split(labels, keep_work_cols=True,
                          **kw)
    v = sp.filter(F.col("split") == "val").groupBy(*CELLS).agg(F.count(F.lit(1)).alias("v"))
    return (c.join(v, CELLS, "left")
            .select(*CELLS, "c", F.coalesce(F.col("v"), F.lit(0)).cast("bigint").alias("val_got"))
            .filter((F.col("c") >= 2) & (F.col("val_got") == 0))
            .orderBy(F.col("c").desc()))
