"""Fold per-group answers back into one record per item and join them to
the source table (A3–A5, A15, A22, JN3, U1–U3, W5).

Shuffle plan of ``merge_groups``:
  1. groupBy(item, group): min(pos) (first seen) and max_by(answer, pos)
     (last wins) — map-side partials, so a hot item repeated a million times
     is combined before the shuffle;
  2. groupBy(item): collect the <= #groups partial rows (bounded by the
     codebook, not by the data) and merge the maps in first-seen order.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.codebook import Codebook, default_codebook
from labelweave.functions.text import meta_id_str, norm_columns, resolve_column, ID_CANDIDATES
from labelweave.operators.records import merged_output_path
from labelweave.session import checkpoint_dir
from labelweave.sources.files import MERGED_SCHEMA, read_jsonl, write_jsonl, write_table


def position(pos_col: str, row) -> Column:
    """Order key of a row: its position, else before all positions by its JSON text."""
    p = F.col(pos_col).cast("long")
    return F.struct(F.coalesce(p, F.lit(-(1 << 63))).alias("p"),
                    F.when(p.isNull(), F.to_json(row)).otherwise("").alias("t"))


def last_wins(df: DataFrame, keys: list[str], pos_col: str, cols: list[str] | None = None) -> DataFrame:
    """Keep the row with the largest ``pos_col`` per key (dict-overwrite
    semantics) via ``max_by`` — partial aggregation, no full-group window. Rows
    without a position come before all others, among them by their JSON text."""
    cols = cols or [c for c in df.columns if c not in keys]
    s = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.max_by(s, position(pos_col, s)).alias("_w"))
            .select(*keys, *[F.col(f"_w.{c}").alias(c) for c in cols]))


def merge_groups(parsed: DataFrame, cb: Codebook | None = None, group_mode: str = "by-category",
                 require_complete: bool = False, pos_col: str = "idx") -> DataFrame:
    """A3 + A4: per item, last record per group wins; group maps merged in
    first-seen group order (later groups override keys); unparsed or empty
    answers are skipped. With a ``model`` column each model's answers are merged
    on their own. Output: model (if given), meta_id, parsed, complete, groups_present,
    missing_groups, json."""
    cb = cb or default_codebook()
    expected = sorted(g.group_id for g in cb.group_configs(group_mode))
    ok = parsed.filter(F.col("parsed") & (F.coalesce(F.size("json"), F.lit(0)) > 0)
                       & F.col("original_meta_id").isNotNull() & (F.col("original_meta_id") != ""))
    by = (["model"] if "model" in parsed.columns else []) + ["original_meta_id"]
    per_group = ok.groupBy(*by, "group_id").agg(
        F.min(pos_col).alias("first_pos"),
        F.max_by(F.map_entries("json"), position(pos_col, F.struct("json"))).alias("entries"))
    items = per_group.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("first_pos", "group_id", "entries"))).alias("gs"))
    present = F.array_sort(F.filter(F.transform("gs", lambda g: g["group_id"]),
                                    lambda x: x.isNotNull() & (x != "")))
    exp = F.array(*[F.lit(x) for x in expected]).cast("array<string>")
    out = items.select(
        *by[:-1], F.col("original_meta_id").alias("meta_id"),
        F.lit(True).alias("parsed"),
        (F.size(F.array_except(exp, present)) == 0).alias("complete"),
        present.alias("groups_present"),
        F.array_except(exp, present).alias("missing_groups"),
        F.map_from_entries(F.flatten(F.transform("gs", lambda g: g["entries"]))).alias("json"))
    if require_complete:
        out = out.filter("complete")
    return out


def merge_stats(merged: DataFrame) -> DataFrame:
    """A5: items, complete, partial, output rows (one row)."""
    return merged.agg(F.count(F.lit(1)).alias("items"),
                      F.count_if("complete").alias("complete"),
                      F.count_if(~F.col("complete")).alias("partial"))


def group_counts(merged: DataFrame) -> DataFrame:
    """A5: items per group present."""
    return (merged.select(F.explode("groups_present").alias("group_id"))
            .groupBy("group_id").agg(F.count(F.lit(1)).alias("n_items")))


def pred_keys(preds: DataFrame, json_col: str = "json") -> list[str]:
    """Sorted prediction keys found in the data (one small distinct job;
    the result is bounded by the key vocabulary, not by the rows)."""
    rows = preds.select(F.explode(F.map_keys(json_col)).alias("k")).distinct().collect()
    return sorted(r["k"] for r in rows)


def join_predictions(source: DataFrame, preds: DataFrame, keys: list[str] | None = None,
                     with_complete: bool = False) -> DataFrame:
    """JN3: source ⟕ predictions on the string id; adds pred_<key> columns
    (sorted), pred_parsed and optionally pred_complete. Predictions are
    deduplicated last-wins by position when they carry one."""
    src = norm_columns(source)
    id_col = resolve_column(src.columns, ID_CANDIDATES)
    p = preds.filter(F.col("parsed") & (F.coalesce(F.size("json"), F.lit(0)) > 0)
                     & (F.col("meta_id").cast("string") != ""))
    if "idx" in p.columns:
        p = last_wins(p.withColumn("meta_id", F.col("meta_id").cast("string")),
                      (["model"] if "model" in p.columns else []) + ["meta_id"], "idx",
                      ["json"] + (["complete"] if "complete" in p.columns else []))
    if keys is None:            # found in the data: write the predictions once instead of computing them twice
        checkpoint_dir(source.sparkSession)
        p = p.checkpoint()
        keys = pred_keys(p)
    cols = [F.try_element_at(F.col("_p.json"), F.lit(k)).alias(f"pred_{k}") for k in sorted(keys)]
    extra = []
    if with_complete:
        c = F.col("_p.complete") if "complete" in p.columns else F.lit(False)
        extra.append(F.coalesce(c, F.lit(False)).alias("pred_complete"))
    pj = p.select(F.col("meta_id").alias("_pid"), F.struct(*p.columns).alias("_p"))
    j = src.withColumn("_sid", meta_id_str(F.col(id_col))).join(pj, F.col("_sid") == F.col("_pid"), "left")
    return j.select(*[F.col(c) for c in src.columns], *cols,
                    F.col("_pid").isNotNull().alias("pred_parsed"), *extra)


def write_merged(merged: DataFrame, path: str, original: DataFrame | None = None) -> list[str]:
    """The merged records as JSON lines at ``path``; or, with an ``original`` table, that table with the
    predictions as CSV or Parquet at ``path``, and the merged records kept beside it. Returns the paths written."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if original is None:
        write_jsonl(merged, path)
        return [path]
    if ext not in (".csv", ".parquet"):
        raise ValueError("with an original table the output must be .csv or .parquet")
    kept = merged_output_path(os.path.splitext(path.rstrip("/"))[0] + ".jsonl")
    write_jsonl(merged, kept)
    back = read_jsonl(merged.sparkSession, kept, MERGED_SCHEMA, strict=False)
    write_table(join_predictions(original, back), path)
    return [path, kept]


def match_rate(joined: DataFrame) -> DataFrame:
    """Matched / rows; null on an empty table."""
    return joined.agg(F.count(F.lit(1)).alias("rows"),
                      F.count_if("pred_parsed").alias("matched"),
                      F.avg(F.col("pred_parsed").cast("double")).alias("match_rate"))


def union_parts(*parts: DataFrame) -> DataFrame:
    """Union of prediction parts by name (missing columns as null)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
