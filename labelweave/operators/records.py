"""Chat-format record building (P20–P32, P40–P44, JN4, JN6, S11).

``build_records`` turns a labelled source table into one record per item
(or per item x dimension group) with a system prompt generated from the
codebook, the user text (optionally with image parts) and, in label mode,
the gold labels as a minified JSON assistant message.

Scale notes:
- the text filter (P11) runs before the frame join and the group fan-out,
  so both only see surviving rows;
- prompts are a relation of (group_id -> text) built once from the codebook
  and joined by broadcast (its size is bounded by the codebook, not data);
- the group fan-out is a generator (``explode`` of the literal group list),
  not a cross join.
"""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.codebook import Codebook, Group, default_codebook, standard_codebook
from labelweave.functions.text import (ID_CANDIDATES, clamp11, compound_id, compute_once, labelize, meta_id_str,
                                       norm_columns, resolve_column, resolve_text_columns, safe_text,
                                       user_text, valid_stripped_text)
from labelweave.session import checkpoint_dir
from labelweave.sources.files import read_small_files

MESSAGE_T = T.StructType([T.StructField("role", T.StringType()),
                          T.StructField("content", T.StringType())])
PART_T = "struct<type:string,text:string,image_url:struct<url:string>>"


# --- prompts (P23, P24) -----------------------------------------------------------

def group_prompt(cb: Codebook, group: Group, numeric: bool = False,
                 vision_prefix: str | None = None) -> str:
    """System prompt for one group: header, numbered definitions,
    numbered output formats, key list; singular/plural by dimension count.
    All prose comes from the codebook; this only lays it out."""
    dims = [cb.dim(k) for k in group.dims]
    n = len(dims)
    s = "S" if n > 1 else ""
    lines = [f"Task: {group.description}", "", "Definitions:"]
    lines += [f"{i}) {d.key}: {d.description}" for i, d in enumerate(dims, 1)]
    lines += ["", f"{'Score' if numeric else 'Label'} the item on {n} dimension{s.lower()}:"]
    lines += [f"{i}) {d.key}: {d.format_numeric if numeric else d.format_categorical}"
              for i, d in enumerate(dims, 1)]
    lines += ["", f"Answer with one minified JSON object with the key{s.lower()}: "
              + ", ".join(group.dims) + "."]
    text = "\n".join(lines)
    return f"{vision_prefix}\n\n{text}" if vision_prefix else text


def prompts_df(spark, cb: Codebook, mode: str, numeric: bool = False,
               vision_prefix: str | None = None) -> DataFrame:
    """(group_id, group_pos, dims, system) for a mode — a tiny relation."""
    rows = [(g.group_id, i, list(g.dims), group_prompt(cb, g, numeric, vision_prefix))
            for i, g in enumerate(cb.group_configs(mode))]
    return spark.createDataFrame(rows, "group_id string, group_pos int, dims array<string>, system string")


def group_prompts_from_codebook(spark, cb: Codebook, mode: str, numeric: bool = False) -> DataFrame:
    """P24 as a relational plan over the codebook tables:
    dims ⋈ groups -> ordered definitions per group -> prompt text."""
    dims = cb.dims_df(spark).withColumnRenamed("pos", "dim_pos")
    groups = cb.groups_df(spark, mode)
    fmt = F.col("format_numeric") if numeric else F.col("format_categorical")
    j = groups.join(F.broadcast(dims), groups.dim_key == dims.key)
    g = j.groupBy("group_id", "group_pos", "group_description").agg(
        F.array_sort(F.collect_list(F.struct("pos", "key", "description", fmt.alias("fmt")))).alias("d"))
    n = F.size("d")
    plural = F.when(n > 1, F.lit("s")).otherwise(F.lit(""))
    defs = F.array_join(F.transform("d", lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(") "), x["key"], F.lit(": "), x["description"])), "\n")
    fmts = F.array_join(F.transform("d", lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(") "), x["key"], F.lit(": "), x["fmt"])), "\n")
    keys = F.array_join(F.transform("d", lambda x: x["key"]), ", ")
    system = F.concat(
        F.lit("Task: "), F.col("group_description"), F.lit("\n\nDefinitions:\n"), defs,
        F.lit("\n\n" + ("Score" if numeric else "Label") + " the item on "), n.cast("string"),
        F.lit(" dimension"), plural, F.lit(":\n"), fmts,
        F.lit("\n\nAnswer with one minified JSON object with the key"), plural, F.lit(": "), keys, F.lit("."))
    return g.select("group_id", "group_pos", F.transform("d", lambda x: x["key"]).alias("dims"),
                    system.alias("system"))


# --- gold (P18, P25, P26, P27) -------------------------------------------------------

def standard_gold(df: DataFrame, yn_thresh: float = 0.5) -> Column:
    """P25: {china_stance_score, china_sensitive, collective_action?} as a
    map<string,string>; the optional key is dropped per row when null.
    Null / NaN stance gives a null gold (row is skipped, rule N2)."""
    stance = clamp11(F.col("china_stance_score"))
    ks = [F.lit("china_stance_score"), F.lit("china_sensitive")]
    vs = [stance.cast("string"), labelize("sensitive", yn_thresh)]
    if "collective_action" in df.columns:
        ks.append(F.lit("collective_action"))
        vs.append(F.when(F.col("collective_action").isNotNull() & ~F.isnan("collective_action"),
                         labelize("collective_action", yn_thresh)))
    m = F.map_filter(F.map_from_arrays(F.array(*ks), F.array(*vs)), lambda k, v: v.isNotNull())
    return F.when(stance.isNotNull(), m)


def standard_gold_json(df: DataFrame, yn_thresh: float = 0.5) -> Column:
    """P25 serialised: stance stays a JSON number, labels are strings."""
    stance = clamp11(F.col("china_stance_score"))
    fields = [stance.alias("china_stance_score"),
              labelize("sensitive", yn_thresh).alias("china_sensitive")]
    if "collective_action" in df.columns:
        fields.append(F.when(F.col("collective_action").isNotNull() & ~F.isnan("collective_action"),
                             labelize("collective_action", yn_thresh)).alias("collective_action"))
    return F.when(stance.isNotNull(), F.to_json(F.struct(*fields)))


def comprehensive_gold(cb: Codebook, columns: list[str]) -> Column:
    """Every dimension from its source column (stripped string; null or no such column -> '')."""
    ks, vs = [], []
    for d in cb.dimensions:
        ks.append(F.lit(d.key))
        source = d.source_column or d.key
        vs.append(safe_text(F.col(source)) if source in columns else F.lit(""))
    return F.map_from_arrays(F.array(*ks), F.array(*vs))


def gold_json_ordered(m: Column, keys: list[str]) -> Column:
    """Minified JSON of a gold map in codebook key order (only keys present)."""
    return F.to_json(F.struct(*[F.try_element_at(m, F.lit(k)).alias(k) for k in keys]))


# --- frames (S11, P21, P22, JN4) ------------------------------------------------------

def read_frames(spark, frames_dir: str, glob: str = "frame_*.jpg", item_re: str = r"([^/]+)/frame_[^/]*$",
                n_re: str = r"frame_([0-9]+)\.jpg$") -> DataFrame:
    """frame_<n>.jpg files under <dir>/<item id>/, as (item_id, n, content); for another layout give
    the files' pattern and where item and number stand in a path."""
    return read_small_files(spark, frames_dir, glob).select(
        F.regexp_extract("path", item_re, 1).alias("item_id"),
        F.regexp_extract("path", n_re, 1).cast("int").alias("n"),
        "content")


def frame_parts(frames: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """P22 + S11: per item, image parts as base64 data URLs in numeric frame
    order. One row per item; the list is bounded by the frames of an item.
    With ``items`` (a column of ids) frames of other items go before anything is
    encoded or grouped."""
    if items is not None:
        ids = items.select(F.col(items.columns[0]).alias("item_id")).distinct()
        frames = frames.join(ids, "item_id", "left_semi")
    url = F.concat(F.lit("data:image/jpeg;base64,"), F.base64("content"))
    part = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                    F.struct(url.alias("url")).alias("image_url"))
    return (frames.filter(F.col("content").isNotNull() & (F.length("content") > 0))
            .groupBy("item_id")
            .agg(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))).alias("f"))
            .select("item_id", F.transform("f", lambda x: x["p"]).alias("images")))


# --- build (P20–P32, JN6, P44) -------------------------------------------------------

def build_records(df: DataFrame, cb: Codebook | None = None, *, comprehensive: bool = False,
                  group_mode: str = "single", label_mode: bool = True, numeric: bool = False,
                  yn_thresh: float = 0.5, min_text_len: int = 10, strip_meta_id: bool = False,
                  frames: DataFrame | None = None, with_reasons: bool = False, with_merged: bool = False):
    """Source table -> chat records.

    Output columns: meta_id, group_id, original_meta_id, messages
    (array<struct<role, content>>) and, when frames are given, ``parts``
    (array of image/text parts; ``content`` then holds the text only).
    With ``with_reasons`` returns (records, rejects) where rejects has
    (meta_id, reason) for the filter accounting (P44). With ``with_merged`` (P30) a grouped
    build also makes the ungrouped record of each item, in the same pass over the source; a
    column ``kind`` tells 'grouped' from 'merged' (``write_both`` writes them apart).
    Optional label columns that are missing give a warning and empty gold (P3).
    """
    cb = cb or default_codebook()
    spark = df.sparkSession
    df = norm_columns(df)
    id_col = resolve_column(df.columns, ID_CANDIDATES)
    tc = resolve_text_columns(df.columns)
    if label_mode:
        need = ([d.source_column or d.key for d in cb.dimensions if d.required] if comprehensive
                else ["china_stance_score", "sensitive"])
        missing = [c for c in need if c not in df.columns]
        if missing:
            raise ValueError(f"missing label columns {missing}")
        soft = [d.source_column or d.key for d in cb.dimensions if not d.required] if comprehensive else []
        if absent := [c for c in soft if c not in df.columns]:
            warnings.warn(f"missing optional label columns {absent}: their gold is empty", stacklevel=2)
    if group_mode != "single" and not comprehensive:
        group_mode = "single"
    mid = meta_id_str(F.col(id_col))
    utext = user_text(*(F.col(tc[k]) if tc[k] else None
                        for k in ("transcript", "description", "embedded_text")))
    derived = {"meta_id": mid, "user_text": utext}
    if label_mode:
        derived["gold"] = comprehensive_gold(cb, df.columns) if comprehensive else standard_gold(df, yn_thresh)
    base = compute_once(df, **derived)
    # user_text is stripped by construction, so the P11 check needs no second strip
    reason = (F.when(F.col("meta_id") == "", F.lit("empty_id"))
              .when(~valid_stripped_text(F.col("user_text"), min_text_len), F.lit("short_text")))
    if label_mode and not comprehensive:
        reason = reason.when(F.col("gold").isNull(), F.lit("invalid_stance"))
    tagged = base.withColumn("reject_reason", reason)
    kept = tagged.filter(F.col("reject_reason").isNull())
    keep_cols = ["meta_id", "user_text"] + (["gold"] if label_mode else [])
    kept = kept.select(*keep_cols)

    if frames is not None:                    # JN4 after the text filter
        kept = kept.join(frame_parts(frames, kept.select("meta_id")), kept.meta_id == F.col("item_id"), "left").drop("item_id")

    pcb = cb if comprehensive else standard_codebook()
    grouped = comprehensive and group_mode != "single"
    kinds = {"grouped": group_mode} if grouped else {}
    if not grouped or with_merged:
        kinds["merged"] = "single"
    vision = "The item comes with video frames; use them with the text." if frames is not None else None
    prompts = reduce(DataFrame.unionByName, [prompts_df(spark, pcb, mode, numeric, vision).withColumn("kind", F.lit(kind))
                                             for kind, mode in kinds.items()])
    outputs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(g.group_id).alias("group_id"))
                        for kind, mode in kinds.items() for g in pcb.group_configs(mode)])
    fan = kept.select("*", F.inline(outputs))                        # JN6 as a generator
    fan = fan.join(F.broadcast(prompts), ["kind", "group_id"])
    user = F.struct(F.lit("user").alias("role"), F.col("user_text").alias("content"))
    msgs = [F.struct(F.lit("system").alias("role"), F.col("system").alias("content")), user]
    if label_mode:
        if comprehensive:
            g = F.map_filter(F.col("gold"), lambda k, v: F.array_contains(F.col("dims"), k))  # P27
            gj = gold_json_ordered(g, cb.gold_keys())
        else:
            gj = _std_json(F.col("gold"))
        msgs.append(F.struct(F.lit("assistant").alias("role"), gj.alias("content")))
    out = fan.select(
        F.when(F.col("kind") == "grouped", compound_id("meta_id", "group_id"))
         .otherwise(F.col("meta_id")).alias("record_id"),
        F.col("meta_id").alias("original_meta_id"),
        F.when(F.col("kind") == "grouped", F.col("group_id")).alias("group_id"),
        F.array(*msgs).alias("messages"),
        *([F.col("images")] if frames is not None else []),
        F.col("group_pos"), *([F.col("kind")] if with_merged else []))
    if frames is not None:                    # P21: images first, then the text part
        text_part = F.struct(F.lit("text").alias("type"), F.col("messages")[1]["content"].alias("text"),
                             F.lit(None).cast("struct<url:string>").alias("image_url"))
        out = out.withColumn("parts", F.when(F.coalesce(F.size("images"), F.lit(0)) > 0,
                                             F.concat("images", F.array(text_part)))).drop("images")
    out = out.withColumnRenamed("record_id", "meta_id")
    if strip_meta_id:
        out = out.select("messages", *(["parts"] if frames is not None else []), *(["kind"] if with_merged else []))
    if with_reasons:
        rejects = tagged.filter(F.col("reject_reason").isNotNull()).select("meta_id", "reject_reason")
        return out, rejects
    return out


def _std_json(gold: Column) -> Column:
    """Standard gold map -> minified JSON with the stance as a number."""
    return F.to_json(F.struct(
        F.try_element_at(gold, F.lit("china_stance_score")).cast("double").alias("china_stance_score"),
        F.try_element_at(gold, F.lit("china_sensitive")).alias("china_sensitive"),
        F.try_element_at(gold, F.lit("collective_action")).alias("collective_action")))


def write_both(records: DataFrame, path: str) -> None:
    """Records of both kinds in one job, each in the folder ``kind=<kind>`` under ``path``, as JSON lines."""
    from labelweave.operators.content import record_json, union_messages

    rows = union_messages(records)
    line = record_json(rows.drop("kind"))
    rows.select(line.alias("value"), "kind").write.mode("overwrite").partitionBy("kind").text(path)


def merged_output_path(path: str) -> str:
    """P30: '<stem>_merged<suffix>' beside the grouped output."""
    import os
    stem, ext = os.path.splitext(path)
    return f"{stem}_merged{ext}" if ext else f"{path}_merged.jsonl"


# --- record accessors (P31–P33, P40, P41) ----------------------------------------------

def gold_of(messages: Column) -> Column:
    """gold = last message content parsed as a JSON object."""
    from labelweave.functions.jsonfix import JSON_OPTS, MAP_T
    return F.from_json(F.element_at(messages, -1)["content"], MAP_T, JSON_OPTS)


def prompt_messages(messages: Column, how: str = "drop_last", enforcer: str | None = None) -> Column:
    """(a) drop_last, (b) drop_last_if_assistant, (c) drop_last + append
    an enforcer system message."""
    n = F.size(messages)
    if how == "drop_last_if_assistant":
        last_is_asst = F.element_at(messages, -1)["role"] == "assistant"
        return F.when(last_is_asst & (n > 0), F.slice(messages, 1, n - 1)).otherwise(messages)
    dropped = F.when(n > 0, F.slice(messages, 1, n - 1)).otherwise(messages)
    if how == "enforce":
        msg = F.struct(F.lit("system").alias("role"), F.lit(enforcer or "").alias("content"))
        return F.array_append(dropped, msg)
    return dropped


def record_user_text(messages: Column) -> Column:
    """User contents joined by a blank line, stripped."""
    from labelweave.functions.text import strip_ws
    users = F.filter(messages, lambda m: m["role"] == "user")
    return strip_ws(F.array_join(F.transform(users, lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n"))


def sanitize_records(df: DataFrame) -> DataFrame:
    """P40 + P41, row by row: a row with ``messages`` keeps only those, another
    row its prompt/completion/text; when any record carries list content,
    every message of the others becomes a one-element text-part list (``parts``
    holds those of the whole conversation, in order)."""
    flat = [c for c in df.columns if c in ("prompt", "completion", "text")]
    has = "messages" in df.columns
    if not has and not flat:
        raise ValueError("no trainable field left after sanitising")
    there = F.col("messages").isNotNull() if has else F.lit(False)
    keep = ([F.col("messages")] if has else []) + [F.when(~there, F.col(c)).alias(c) for c in flat]
    if "parts" in df.columns and has and df.filter(F.col("parts").isNotNull()).limit(1).count():
        wrap = F.transform("messages", lambda m: F.struct(
            F.lit("text").alias("type"), m["content"].alias("text"),
            F.lit(None).cast("struct<url:string>").alias("image_url")))
        keep.append(F.coalesce("parts", wrap).alias("parts"))
    return df.select(*keep)


TOP_ROWS = 10_000       # up to this many leading rows are taken as a top-k, without a shuffle of the table


def skip_limit(df: DataFrame, skip: int = 0, limit: int | None = None, pos_col: str = "idx") -> DataFrame:
    """Rows by file position: skip the first ``skip``, keep ``limit``.
    Positions are an explicit column (never partition order), null ones first; rows
    of the same position go by the start of their JSON text and then by its hash, and of
    identical rows the number counts. Skipping past the end is an error.

    A few leading rows are a top-k. Otherwise the rows are dealt by ranges of their
    order (a crowded position is split by the start of the text) and written once; the counts of the
    ranges, one number a task, tell in which range a rank lies, and the rows kept are a range of row numbers. No task
    gets more than its range, however many rows are skipped."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    text = F.to_json(F.struct(*cols))
    rows = df.select(F.struct(*cols).alias("_r"), F.struct(
        F.col(f"`{pos_col}`").alias("p"), F.substring(text, 1, 64).alias("t"), F.xxhash64(text).alias("h")).alias("_key"))
    if limit is not None and skip + limit <= TOP_ROWS:
        if skip and skip >= (n := df.limit(skip + 1).count()):
            raise ValueError(f"skip={skip} but only {n} records")
        top = rows.orderBy("_key").limit(skip + limit)
        ranked = top.withColumn("_n", F.row_number().over(Window.orderBy("_key")))      # at most TOP_ROWS rows
        return ranked.filter(F.col("_n") > skip).select("_r.*")
    if not skip and limit is None:
        return df
    dealt = rows.repartitionByRange("_key", F.monotonically_increasing_id()).sortWithinPartitions("_key")
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/skip-{uuid.uuid4().hex}"
    dealt.select("_r", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_nr")).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    parts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_nr").alias("first")).orderBy("_part").collect()
    total = sum(r["n"] for r in parts)
    if skip and skip >= total:
        raise ValueError(f"skip={skip} but only {total} records")

    def number_of(rank: int) -> int | None:
        """Row number of the row with ``rank`` rows before it; None past the end."""
        for r in parts:
            if rank < r["n"]:
                return r["first"] + rank
            rank -= r["n"]
        return None

    start, stop = number_of(skip), None if limit is None else number_of(skip + limit)
    kept = held.filter(F.col("_nr") >= start)
    return (kept if stop is None else kept.filter(F.col("_nr") < stop)).select("_r.*")
