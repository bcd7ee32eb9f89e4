"""Parse free-text model answers into validated JSON maps.

``parse_predictions`` works in two passes, without a shuffle or Python worker. The first
pass parses every answer as it is; answers that are one valid object are done
and never enter a fold. The second pass runs the extraction ladder on the rest:

  strict            whole answer (trimmed) -> repair-parse -> standardise -> validate
  codefence_stripped  content of the first ``` fence, same steps
  balanced_block    last complete top-level {...} block, same steps
  pattern_match     last brace-free object holding a search key, same steps
  none              nothing validated -> quarantined

The rungs are steps of one fold; a later rung is evaluated only for rows on
which every earlier one failed, so the brace fold runs on the failures only.
The result is the union of both passes.

``first_pass`` says how the second pass gets its rows. 'table' (default) writes the
first pass to the shared folder, split by its outcome: the input is computed once, so an answer cannot fall
between the passes when it is not the same twice (a model's). 'scan' reads
the input once per pass and writes nothing: for files and other inputs that
are cheap and the same each time. 'none' runs the ladder on every row; streams use it,
as a stream cannot be written halfway.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.codebook import Codebook, default_codebook
from labelweave.functions import jsonfix as J
from labelweave.functions.text import split_compound_id, strip_ws
from labelweave.session import checkpoint_dir

RESULT_T = "struct<json:map<string,string>,mode:string>"


def _process(candidate: Column, mode: Column, cb: Codebook, check) -> Column:
    """repair-parse -> standardise -> validate -> gate, as struct(json, mode)."""
    def body(c):
        return J.let(J.standardize(J.repair_parse(c, cb), cb), lambda m: F.when(
            F.coalesce(check(m), F.lit(False)),
            F.struct(J.apply_gates(m, cb).alias("json"), mode.alias("mode"))))
    return F.when(candidate.isNotNull() & (candidate != ""), J.let(candidate, body))


def _pattern_keys(cb: Codebook) -> list[str]:
    keys = [k for k in J.PATTERN_KEYS if k in cb.canonical_keys()]
    return keys or cb.keys[:1]


def extract_json(text: Column, cb: Codebook | None = None, group_mode: str | None = None,
                 numeric: bool = False, strict: bool = True,
                 group_id: Column | None = None, strategy: str = "ladder") -> Column:
    """J17 (``ladder``) / J18 (``simple``) as one Column:
    struct<json map<string,string>, mode string> or null when nothing validates.

    The ladder is a fold over rung numbers; the candidate of a rung is only
    computed when every earlier rung failed.
    """
    cb = cb or default_codebook()
    gid = group_id if group_id is not None else F.lit(None).cast("string")
    check = J.validator(cb, group_mode, numeric, strict, gid)
    if strategy == "simple":
        return _simple(text, cb, check)
    groups = cb.group_configs(group_mode) if group_mode and group_mode != "single" else []
    pkeys = _pattern_keys(cb)
    n_rungs = 3 + len(pkeys)
    modes = F.array(*[F.lit(m) for m in ("strict", "codefence_stripped", "balanced_block")],
                    *[F.lit("pattern_match")] * len(pkeys))

    def candidate(t, fenced, i):
        expr = (F.when(i == 1, strip_ws(t))
                .when(i == 2, F.when(fenced != t, strip_ws(fenced)))
                .when(i == 3, J.last_balanced_block(fenced)))
        for j, k in enumerate(pkeys):
            pat = J.pattern_candidate(t, k)
            if groups:
                grouped = None
                for g in groups:
                    c = gid == F.lit(g.group_id)
                    v = J.pattern_candidate(t, g.dims[0]) if j == 0 else F.lit(None).cast("string")
                    grouped = F.when(c, v) if grouped is None else grouped.when(c, v)
                pat = grouped.otherwise(pat)
            expr = expr.when(i == 4 + j, pat)
        return expr

    def ladder(t):
        def with_fence(fenced):
            init = F.lit(None).cast(RESULT_T)
            return F.aggregate(
                F.sequence(F.lit(1), F.lit(n_rungs)), init,
                lambda acc, i: F.when(acc.isNotNull(), acc).otherwise(
                    _process(candidate(t, fenced, i), F.element_at(modes, i), cb, check)))
        return J.let(J.strip_code_fence(t), with_fence)
    return F.when(text.isNotNull() & (text != ""), J.let(text, ladder)).cast(RESULT_T)


def _simple(text: Column, cb: Codebook, check) -> Column:
    """Whole text -> fence + tail -> last balanced block that validates.
    No repairs; every rung reports mode 'strict' / 'tail' / 'balanced_block'."""
    def ok(m, mode):
        return F.when(F.coalesce(check(m), F.lit(False)),
                      F.struct(m.alias("json"), F.lit(mode).alias("mode")))

    def body(t):
        whole = J.let(J.strict_parse(t), lambda m: ok(m, "strict"))
        tail = J.let(J.strict_parse(J.tail_json(J.strip_code_fence(t))), lambda m: ok(m, "tail"))
        blocks = J.balanced_blocks(J.strip_code_fence(t))
        valid = F.filter(F.transform(blocks, lambda b: ok(J.strict_parse(b), "balanced_block")),
                         lambda r: r.isNotNull())
        last = F.when(F.size(valid) > 0, F.element_at(valid, -1))
        return F.coalesce(whole, tail, last)
    return F.when(F.length(strip_ws(text)) > 0, J.let(text, body)).cast(RESULT_T)


def clean_json(text: Column, cb: Codebook | None = None, group_mode: str | None = None,
               numeric: bool = False, strict: bool = True, group_id: Column | None = None) -> Column:
    """The first pass: the answer's object if the whole answer is one valid object, else null. No repair, no fold."""
    cb = cb or default_codebook()
    gid = group_id if group_id is not None else F.lit(None).cast("string")
    check = J.validator(cb, group_mode, numeric, strict, gid)
    found = J.let(J.standardize(J.strict_parse(text), cb), lambda m: F.when(
        F.coalesce(check(m), F.lit(False)), F.struct(J.apply_gates(m, cb).alias("json"), F.lit("strict").alias("mode"))))
    return found.cast(RESULT_T)


_EXPR_CACHE: dict = {}
_CACHED = 16        # configurations kept; the oldest goes first


def _cached(what, session, cb: Codebook, *args) -> Column:
    """The extraction Column over placeholder columns ``_lw_text`` / ``_lw_gid``, built once per
    session and configuration (building it is thousands of JVM calls; the unresolved
    expression is reusable across DataFrames)."""
    key = (what.__name__, id(session), id(cb), args)
    if key not in _EXPR_CACHE:
        while len(_EXPR_CACHE) >= _CACHED:
            _EXPR_CACHE.pop(next(iter(_EXPR_CACHE)))
        group_mode, numeric, strict, *strategy = args
        expr = what(F.col("_lw_text"), cb, group_mode, numeric, strict, F.col("_lw_gid"), *strategy)
        _EXPR_CACHE[key] = (session, cb, expr)       # held, so that an id is not given anew
    return _EXPR_CACHE[key][-1]


def parse_predictions(raw: DataFrame, cb: Codebook | None = None, group_mode: str | None = None,
                      numeric: bool = False, strict: bool = True, text_col: str = "raw",
                      id_col: str = "meta_id", strategy: str = "ladder", first_pass: str = "table") -> DataFrame:
    """Raw answers -> idx, meta_id, original_meta_id, group_id, parsed,
    raw, json, mode (plus any other input columns, kept as they are).

    The compound id is always split on its last '__group_' (fixes a quirk
    where a row carrying ``group_id`` kept the compound id and could not be
    merged); an explicit ``group_id`` column wins over the suffix.

    A parse result passes through a one-row ``explode`` (a Generate node):
    filters on ``parsed`` downstream cannot be pushed below it, so the
    optimizer never duplicates the extraction expression into a filter.
    """
    if first_pass not in ("table", "scan", "none"):
        raise ValueError(f"unknown first_pass {first_pass!r}")
    cb = cb or _default()
    cols = raw.columns
    mid = F.col(id_col).cast("string") if id_col in cols else F.col("idx").cast("string")
    base, suffix = split_compound_id(mid)
    gid = F.coalesce(F.col("group_id").cast("string"), suffix) if "group_id" in cols else suffix
    df = (raw.withColumn("meta_id", mid)
          .withColumn("original_meta_id", base)
          .withColumn("group_id", gid))
    keep = [c for c in df.columns if c not in ("parsed", "json", "mode")]
    session = raw.sparkSession

    def parsed_by(rows: DataFrame, what, *args) -> DataFrame:
        expr = _cached(what, session, cb, group_mode, numeric, strict, *args)
        rows = rows.select(*keep, F.col(text_col).alias("_lw_text"), F.col("group_id").alias("_lw_gid"))
        rows = rows.select(*keep, F.explode(F.array(expr)).alias("_res"))
        return rows.select(*keep, F.col("_res").isNotNull().alias("parsed"), F.col("_res.json").alias("json"),
                           F.coalesce(F.col("_res.mode"), F.lit("none")).alias("mode"))

    if first_pass == "none" or raw.isStreaming or strategy != "ladder" or text_col not in keep:
        return parsed_by(df, extract_json, strategy)
    first = parsed_by(df, clean_json)
    if first_pass == "table":
        path = f"{checkpoint_dir(session).rstrip('/')}/parse-{uuid.uuid4().hex}"
        first.withColumn("_clean", F.col("parsed")).write.partitionBy("_clean").parquet(path)
        schema = T.StructType([*first.schema.fields, T.StructField("_clean", T.BooleanType())])
        first = session.read.schema(schema).parquet(path)
        clean, rest = first.filter("_clean").drop("_clean"), first.filter("NOT _clean").drop("_clean")
    else:
        clean, rest = first.filter("parsed"), first.filter("NOT parsed")
    return clean.unionByName(parsed_by(rest, extract_json, strategy))


_DEFAULT_CB: list = []


def _default() -> Codebook:
    if not _DEFAULT_CB:
        _DEFAULT_CB.append(default_codebook())
    return _DEFAULT_CB[0]


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rows that did not parse (id, group, text) for the bad-output sink."""
    return parsed.filter(~F.col("parsed")).select("idx", "meta_id", "group_id", "raw")


def preview_bad(parsed: DataFrame, k: int) -> DataFrame:
    """First ``k`` unparsed rows by position (a top-k, not a full sort)."""
    return quarantine(parsed).orderBy("idx").limit(k)


def parse_rate(parsed: DataFrame) -> DataFrame:
    """Ok / total (0 when empty), per model when a model column exists."""
    keys = [c for c in ("model",) if c in parsed.columns]
    agg = [F.count(F.lit(1)).alias("total"),
           F.count_if(F.col("parsed")).alias("ok")]
    g = parsed.groupBy(*keys).agg(*agg) if keys else parsed.agg(*agg)
    return g.withColumn("parse_rate", F.coalesce(F.col("ok") / F.col("total"), F.lit(0.0)))
