"""Score models against gold labels (A7–A12, A14, A23, P36–P38, P42, JN1, S12, W6).

Plan: gold records (one per item) are fanned out over the model list with a
generator (``explode`` of the model names — no cross join), left-joined to
the last-wins predictions on (model, meta_id), and reduced with hash
aggregates. The comprehensive scorecard reduces first to a confusion table
(model, dim, gold, pred) -> count (tens of rows), and every F1 is computed
from that. Confidence intervals (A13) are in ``operators.bootstrap``.
"""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.codebook import Codebook, default_codebook, STANCE
from labelweave.functions import metrics as M
from labelweave.functions.text import (clamp01, clamp11, compute_once, normalize_cd_label, strip_ws, valid_stripped_text,
                                       yesno_label)
from labelweave.operators.merge import last_wins
from labelweave.operators import content
from labelweave.operators.records import gold_of, record_user_text

# ---------------------------------------------------------------------------
# FIXED VALUES — metric names and their order in the long output.
STANDARD_F1_METRICS = ["stance_R2", "stance_pos_F1", "stance_neg_F1", "ch_sensitive_F", "col_action_F"]
STANDARD_R2_METRICS = ["stance_R2", "stance_pos_F1", "stance_neg_F1", "ch_sensitive_R2", "col_action_R2"]
BINARY_METRIC = {"china_related": "china_related_F1", "china_sensitive": "sensitive_F1",
                 "collective_action": "collective_F1", "hate_speech": "hate_F1",
                 "harmful_content": "harmful_F1", "news_segments": "news_F1",
                 "inauthentic_content": "inauthentic_F1", "derivative_content": "derivative_F1"}
STANCE_PREFIX = {"china_ccp_government": "stance_gov", "china_people_culture": "stance_culture",
                 "china_technology_development": "stance_tech"}
STANCE_CLASSES = ["pro", "anti", "neutral/unclear"]
STANCE_SUFFIX = {"pro": "f1_pro", "anti": "f1_anti", "neutral/unclear": "f1_neutral", "macro": "f1_macro"}
CD_MAP_DEFAULT = {"yes": 1.0, "no": 0.0, "cannot_determine": 0.5}
NUMERIC_SUFFIXES = ["", "_score", "_prob", "_yes_prob", "_p"]
# ---------------------------------------------------------------------------


def parse_cd_map(s: str | None) -> dict[str, float]:
    """P38: 'yes=1,no=0,cannot_determine=0.5'; unknown keys ignored, missing
    keys defaulted, malformed text -> all defaults."""
    pairs = re.findall(r"\s*([^=,\s]+)\s*=\s*([^=,]+?)\s*(?:,|$)", s or "")
    whole = len(pairs) == len((s or "").split(","))
    try:
        given = {k: float(v) for k, v in pairs} if whole else {}
    except ValueError:
        given = {}
    return {k: given.get(k, default) for k, default in CD_MAP_DEFAULT.items()}


def _get(m: Column, k: str) -> Column:
    return F.try_element_at(m, F.lit(k))


def derive_label(pred: Column, key: str, yn_thresh: float | None = None) -> Column:
    """Threshold ``<key>_score`` when a threshold is given and the score
    parses, else the yes/no/cd label of ``key``."""
    lab = yesno_label(_get(pred, key))
    if yn_thresh is None:
        return lab
    v = clamp01(_get(pred, f"{key}_score"))
    return F.when(v.isNotNull(), F.when(v >= yn_thresh, F.lit("yes")).otherwise(F.lit("no"))).otherwise(lab)


def numeric_from_pred(pred: Column, key: str, cd_map: dict[str, float]) -> Column:
    """First of key, key_score, key_prob, key_yes_prob, key_p that parses
    as a number (percent-aware clamp), else the label mapped through cd_map."""
    nums = [clamp01(_get(pred, key + s)) for s in NUMERIC_SUFFIXES]
    return F.coalesce(*nums, label_value(_get(pred, key), cd_map))


def label_value(answer: Column, cd_map: dict[str, float]) -> Column:
    """The number that ``cd_map`` gives a yes/no/cannot_determine answer, else null."""
    values = F.create_map(*[F.lit(x) for k, v in cd_map.items() for x in (k, float(v))])
    return F.try_element_at(values, yesno_label(answer))


def gold_table(val_records: DataFrame, min_text_len: int = 0) -> DataFrame:
    """(meta_id, gold map) from chat records. With ``min_text_len`` records whose user text is
    shorter or a mark of missing text go before scoring (P11)."""
    if min_text_len > 0:
        texts = content.user_text if "parts" in val_records.schema["messages"].dataType.elementType.names else record_user_text
        val_records = compute_once(val_records, _user_text=texts(F.col("messages")))
        val_records = val_records.filter(valid_stripped_text(F.col("_user_text"), min_text_len))
    return val_records.select(F.col("meta_id").cast("string").alias("meta_id"),
                              gold_of(F.col("messages")).alias("gold"))


def detect_format(gold: DataFrame) -> str:
    """P42: 'comprehensive' when any gold carries china_related (decided from
    the data with one scalar aggregate, not from the first record)."""
    r = gold.agg(F.bool_or(F.map_contains_key("gold", F.lit("china_related"))).alias("c")).first()
    return "comprehensive" if r and r["c"] else "standard"


def missing_gold_keys(gold: DataFrame, fmt: str) -> DataFrame:
    """Records whose gold lacks a required key (for a fail-fast check)."""
    req = ["china_related", "china_sensitive"] if fmt == "comprehensive" else \
        ["china_stance_score", "china_sensitive"]
    cond = reduce(lambda a, b: a | b, [~F.map_contains_key("gold", F.lit(k)) for k in req])
    return gold.filter(F.col("gold").isNull() | cond)


def latest_predictions(preds: DataFrame) -> DataFrame:
    """JN1 right side: parsed predictions, last-wins per (model, meta_id)."""
    p = preds.filter(F.col("parsed") & F.col("json").isNotNull() & (F.col("meta_id").cast("string") != ""))
    p = p.withColumn("meta_id", F.col("meta_id").cast("string"))
    pos = "idx" if "idx" in p.columns else None
    if pos:
        return last_wins(p, ["model", "meta_id"], pos, ["json"])
    return p.select("model", "meta_id", "json").dropDuplicates(["model", "meta_id"])


def align(gold: DataFrame, preds: DataFrame, models: list[str]) -> DataFrame:
    """JN1: every gold item once per model, left-joined to its prediction
    (missing prediction = empty answer)."""
    gm = gold.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return gm.join(latest_predictions(preds), ["model", "meta_id"], "left")


def model_list(preds: DataFrame) -> list[str]:
    """Distinct model names (bounded by the number of prediction sources)."""
    return sorted(r["model"] for r in preds.select("model").distinct().collect())


# --- standard scorecard (A12) ----------------------------------------------------------

def standard_columns(aligned: DataFrame, yn_metric: str = "f1", yn_thresh: float | None = None,
                     cd_map: dict[str, float] | None = None) -> DataFrame:
    cd = cd_map or dict(CD_MAP_DEFAULT)
    g, p = F.col("gold"), F.col("json")
    cols = [F.col("model"), F.col("meta_id"),
            clamp11(_get(g, "china_stance_score")).alias("g_stance"),
            clamp11(_get(p, "china_stance_score")).alias("p_stance"),
            F.map_contains_key(g, F.lit("collective_action")).alias("has_coll")]
    if yn_metric == "f1":
        cols += [yesno_label(_get(g, "china_sensitive")).alias("g_sens"),
                 derive_label(p, "china_sensitive", yn_thresh).alias("p_sens"),
                 yesno_label(_get(g, "collective_action")).alias("g_coll"),
                 derive_label(p, "collective_action", yn_thresh).alias("p_coll")]
    else:
        def gnum(k):
            v = _get(g, k)
            return F.coalesce(clamp01(v), label_value(v, cd))
        cols += [gnum("china_sensitive").alias("g_sens"),
                 numeric_from_pred(p, "china_sensitive", cd).alias("p_sens"),
                 gnum("collective_action").alias("g_coll"),
                 numeric_from_pred(p, "collective_action", cd).alias("p_coll")]
    return aligned.select(*cols)


def standard_metric_exprs(yn_metric: str = "f1", weight: Column | None = None) -> dict[str, Column]:
    gs, ps = F.col("g_stance"), F.col("p_stance")
    out = {"stance_R2": M.r2(gs, ps, weight),
           "stance_pos_F1": M.f1_binary(gs > 0, ps > 0, weight),
           "stance_neg_F1": M.f1_binary(gs < 0, ps < 0, weight)}
    has = F.col("has_coll")
    wc = F.when(has, weight if weight is not None else F.lit(1)).otherwise(F.lit(0))
    if yn_metric == "f1":
        out["ch_sensitive_F"] = M.f1_yes(F.col("g_sens"), F.col("p_sens"), weight)
        out["col_action_F"] = M.f1_yes(F.col("g_coll"), F.col("p_coll"), wc)
    else:
        out["ch_sensitive_R2"] = M.r2(F.col("g_sens"), F.col("p_sens"), weight)
        out["col_action_R2"] = M.r2(F.when(has, F.col("g_coll")), F.col("p_coll"), weight)
    return out


def to_long(wide: DataFrame, metrics: list[str], id_cols=("model",)) -> DataFrame:
    """(model, metric, score) in fixed metric order."""
    order = F.create_map(*[x for i, m in enumerate(metrics) for x in (F.lit(m), F.lit(i))])
    long = wide.unpivot(list(id_cols), metrics, "metric", "score")
    return long.withColumn("metric_pos", F.try_element_at(order, F.col("metric")))


def score_standard(gold: DataFrame, preds: DataFrame, models: list[str] | None = None,
                   yn_metric: str = "f1", yn_thresh: float | None = None,
                   cd_map: dict[str, float] | None = None) -> DataFrame:
    """Long scorecard (model, metric, score, metric_pos)."""
    models = models or model_list(preds)
    cols = standard_columns(align(gold, preds, models), yn_metric, yn_thresh, cd_map)
    ex = standard_metric_exprs(yn_metric)
    wide = cols.groupBy("model").agg(*[e.cast("double").alias(k) for k, e in ex.items()])
    names = STANDARD_F1_METRICS if yn_metric == "f1" else STANDARD_R2_METRICS
    return to_long(wide, names)


# --- comprehensive scorecard (A10, A11) ---------------------------------------------------

def comprehensive_answers(aligned: DataFrame, cb: Codebook | None = None,
                          yn_thresh: float | None = None) -> DataFrame:
    """(model, meta_id, answers) — one row per item x model, its answers as an array of (dim, kind, g, p)."""
    cb = cb or default_codebook()
    g, p = F.col("gold"), F.col("json")
    items = []
    for d in cb.dimensions:
        if d.categorical == STANCE:
            gv = normalize_cd_label(F.lower(strip_ws(F.coalesce(_get(g, d.key), F.lit("")))))
            pv = normalize_cd_label(F.lower(strip_ws(F.coalesce(_get(p, d.key), F.lit("")))))
            kind = "stance"
        else:
            gv = yesno_label(_get(g, d.key))
            pv = yesno_label(_get(p, d.key)) if d.key == "china_related" else derive_label(p, d.key, yn_thresh)
            kind = "binary"
        items.append(F.struct(F.lit(d.key).alias("dim"), F.lit(kind).alias("kind"),
                              gv.alias("g"), pv.alias("p")))
    return aligned.select("model", "meta_id", F.array(*items).alias("answers"))


def comprehensive_long(aligned: DataFrame, cb: Codebook | None = None,
                       yn_thresh: float | None = None) -> DataFrame:
    """(model, meta_id, dim, kind, g, p) — one row per item x model x dimension."""
    return comprehensive_answers(aligned, cb, yn_thresh).select("model", "meta_id", F.inline("answers"))


def confusion(long: DataFrame) -> DataFrame:
    """(model, dim, kind, g, p) -> n : the whole scorecard's sufficient statistic."""
    return long.groupBy("model", "dim", "kind", "g", "p").agg(F.count(F.lit(1)).alias("n"))


def metrics_from_confusion(conf: DataFrame, weight_col: str = "n",
                           keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """A11 from confusion counts: binary F1 per dim, 3-class F1 + macro per
    stance dim. Output (keys..., metric, score)."""
    w = F.col(weight_col)
    g, p = F.col("g"), F.col("p")
    binary = conf.filter(F.col("kind") == "binary").groupBy(*keys, "dim").agg(
        M.f1_yes(g, p, w).alias("score"))
    bmetric = F.create_map(*[x for k, v in BINARY_METRIC.items() for x in (F.lit(k), F.lit(v))])
    b = binary.select(*keys, F.try_element_at(bmetric, F.col("dim")).alias("metric"), "score")
    mc = M.multiclass_f1(g, p, STANCE_CLASSES, w)
    st = conf.filter(F.col("kind") == "stance").groupBy(*keys, "dim").agg(
        *[e.alias(STANCE_SUFFIX[k]) for k, e in mc.items()])
    pref = F.create_map(*[x for k, v in STANCE_PREFIX.items() for x in (F.lit(k), F.lit(v))])
    sl = st.unpivot([*keys, "dim"], list(STANCE_SUFFIX.values()), "suffix", "score")
    s = sl.select(*keys, F.concat(F.try_element_at(pref, F.col("dim")), F.lit("_"), F.col("suffix")).alias("metric"),
                  "score")
    return b.unionByName(s)


def comprehensive_metric_order() -> list[str]:
    out = list(BINARY_METRIC.values())
    for pre in STANCE_PREFIX.values():
        out += [f"{pre}_{s}" for s in STANCE_SUFFIX.values()]
    return out


def score_comprehensive(gold: DataFrame, preds: DataFrame, models: list[str] | None = None,
                        cb: Codebook | None = None, yn_thresh: float | None = None) -> DataFrame:
    """20-metric scorecard, long form (model, metric, score, metric_pos)."""
    models = models or model_list(preds)
    conf = confusion(comprehensive_long(align(gold, preds, models), cb, yn_thresh))
    out = metrics_from_confusion(conf)
    order = comprehensive_metric_order()
    om = F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))])
    return out.withColumn("metric_pos", F.try_element_at(om, F.col("metric")))


def constant_gold(gold_cols: DataFrame, col: str) -> DataFrame:
    """A one-row notice when the gold column has a single value."""
    return gold_cols.agg(F.count_distinct(col).alias("n_values"),
                         F.first(col, ignorenulls=True).alias("value")).withColumn(
        "constant", F.col("n_values") == 1)


def console_view(long: DataFrame, models: list[str]) -> DataFrame:
    """Transposed view — one row per metric, one column per model,
    'v [lo, hi]' when a CI exists (models given, so the pivot needs no job)."""
    v = F.when(F.col("score").isNull(), F.lit("nan"))
    if "ci_low" in long.columns:
        cell = v.when(F.col("ci_low").isNotNull() & F.col("ci_high").isNotNull(),
                      F.format_string("%.3f [%.3f, %.3f]", "score", "ci_low", "ci_high"))
    else:
        cell = v
    cell = cell.otherwise(F.format_string("%.3f", "score"))
    return (long.withColumn("cell", cell).groupBy("metric_pos", "metric").pivot("model", models)
            .agg(F.first("cell")).orderBy("metric_pos"))
