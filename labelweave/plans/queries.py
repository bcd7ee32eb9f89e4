"""The query catalogue (one entry per implemented operator family).

Every query reads the driver tables (through ``sources.standins``) and
returns whole results; doubles are rounded to 6 places in both engines so
that engine-specific summation order cannot flip a hash.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.operators import split as SP
from labelweave.plans.catalog import register
from labelweave.plans.oracle_views import with_views
from labelweave.sources import standins as S

R = 6  # rounding of derived doubles


def rnd(c, n: int = R):
    return F.round(c, n)


# --- E1 stratified split ------------------------------------------------------

@register("split_assign", with_views(["split_out"], """
SELECT meta_id, split, china_stance_score, sensitive, collective_action,
       english, mandarin, spanish, other_lang, no_language
FROM split_out"""))
def q_split_assign(spark, sf):
    """Stratified capped split of the coder-label table."""
    return SP.stratified_split(S.d_labels(spark, sf))


@register("split_summary", with_views(["split_out"], """
SELECT split, CAST(count(*) AS BIGINT) AS n_rows,
       min(china_stance_score) AS stance_min, max(china_stance_score) AS stance_max,
       round(avg(sensitive), 6) AS mean_sensitive,
       round(avg(collective_action), 6) AS mean_collective_action,
       round(avg(english), 6) AS mean_english, round(avg(mandarin), 6) AS mean_mandarin,
       round(avg(spanish), 6) AS mean_spanish, round(avg(other_lang), 6) AS mean_other_lang,
       round(avg(no_language), 6) AS mean_no_language
FROM split_out GROUP BY split"""))
def q_split_summary(spark, sf):
    """A1: per-split row count, stance range and label means."""
    s = SP.split_summary(SP.stratified_split(S.d_labels(spark, sf)))
    return s.select("split", "n_rows", "stance_min", "stance_max",
                    *[rnd(F.col(f"mean_{c}")).alias(f"mean_{c}") for c in SP.LABEL_COLS])


@register("split_cells", with_views(["split_out"], """
WITH c AS (SELECT stance_bucket, sensitive_bucket, collective_bucket, count(*) AS c
           FROM split_b GROUP BY ALL),
     v AS (SELECT stance_bucket, sensitive_bucket, collective_bucket,
                  count(*) FILTER (WHERE split = 'train') AS t,
                  count(*) FILTER (WHERE split = 'val') AS v
           FROM split_out GROUP BY ALL)
SELECT c.stance_bucket, c.sensitive_bucket, c.collective_bucket, CAST(c.c AS BIGINT) AS c,
       CAST(coalesce(v.t, 0) AS BIGINT) AS train_got, CAST(coalesce(v.v, 0) AS BIGINT) AS val_got,
       (c.c >= 2 AND coalesce(v.v, 0) = 0) AS starved
FROM c LEFT JOIN v USING (stance_bucket, sensitive_bucket, collective_bucket)"""))
def q_split_cells(spark, sf):
    """A2 + JN5: per-cell population, train/val allocation and the starved flag."""
    lab = S.d_labels(spark, sf)
    b = SP.with_buckets(SP.prepare_labels(lab))
    c = b.groupBy(*SP.CELLS).agg(F.count(F.lit(1)).alias("c"))
    sp = SP.stratified_split(lab, keep_work_cols=True)
    v = sp.groupBy(*SP.CELLS).agg(F.count_if(F.col("split") == "train").alias("t"),
                                  F.count_if(F.col("split") == "val").alias("v"))
    j = c.join(v, SP.CELLS, "left")
    return j.select(*SP.CELLS, F.col("c").cast("bigint").alias("c"),
                    F.coalesce(F.col("t"), F.lit(0)).cast("bigint").alias("train_got"),
                    F.coalesce(F.col("v"), F.lit(0)).cast("bigint").alias("val_got"),
                    ((F.col("c") >= 2) & (F.coalesce(F.col("v"), F.lit(0)) == 0)).alias("starved"))


# --- parse (J1–J19, A6, S13) ----------------------------------------------------------

from labelweave.operators import parse as PA  # noqa: E402
from labelweave.operators import merge as MG  # noqa: E402
from labelweave.operators import records as RC  # noqa: E402
from labelweave.operators import bootstrap as BT  # noqa: E402
from labelweave.operators import scoring as SC  # noqa: E402
from labelweave.functions.text import to_double  # noqa: E402


def _parsed(spark, sf):
    return PA.parse_predictions(S.d_raw(spark, sf), first_pass="scan")


@register("parse_answers", with_views(["parse_expect"], """
SELECT model, meta_id, idx, parsed, mode, stance, sensitive, collective, n_keys FROM parse_expect"""))
def q_parse_answers(spark, sf):
    """Extraction ladder over two models' raw answers (one row per answer)."""
    p = _parsed(spark, sf)
    j = F.col("json")
    return p.select("model", "meta_id", "idx", "parsed", "mode",
                    to_double(F.try_element_at(j, F.lit("china_stance_score"))).alias("stance"),
                    F.try_element_at(j, F.lit("china_sensitive")).alias("sensitive"),
                    F.try_element_at(j, F.lit("collective_action")).alias("collective"),
                    F.when(F.col("parsed"), F.size(j)).alias("n_keys"))


@register("parse_rate", with_views(["parse_expect"], """
SELECT model, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE parsed) AS BIGINT) AS ok,
       round(CAST(count(*) FILTER (WHERE parsed) AS DOUBLE) / count(*), 6) AS parse_rate,
       CAST(count(*) FILTER (WHERE mode = 'strict') AS BIGINT) AS n_strict,
       CAST(count(*) FILTER (WHERE mode = 'codefence_stripped') AS BIGINT) AS n_codefence,
       CAST(count(*) FILTER (WHERE mode = 'balanced_block') AS BIGINT) AS n_balanced,
       CAST(count(*) FILTER (WHERE mode = 'pattern_match') AS BIGINT) AS n_pattern
FROM parse_expect GROUP BY model"""))
def q_parse_rate(spark, sf):
    """Parse rate and extraction-mode mix per model."""
    p = _parsed(spark, sf)
    m = F.col("mode")
    return p.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("parsed").alias("ok"),
        rnd(F.count_if("parsed") / F.count(F.lit(1))).alias("parse_rate"),
        F.count_if(m == "strict").alias("n_strict"),
        F.count_if(m == "codefence_stripped").alias("n_codefence"),
        F.count_if(m == "balanced_block").alias("n_balanced"),
        F.count_if(m == "pattern_match").alias("n_pattern"))


@register("parse_quarantine", with_views(["parse_expect"], """
SELECT model, idx, meta_id FROM parse_expect WHERE NOT parsed"""))
def q_parse_quarantine(spark, sf):
    """The quarantine output (every answer that did not validate)."""
    p = _parsed(spark, sf)
    return p.filter(~F.col("parsed")).select("model", "idx", "meta_id")


@register("parse_bad_preview", with_views(["parse_expect"], """
SELECT model, idx, meta_id FROM (
  SELECT model, idx, meta_id, row_number() OVER (PARTITION BY model ORDER BY idx) AS rn
  FROM parse_expect WHERE NOT parsed) WHERE rn <= 5"""))
def q_parse_bad_preview(spark, sf):
    """First five bad outputs per model by position (top-k per group)."""
    from pyspark.sql import Window
    q = _parsed(spark, sf).filter(~F.col("parsed"))
    w = Window.partitionBy("model").orderBy("idx")
    return q.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 5).select("model", "idx", "meta_id")


# --- merge (A3–A5, JN3, A15, A22) --------------------------------------------------------

def _merged(spark, sf):
    parsed = PA.parse_predictions(S.d_grouped(spark, sf), first_pass="scan", group_mode="binary")
    return MG.merge_groups(parsed, group_mode="binary")


@register("merge_groups", with_views(["grouped_expect"], """
SELECT meta_id, has_content AS complete,
       CASE WHEN has_content THEN 'china,content' ELSE 'china' END AS groups_present,
       CASE WHEN has_content THEN 11 ELSE 6 END AS n_keys,
       related, gov, sensitive, collective, hate
FROM grouped_expect"""))
def q_merge_groups(spark, sf):
    """A3 + A4 (+ J15/JN7 group validation, P35, W5): per-group answers folded per item."""
    m = _merged(spark, sf)
    j = F.col("json")
    g = lambda k: F.try_element_at(j, F.lit(k))
    return m.select("meta_id", "complete", F.array_join("groups_present", ",").alias("groups_present"),
                    F.size(j).alias("n_keys"), g("china_related").alias("related"),
                    g("china_ccp_government").alias("gov"), g("china_sensitive").alias("sensitive"),
                    g("collective_action").alias("collective"), g("hate_speech").alias("hate"))


@register("merge_stats", with_views(["grouped_expect"], """
SELECT CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (WHERE has_content) AS BIGINT) AS complete,
       CAST(count(*) FILTER (WHERE NOT has_content) AS BIGINT) AS partial,
       CAST(count(*) AS BIGINT) AS n_china, CAST(count(*) FILTER (WHERE has_content) AS BIGINT) AS n_content
FROM grouped_expect"""))
def q_merge_stats(spark, sf):
    """A5: merge statistics (items, complete, partial, items per group)."""
    m = _merged(spark, sf)
    has = lambda gname: F.array_contains("groups_present", gname)
    return m.agg(F.count(F.lit(1)).alias("items"), F.count_if("complete").alias("complete"),
                 F.count_if(~F.col("complete")).alias("partial"),
                 F.count_if(has("china")).alias("n_china"), F.count_if(has("content")).alias("n_content"))


@register("join_source", with_views(["grouped_expect", "comp_gold"], """
SELECT g.meta_id AS id, g.china_related AS china_related, e.meta_id IS NOT NULL AS pred_parsed,
       coalesce(e.has_content, false) AS pred_complete,
       e.related AS pred_china_related, e.gov AS pred_china_ccp_government,
       e.sensitive AS pred_china_sensitive, e.collective AS pred_collective_action,
       e.hate AS pred_hate_speech,
       CASE WHEN e.has_content THEN 'no' END AS pred_news_segments
FROM comp_gold g LEFT JOIN grouped_expect e ON g.meta_id = e.meta_id"""))
def q_join_source(spark, sf):
    """JN3 + A15: source table left-joined to merged predictions (pred_<key> columns)."""
    src = S.d_comp_items(spark, sf).select("id", "china_related")
    j = MG.join_predictions(src, _merged(spark, sf), with_complete=True)
    return j.select("id", "china_related", "pred_parsed", "pred_complete", "pred_china_related",
                    "pred_china_ccp_government", "pred_china_sensitive", "pred_collective_action",
                    "pred_hate_speech", "pred_news_segments")


@register("join_match_rate", with_views(["grouped_expect", "comp_gold"], """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(e.meta_id) AS BIGINT) AS matched,
       round(CAST(count(e.meta_id) AS DOUBLE) / count(*), 6) AS match_rate
FROM comp_gold g LEFT JOIN grouped_expect e ON g.meta_id = e.meta_id"""))
def q_join_match_rate(spark, sf):
    """Share of source rows that found a prediction."""
    src = S.d_comp_items(spark, sf).select("id")
    r = MG.match_rate(MG.join_predictions(src, _merged(spark, sf), keys=[]))
    return r.select("rows", "matched", rnd(F.col("match_rate")).alias("match_rate"))


# --- scoring (A7–A14, JN1, P31, P36, P42) ------------------------------------------------

MODELS = [m for m, _, _ in S.MODELS]


def _sql_f1(g: str, p: str, w: str = "1") -> str:
    tp = f"sum(CASE WHEN ({g}) AND ({p}) THEN {w} ELSE 0 END)"
    fp = f"sum(CASE WHEN NOT ({g}) AND ({p}) THEN {w} ELSE 0 END)"
    fn = f"sum(CASE WHEN ({g}) AND NOT ({p}) THEN {w} ELSE 0 END)"
    n = f"sum({w})"
    return (f"CASE WHEN coalesce({n}, 0) = 0 THEN NULL WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 "
            f"ELSE CAST(2 * {tp} AS DOUBLE) / (2 * {tp} + {fp} + {fn}) END")


def _sql_r2(g: str, p: str) -> str:
    m = f"{g} IS NOT NULL AND {p} IS NOT NULL"
    n = f"count(*) FILTER (WHERE {m})"
    sst = f"(var_pop({g}) FILTER (WHERE {m}) * {n})"
    ssr = f"sum(({g} - {p}) * ({g} - {p})) FILTER (WHERE {m})"
    return (f"CASE WHEN {n} < 2 THEN NULL WHEN {sst} = 0 THEN CASE WHEN {ssr} = 0 THEN 1.0 ELSE 0.0 END "
            f"ELSE 1 - {ssr} / {sst} END")


def _sql_r2_w(g: str, p: str, w: str) -> str:
    m = f"{g} IS NOT NULL AND {p} IS NOT NULL"
    W = f"sum(CASE WHEN {m} THEN CAST({w} AS DOUBLE) END)"
    sg = f"sum(CASE WHEN {m} THEN CAST({w} AS DOUBLE) * {g} END)"
    sst = f"(sum(CASE WHEN {m} THEN CAST({w} AS DOUBLE) * {g} * {g} END) - {sg} * {sg} / {W})"
    ssr = f"sum(CASE WHEN {m} THEN CAST({w} AS DOUBLE) * ({g} - {p}) * ({g} - {p}) END)"
    low, high = (f"{f}({g}) FILTER (WHERE {m} AND {w} > 0)" for f in ("min", "max"))
    return (f"CASE WHEN coalesce({W}, 0) < 2 THEN NULL WHEN {low} = {high} THEN CASE WHEN {ssr} = 0 THEN 1.0 "
            f"ELSE 0.0 END ELSE 1 - {ssr} / {sst} END")


def _sql_long(wide_cte: str, metrics: list[str], keys: str = "model") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {keys}, '{m}' AS metric, round({m}, 6) AS score, {i} AS metric_pos FROM {wide_cte}"
        for i, m in enumerate(metrics))


_STD_PAIRS = """
std_pairs AS (
  SELECT m.model, g.meta_id, g.g_stance, g.g_sens, g.g_coll,
         CASE WHEN p.stance IS NOT NULL THEN GREATEST(-1.0, LEAST(1.0, p.stance)) END AS p_stance,
         CASE WHEN lower(trim(p.sensitive)) IN ('yes', 'no', 'cannot_determine') THEN lower(trim(p.sensitive)) ELSE '' END AS p_sens,
         CASE WHEN lower(trim(p.collective)) IN ('yes', 'no', 'cannot_determine') THEN lower(trim(p.collective)) ELSE '' END AS p_coll
  FROM std_gold g CROSS JOIN (VALUES ('m_alpha'), ('m_beta')) m(model)
  LEFT JOIN parse_expect p ON p.model = m.model AND p.meta_id = g.meta_id AND p.parsed)"""

_STD_METRIC_SQL = {
    "stance_R2": _sql_r2("g_stance", "p_stance"),
    "stance_pos_F1": _sql_f1("coalesce(g_stance > 0, false)", "coalesce(p_stance > 0, false)"),
    "stance_neg_F1": _sql_f1("coalesce(g_stance < 0, false)", "coalesce(p_stance < 0, false)"),
    "ch_sensitive_F": _sql_f1("g_sens = 'yes'", "p_sens = 'yes'"),
    "col_action_F": _sql_f1("g_coll = 'yes'", "p_coll = 'yes'"),
}


def _val_gold(spark, sf):
    recs = RC.build_records(S.d_items(spark, sf))
    return SC.gold_table(recs)


@register("score_standard", with_views(["std_gold", "parse_expect"], "WITH " + _STD_PAIRS + """,
wide AS (SELECT model, """ + ",\n".join(f"{e} AS {k}" for k, e in _STD_METRIC_SQL.items()) + """
         FROM std_pairs GROUP BY model)
""" + _sql_long("wide", SC.STANDARD_F1_METRICS)))
def q_score_standard(spark, sf):
    """A7–A9, A12, A14, JN1, P31, P36: standard scorecard of two models (long form)."""
    s = SC.score_standard(_val_gold(spark, sf), _parsed(spark, sf), MODELS)
    return s.select("model", "metric", rnd(F.col("score")).alias("score"), F.col("metric_pos").cast("int"))


def _comp_sql() -> str:
    cb_dims = [("china_related", "binary", "china_related", "related"),
               ("china_sensitive", "binary", "sensitive", "p_sensitive"),
               ("collective_action", "binary", "collective_action", "p_collective"),
               ("hate_speech", "binary", "hate_speech", "hate"),
               ("harmful_content", "binary", "harmful", "CASE WHEN has_content THEN 'no' END"),
               ("news_segments", "binary", "news", "CASE WHEN has_content THEN 'no' END"),
               ("inauthentic_content", "binary", "inauthentic", "CASE WHEN has_content THEN 'no' END"),
               ("derivative_content", "binary", "derivative", "CASE WHEN has_content THEN 'no' END"),
               ("china_ccp_government", "stance", "stance_gov", "gov"),
               ("china_people_culture", "stance", "stance_culture", "'pro'"),
               ("china_technology_development", "stance", "stance_tech", "'anti'")]

    def norm(x):
        t = f"lower(trim(coalesce({x}, '')))"
        return (f"CASE WHEN {t} IN ('', 'nan', 'none', 'n/a') THEN 'n/a' "
                f"WHEN {t} IN ('neutral', 'unclear', 'neutral/unclear') THEN 'neutral/unclear' ELSE {t} END")

    def yn(x):
        t = f"lower(trim({x}))"
        return f"CASE WHEN {t} IN ('yes', 'no', 'cannot_determine') THEN {t} ELSE '' END"
    sel = []
    for key, kind, gcol, pexpr in cb_dims:
        pe = f"(CASE WHEN e.e_id IS NULL THEN NULL ELSE {pexpr} END)"
        if kind == "binary":
            sel += [f"{yn('g.' + gcol)} AS g_{key}", f"{yn(pe)} AS p_{key}"]
        else:
            sel += [f"{norm('g.' + gcol)} AS g_{key}", f"{norm(pe)} AS p_{key}"]
    pairs = ("comp_pairs AS (SELECT 'm_alpha' AS model, g.meta_id AS meta_id, " + ", ".join(sel) +
             " FROM comp_gold g LEFT JOIN (SELECT meta_id AS e_id, meta_id, has_content, related, gov, "
             "sensitive AS p_sensitive, collective AS p_collective, hate FROM grouped_expect) e "
             "ON g.meta_id = e.e_id)")
    metrics = {}
    for key, kind, _, _ in cb_dims:
        if kind == "binary":
            metrics[SC.BINARY_METRIC[key]] = _sql_f1(f"g_{key} = 'yes'", f"p_{key} = 'yes'")
        else:
            pre = SC.STANCE_PREFIX[key]
            keep = f"g_{key} IN ('pro', 'anti', 'neutral/unclear')"
            w = f"CASE WHEN {keep} THEN 1 ELSE 0 END"
            per = []
            for lab in SC.STANCE_CLASSES:
                e = _sql_f1(f"g_{key} = '{lab}'", f"p_{key} = '{lab}'", w)
                metrics[f"{pre}_{SC.STANCE_SUFFIX[lab]}"] = e
                per.append(f"({e})")
            metrics[f"{pre}_f1_macro"] = "(" + " + ".join(per) + f") / {len(per)}"
    order = SC.comprehensive_metric_order()
    wide = ("wide AS (SELECT model, " + ",\n".join(f"{metrics[m]} AS {m}" for m in order) +
            " FROM comp_pairs GROUP BY model)")
    return with_views(["comp_gold", "grouped_expect"], "WITH " + pairs + ",\n" + wide + "\n" +
                      _sql_long("wide", order))


def _comp_gold(spark, sf):
    recs = RC.build_records(S.d_comp_items(spark, sf), comprehensive=True)
    return SC.gold_table(recs)


@register("score_comprehensive", _comp_sql())
def q_score_comprehensive(spark, sf):
    """A10, A11, A14 (E3 end to end): grouped answers -> parse -> merge -> 20-metric scorecard."""
    preds = _merged(spark, sf).withColumn("model", F.lit("m_alpha"))
    s = SC.score_comprehensive(_comp_gold(spark, sf), preds, ["m_alpha"])
    return s.select("model", "metric", rnd(F.col("score")).alias("score"), F.col("metric_pos").cast("int"))


_BOOT_B, _BOOT_SEED, _BOOT_ALPHA = 1000, 0, 0.05


def _boot_sql() -> str:
    w = "w"
    rep = {
        "stance_R2": _sql_r2_w("g_stance", "p_stance", w),
        "stance_pos_F1": _sql_f1("coalesce(g_stance > 0, false)", "coalesce(p_stance > 0, false)", w),
        "stance_neg_F1": _sql_f1("coalesce(g_stance < 0, false)", "coalesce(p_stance < 0, false)", w),
        "ch_sensitive_F": _sql_f1("g_sens = 'yes'", "p_sens = 'yes'", w),
        "col_action_F": _sql_f1("g_coll = 'yes'", "p_coll = 'yes'", w),
    }
    names = SC.STANDARD_F1_METRICS
    body = "WITH " + _STD_PAIRS + f""",
us AS (SELECT t.range AS b, g.meta_id,
         ('0x' || substr(md5('{_BOOT_SEED}:' || CAST(t.range AS VARCHAR) || ':' || g.meta_id), 1, 13))::BIGINT::DOUBLE / {16 ** 13}::DOUBLE AS u
       FROM range(0, {_BOOT_B}) t, std_gold g),
wts AS (SELECT b, meta_id, CASE {" ".join(f"WHEN u < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(BT.ITEM_CDF))} ELSE {len(BT.ITEM_CDF)} END AS w FROM us),
reps AS (SELECT model, b, """ + ",\n".join(f"{e} AS {k}" for k, e in rep.items()) + """
         FROM std_pairs JOIN wts USING (meta_id) WHERE w > 0 GROUP BY model, b),
rl AS (""" + "\nUNION ALL\n".join(f"SELECT model, '{m}' AS metric, {m} AS v FROM reps" for m in names) + f"""),
ci AS (SELECT model, metric, round(quantile_cont(v, {_BOOT_ALPHA / 2}), 6) AS ci_low,
              round(quantile_cont(v, {1 - _BOOT_ALPHA / 2}), 6) AS ci_high
       FROM rl WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY model, metric),
wide AS (SELECT model, """ + ",\n".join(f"{e} AS {k}" for k, e in _STD_METRIC_SQL.items()) + """
         FROM std_pairs GROUP BY model),
pt AS (""" + _sql_long("wide", names) + """)
SELECT pt.model, pt.metric, pt.score, pt.metric_pos, ci.ci_low, ci.ci_high
FROM pt LEFT JOIN ci USING (model, metric)"""
    return with_views(["std_gold", "parse_expect"], body)


@register("bootstrap_ci", _boot_sql())
def q_bootstrap_ci(spark, sf):
    """Bootstrap CIs (B=1000, alpha=0.05) of the standard scorecard, Poisson(1) weights hashed from the item id."""
    s = BT.bootstrap_standard(_val_gold(spark, sf), _parsed(spark, sf), MODELS,
                              B=_BOOT_B, alpha=_BOOT_ALPHA, seed=_BOOT_SEED)
    return s.select("model", "metric", rnd(F.col("score")).alias("score"), F.col("metric_pos").cast("int"),
                    rnd(F.col("ci_low")).alias("ci_low"), rnd(F.col("ci_high")).alias("ci_high"))


# --- records (P20–P33, P44, JN6) ----------------------------------------------------------

import hashlib  # noqa: E402

from labelweave.codebook import default_codebook  # noqa: E402
from labelweave.plans import prompt_texts as PT  # noqa: E402
from labelweave.operators import usage as US  # noqa: E402
from labelweave.operators import summary as SM  # noqa: E402
from labelweave.functions.text import looks_truncated  # noqa: E402

NL = "chr(10)"


def _md5(s: str) -> str:
    return hashlib.md5(s.encode()).hexdigest()


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_user_text(t: str, d: str) -> str:
    tt, dd = _sql_strip(f"coalesce({t}, '')"), _sql_strip(f"coalesce({d}, '')")
    return (f"concat_ws({NL} || {NL}, CASE WHEN {tt} <> '' THEN 'TRANSCRIPT:' || {NL} || {tt} END, "
            f"CASE WHEN {dd} <> '' THEN 'DESCRIPTION:' || {NL} || {dd} END)")


_STD_SYSTEM_MD5 = _md5(PT.STANDARD)


@register("records_standard", with_views(["d_labels"], f"""
SELECT lpad(CAST(l.doc_id AS VARCHAR), 12, '0') AS meta_id, 3 AS n_messages,
       md5({_sql_user_text('d.text', 'd.source')}) AS user_md5,
       '{_STD_SYSTEM_MD5}' AS system_md5,
       '{{"china_stance_score":' || CAST(GREATEST(-1.0, LEAST(1.0, l.china_stance_score)) AS VARCHAR) ||
       ',"china_sensitive":"' || CASE WHEN l.sensitive >= 0.5 THEN 'yes' ELSE 'no' END ||
       '","collective_action":"' || CASE WHEN l.collective_action >= 0.5 THEN 'yes' ELSE 'no' END || '"}}' AS gold_json
FROM d_labels l JOIN documents d ON l.doc_id = d.doc_id
WHERE l.china_stance_score IS NOT NULL"""))
def q_records_standard(spark, sf):
    """Standard chat records (system, user, gold assistant)."""
    r = RC.build_records(S.d_items(spark, sf))
    m = F.col("messages")
    return r.select("meta_id", F.size(m).alias("n_messages"), F.md5(m[1]["content"]).alias("user_md5"),
                    F.md5(m[0]["content"]).alias("system_md5"), m[2]["content"].alias("gold_json"))


def _grouped_records_sql() -> str:
    cb = default_codebook()
    order = cb.gold_keys()
    src = {d.key: d.source_column for d in cb.dimensions}
    rows = []
    for g in cb.group_configs("by-category"):
        keys = [k for k in order if k in g.dims]
        parts = []
        for i, k in enumerate(keys):
            parts.append(("'{' || " if i == 0 else "',' || ") + f"'\"{k}\":\"' || {_sql_strip('g.' + src[k])} || '\"' || ")
        js = "".join(parts) + "'}'"
        rows.append(f"SELECT g.meta_id || '__group_{g.group_id}' AS meta_id, '{g.group_id}' AS group_id, "
                    f"g.meta_id AS original_meta_id, '{_md5(PT.BY_CATEGORY[g.group_id])}' AS system_md5, "
                    f"{js} AS gold_json FROM comp_gold g")
    return with_views(["comp_gold"], "\nUNION ALL\n".join(rows))


@register("records_grouped", _grouped_records_sql())
def q_records_grouped(spark, sf):
    """JN6, P24, P26, P27, P35: comprehensive records fanned out per dimension group."""
    r = RC.build_records(S.d_comp_items(spark, sf), comprehensive=True, group_mode="by-category")
    m = F.col("messages")
    return r.select("meta_id", "group_id", "original_meta_id", F.md5(m[0]["content"]).alias("system_md5"),
                    m[2]["content"].alias("gold_json"))


@register("records_rejects", with_views(["d_labels"], """
SELECT reject_reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN l.doc_id % 23 = 0 THEN 'empty_id' WHEN l.doc_id % 17 = 0 THEN 'short_text'
              WHEN l.china_stance_score IS NULL THEN 'invalid_stance' END AS reject_reason
  FROM d_labels l JOIN documents d ON l.doc_id = d.doc_id) WHERE reject_reason IS NOT NULL GROUP BY 1"""))
def q_records_rejects(spark, sf):
    """Filter accounting of the record build (rows dropped, by reason); some items have no id or no text."""
    n = F.col("id").cast("long")
    items = S.d_items(spark, sf).select(
        F.when(n % 23 == 0, F.lit(" ")).otherwise(F.col("id")).alias("id"), "china_stance_score", "sensitive", "collective_action",
        F.when(n % 17 == 0, F.lit(" \n ")).otherwise(F.col("transcript")).alias("transcript"),
        F.when(n % 17 == 0, F.lit(None)).otherwise(F.col("description")).alias("description"))
    _, rej = RC.build_records(items, with_reasons=True)
    return rej.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@register("record_prompts", f"""
WITH c AS (
  SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last_role,
         {_sql_strip(f"coalesce(string_agg(text, {NL} || {NL} ORDER BY turn) FILTER (WHERE role = 'user'), '')")} AS ut
  FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS meta_id, CAST(n AS INTEGER) AS n_messages,
       CAST(CASE WHEN last_role = 'assistant' THEN n - 1 ELSE n END AS INTEGER) AS n_prompt,
       CAST(n - 1 AS INTEGER) AS n_prompt_drop_last, CAST(n AS INTEGER) AS n_prompt_enforced,
       last_role, md5(ut) AS user_md5
FROM c""")
def q_record_prompts(spark, sf):
    """P31–P33 on chat records: prompt messages three ways, user text."""
    r = S.d_records(spark, sf)
    m = F.col("messages")
    return r.select("meta_id", F.size(m).alias("n_messages"),
                    F.size(RC.prompt_messages(m, "drop_last_if_assistant")).alias("n_prompt"),
                    F.size(RC.prompt_messages(m, "drop_last")).alias("n_prompt_drop_last"),
                    F.size(RC.prompt_messages(m, "enforce", "Answer with JSON only.")).alias("n_prompt_enforced"),
                    F.element_at(m, -1)["role"].alias("last_role"),
                    F.md5(RC.record_user_text(m)).alias("user_md5"))


def _sql_tokens(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR length({x}) = 0 THEN 0 "
            f"ELSE GREATEST(1, CAST(round_even(length({x}) / 4.0, 0) AS BIGINT)) END")


@register("token_tally", f"""
WITH r AS (SELECT conv_id, CAST(sum({_sql_tokens('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)
SELECT CAST(count(*) AS BIGINT) AS examples, CAST(sum(tokens) AS BIGINT) AS tokens_total,
       round(sum(tokens) / GREATEST(count(*), 1), 6) AS avg_per_example,
       CAST(min(tokens) AS BIGINT) AS min_per_example, CAST(max(tokens) AS BIGINT) AS max_per_example,
       CAST(sum(tokens) AS BIGINT) AS charged_training_tokens,
       round(sum(tokens) / 1e6 * 25.0, 6) AS training_cost,
       round((SELECT 932 * count(*) / 1e6 * 0.15 + 308 * count(*) / 1e6 * 0.60 FROM labels), 6) AS infer_cost_total
FROM r""")
def q_token_tally(spark, sf):
    """Heuristic token counts of chat records, tally and cost estimate."""
    r = S.d_records(spark, sf).select(US.record_tokens(F.col("messages")).alias("tokens"))
    calls = S.table(spark, sf, "labels").count()        # one call per labelled item
    c = US.cost_estimate(US.tally(r), infer_calls=calls, keep=True)
    return c.select("examples", F.col("train_tokens").alias("tokens_total"),
                    rnd(F.col("avg_per_example")).alias("avg_per_example"),
                    F.col("min_per_example").cast("bigint").alias("min_per_example"),
                    F.col("max_per_example").cast("bigint").alias("max_per_example"), "charged_training_tokens",
                    rnd(F.col("training_cost")).alias("training_cost"),
                    rnd(F.col("infer_cost_total")).alias("infer_cost_total"))


def _usage_sql():
    def st(c, p):
        return (f"round(avg({c}), 6) AS {p}_mean, round(quantile_cont({c}, 0.5), 6) AS {p}_median, "
                f"round(quantile_cont({c}, 0.9), 6) AS {p}_p90, round(quantile_cont({c}, 0.99), 6) AS {p}_p99, "
                f"CAST(min({c}) AS BIGINT) AS {p}_min, CAST(max({c}) AS BIGINT) AS {p}_max, "
                f"CAST(sum({c}) AS BIGINT) AS {p}_total")
    return f"""
WITH u AS (SELECT doc_id AS idx, CAST(floor(n_chars / 4) AS BIGINT) AS prompt_tokens,
                  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST((doc_id * 13) % 300 + 20 AS BIGINT) END AS completion_tokens
           FROM documents)
SELECT CAST(count(*) AS BIGINT) AS calls, CAST(count(completion_tokens) AS BIGINT) AS with_usage,
       {st('prompt_tokens', 'prompt')}, {st('completion_tokens', 'completion')},
       CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS tokens_total,
       round(sum(prompt_tokens) / sum(completion_tokens), 6) AS input_output_ratio,
       round(sum(completion_tokens) / sum(prompt_tokens), 6) AS output_input_ratio
FROM u"""


@register("usage_summary", _usage_sql())
def q_usage_summary(spark, sf):
    """Prompt / completion token distribution (mean, median, p90, p99, min, max, totals, ratios)."""
    u = US.usage_distribution(S.d_usage(spark, sf))
    out = []
    for c in u.columns:
        if any(c.endswith(s) for s in ("_mean", "_median", "_p90", "_p99", "_ratio")):
            out.append(rnd(F.col(c)).alias(c))
        else:
            out.append(F.col(c).cast("bigint").alias(c))
    return u.select(*out)


def _final_joined(spark, sf):
    from labelweave.operators import merge as MGx
    preds = _parsed(spark, sf).filter(F.col("model") == "m_alpha")
    return MGx.join_predictions(S.d_items(spark, sf).select("id"), preds,
                                keys=["china_stance_score", "china_sensitive"])


_FINAL_PRED = """
fp AS (SELECT g.meta_id, e.meta_id IS NOT NULL AS pred_parsed, e.stance AS s, e.sensitive AS sens
       FROM (SELECT lpad(CAST(l.doc_id AS VARCHAR), 12, '0') AS meta_id FROM d_labels l
             JOIN documents d ON l.doc_id = d.doc_id) g
       LEFT JOIN parse_expect e ON e.meta_id = g.meta_id AND e.model = 'm_alpha' AND e.parsed)"""


@register("final_summary", with_views(["d_labels", "parse_expect"], "WITH " + _FINAL_PRED + """
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (WHERE pred_parsed) AS BIGINT) AS predicted_rows,
       round(100.0 * count(*) FILTER (WHERE pred_parsed) / count(*), 6) AS predicted_pct,
       CAST(count(s) AS BIGINT) AS score_count, round(avg(s), 6) AS score_mean,
       min(s) AS score_min, max(s) AS score_max,
       CAST(count(*) FILTER (WHERE s < -0.1) AS BIGINT) AS negative,
       CAST(count(*) FILTER (WHERE s >= -0.1 AND s <= 0.1) AS BIGINT) AS neutral,
       CAST(count(*) FILTER (WHERE s > 0.1) AS BIGINT) AS positive,
       round(100.0 * count(*) FILTER (WHERE s < -0.1) / count(s), 6) AS negative_pct,
       round(100.0 * count(*) FILTER (WHERE s >= -0.1 AND s <= 0.1) / count(s), 6) AS neutral_pct,
       round(100.0 * count(*) FILTER (WHERE s > 0.1) / count(s), 6) AS positive_pct
FROM fp"""))
def q_final_summary(spark, sf):
    """Final distribution of predictions joined back to the source table."""
    s = SM.final_summary(_final_joined(spark, sf))
    return s.select(*[rnd(F.col(c)).alias(c) if c.endswith(("_pct", "_mean")) else F.col(c)
                      for c in s.columns])


@register("final_value_counts", with_views(["d_labels", "parse_expect"], "WITH " + _FINAL_PRED + """
SELECT sens AS value, CAST(count(*) AS BIGINT) AS count,
       round(100.0 * count(*) / (SELECT count(*) FROM fp WHERE pred_parsed), 6) AS pct
FROM fp WHERE pred_parsed AND sens IS NOT NULL GROUP BY sens"""))
def q_final_value_counts(spark, sf):
    """Value counts of the predicted sensitivity label with % of predicted rows."""
    v = SM.value_counts(_final_joined(spark, sf))
    return v.select("value", "count", rnd(F.col("pct")).alias("pct"))


def _compare_gold(spark, sf):
    recs = RC.build_records(S.d_items(spark, sf))
    return recs.select("meta_id", RC.gold_of(F.col("messages")).alias("gold"),
                       RC.record_user_text(F.col("messages")).alias("transcript"))


def _compare_sql():
    def yn(x):
        t = f"lower(trim({x}))"
        return f"CASE WHEN {t} IN ('yes', 'no', 'cannot_determine') THEN {t} ELSE 'invalid' END"
    cols = ["g.meta_id AS meta_id"]
    for name, expr in (("stance", None), ("sensitive", "sensitive"), ("collective", "collective")):
        for m in MODELS:
            a = f"p_{m}"
            if name == "stance":
                cols.append(f"CASE WHEN {a}.stance IS NOT NULL THEN GREATEST(-1.0, LEAST(1.0, {a}.stance)) END AS {m}_stance")
            else:
                cols.append(f"{yn(f'{a}.{expr}')} AS {m}_{name}")
        if name == "stance":
            cols.append("g.g_stance AS human_stance")
        elif name == "sensitive":
            cols.append("g.g_sens AS human_sensitive")
        else:
            cols.append("g.g_coll AS human_collective")
    cols.append(f"{_sql_user_text('d.text', 'd.source')} AS transcript")
    joins = " ".join(f"LEFT JOIN parse_expect p_{m} ON p_{m}.meta_id = g.meta_id AND p_{m}.model = '{m}' "
                     f"AND p_{m}.parsed" for m in MODELS)
    return with_views(["std_gold", "parse_expect"],
                      "SELECT " + ", ".join(cols) + " FROM std_gold g JOIN documents d ON "
                      "lpad(CAST(d.doc_id AS VARCHAR), 12, '0') = g.meta_id " + joins)


@register("compare_wide", _compare_sql())
def q_compare_wide(spark, sf):
    """JN2: wide side-by-side table (models then human per dimension, transcript last), keyed on meta_id."""
    return SM.compare_wide(_compare_gold(spark, sf), _parsed(spark, sf), MODELS)


# --- streaming (ST1, ST2) and inference (F1) ---------------------------------------------

import uuid  # noqa: E402

from labelweave.session import checkpoint_dir  # noqa: E402
from labelweave.streaming import monitor as ST  # noqa: E402
from labelweave.operators import infer as INF  # noqa: E402


@register("stream_parse", with_views(["parse_expect"], """
SELECT model, meta_id, idx, parsed, mode, stance, sensitive, collective, n_keys FROM parse_expect"""))
def q_stream_parse(spark, sf):
    """ST1 + ST2: raw answers landed as JSON files, parsed by a Structured
    Streaming query (foreachBatch, idempotent per batch id), read back."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    S.d_raw(spark, sf).repartition(4).write.mode("overwrite").json(f"{base}/landing")
    raw = ST.raw_stream(spark, f"{base}/landing", max_files_per_trigger=2)
    q = ST.parse_stream(raw, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    p = spark.read.parquet(f"{base}/out/parsed")
    j = F.col("json")
    return p.select("model", "meta_id", "idx", "parsed", "mode",
                    to_double(F.try_element_at(j, F.lit("china_stance_score"))).alias("stance"),
                    F.try_element_at(j, F.lit("china_sensitive")).alias("sensitive"),
                    F.try_element_at(j, F.lit("collective_action")).alias("collective"),
                    F.when(F.col("parsed"), F.size(j)).alias("n_keys"))


def _infer_sql():
    ut = _sql_user_text("d.text", "d.source")
    return with_views(["d_labels"], f"""
WITH u AS (SELECT l.doc_id, lpad(CAST(l.doc_id AS VARCHAR), 12, '0') AS meta_id, length({ut}) AS n
           FROM d_labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.china_stance_score IS NOT NULL)
SELECT doc_id AS idx, meta_id,
       '{{"china_stance_score":' || CAST(CAST((n * 37) % 201 - 100 AS DOUBLE) / 100 AS VARCHAR) ||
       ',"china_sensitive":"' || CASE WHEN n % 3 = 0 THEN 'yes' ELSE 'no' END || '"}}' AS raw,
       CAST(CASE WHEN n % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt,
       CAST(CASE WHEN n % 5 = 0 THEN 192 ELSE 128 END AS INTEGER) AS max_tokens_used,
       'stop' AS finish_reason, false AS truncated, 'echo' AS model
FROM u""")


@register("infer_echo", _infer_sql())
def q_infer_echo(spark, sf):
    """batched scoring (mapInPandas) with retry on truncation and a growing
    token budget, over records built from the tables, with a deterministic model."""
    recs = RC.build_records(S.d_items(spark, sf), label_mode=True)
    recs = recs.withColumn("idx", F.col("meta_id").cast("long"))
    pol = INF.RetryPolicy(max_tokens=128, retries=3, base_sleep=0.0, growth=1.5, max_tokens_cap=400)
    out = INF.score_batches(recs, INF.echo_model, "echo", pol)
    return out.select("idx", "meta_id", "raw", "attempt", "max_tokens_used", "finish_reason", "truncated", "model")


@register("truncation_flags", with_views(["parse_expect"], """
SELECT model, idx, (cls IN (6, 7, 14) OR (cls = 13 AND (idx // 15) % 3 = 0)) AS truncated
FROM parse_expect"""))
def q_truncation_flags(spark, sf):
    """Truncation predicate (finish reason, empty text, unbalanced braces
    after the fence is stripped, dangling '{ [ : ,') over every raw answer."""
    r = S.d_raw(spark, sf)
    return r.select("model", "idx", looks_truncated(F.col("raw"), F.col("finish_reason")).alias("truncated"))


# --- checks of single rules and of files, streams and resampling -------------------------------

from labelweave.functions import text as TX  # noqa: E402
from labelweave.plans.oracle_views import VIEWS  # noqa: E402
from labelweave.sources import files as IO  # noqa: E402


def _fresh(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("score_merged_files", with_views(["std_gold", "parse_expect"], "WITH " + _STD_PAIRS + """,
wide AS (SELECT model, """ + ",\n".join(f"{e} AS {k}" for k, e in _STD_METRIC_SQL.items()) + """
         FROM std_pairs GROUP BY model)
""" + _sql_long("wide", SC.STANDARD_F1_METRICS)))
def q_score_merged_files(spark, sf):
    """One JSONL file of answers per model (one without positions), written, read back and scored."""
    base = _fresh(spark, "files")
    _parsed(spark, sf).drop("mode").write.parquet(f"{base}/all")
    rows = spark.read.parquet(f"{base}/all")
    for m in MODELS:
        mine = rows.filter(F.col("model") == m).drop("model")
        if m == MODELS[-1]:
            mine = mine.withColumn("idx", F.lit(None).cast("long"))
        IO.write_jsonl(mine, f"{base}/{m}.parsed.jsonl")
    preds = IO.read_predictions(spark, [f"{base}/{m}.parsed.jsonl" for m in MODELS])
    s = SC.score_standard(_val_gold(spark, sf), preds, MODELS)
    return s.select("model", "metric", rnd(F.col("score")).alias("score"), F.col("metric_pos").cast("int"))


def _r2_sql() -> str:
    def num(x):
        return (f"CASE lower(trim({x})) WHEN 'yes' THEN 1.0::DOUBLE WHEN '1' THEN 1.0::DOUBLE WHEN 'no' THEN 0.0::DOUBLE "
                f"WHEN '0' THEN 0.0::DOUBLE WHEN 'cannot_determine' THEN 0.5::DOUBLE END")
    pairs = _STD_PAIRS.strip().removeprefix("std_pairs AS (").removesuffix(")")
    ex = {"stance_R2": _sql_r2("g_stance", "p_stance"), "stance_pos_F1": _STD_METRIC_SQL["stance_pos_F1"],
          "stance_neg_F1": _STD_METRIC_SQL["stance_neg_F1"], "ch_sensitive_R2": _sql_r2("gs", "ps"),
          "col_action_R2": _sql_r2("gc", "pc")}
    raw = pairs.replace("SELECT m.model", f"SELECT {num('g.g_sens')} AS gs, {num('p.sensitive')} AS ps, "
                        f"{num('g.g_coll')} AS gc, {num('p.collective')} AS pc, m.model")
    return with_views(["std_gold", "parse_expect"], f"WITH std_pairs AS ({raw}), wide AS (SELECT model, "
                      + ", ".join(f"{e} AS {k}" for k, e in ex.items()) + " FROM std_pairs GROUP BY model)\n"
                      + _sql_long("wide", SC.STANDARD_R2_METRICS))


@register("score_standard_r2", _r2_sql())
def q_score_standard_r2(spark, sf):
    """A12 in R2 mode, P37, P38: labels and numbers mapped to [0, 1] and compared by R2."""
    s = SC.score_standard(_val_gold(spark, sf), _parsed(spark, sf), MODELS, yn_metric="r2",
                          cd_map=SC.parse_cd_map("yes=1,no=0,cannot_determine=0.5"))
    return s.select("model", "metric", rnd(F.col("score")).alias("score"), F.col("metric_pos").cast("int"))


_COMP_B, _COMP_SEED = 200, 3


def _comp_boot_sql() -> str:
    """The point scores of score_comprehensive, and the same sums weighted per replicate."""
    plain = _comp_sql()
    head, tail = plain.rsplit("wide AS (", 1)
    wide = tail[:tail.index("FROM comp_pairs GROUP BY model)")]
    order = SC.comprehensive_metric_order()
    weighted = wide.replace("THEN 1 ELSE 0 END ELSE 0 END", "THEN w ELSE 0 END ELSE 0 END")
    for m in ("THEN 1 ELSE 0 END", "sum(1)"):
        weighted = weighted.replace(m, {"sum(1)": "sum(w)"}.get(m, "THEN w ELSE 0 END"))
    cdf = " ".join(f"WHEN u < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(BT.ITEM_CDF))
    return head + f"""us AS (SELECT t.range AS b, g.meta_id,
         ('0x' || substr(md5('{_COMP_SEED}:' || CAST(t.range AS VARCHAR) || ':' || g.meta_id), 1, 13))::BIGINT::DOUBLE / {16 ** 13}::DOUBLE AS u
       FROM range(0, {_COMP_B}) t, comp_pairs g),
wts AS (SELECT b, meta_id, CASE {cdf} ELSE {len(BT.ITEM_CDF)} END AS w FROM us),
wide AS ({wide} FROM comp_pairs GROUP BY model),
reps AS ({weighted.replace("SELECT model,", "SELECT model, b,", 1)} FROM comp_pairs JOIN wts USING (meta_id) WHERE w > 0 GROUP BY model, b),
rl AS ({" UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS v FROM reps" for m in order)}),
ci AS (SELECT model, metric, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high
       FROM rl WHERE v IS NOT NULL GROUP BY model, metric),
pt AS ({_sql_long("wide", order)})
SELECT pt.model, pt.metric, pt.score, pt.metric_pos, ci.ci_low, ci.ci_high FROM pt LEFT JOIN ci USING (model, metric)"""


@register("bootstrap_comprehensive", _comp_boot_sql())
def q_bootstrap_comprehensive(spark, sf):
    """A13 on the 20 metrics: bootstrap CIs from weighted confusion tables."""
    preds = _merged(spark, sf).withColumn("model", F.lit("m_alpha"))
    s = BT.bootstrap_comprehensive(_comp_gold(spark, sf), preds, ["m_alpha"], B=_COMP_B, seed=_COMP_SEED)
    return s.select("model", "metric", rnd(F.col("score")).alias("score"), F.col("metric_pos").cast("int"),
                    rnd(F.col("ci_low")).alias("ci_low"), rnd(F.col("ci_high")).alias("ci_high"))


@register("parse_simple", with_views(["raw_expect"], """
SELECT model, meta_id, cls IN (0, 1, 2, 3, 8, 9) AS parsed,
       CASE WHEN cls IN (0, 8, 9) THEN 'strict' WHEN cls IN (1, 2) THEN 'tail' WHEN cls = 3 THEN 'balanced_block' ELSE 'none' END AS mode,
       CASE WHEN cls IN (0, 1, 2, 3, 8, 9) THEN y END AS sensitive,
       CASE WHEN cls IN (0, 1, 2, 3, 8) THEN c END AS collective,
       CASE WHEN cls IN (0, 1, 2, 3, 8) THEN 3 WHEN cls = 9 THEN 4 END AS n_keys
FROM raw_expect"""))
def q_parse_simple(spark, sf):
    """The ladder without repairs (whole text, tail, last valid block)."""
    p = PA.parse_predictions(S.d_raw(spark, sf), first_pass="scan", strategy="simple")
    j = F.col("json")
    return p.select("model", "meta_id", "parsed", "mode", F.try_element_at(j, F.lit("china_sensitive")).alias("sensitive"),
                    F.try_element_at(j, F.lit("collective_action")).alias("collective"),
                    F.when(F.col("parsed"), F.size(j)).alias("n_keys"))


@register("split_dedupe", with_views(["split_l0"], """
SELECT meta_id, min(least(china_stance_score, CASE WHEN CAST(meta_id AS BIGINT) % 5 = 0 THEN -china_stance_score ELSE china_stance_score END)) AS china_stance_score,
       CAST(count(*) AS BIGINT) AS n
FROM split_l0 GROUP BY meta_id"""))
def q_split_dedupe(spark, sf):
    """Q13: one row per id before the split; a fifth of the ids are labelled twice."""
    d = SP.dedupe_ids(SP.prepare_labels(_twice(spark, sf)))
    return d.groupBy("meta_id").agg(F.min("china_stance_score").alias("china_stance_score"), F.count(F.lit(1)).alias("n"))


def _twice(spark, sf):
    lab = S.d_labels(spark, sf)
    again = lab.filter("doc_id % 5 = 0").withColumn("china_stance_score", -F.col("china_stance_score"))
    return lab.unionByName(again)


def _leaks_sql() -> str:
    d = VIEWS["d_labels"]
    ctes = [("d_once", d), ("d_labels", "SELECT * FROM d_once UNION ALL SELECT * REPLACE (-china_stance_score AS china_stance_score) "
                                        "FROM d_once WHERE doc_id % 5 = 0")]
    ctes += [(v, VIEWS[v]) for v in ("split_l0", "split_b", "split_r", "split_a", "split_out")]
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + """
SELECT meta_id, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train,
       CAST(count(*) FILTER (WHERE split = 'val') AS BIGINT) AS n_val
FROM split_out GROUP BY meta_id HAVING n_train > 0 AND n_val > 0"""


@register("split_leaks", _leaks_sql())
def q_split_leaks(spark, sf):
    """Q13: ids that a split without deduplication puts on both sides."""
    return SP.leak_audit(SP.stratified_split(_twice(spark, sf)))


@register("split_starved", with_views(["split_b"], """
SELECT stance_bucket, sensitive_bucket, collective_bucket, CAST(count(*) AS BIGINT) AS c, CAST(0 AS BIGINT) AS val_got
FROM split_b GROUP BY ALL HAVING count(*) >= 2"""))
def q_split_starved(spark, sf):
    """JN5 with a validation cap of 0 and a renamed path column: every cell of two or more rows is starved."""
    lab = S.d_labels(spark, sf).withColumnRenamed("video", "clip")
    return SP.starved_cells(lab, video_col="clip", val_cap=0)


@register("value_rules", """
WITH v AS (SELECT doc_id, doc_id % 10 AS k FROM labels)
SELECT doc_id,
       CASE k WHEN 0 THEN 0.85 WHEN 1 THEN 0.4 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN 1.0 WHEN 9 THEN 0.5 END::DOUBLE AS unit,
       CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 WHEN 2 THEN 1.0 WHEN 3 THEN -1.0 WHEN 4 THEN 1.0 WHEN 9 THEN 0.5 END::DOUBLE AS signed,
       CASE k WHEN 0 THEN 'pro' WHEN 1 THEN 'anti' WHEN 2 THEN 'neutral' WHEN 3 THEN 'neutral/unclear' ELSE '' END AS stance,
       CASE k WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'cannot_determine' ELSE '' END AS label,
       CAST(20000000 + doc_id AS VARCHAR) AS id_text,
       CASE WHEN k = 7 THEN '' ELSE CAST(doc_id AS VARCHAR) || '.5' END AS number_text,
       k IN (0, 1, 2) AS valid_text,
       LEAST(2, GREATEST(1, (100 + doc_id % 1500) // 560)) * LEAST(2, GREATEST(1, (300 + doc_id % 1100) // 560)) * 1601 AS image_tokens
FROM v""")
def q_value_rules(spark, sf):
    """Tolerant number, label, id and text rules on derived values."""
    d = F.col("doc_id")
    k = d % 10

    def pick(values: list[str | None]):
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k + 1).cast("int"))

    number = pick(["85", " 0.4 ", "1", "-3", "100", "nan", "abc", "", None, "5e-1"])
    stance = pick(["Pro", " anti ", "NEUTRAL", "neutral/unclear", "both", "", None, "0", "proo", "n/a"])
    label = pick(["Yes", " NO", "cannot_determine", "maybe", "", None, "1", "true", "y", "nope"])
    text = pick(["long enough words", "  just ten c  ", "undefined values", "short", "   ", "", None, "nan", "None", "123456789"])
    return S.table(spark, sf, "labels").select(
        "doc_id", TX.clamp01(number).alias("unit"), TX.clamp11(number).alias("signed"), TX.stance_label(stance).alias("stance"),
        TX.yesno_label(label).alias("label"), TX.meta_id_str((d + 20000000).cast("double")).alias("id_text"),
        TX.safe_text(F.when(k == 7, F.lit(float("nan"))).otherwise(d + 0.5)).alias("number_text"),
        TX.is_valid_text(text).alias("valid_text"),
        US.image_tokens(100 + d % 1500, 300 + d % 1100).alias("image_tokens"))


@register("gold_checks", with_views(["std_gold"], """
SELECT 'standard' AS format, CAST(count(*) FILTER (meta_id::BIGINT % 7 = 2) AS BIGINT) AS n_missing,
       CAST(count(DISTINCT g_stance) AS BIGINT) AS n_values, count(DISTINCT g_stance) = 1 AS constant,
       true AS same_constant FROM std_gold"""))
def q_gold_checks(spark, sf):
    """Format of the gold records, records without a required key, constant gold (stance is not, a fixed value is)."""
    gold = _val_gold(spark, sf)
    fmt = SC.detect_format(gold)
    cut = F.when(F.col("meta_id").cast("long") % 7 == 2, F.map_filter("gold", lambda k, v: k != "china_sensitive")).otherwise(F.col("gold"))
    missing = SC.missing_gold_keys(gold.withColumn("gold", cut), fmt).count()
    values = SC.constant_gold(gold.select(TX.clamp11(F.try_element_at("gold", F.lit("china_stance_score"))).alias("s")), "s")
    same = SC.constant_gold(gold.select(F.lit("no").alias("s")), "s").first()["constant"]
    return values.select(F.lit(fmt).alias("format"), F.lit(missing).cast("bigint").alias("n_missing"), "n_values", "constant",
                         F.lit(same).alias("same_constant"))


@register("jsonl_parts", """
SELECT doc_id, CASE WHEN doc_id % 7 IN (1, 2, 3) THEN NULL ELSE quality END AS quality, doc_id % 7 IN (1, 2, 3) AS bad,
       CASE WHEN doc_id % 7 IN (1, 2, 3) THEN row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) END AS line_no
FROM labels""")
def q_jsonl_parts(spark, sf):
    """JSON lines with cut lines, trailing text and two objects in a line; bad lines are kept apart, with file and line number."""
    path = _fresh(spark, "jsonl")
    good = F.format_string('{"doc_id":%d,"quality":%d,"tags":["a]","}"]}', "doc_id", "quality")
    k = F.col("doc_id") % 7
    line = (F.when(k == 1, F.concat(good, F.lit(" garbage"))).when(k == 2, F.concat(good, good))
            .when(k == 3, F.substring(good, 1, 18)).otherwise(good))
    rows = S.table(spark, sf, "labels").withColumn("file", F.col("doc_id") % 3)
    rows = rows.repartition("file").sortWithinPartitions("file", "doc_id")       # a file's lines in the order of the ids
    rows.select(line.alias("value"), "file").write.partitionBy("file").text(path)
    rows, bad = IO.read_jsonl_parts(spark, path)
    left = bad.select(F.regexp_extract("line", '^."doc_id":([0-9]+)', 1).cast("long").alias("doc_id"),
                      F.lit(None).cast("long").alias("quality"), F.lit(True).alias("bad"), F.col("line_no").cast("long"))
    return rows.select("doc_id", "quality", F.lit(False).alias("bad"), F.lit(None).cast("long").alias("line_no")).unionByName(left)


@register("csv_parts", """
SELECT doc_id, CASE WHEN doc_id % 11 = 4 THEN NULL ELSE quality END AS quality, doc_id % 11 = 4 AS bad FROM labels""")
def q_csv_parts(spark, sf):
    """Rows with too many fields are found wherever they stand and kept apart."""
    path = _fresh(spark, "csv")
    line = F.concat_ws(",", "doc_id", "quality", F.when(F.col("doc_id") % 11 == 4, F.lit("more")))
    S.table(spark, sf, "labels").select(line.alias("value")).write.text(path)
    rows, bad = IO.read_csv_parts(spark, path, infer=True, names=["doc_id", "quality"])
    left = bad.select(F.split("line", ",")[0].cast("long").alias("doc_id"), F.lit(None).cast("long").alias("quality"),
                      F.lit(True).alias("bad"))
    return rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("long"), F.lit(False).alias("bad")).unionByName(left)


@register("stream_merge", with_views(["grouped_expect"], """
SELECT meta_id, has_content AS complete, CASE WHEN has_content THEN 'china,content' ELSE 'china' END AS groups_present,
       CASE WHEN has_content THEN '' ELSE 'content' END AS missing_groups, related, sensitive, collective, hate
FROM grouped_expect"""))
def q_stream_merge(spark, sf):
    """ST3: answers per group merged by a stateful stream; complete items as they complete, partial ones on time-out,
    corrections for later answers. The feed is closed after the last answer."""
    base = _fresh(spark, "merge")
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    rows = PA.parse_predictions(S.d_grouped(spark, sf), first_pass="scan", group_mode="binary").select(
        "original_meta_id", "group_id", "idx", "parsed", "json", start.alias("arrived"))
    rows.write.parquet(f"{base}/landing")
    close = spark.createDataFrame([(None,) * 5], "original_meta_id string, group_id string, idx long, parsed boolean, json map<string,string>")
    close.select("*", F.timestamp_seconds(F.lit(1_700_100_000)).alias("arrived")).write.mode("append").parquet(f"{base}/landing")
    landed = spark.readStream.schema(rows.schema).parquet(f"{base}/landing")
    merged = ST.merge_stream(landed, group_mode="binary")
    (merged.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
     .trigger(availableNow=True).start().awaitTermination())
    g = lambda k: F.try_element_at("json", F.lit(k))
    return ST.latest_merged(spark.read.schema(ST.MERGE_OUT).parquet(f"{base}/out")).select(
        "meta_id", "complete", F.array_join("groups_present", ",").alias("groups_present"),
        F.array_join("missing_groups", ",").alias("missing_groups"), g("china_related").alias("related"),
        g("china_sensitive").alias("sensitive"), g("collective_action").alias("collective"), g("hate_speech").alias("hate"))


@register("stream_watch", """
SELECT rule, CAST(poll AS INTEGER) AS poll, CAST(CASE WHEN poll = 1 THEN n ELSE 2 * n END AS BIGINT) AS landed,
       CAST(unchanged AS INTEGER) AS unchanged, reason
FROM (SELECT count(*) AS n FROM labels), (VALUES
  ('expected', 1, 0, NULL), ('expected', 2, 0, 'expected'),
  ('idle', 1, 0, NULL), ('idle', 2, 0, NULL), ('idle', 3, 1, NULL), ('idle', 4, 2, 'idle')) t(rule, poll, unchanged, reason)""")
def q_stream_watch(spark, sf):
    """ST1: a watch that ends when all answers have landed, and one that ends when two polls in a row bring none;
    the second model's answers land between the first two polls."""
    n = S.table(spark, sf, "labels").count()
    raw = S.d_raw(spark, sf)
    out = []
    for rule, expected in (("expected", 2 * n), ("idle", 2 * n + 1)):
        base = _fresh(spark, "watch")
        raw.filter(F.col("model") == MODELS[0]).write.json(f"{base}/landing")

        def land(_seconds, base=base, done=[]):  # noqa: B006
            if base not in done:
                done.append(base)
                raw.filter(F.col("model") == MODELS[1]).write.mode("append").json(f"{base}/landing")

        polls = ST.watch(lambda base=base: ST.raw_stream(spark, f"{base}/landing"), f"{base}/watch", expected, idle_polls=2, sleep=land)
        out.append(polls.select(F.lit(rule).alias("rule"), "poll", "landed", "unchanged", "reason"))
    return out[0].unionByName(out[1])


@register("stream_progress", """
SELECT CAST(2 * count(*) AS BIGINT) AS landed, CAST(4 * count(*) AS BIGINT) AS expected, 50.0::DOUBLE AS progress_pct, false AS done
FROM labels""")
def q_stream_progress(spark, sf):
    """ST1: landed against expected answers, as a running aggregate over a stream; the last state."""
    base = _fresh(spark, "progress")
    S.d_raw(spark, sf).repartition(4).write.json(f"{base}/landing")
    expected = 4 * S.table(spark, sf, "labels").count()
    seen = ST.progress_query(ST.raw_stream(spark, f"{base}/landing", max_files_per_trigger=1), expected)

    def keep(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    (seen.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/ckpt")
     .trigger(availableNow=True).start().awaitTermination())
    out = spark.read.parquet(f"{base}/out")
    return out.agg(F.max_by(F.struct("landed", "expected", "progress_pct", "done"), "batch_id").alias("r")).select(
        "r.landed", F.col("r.expected").cast("bigint").alias("expected"), "r.progress_pct", "r.done")


from labelweave.plans import feature_queries  # noqa: E402, F401  (registers)
