"""Registered queries over features that span files, records and parsing (see ``plans.queries``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelweave.codebook import BINARY, LABEL_LIST, NUMERIC_01, Codebook, Dimension, default_codebook
from labelweave.operators import content as CT
from labelweave.operators import merge as MG
from labelweave.operators import parse as PA
from labelweave.operators import records as RC
from labelweave.operators import scoring as SC
from labelweave.operators import summary as SM
from labelweave.operators import usage as US
from labelweave.plans import prompt_texts as PT
from labelweave.plans import queries as Q
from labelweave.plans.catalog import register
from labelweave.plans.oracle_views import with_views
from labelweave.session import checkpoint_dir
from labelweave.sources import files as IO
from labelweave.sources import standins as S


def _fresh(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- records: images, two outputs, skip ---------------------------------------------------------

_FRAMES = [10, 2]       # frame numbers in file order; the order of a record is numeric
_FRAME_TASKS_PER_CORE = 4


def _url_sql(n: int) -> str:
    return f"'data:image/jpeg;base64,' || base64(encode('frame {n} of ' || coalesce(d.source, '-') || chr(10)))"


@register("records_multimodal", with_views(["d_labels"], f"""
SELECT lpad(CAST(l.doc_id AS VARCHAR), 12, '0') AS meta_id,
       CASE WHEN l.doc_id % 3 = 0 THEN 'string,string,string' ELSE 'string,list,string' END AS kinds,
       CASE WHEN l.doc_id % 3 = 0 THEN 0 ELSE 2 END AS n_images,
       md5(CASE WHEN l.doc_id % 3 = 0 THEN '' ELSE {_url_sql(2)} || ' ' || {_url_sql(10)} END) AS urls_md5,
       md5({Q._sql_user_text('d.text', 'd.source')}) AS user_md5,
       CASE WHEN l.doc_id % 3 = 0 THEN 3 ELSE 5 END AS forced_parts
FROM d_labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.china_stance_score IS NOT NULL"""))
def q_records_multimodal(spark, sf):
    """S2, S11, P21, P22, P33, P41, JN4: frames read as binary files, put into the user message as image parts, records written
    as JSON lines whose content is a string or a list, read back, and forced to lists."""
    base = _fresh(spark, "frames")
    docs = S.table(spark, sf, "labels").select("doc_id").join(S.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    frames = docs.filter("doc_id % 3 <> 0").select(
        S.pad_id(F.col("doc_id")).alias("item"), F.explode(F.array(*map(F.lit, _FRAMES))).alias("frame"),
        F.coalesce("source", F.lit("-")).alias("source"))
    # a file per frame: the rows are few bytes and would be left to one task unless their number of tasks is given
    IO.write_small_files(
        frames.select("item", "frame", F.concat(F.lit("frame "), "frame", F.lit(" of "), "source").alias("value")),
        f"{base}/frames", ["item", "frame"], _FRAME_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    found = RC.read_frames(spark, f"{base}/frames", "part-*", r"/item=([^/]+)/", r"/frame=([0-9]+)/")
    CT.write_records(RC.build_records(S.d_items(spark, sf), frames=found), f"{base}/records.jsonl")
    back, _ = CT.read_records(spark, f"{base}/records.jsonl")
    forced = CT.force_parts(back).select("meta_id", F.aggregate(
        "messages", F.lit(0), lambda n, m: n + F.size(m["parts"])).alias("forced_parts"))
    m = F.col("messages")
    urls = F.filter(F.transform(F.coalesce(m[1]["parts"], F.array()), lambda p: p["image_url"]["url"]), lambda u: u.isNotNull())
    return back.select(
        "meta_id", F.array_join(F.transform(m, lambda x: F.when(x["parts"].isNotNull(), "list").when(
            x["content"].isNotNull(), "string").otherwise("null")), ",").alias("kinds"),
        F.size(urls).alias("n_images"), F.md5(F.array_join(urls, " ")).alias("urls_md5"),
        F.md5(CT.user_text(m)).alias("user_md5")).join(forced, "meta_id")


def _both_sql() -> str:
    cb = default_codebook()
    source = {d.key: d.source_column for d in cb.dimensions}

    def gold(keys):
        pairs = [f"'\"{k}\":\"' || {Q._sql_strip('g.' + source[k])} || '\"'" for k in cb.gold_keys() if k in keys]
        return "'{' || " + " || ',' || ".join(pairs) + " || '}'"

    rows = [f"SELECT 'grouped' AS kind, g.meta_id || '__group_{g.group_id}' AS meta_id, '{g.group_id}' AS group_id, "
            f"{gold(g.dims)} AS gold_json, md5('{PT.BY_CATEGORY[g.group_id].replace(chr(39), chr(39) * 2)}') AS system_md5 FROM comp_gold g"
            for g in cb.group_configs("by-category")]
    rows.append(f"SELECT 'merged', g.meta_id, NULL, {gold(cb.keys)}, NULL FROM comp_gold g")
    return with_views(["comp_gold"], "\nUNION ALL\n".join(rows))


@register("records_both", _both_sql())
def q_records_both(spark, sf):
    """Grouped and ungrouped records of one pass over the source, written by kind as JSON lines and read back."""
    path = _fresh(spark, "both")
    RC.write_both(RC.build_records(S.d_comp_items(spark, sf), comprehensive=True, group_mode="by-category", with_merged=True), path)
    out = []
    for kind in ("grouped", "merged"):
        rows, _ = CT.read_records(spark, f"{path}/kind={kind}")
        system = F.md5(F.col("messages")[0]["content"]) if kind == "grouped" else F.lit(None).cast("string")
        out.append(rows.select(F.lit(kind).alias("kind"), "meta_id", "group_id", F.col("messages")[2]["content"].alias("gold_json"),
                               system.alias("system_md5")))
    return out[0].unionByName(out[1])


@register("records_skip", """
SELECT pos, doc_id FROM (
  SELECT *, row_number() OVER (ORDER BY pos NULLS FIRST, '{' || coalesce('"pos":' || pos || ',', '') || '"doc_id":' || doc_id || '}') AS r,
         count(*) OVER () AS n
  FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 97 END AS pos, doc_id FROM documents)) WHERE r > n // 2""")
def q_records_skip(spark, sf):
    """The second half of the rows by position; a third of the rows have none, many share one."""
    d = F.col("doc_id")
    rows = S.table(spark, sf, "documents").select(F.when(d % 3 == 0, F.lit(None)).otherwise(d % 97).alias("pos"), "doc_id")
    return RC.skip_limit(rows, skip=rows.count() // 2, pos_col="pos")


@register("prompt_vision", f"""
SELECT lpad(CAST(l.doc_id AS VARCHAR), 12, '0') || '__group_hate_speech' AS meta_id, '{Q._md5(PT.HATE_NUMERIC_VISION)}' AS system_md5
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def q_prompt_vision(spark, sf):
    """The numeric prompt of a one-dimension group with frames; optional label columns are absent."""
    none = spark.createDataFrame([], "item_id string, n int, content binary")
    items = S.d_comp_items(spark, sf).drop("stance_gov", "stance_culture", "stance_tech", "sensitive")
    recs = RC.build_records(items, comprehensive=True, group_mode="per-item", numeric=True, frames=none)
    return recs.filter("group_id = 'hate_speech'").select("meta_id", F.md5(F.col("messages")[0]["content"]).alias("system_md5"))


# --- scoring ------------------------------------------------------------------------------------

_LONG = 400

_LONG_PAIRS = Q._STD_PAIRS.replace("FROM std_gold g", f"""FROM (
    SELECT g.* FROM std_gold g JOIN documents d ON g.meta_id = lpad(CAST(d.doc_id AS VARCHAR), 12, '0')
    WHERE length({Q._sql_user_text('d.text', 'd.source')}) >= {_LONG}) g""")


@register("score_long_texts", with_views(["std_gold", "parse_expect"], "WITH " + _LONG_PAIRS + """,
wide AS (SELECT model, """ + ",\n".join(f"{e} AS {k}" for k, e in Q._STD_METRIC_SQL.items()) + """
         FROM std_pairs GROUP BY model)
""" + Q._sql_long("wide", SC.STANDARD_F1_METRICS)))
def q_score_long_texts(spark, sf):
    """P11 before A12: records whose user text is too short go before scoring."""
    gold = SC.gold_table(RC.build_records(S.d_items(spark, sf)), min_text_len=_LONG)
    s = SC.score_standard(gold, Q._parsed(spark, sf), Q.MODELS)
    return s.select("model", "metric", Q.rnd(F.col("score")).alias("score"), F.col("metric_pos").cast("int"))


def _wide_sql() -> str:
    yn = lambda x: f"CASE WHEN lower(trim({x})) IN ('yes', 'no', 'cannot_determine') THEN lower(trim({x})) ELSE 'invalid' END"
    st = lambda x: (f"CASE WHEN lower(trim({x})) IN ('pro', 'anti', 'neutral', 'neutral/unclear') "  # noqa: E731
                    f"THEN lower(trim({x})) ELSE '' END")
    fields = [("china_related", "g.china_related", "e.related", yn), ("stance_gov", "g.stance_gov", "e.gov", st),
              ("stance_culture", "g.stance_culture", "'pro'", st), ("stance_tech", "g.stance_tech", "'anti'", st),
              ("sensitive", "g.sensitive", "e.sensitive", yn), ("collective", "g.collective_action", "e.collective", yn),
              ("hate", "g.hate_speech", "e.hate", yn), ("harmful", "g.harmful", "CASE WHEN e.has_content THEN 'no' END", yn),
              ("news", "g.news", "CASE WHEN e.has_content THEN 'no' END", yn),
              ("inauthentic", "g.inauthentic", "CASE WHEN e.has_content THEN 'no' END", yn),
              ("derivative", "g.derivative", "CASE WHEN e.has_content THEN 'no' END", yn)]
    cols = ",\n".join(f"{f(p)} AS m_alpha_{n}, {f(g)} AS human_{n}" for n, g, p, f in fields)
    return with_views(["comp_gold", "grouped_expect"], f"""
SELECT g.meta_id, {cols}, md5({Q._sql_user_text('d.text', 'd.source')}) AS transcript_md5
FROM comp_gold g JOIN documents d ON d.doc_id = g.doc_id JOIN grouped_expect e ON e.meta_id = g.meta_id""")


@register("compare_comprehensive", _wide_sql())
def q_compare_comprehensive(spark, sf):
    """JN2: the wide side-by-side table of the 11 dimensions."""
    recs = RC.build_records(S.d_comp_items(spark, sf), comprehensive=True)
    gold = recs.select("meta_id", RC.gold_of(F.col("messages")).alias("gold"), RC.record_user_text(F.col("messages")).alias("transcript"))
    preds = Q._merged(spark, sf).withColumn("model", F.lit("m_alpha"))
    wide = SM.compare_wide(gold, preds, ["m_alpha"], fields=SM.COMPREHENSIVE_FIELDS)
    return wide.withColumn("transcript_md5", F.md5("transcript")).drop("transcript")


# --- parsing: numeric groups, label lists, malformed keys ----------------------------------------

@register("parse_numeric_groups", """
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS meta_id, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS parsed,
       CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 <> 0 THEN CAST((doc_id * 37) % 201 - 100 AS DOUBLE) / 100 END AS gov
FROM labels""")
def q_parse_numeric_groups(spark, sf):
    """Answers of a group in numbers; values outside their range, or a missing key, quarantine the answer."""
    d = F.col("doc_id")
    gov = F.when(d % 4 == 0, F.lit(1.5)).otherwise(S.stance_int(d).cast("double") / 100)
    rest = F.when(d % 5 == 0, F.lit('"china_sensitive":0.2}')).otherwise(F.lit('"china_sensitive":0.2,"collective_action":1}'))
    raw = S.table(spark, sf, "labels").select(
        d.alias("idx"), F.concat(S.pad_id(d), F.lit("__group_china")).alias("meta_id"),
        F.concat(F.lit('{"china_related":1,"china_ccp_government":'), gov.cast("string"),
                 F.lit(',"china_people_culture":-1,"china_technology_development":0,'), rest).alias("raw"))
    p = PA.parse_predictions(raw, group_mode="binary", numeric=True)
    return p.select(F.col("original_meta_id").alias("meta_id"), "parsed",
                    F.try_element_at("json", F.lit("china_ccp_government")).try_cast("double").alias("gov"))


_LANGUAGES = ("english", "mandarin", "spanish", "other", "no_language")


def _list_codebook() -> Codebook:
    dims = [Dimension("languages", "Languages", "Languages heard in the item.", LABEL_LIST, LABEL_LIST, "languages",
                      allowed=_LANGUAGES, exclusive="no_language"),
            Dimension("on_topic", "On topic", "Whether the item is on topic.", BINARY, NUMERIC_01, "on_topic")]
    return Codebook(dimensions=dims, groups={}, aliases={"langs": "languages"})


@register("parse_label_lists", """
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS meta_id, doc_id % 7 < 3 AS parsed,
       CASE doc_id % 7 WHEN 0 THEN 'english' WHEN 1 THEN 'english,spanish' WHEN 2 THEN 'no_language' END AS languages
FROM labels""")
def q_parse_label_lists(spark, sf):
    """A dimension whose value is a list: allowed values, none empty, the exclusive value alone."""
    d = F.col("doc_id")
    lists = ['["english"]', '["english","spanish"]', '["no_language"]', '["no_language","english"]', "[]", '["klingon"]', '"english"']
    raw = S.table(spark, sf, "labels").select(
        d.alias("idx"), S.pad_id(d).alias("meta_id"), F.concat(
            F.lit('{"on_topic":"yes","langs":'), F.element_at(F.array(*map(F.lit, lists)), (d % 7 + 1).cast("int")), F.lit("}")).alias("raw"))
    p = PA.parse_predictions(raw, _list_codebook())
    found = F.from_json(F.try_element_at("json", F.lit("languages")), "array<string>")
    return p.select("meta_id", "parsed", F.array_join(found, ",").alias("languages"))


@register("parse_malformed_keys", """
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS meta_id, true AS parsed,
       CASE WHEN doc_id % 5 = 3 THEN CAST(doc_id % 2 AS VARCHAR) END AS hate,
       CASE WHEN doc_id % 5 IN (1, 4) THEN '0' END AS inauthentic,
       CASE WHEN doc_id % 5 = 2 THEN CAST(doc_id % 2 AS VARCHAR) END AS news, 'no' AS harmful
FROM labels""")
def q_parse_malformed_keys(spark, sf):
    """A value inside the key's quotes, missing quotes, short names and zeros glued to a key. A short name in quotes
    that is no known spelling (class 0) is dropped like any unknown key."""
    d = F.col("doc_id")
    v = (d % 2).cast("string")
    L = F.lit
    tail = L('"harmful_content":"no"}')
    raw = (F.when(d % 5 == 0, F.concat(L('{"hate:'), v, L('",'), tail))
           .when(d % 5 == 1, F.concat(L('{"inauthentic:0,'), tail))
           .when(d % 5 == 2, F.concat(L('{"news:'), v, L('",'), tail))
           .when(d % 5 == 3, F.concat(L('{hate:'), v, L(','), tail))
           .otherwise(F.concat(L('{"inauthentic:0,"'), F.substring(tail, 2, 99))))
    p = PA.parse_predictions(S.table(spark, sf, "labels").select(d.alias("idx"), S.pad_id(d).alias("meta_id"), raw.alias("raw")))
    g = lambda k: F.try_element_at("json", F.lit(k))
    return p.select("meta_id", "parsed", g("hate_speech").alias("hate"), g("inauthentic_content").alias("inauthentic"),
                    g("news_segments").alias("news"), g("harmful_content").alias("harmful"))


# --- files ---------------------------------------------------------------------------------------

@register("csv_round_trip", """
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, md5(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')) AS text_md5,
       coalesce(lang, '') AS lang
FROM documents""")
def q_csv_round_trip(spark, sf):
    """Texts with quotes and line breaks written as CSV with every field quoted, and read back."""
    path = f"{_fresh(spark, 'csv')}.csv"
    rows = S.table(spark, sf, "documents").select(
        S.pad_id(F.col("doc_id")).alias(" ID "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n").alias("text"),
        F.coalesce("lang", F.lit("")).alias("lang"))
    IO.write_table(rows, path)
    back = IO.load_table(spark, path)
    return back.select("id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.coalesce("lang", F.lit("")).alias("lang"))


@register("csv_sniffed", """
SELECT doc_id, CAST(quality AS DOUBLE) AS sensitive, CAST(toxic AS DOUBLE) AS pol FROM labels""")
def q_csv_sniffed(spark, sf):
    """A label file with another delimiter is found out by its missing columns and read again."""
    path = _fresh(spark, "labels")
    rows = S.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("video"), F.col("toxic").alias("pol"),
                                               F.col("quality").alias("sensitive"))
    rows.write.option("header", True).option("sep", ";").csv(path)
    found = IO.read_label_csv(spark, path)
    return found.select(F.col("video").cast("long").alias("doc_id"), F.col("sensitive").cast("double").alias("sensitive"),
                        F.col("pol").cast("double").alias("pol"))


@register("merged_files", with_views(["grouped_expect"], """
SELECT 'table' AS output, g.meta_id AS id, e.sensitive AS sensitive, e.has_content AS complete
FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS meta_id FROM labels WHERE doc_id % 2 = 0) g JOIN grouped_expect e USING (meta_id)
UNION ALL SELECT 'kept', meta_id, sensitive, has_content FROM grouped_expect"""))
def q_merged_files(spark, sf):
    """S10, A15, JN3: merged records joined to an original table as CSV, and the merged JSON lines kept beside it."""
    base = _fresh(spark, "merged")
    original = S.table(spark, sf, "labels").filter("doc_id % 2 = 0").select(S.pad_id(F.col("doc_id")).alias("id"), F.lit("x").alias("note"))
    paths = MG.write_merged(Q._merged(spark, sf), f"{base}/joined.csv", original)
    table = IO.load_table(spark, paths[0])
    kept = IO.read_jsonl(spark, paths[1], IO.MERGED_SCHEMA)
    known = kept.select("meta_id", "complete")
    one = table.join(known, table["id"] == known["meta_id"]).select(
        F.lit("table").alias("output"), "id", F.col("pred_china_sensitive").alias("sensitive"), "complete")
    return one.unionByName(kept.select(F.lit("kept").alias("output"), F.col("meta_id").alias("id"),
                                       F.try_element_at("json", F.lit("china_sensitive")).alias("sensitive"), "complete"))


# --- sanitised records, thresholds, tokenizers, score files ----------------------------------------

@register("records_sanitised", """
SELECT CASE WHEN conv_id % 4 = 3 THEN 'flat' ELSE 'chat' END AS kind, CASE WHEN conv_id % 4 <> 3 THEN n END AS n_messages,
       CASE WHEN conv_id % 4 = 3 THEN 'p' || conv_id END AS prompt, CASE WHEN conv_id % 4 = 3 THEN 'c' || conv_id END AS completion,
       'messages,prompt,completion' AS kept
FROM (SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id)""")
def q_records_sanitised(spark, sf):
    """Rows with messages keep only these, other rows their prompt and completion; every other field goes."""
    flat = F.col("meta_id").cast("long") % 4 == 3
    rows = S.d_records(spark, sf).select(
        "meta_id", F.when(~flat, F.col("messages")).alias("messages"), F.when(flat, F.concat(F.lit("p"), "meta_id")).alias("prompt"),
        F.concat(F.lit("c"), "meta_id").alias("completion"), F.lit("x").alias("note"))
    kept = RC.sanitize_records(rows)
    return kept.select(F.when(F.col("messages").isNull(), "flat").otherwise("chat").alias("kind"),
                       F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n_messages"), "prompt", "completion",
                       F.lit(",".join(kept.columns)).alias("kept"))


@register("records_stripped", with_views(["d_labels"], """
SELECT 3 AS n_messages, CAST(count(*) AS BIGINT) AS n, 'messages' AS columns
FROM d_labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.china_stance_score IS NOT NULL"""))
def q_records_stripped(spark, sf):
    """Records without any key but their messages."""
    r = RC.build_records(S.d_items(spark, sf), strip_meta_id=True)
    return r.groupBy(F.size("messages").alias("n_messages")).agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(",".join(r.columns)))


@register("labels_by_threshold", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END
                    WHEN (doc_id % 100) / 100.0 >= 0.4 THEN 'yes' ELSE 'no' END AS by_score,
       CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS by_label,
       CASE WHEN doc_id % 4 = 0 THEN (doc_id % 100) / 100.0::DOUBLE WHEN doc_id % 4 = 1 THEN (doc_id % 100) / 100.0::DOUBLE
            WHEN doc_id % 4 = 2 THEN (doc_id % 100) / 100.0::DOUBLE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END AS number
FROM labels""")
def q_labels_by_threshold(spark, sf):
    """A score beside the label decides by the threshold; without one the label stands."""
    d = F.col("doc_id")
    score = (F.when(d % 4 == 0, ((d % 100) / 100).cast("string")).when(d % 4 == 1, F.format_string("%.4f", (d % 100) / 100))
             .when(d % 4 == 2, ((d % 100) / 100).cast("string")))
    m = F.map_filter(F.create_map(F.lit("china_sensitive"), F.when(F.col("toxic") == 1, "Yes").otherwise(" no"), F.lit("china_sensitive_score"), score),
                     lambda k, v: v.isNotNull())
    rows = S.table(spark, sf, "labels").select("doc_id", m.alias("m"))
    return rows.select("doc_id", SC.derive_label(F.col("m"), "china_sensitive", 0.4).alias("by_score"),
                       SC.derive_label(F.col("m"), "china_sensitive").alias("by_label"),
                       SC.numeric_from_pred(F.col("m"), "china_sensitive", SC.CD_MAP_DEFAULT).alias("number"))


@register("tokens_by_tokenizer", """
SELECT conv_id, CAST(sum(len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> ''))) AS BIGINT) AS tokens
FROM conversations GROUP BY conv_id""")
def q_tokens_by_tokenizer(spark, sf):
    """Tokens per conversation by a tokenizer that the caller plugs in (here: blanks)."""
    tok = US.tokenizer_udf(lambda t: sum(1 for w in t.split(" ") if w))
    rows = S.table(spark, sf, "conversations").select("conv_id", tok("text").alias("n"))
    return rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("tokens"))


@register("score_csv", with_views(["std_gold", "parse_expect"], "WITH " + Q._STD_PAIRS + """,
wide AS (SELECT model, """ + ",\n".join(f"{e} AS {k}" for k, e in Q._STD_METRIC_SQL.items()) + """
         FROM std_pairs GROUP BY model)
""" + Q._sql_long("wide", SC.STANDARD_F1_METRICS)))
def q_score_csv(spark, sf):
    """The long scorecard written as CSV with a header and read back."""
    s = SC.score_standard(Q._val_gold(spark, sf), Q._parsed(spark, sf), Q.MODELS)
    path = _fresh(spark, "scores")
    IO.write_csv(s, path)
    back = IO.read_csv(spark, path, infer=True)
    return back.select("model", "metric", Q.rnd(F.col("score").cast("double")).alias("score"), F.col("metric_pos").cast("int"))


@register("compare_by_position", Q._compare_sql().replace("g.meta_id AS meta_id", "CAST(g.meta_id AS BIGINT) AS idx", 1))
def q_compare_by_position(spark, sf):
    """JN2 by file position instead of id."""
    gold = Q._compare_gold(spark, sf).withColumn("idx", F.col("meta_id").cast("long"))
    return SM.compare_wide(gold, Q._parsed(spark, sf), Q.MODELS, key="idx")


@register("merge_two_models", with_views(["grouped_expect"], """
SELECT 'm_alpha' AS model, meta_id, has_content AS complete, related, collective FROM grouped_expect
UNION ALL
SELECT 'm_beta', e.meta_id, false, e.related, CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END
FROM grouped_expect e JOIN labels l USING (doc_id)"""))
def q_merge_two_models(spark, sf):
    """Answers of two models in one table are merged on their own; the second has no content group."""
    rows = S.d_grouped(spark, sf)
    beta = rows.filter(F.col("meta_id").endswith("__group_china")).withColumn("model", F.lit("m_beta"))
    merged = MG.merge_groups(PA.parse_predictions(rows.unionByName(beta), group_mode="binary"), group_mode="binary")
    g = lambda k: F.try_element_at("json", F.lit(k))
    return merged.select("model", "meta_id", "complete", g("china_related").alias("related"), g("collective_action").alias("collective"))
