"""Reference-shaped inputs derived from the driver tables (FIXTURES.md part B/C).

The reference reads coder-label CSVs, source tables, chat records, raw model
answers and usage logs. The driver ships ``labels``, ``documents`` and
``conversations`` instead; these functions derive the reference shapes from
them with plain DataFrame expressions, so every query's work grows with the
tables. ``labelweave.plans.oracle_views`` holds the same definitions in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

MODELS = (("m_alpha", 7919, 15), ("m_beta", 104729, 30))   # name, prime, flip percent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pad_id(doc_id: Column) -> Column:
    return F.lpad(doc_id.cast("string"), 12, "0")


def stance_int(doc_id: Column) -> Column:
    return (doc_id * 37) % 201 - 100


def d_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 coder-label table: video path, stance, two yes/no means, languages."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    d = lab.join(doc, "doc_id", "left")
    k = stance_int(F.col("doc_id"))
    lang = F.coalesce(F.col("lang"), F.lit(""))
    return d.select(
        F.col("doc_id"),
        F.concat(F.lit("v/"), pad_id(F.col("doc_id")), F.lit(".mp4")).alias("video"),
        F.when(F.col("doc_id") % 29 == 0, F.lit(None).cast("double"))
         .otherwise(k.cast("double") / 100).alias("china_stance_score"),
        F.col("toxic").cast("double").alias("sensitive"),
        F.col("quality").cast("double").alias("collective_action"),
        (lang == "en").cast("double").alias("english"),
        (lang == "zh").cast("double").alias("mandarin"),
        (lang == "es").cast("double").alias("spanish"),
        (~lang.isin("en", "zh", "es")).cast("double").alias("other_lang"),
        (F.coalesce(F.col("n_chars"), F.lit(0)) < 100).cast("double").alias("no_language"),
    )


def d_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 standard source table: id, stance, sensitive, collective, transcript, description."""
    lab = d_labels(spark, sf_dir).select("doc_id", "china_stance_score", "sensitive", "collective_action")
    doc = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lab.join(doc, "doc_id").select(
        pad_id(F.col("doc_id")).alias("id"), "china_stance_score", "sensitive", "collective_action",
        F.col("text").alias("transcript"), F.col("source").alias("description"))


def _case(c: Column, pairs, default: str) -> Column:
    e = None
    for cond, val in pairs:
        e = F.when(cond, F.lit(val)) if e is None else e.when(cond, F.lit(val))
    return e.otherwise(F.lit(default))


def comp_gold_columns(doc_id: Column, toxic: Column, quality: Column, lang: Column) -> list[Column]:
    """A3 comprehensive label columns (source-column names)."""
    return [
        _case(doc_id, [(doc_id % 4 == 0, "no")], "yes").alias("china_related"),
        _case(doc_id, [(doc_id % 3 == 0, "pro"), (doc_id % 3 == 1, "anti")], "neutral/unclear").alias("stance_gov"),
        _case(doc_id, [(doc_id % 9 < 3, "pro"), (doc_id % 9 < 6, "anti")], "neutral").alias("stance_culture"),
        _case(doc_id, [(doc_id % 5 == 0, "anti"), (doc_id % 5 == 1, "pro")], "Neutral/Unclear").alias("stance_tech"),
        _case(toxic, [(toxic == 1, "yes")], "no").alias("sensitive"),
        _case(quality, [(quality == 1, "yes")], "no").alias("collective_action"),
        _case(doc_id, [(doc_id % 6 == 0, "yes")], "no").alias("hate_speech"),
        _case(doc_id, [(doc_id % 7 == 0, "yes"), (doc_id % 7 == 1, "cannot_determine")], "no").alias("harmful"),
        _case(lang, [(lang == "en", "yes")], "no").alias("news"),
        _case(doc_id, [(doc_id % 10 == 3, "yes")], "no").alias("inauthentic"),
        _case(doc_id, [(doc_id % 8 == 5, "yes")], "no").alias("derivative"),
    ]


def d_comp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 comprehensive source table (string labels) with text columns."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    d = lab.join(doc, "doc_id")
    return d.select(pad_id(F.col("doc_id")).alias("id"),
                    *comp_gold_columns(F.col("doc_id"), F.col("toxic"), F.col("quality"), F.col("lang")),
                    F.col("text").alias("transcript"), F.col("source").alias("description"))


def d_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 chat records: one per conversation, messages ordered by turn."""
    conv = table(spark, sf_dir, "conversations")
    g = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn"), F.col("role"), F.col("text").alias("content")))).alias("m"))
    return g.select(F.col("conv_id").cast("string").alias("meta_id"),
                    F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                        x["content"].alias("content"))).alias("messages"))


def _answer_parts(doc_id: Column, toxic: Column, quality: Column, prime: int, pct: int):
    flip = (doc_id * prime) % 100 < pct
    k = stance_int(doc_id)
    km = F.when(flip, -k).otherwise(k)
    s = (km.cast("double") / 100).cast("string")
    y = F.when((toxic == 1) != flip, F.lit("yes")).otherwise(F.lit("no"))
    c = F.when((quality == 1) != flip, F.lit("yes")).otherwise(F.lit("no"))
    yn = F.when(y == "yes", F.lit("1")).otherwise(F.lit("0"))
    cn = F.when(c == "yes", F.lit("1")).otherwise(F.lit("0"))
    return flip, s, y, c, yn, cn


def raw_answer(doc_id: Column, toxic: Column, quality: Column, prime: int, pct: int) -> Column:
    """FIXTURES part C: one synthetic answer, corruption class doc_id % 15."""
    _, s, y, c, yn, cn = _answer_parts(doc_id, toxic, quality, prime, pct)
    L = F.lit
    obj = F.concat(L('{"china_stance_score":'), s, L(',"china_sensitive":"'), y,
                   L('","collective_action":"'), c, L('"}'))
    cls = doc_id % 15
    full = F.concat(L('{"china_related":"no","china_ccp_government":"Unclear",'
                      '"china_people_culture":"Unclear","china_technology_development":"Unclear",'
                      '"china_sensitive":"'), y, L('","collective_action":"'), c,
                    L('","hate_speech":"no","harmful_content":"no","news_segments":"no",'
                      '"inauthentic_content":"no","derivative_content":"cannot_determine"}'))
    junk = (F.when((F.floor(doc_id / 15) % 3) == 0, L(""))
            .when((F.floor(doc_id / 15) % 3) == 1, L("I cannot label this item."))
            .otherwise(L("<<REQUEST FAILED: timeout>>")))
    return (F.when(cls == 0, obj)
            .when(cls == 1, F.concat(L("```json\n"), obj, L("\n```")))
            .when(cls == 2, F.concat(L("Here is my assessment of the item.\n"), obj))
            .when(cls == 3, F.concat(L('{"draft":1} Revised answer follows. '), obj))
            .when(cls == 4, F.concat(L('{"china_stance_score":'), s, L(',"china_sensitive":"'), y,
                                     L('","collective_action":"'), c, L('",}')))
            .when(cls == 5, F.concat(L('{"china_stance_score":'), s, L('.0,"china_sensitive":"'), y,
                                     L('","collective_action":"'), c, L('"}')))
            .when(cls == 6, F.concat(L('{"china_sensitive":"'), y, L('","china_stance_score":'), s))
            .when(cls == 7, F.concat(L('{"china_sensitive":"'), y, L('","china_stance_score":'), s, L(",")))
            .when(cls == 8, F.concat(L('{"china_stance":'), s, L(',"china_sensitive":"'), y,
                                     L('","collective_action":"'), c, L('"}')))
            .when(cls == 9, F.concat(L('{"china_stance_score":'), s, L(',"china_sensitive":"'), y,
                                     L('","collective?":"'), c, L('","mood":"calm"}')))
            .when(cls == 10, F.concat(s, L(" "), yn, L(" "), cn, L(" 0 0 0 0")))
            .when(cls == 11, full)
            .when(cls == 12, F.concat(L('{"china_stance_score":'), s, L(',"china_sensitive":"maybe",'
                                                                         '"collective_action":"'), c, L('"}')))
            .when(cls == 13, junk)
            .otherwise(F.concat(L("Thinking {not sure yet. Final answer: "), obj)))


def d_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 raw predictions of two models (one answer per label row each).
    One scan of ``labels``; the model fan-out is a generator, not a union."""
    lab = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    answers = F.array(*[F.struct(F.lit(name).alias("model"),
                                 raw_answer(d, F.col("toxic"), F.col("quality"), prime, pct).alias("raw"))
                        for name, prime, pct in MODELS])
    x = lab.select(d, F.explode(answers).alias("a"))
    return x.select(
        d.alias("idx"), pad_id(d).alias("meta_id"), F.col("a.raw").alias("raw"),
        F.lit(1).alias("attempt"), F.lit(0.0).alias("latency_s"), F.col("a.model").alias("model"),
        F.lit("stop").alias("finish_reason"), F.lit(False).alias("truncated"),
        F.lit(128).alias("max_tokens_used"))


def grouped_answer(doc_id: Column, toxic: Column, quality: Column, slot: int) -> Column:
    """Per-group answers for the two-group ('binary') mode.
    slot 0: group 'china'; slot 1: group 'content'; slot 2: a later duplicate
    of 'china' (doc_id % 13 = 0)."""
    L = F.lit
    y = F.when(toxic == 1, L("yes")).otherwise(L("no"))
    c = F.when(quality == 1, L("yes")).otherwise(L("no"))
    gov = F.when(doc_id % 3 == 0, L("pro")).when(doc_id % 3 == 1, L("anti")).otherwise(L("neutral"))
    if slot in (0, 2):
        rel = L("yes") if slot == 0 else F.when(doc_id % 2 == 0, L("no")).otherwise(L("yes"))
        sens = y if slot == 0 else L("cannot_determine")
        return F.concat(L('{"china_related":"'), rel, L('","china_ccp_government":"'), gov,
                        L('","china_people_culture":"pro","china_technology_development":"anti",'
                          '"china_sensitive":"'), sens, L('","collective_action":"'), c, L('"}'))
    hate = F.when(doc_id % 6 == 0, L("yes")).otherwise(L("no"))
    extra = F.when(doc_id % 5 == 0, L(',"collective_action":"cannot_determine"')).otherwise(L(""))
    body = F.concat(L('{"hate_speech":"'), hate, L('","harmful_content":"no","news_segments":"no",'
                                                  '"inauthentic_content":"no","derivative_content":"no"'),
                    extra, L("}"))
    return F.when(doc_id % 7 == 3, L("no answer")).otherwise(body)


def d_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 per-group raw answers with compound ids; group 'content' missing
    when doc_id % 11 = 0, group 'china' answered twice when doc_id % 13 = 0."""
    lab = table(spark, sf_dir, "labels")
    d, t, q = F.col("doc_id"), F.col("toxic"), F.col("quality")
    slots = [(0, "china", None), (1, "content", d % 11 != 0), (2, "china", d % 13 == 0)]
    parts = []
    for slot, gid, cond in slots:
        x = lab if cond is None else lab.filter(cond)
        parts.append(x.select(
            (d * 4 + slot).alias("idx"),
            F.concat(pad_id(d), F.lit("__group_" + gid)).alias("meta_id"),
            grouped_answer(d, t, q, slot).alias("raw"),
            F.lit("m_alpha").alias("model")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def d_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 per-call usage rows derived from documents."""
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    d = F.col("doc_id")
    pt = F.floor(F.col("n_chars") / 4).cast("bigint")
    ct = F.when(d % 17 == 0, F.lit(None).cast("bigint")).otherwise(((d * 13) % 300 + 20).cast("bigint"))
    return doc.select(d.alias("idx"), pt.alias("prompt_tokens"), ct.alias("completion_tokens"),
                      (pt + ct).alias("total_tokens"), (F.coalesce(ct, F.lit(0)) * 4).alias("output_chars"))
