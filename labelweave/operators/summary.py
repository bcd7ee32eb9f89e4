"""Final distribution summary of predictions joined to a source table
and the wide side-by-side comparison (JN2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.text import clamp11, stance_label, strip_ws, to_double
from labelweave.session import checkpoint_dir

NEUTRAL_BAND = 0.1

# FIXED VALUES — the blocks of the wide comparison: (json key, short name, kind), in column order.
STANDARD_FIELDS = [
    ("china_stance_score", "stance", "float"),
    ("china_sensitive", "sensitive", "yn"),
    ("collective_action", "collective", "yn"),
]
COMPREHENSIVE_FIELDS = [
    ("china_related", "china_related", "yn"),
    ("china_ccp_government", "stance_gov", "stance"),
    ("china_people_culture", "stance_culture", "stance"),
    ("china_technology_development", "stance_tech", "stance"),
    ("china_sensitive", "sensitive", "yn"),
    ("collective_action", "collective", "yn"),
    ("hate_speech", "hate", "yn"),
    ("harmful_content", "harmful", "yn"),
    ("news_segments", "news", "yn"),
    ("inauthentic_content", "inauthentic", "yn"),
    ("derivative_content", "derivative", "yn"),
]


def final_summary(joined: DataFrame, score_col: str = "pred_china_stance_score") -> DataFrame:
    """Total rows, rows with a prediction (and %), score count / mean /
    min / max and the three-way split at +-0.1 with percentages."""
    s = to_double(F.col(score_col))
    pred = F.col("pred_parsed")
    sp = F.when(pred, s)
    n_s = F.count(sp)
    neg = F.count_if(pred & (s < -NEUTRAL_BAND))
    neu = F.count_if(pred & (s >= -NEUTRAL_BAND) & (s <= NEUTRAL_BAND))
    pos = F.count_if(pred & (s > NEUTRAL_BAND))
    return joined.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(pred).alias("predicted_rows"),
        (100.0 * F.count_if(pred) / F.count(F.lit(1))).alias("predicted_pct"),
        n_s.alias("score_count"), F.avg(sp).alias("score_mean"),
        F.min(sp).alias("score_min"), F.max(sp).alias("score_max"),
        neg.alias("negative"), neu.alias("neutral"), pos.alias("positive"),
        (100.0 * neg / n_s).alias("negative_pct"), (100.0 * neu / n_s).alias("neutral_pct"),
        (100.0 * pos / n_s).alias("positive_pct"))


def value_counts(joined: DataFrame, col: str = "pred_china_sensitive") -> DataFrame:
    """Value counts of a categorical prediction over predicted rows,
    with % of predicted rows, most frequent first (null values excluded)."""
    # the counts, null included, are written once: the total comes from them, not from a second run
    checkpoint_dir(joined.sparkSession)
    vc = (joined.filter(F.col("pred_parsed")).groupBy(F.col(col).alias("value"))
          .agg(F.count(F.lit(1)).alias("count")).checkpoint())
    n = vc.agg(F.sum("count")).first()[0] or 0           # one scalar
    return (vc.filter("value IS NOT NULL").select(
        "value", "count", (100.0 * F.col("count") / F.lit(max(n, 1))).alias("pct"))
            .orderBy(F.col("count").desc(), F.col("value")))


def norm_yn_cd(x):
    """yes/no/cannot_determine else 'invalid' (case-insensitive, stripped)."""
    t = F.lower(strip_ws(x.cast("string")))
    return F.when(t.isin("yes", "no", "cannot_determine"), t).otherwise(F.lit("invalid"))


def compare_wide(gold: DataFrame, preds: DataFrame, models: list[str], key: str = "meta_id",
                 fields: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """JN2: one row per gold item; per field a block of <model>_<name>
    columns then human_<name>; the user text last. Built as one long left
    join pivoted on the model (model list given, so no extra job), keyed on
    ``meta_id`` (default) or file position ``idx``.

    ``fields``: (json key, short name, kind) with kind 'float' | 'yn' | 'stance'; ``STANDARD_FIELDS``
    (default) or ``COMPREHENSIVE_FIELDS`` for the 11 dimensions.
    """
    from labelweave.operators.merge import last_wins
    from labelweave.operators.scoring import latest_predictions
    fields = fields or STANDARD_FIELDS

    def norm(v, kind):
        if kind == "float":
            return clamp11(v)
        if kind == "yn":
            return norm_yn_cd(v)
        return stance_label(v)
    if key == "idx":        # by position: the last answer of each position
        p = last_wins(preds.filter(F.col("parsed") & F.col("json").isNotNull() & F.col("idx").isNotNull()),
                      ["model", "idx"], "idx", ["json"])
    else:
        p = latest_predictions(preds)
    pv = p.select("model", F.col("idx" if key == "idx" else "meta_id").alias(key),
                  *[norm(F.try_element_at("json", F.lit(k)), kind).alias(n) for k, n, kind in fields])
    wide = pv.groupBy(key).pivot("model", models).agg(*[F.first(n).alias(n) for _, n, _ in fields])
    g = gold.select(key, F.col("gold"), F.col("transcript"))
    out = g.join(wide, key, "left")
    cols = [F.col(key)]
    for k, n, kind in fields:
        for m in models:
            c = f"{m}_{n}" if len(fields) > 1 else m
            miss = F.lit(None) if kind == "float" else (F.lit("invalid") if kind == "yn" else F.lit(""))
            cols.append(F.coalesce(F.col(c), miss).alias(f"{m}_{n}"))
        cols.append(norm(F.try_element_at("gold", F.lit(k)), kind).alias(f"human_{n}"))
    cols.append(F.col("transcript"))
    return out.select(*cols)
