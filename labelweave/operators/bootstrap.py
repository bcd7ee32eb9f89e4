"""Bootstrap confidence intervals.

Every item meets every replicate: its weight there is Poisson(1), from a uniform of
52 bits that md5 makes of (seed, replicate, item id). No generator state, no row number
and no draw table: the same weights on any partitioning and in any engine, and all metrics and
models of an item share them. The items are dealt evenly, each task sums its items per
replicate, and only these sums (models x B rows, for the 20 metrics times the
confusion cells) are shuffled. The point scores are one more replicate in which every weight is 1, so
the items are read once.

``by="cells"`` draws the replicates from sufficient statistics instead, for tables where items x B
is out of reach; it is an approximation and no registered query uses it:

- F1 metrics need the counts of the confusion cells. A resample of n items is a
  multinomial draw of the cells, made as a chain of binomials: each cell takes
  its binomial share of what the earlier cells have left. Work per metric is
  cells x B, whatever n is. Binomials with a mean below ``EXACT_MEAN`` (of the rarer side)
  are drawn by inverting the distribution function, others from the normal quantile with
  the skewness term of its Cornish-Fisher expansion.
- R2 needs sums of g, g^2 and (g - p)^2. Items are dealt by a hash of their id to
  ``BUCKETS`` buckets, the sums are taken per bucket, and a replicate gives each
  bucket a Poisson(1) weight: buckets are resampled, not items. Work per metric is ``BUCKETS`` x B.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.codebook import Codebook
from labelweave.functions import metrics as M
from labelweave.functions.text import compute_once
from labelweave.operators import scoring as SC
from labelweave.session import checkpoint_dir

BUCKETS = 1024
EXACT_MEAN = 12
OUTSIDE = "other"       # a predicted class that is none of the metric's


def _poisson_cdf(bits: int) -> list[float]:
    """Distribution function of Poisson(1), up to where it is within 2^-bits of 1."""
    out, total, p = [], 0.0, math.exp(-1.0)
    while not out or out[-1] < 1.0 - 2.0 ** -bits:
        total += p
        out.append(total)
        p /= len(out)
    return out


POISSON_CDF = _poisson_cdf(33)      # for 32-bit uniforms
ITEM_CDF = _poisson_cdf(52)         # for 52-bit uniforms
POINT = -1                          # the replicate in which every weight is 1
TASKS_PER_CORE = 4


# --- weights of items ---------------------------------------------------------------------

def replicate_weights(items: DataFrame, B: int, seed: int | str) -> DataFrame:
    """Every item (by ``meta_id``) with its weight ``w`` > 0 in each replicate ``b``, and with weight 1 in ``POINT``.

    The uniform is the first 13 digits of md5(seed:b:id) over 16^13. It is below a bound if the hex text sorts
    before the bound's hex text, so no digit is converted. Items are dealt evenly to a number of tasks that does not
    shrink with their few bytes: the work is in the replicates."""
    tasks = TASKS_PER_CORE * items.sparkSession.sparkContext.defaultParallelism
    rep = items.repartition(tasks).withColumn("b", F.explode(F.sequence(F.lit(POINT), F.lit(B - 1))))
    rep = compute_once(rep, _h=F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"),
                                                 F.coalesce(F.col("meta_id"), F.lit("")))))
    w = F.lit(len(ITEM_CDF))
    for k in range(len(ITEM_CDF) - 1, -1, -1):
        bound = math.ceil(ITEM_CDF[k] * 16 ** 13)
        w = F.lit(k) if bound >= 16 ** 13 else F.when(F.col("_h") < f"{bound:013x}", F.lit(k)).otherwise(w)
    return compute_once(rep, w=F.when(F.col("b") == POINT, F.lit(1)).otherwise(w)).drop("_h").filter("w > 0")


# --- draws ----------------------------------------------------------------------------------

def binomial_sql(n: str, p: str, u: str, v: str) -> str:
    """SQL text of a Binomial(n, p) draw from two uniforms in (0, 1)."""
    exact = ("transform(array(exp(t.n * ln(1 - t.q))), z -> aggregate("
             "sequence(1, CAST(least(t.n, ceil(t.n * t.q + 7 * sqrt(t.n * t.q)) + 8) AS INT)), "
             "struct(0L AS x, z AS f, z AS cdf), (a, k) -> CASE WHEN t.u < a.cdf THEN a ELSE "
             "transform(array(a.f * (t.n - k + 1) / k * (t.q / (1 - t.q))), f -> "
             "struct(CAST(k AS BIGINT) AS x, f AS f, a.cdf + f AS cdf))[0] END, a -> a.x))[0]")
    normal = ("transform(array(sqrt(-2 * ln(t.u)) * cos(2 * pi() * t.v)), z -> CAST(greatest(0, least(t.n, "
              "floor(t.n * t.q + sqrt(t.n * t.q * (1 - t.q)) * z + (1 - 2 * t.q) * (z * z - 1) / 6 + 0.5))) AS BIGINT))[0]")
    return (f"transform(array(struct(CAST({n} AS BIGINT) AS n, least({p}, 1 - {p}) AS q, {p} > 0.5 AS flip, "
            f"{u} AS u, {v} AS v)), t -> transform(array(CASE WHEN t.n = 0 OR t.q <= 0 THEN 0L "
            f"WHEN t.n * t.q < {EXACT_MEAN} THEN {exact} ELSE {normal} END), x -> CASE WHEN t.flip THEN t.n - x ELSE x END)[0])[0]")


def _uniform_sql(h: str, at: int) -> str:
    return f"((CAST(conv(substr({h}, {at}, 13), 16, 10) AS DOUBLE) + 0.5) / {float(16 ** 13)!r}D)"


def resample_cells(cells: DataFrame, B: int, seed: int | str, key: list[str]) -> DataFrame:
    """``cells`` has the columns ``key`` and ``cells`` (array of counts); returns key, ``b`` and ``draws``:
    for each replicate ``b`` a multinomial draw of sum(cells) items over the cells."""
    label = ", ".join(f"`{k}`" for k in key)
    chain = ("aggregate(sequence(1, size(cells)), "
             "struct(aggregate(cells, 0L, (s, c) -> s + c) AS left, aggregate(cells, 0L, (s, c) -> s + c) AS mass, CAST(array() AS array<bigint>) AS draws), "
             f"(a, i) -> transform(array(md5(concat_ws(':', '{seed}', {label}, b, i))), h -> "
             "transform(array(" + binomial_sql("a.left", "(CASE WHEN a.mass = 0 THEN 0D ELSE cells[i - 1] / a.mass END)",
                                               _uniform_sql("h", 1), _uniform_sql("h", 14)) +
             "), x -> struct(a.left - x AS left, a.mass - cells[i - 1] AS mass, array_append(a.draws, x) AS draws))[0])[0], a -> a.draws)")
    tasks = max(1, min(B, cells.sparkSession.sparkContext.defaultParallelism))
    reps = cells.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B - 1)))).repartition(tasks, *key, "b")
    return compute_once(reps, draws=F.expr(chain)).drop("cells")


def bucket_of(id_col: str = "meta_id") -> Column:
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int")


def resample_buckets(sums: DataFrame, B: int, seed: int | str) -> DataFrame:
    """Rows with a ``bucket``, once per replicate ``b`` in which the bucket's weight ``w`` is positive.

    One md5 gives the 32-bit uniforms of four replicates."""
    held = sums.groupBy("bucket").agg(F.collect_list(F.struct(*[c for c in sums.columns if c != "bucket"])).alias("rows"))
    tasks = max(1, min(BUCKETS, sums.sparkSession.sparkContext.defaultParallelism))
    four = held.repartition(tasks, "bucket").withColumn("b4", F.explode(F.sequence(F.lit(0), F.lit((B - 1) // 4))))
    cdf = " ".join(f"WHEN u < {c!r}D THEN {k}" for k, c in enumerate(POISSON_CDF))
    h = f"md5(concat_ws(':', '{seed}', b4, bucket))"
    weights = (f"transform(array({h}), h -> transform(sequence(0, 3), i -> struct(4 * b4 + i AS b, "
               "CAST(conv(substr(h, 8 * i + 1, 8), 16, 10) AS DOUBLE) / 4294967296D AS u)))[0]")
    reps = four.select("rows", F.expr(f"inline({weights})")).filter(F.col("b") < B)
    return reps.withColumn("w", F.expr(f"CASE {cdf} ELSE {len(POISSON_CDF)} END")).filter("w > 0").select("b", "w", F.inline("rows"))


# --- sufficient statistics ------------------------------------------------------------------

def binary_cells(gold_pos: Column, pred_pos: Column, counted: Column | None = None, n: Column | None = None) -> Column:
    """Counts of (tp, fp, fn, tn, rows that the metric leaves out)."""
    g, p = F.coalesce(gold_pos, F.lit(False)), F.coalesce(pred_pos, F.lit(False))
    w = F.lit(1).cast("long") if n is None else n
    here = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    return F.array(*[F.coalesce(F.sum(F.when(c, w)), F.lit(0).cast("long"))
                     for c in (here & g & p, here & ~g & p, here & g & ~p, here & ~g & ~p, ~here)])


def binary_score(draws: Column) -> Column:
    tp, fp, fn, tn = (draws[i] for i in range(4))
    return M.f1_from_counts(tp, fp, fn, tp + fp + fn + tn)


def class_cells(g: Column, p: Column, labels: list[str], n: Column) -> Column:
    """Counts of (gold class, predicted class or none of them), gold by gold, then rows of other gold."""
    shown = F.when(p.isin(*labels), p).otherwise(F.lit(OUTSIDE))
    pairs = [(g == a) & (shown == b) for a in labels for b in [*labels, OUTSIDE]]
    return F.array(*[F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("long"))
                     for c in [*pairs, ~F.coalesce(g.isin(*labels), F.lit(False))]])


def class_scores(draws: Column, labels: list[str]) -> dict[str, Column]:
    """One-vs-rest F1 of each class and their mean, from a draw of ``class_cells``."""
    k = len(labels)
    at = lambda g, p: draws[g * (k + 1) + p]
    total = sum(at(g, p) for g in range(k) for p in range(k + 1))
    out = {}
    for i, lab in enumerate(labels):
        fp = sum(at(g, i) for g in range(k) if g != i)
        fn = sum(at(i, p) for p in range(k + 1) if p != i)
        out[lab] = M.f1_from_counts(at(i, i), fp, fn, total)
    out["macro"] = sum(out.values()) / k
    return out


def r2_sums(gold: Column, pred: Column) -> list[Column]:
    here = gold.isNotNull() & pred.isNotNull() & ~F.isnan(gold) & ~F.isnan(pred)
    g, d = F.when(here, gold), F.when(here, gold - pred)
    return [F.count(g).alias("n"), F.sum(g).alias("sg"), F.sum(g * g).alias("sgg"), F.sum(d * d).alias("ssr"),
            F.min(g).alias("low"), F.max(g).alias("high")]


def r2_of_sums(w: Column) -> Column:
    """R2 of weighted rows of ``r2_sums``; the same rules for few pairs and constant gold as ``metrics.r2``."""
    n, sg, ssr = F.sum(w * F.col("n")), F.sum(w * F.col("sg")), F.sum(w * F.col("ssr"))
    sst = F.sum(w * F.col("sgg")) - F.try_divide(sg * sg, n)
    return (F.when(F.coalesce(n, F.lit(0)) < 2, F.lit(None).cast("double"))
            .when(F.min("low") == F.max("high"), F.when(ssr == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(1 - F.try_divide(ssr, sst)))


def intervals(scores: DataFrame, alpha: float) -> DataFrame:
    """(model, metric, ci_low, ci_high) from (model, metric, b, score); null and NaN scores do not count."""
    return scores.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("model", "metric").agg(
        F.percentile("score", alpha / 2).alias("ci_low"), F.percentile("score", 1 - alpha / 2).alias("ci_high"))


# --- the two scorecards ---------------------------------------------------------------------

def _held(small: DataFrame) -> DataFrame:
    """A table whose size does not grow with the items, written once: point scores and replicates both read it."""
    checkpoint_dir(small.sparkSession)
    return small.checkpoint()


def standard_sums(cols: DataFrame, yn_metric: str = "f1") -> tuple[DataFrame, DataFrame]:
    """(model, metric, cells) and (model, bucket, metric, sums of ``r2_sums``) of the standard metrics, from one
    pass over the rows of ``scoring.standard_columns``."""
    gs, ps, has = F.col("g_stance"), F.col("p_stance"), F.col("has_coll")
    binary = {"stance_pos_F1": (gs > 0, ps > 0, None), "stance_neg_F1": (gs < 0, ps < 0, None)}
    numeric = {"stance_R2": (gs, ps)}
    if yn_metric == "f1":
        binary["ch_sensitive_F"] = (F.col("g_sens") == "yes", F.col("p_sens") == "yes", None)
        binary["col_action_F"] = (F.col("g_coll") == "yes", F.col("p_coll") == "yes", has)
    else:
        numeric["ch_sensitive_R2"] = (F.col("g_sens"), F.col("p_sens"))
        numeric["col_action_R2"] = (F.when(has, F.col("g_coll")), F.col("p_coll"))
    wide = _held(cols.groupBy("model", bucket_of().alias("bucket")).agg(
        *[binary_cells(*x).alias(m) for m, x in binary.items()], *[F.struct(*r2_sums(*x)).alias(m) for m, x in numeric.items()]))
    cells = wide.unpivot(["model"], list(binary), "metric", "c").groupBy("model", "metric").agg(
        F.array(*[F.sum(F.col("c")[i]) for i in range(5)]).alias("cells"))
    sums = wide.unpivot(["model", "bucket"], list(numeric), "metric", "s").select("model", "bucket", "metric", "s.*")
    return cells, sums


def standard_replicates(cells: DataFrame, sums: DataFrame, B: int, seed: int | str) -> DataFrame:
    """(model, metric, b, score) of the standard metrics."""
    f1 = resample_cells(cells, B, seed, ["model", "metric"])
    r2 = resample_buckets(sums, B, seed).groupBy("model", "metric", "b").agg(r2_of_sums(F.col("w")).alias("score"))
    return f1.select("model", "metric", "b", binary_score(F.col("draws")).alias("score")).unionByName(r2)


def standard_item_replicates(cols: DataFrame, B: int, seed: int | str, yn_metric: str = "f1") -> DataFrame:
    """(model, metric, b, score) of the standard metrics from weighted items, ``POINT`` included; ``cols``: the rows of
    ``scoring.standard_columns``."""
    exprs = SC.standard_metric_exprs(yn_metric, F.col("w"))
    wide = replicate_weights(cols, B, seed).groupBy("model", "b").agg(*[e.cast("double").alias(k) for k, e in exprs.items()])
    return _held(wide).unpivot(["model", "b"], list(exprs), "metric", "score")


def bootstrap_standard(gold: DataFrame, preds: DataFrame, models: list[str] | None = None,
                       B: int = 1000, alpha: float = 0.05, seed: int | str = 0,
                       yn_metric: str = "f1", yn_thresh: float | None = None,
                       cd_map: dict[str, float] | None = None, by: str = "items") -> DataFrame:
    """A13 on the standard scorecard: (model, metric, score, metric_pos, ci_low, ci_high)."""
    models = models or SC.model_list(preds)
    cols = SC.standard_columns(SC.align(gold.select("meta_id", "gold"), preds, models), yn_metric, yn_thresh, cd_map)
    if by == "cells":
        cells, sums = standard_sums(cols, yn_metric)
        point = cells.select("model", "metric", binary_score(F.col("cells")).alias("score")).unionByName(
            sums.groupBy("model", "metric").agg(r2_of_sums(F.lit(1)).alias("score")))
        reps = standard_replicates(cells, sums, B, seed)
    else:
        reps = standard_item_replicates(cols, B, seed, yn_metric)
        point, reps = reps.filter(F.col("b") == POINT).drop("b"), reps.filter(F.col("b") != POINT)
    names = SC.STANDARD_F1_METRICS if yn_metric == "f1" else SC.STANDARD_R2_METRICS
    pos = F.create_map(*[x for i, m in enumerate(names) for x in (F.lit(m), F.lit(i))])
    return (point.withColumn("metric_pos", F.try_element_at(pos, F.col("metric")))
            .join(intervals(reps, alpha), ["model", "metric"], "left"))


def comprehensive_replicates(conf: DataFrame, B: int, seed: int | str) -> DataFrame:
    """(model, metric, b, score) of the 20 metrics; ``conf``: the confusion counts of ``scoring.confusion``."""
    g, p, n = F.col("g"), F.col("p"), F.col("n")
    two = conf.filter(F.col("kind") == "binary").groupBy("model", "dim").agg(
        binary_cells(g == "yes", p == "yes", None, n).alias("cells"))
    two = resample_cells(two, B, seed, ["model", "dim"])
    names = F.create_map(*[x for k, v in SC.BINARY_METRIC.items() for x in (F.lit(k), F.lit(v))])
    f1 = two.select("model", F.try_element_at(names, F.col("dim")).alias("metric"), "b", binary_score(F.col("draws")).alias("score"))
    three = conf.filter(F.col("kind") == "stance").groupBy("model", "dim").agg(
        class_cells(g, p, SC.STANCE_CLASSES, n).alias("cells"))
    three = resample_cells(three, B, seed, ["model", "dim"])
    prefix = F.create_map(*[x for k, v in SC.STANCE_PREFIX.items() for x in (F.lit(k), F.lit(v))])
    wide = three.select("model", "dim", "b", *[e.alias(SC.STANCE_SUFFIX[k])
                                               for k, e in class_scores(F.col("draws"), SC.STANCE_CLASSES).items()])
    long = wide.unpivot(["model", "dim", "b"], list(SC.STANCE_SUFFIX.values()), "suffix", "score")
    return f1.unionByName(long.select("model", F.concat(F.try_element_at(prefix, F.col("dim")), F.lit("_"), F.col("suffix")).alias("metric"),
                                      "b", "score"))


def comprehensive_item_confusion(answers: DataFrame, B: int, seed: int | str) -> DataFrame:
    """(model, b, dim, kind, g, p) -> n: the weighted confusion table of every replicate and of ``POINT``; ``answers``: the rows of
    ``scoring.comprehensive_answers``. Labels that no metric tells apart are one, so its size does not grow with the items."""
    def shown(x, side):
        known = F.when(x["kind"] == "binary", x[side] == "yes").otherwise(x[side].isin(*SC.STANCE_CLASSES))
        return F.when(known, x[side]).otherwise(F.lit(OUTSIDE)).alias(side)

    few = answers.select("model", "meta_id", F.transform("answers", lambda x: F.struct(
        x["dim"].alias("dim"), x["kind"].alias("kind"), shown(x, "g"), shown(x, "p"))).alias("answers"))
    return (replicate_weights(few, B, seed).select("model", "b", "w", F.inline("answers"))
            .groupBy("model", "b", "dim", "kind", "g", "p").agg(F.sum("w").alias("n")))


def bootstrap_comprehensive(gold: DataFrame, preds: DataFrame, models: list[str] | None = None,
                            B: int = 1000, alpha: float = 0.05, seed: int | str = 0,
                            cb: Codebook | None = None, yn_thresh: float | None = None, by: str = "items") -> DataFrame:
    """A13 on the 20-metric scorecard: (model, metric, score, metric_pos, ci_low, ci_high).

    Point scores and replicates come from one confusion table, so the items are read once."""
    models = models or SC.model_list(preds)
    aligned = SC.align(gold.select("meta_id", "gold"), preds, models)
    order = {m: i for i, m in enumerate(SC.comprehensive_metric_order())}
    pos = F.create_map(*[x for m, i in order.items() for x in (F.lit(m), F.lit(i))])
    if by == "cells":
        conf = _held(SC.confusion(SC.comprehensive_long(aligned, cb, yn_thresh)))
        point, reps = SC.metrics_from_confusion(conf), comprehensive_replicates(conf, B, seed)
    else:
        conf = _held(comprehensive_item_confusion(SC.comprehensive_answers(aligned, cb, yn_thresh), B, seed))
        point = SC.metrics_from_confusion(conf.filter(F.col("b") == POINT))
        reps = SC.metrics_from_confusion(conf.filter(F.col("b") != POINT), "n", ("model", "b"))
    return (point.withColumn("metric_pos", F.try_element_at(pos, F.col("metric")))
            .join(intervals(reps, alpha), ["model", "metric"], "left"))
