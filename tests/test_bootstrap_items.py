"""Bootstrap (A13): every item is weighted in every replicate."""
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from labelweave.codebook import default_codebook
from labelweave.operators import bootstrap as BT
from labelweave.operators import scoring as SC


def weight(seed, b, item):
    """Poisson(1) weight from the first 13 hex digits of md5(seed:b:item)."""
    u, k, p = int(hashlib.md5(f"{seed}:{b}:{item}".encode()).hexdigest()[:13], 16) / 16 ** 13, 0, math.exp(-1)
    total = p
    while u >= total:
        k += 1
        p /= k
        total += p
    return k


def f1(g, p, w):
    tp, fp, fn = w[g & p].sum(), w[~g & p].sum(), w[g & ~p].sum()
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


def near(row, values):
    low, high = np.quantile(values, [0.025, 0.975])
    assert abs(row.ci_low - low) < 1e-9 and abs(row.ci_high - high) < 1e-9, (row, low, high)


def test_standard_replicates_weigh_items(spark):
    """Scores and intervals equal those of items weighted one by one in Python; an id that comes twice is two items."""
    rng = np.random.default_rng(4)
    ids = [f"i{k}" for k in range(90)] + ["i0", "i1"]
    g, e = np.round(rng.uniform(-1, 1, 92), 2), np.round(rng.normal(0, 0.3, 90), 2)
    p = np.clip(np.round(g[:90] + e, 2), -1, 1)
    gy = rng.random(92) < 0.4
    py = np.where(rng.random(90) < 0.8, gy[:90], ~gy[:90])
    yn = lambda x: "yes" if x else "no"
    gold = spark.createDataFrame([(i, {"china_stance_score": str(a), "china_sensitive": yn(c)})
                                  for i, a, c in zip(ids, g.tolist(), gy, strict=True)], "meta_id string, gold map<string,string>")
    preds = spark.createDataFrame([("m", i, True, {"china_stance_score": str(a), "china_sensitive": yn(c)})
                                   for i, a, c in zip(ids[:90], p.tolist(), py, strict=True)],
                                  "model string, meta_id string, parsed boolean, json map<string,string>")
    B, at = 60, {i: k for k, i in enumerate(ids[:90])}
    p, py = np.array([p[at[i]] for i in ids]), np.array([py[at[i]] for i in ids])
    want = {"stance_R2": [], "stance_pos_F1": [], "ch_sensitive_F": []}
    for b in range(-1, B):
        w = np.array([1 if b < 0 else weight("s", b, i) for i in ids])
        mean = (w * g).sum() / w.sum()
        want["stance_R2"].append(1 - (w * (g - p) ** 2).sum() / (w * (g - mean) ** 2).sum())
        want["stance_pos_F1"].append(f1(g > 0, p > 0, w))
        want["ch_sensitive_F"].append(f1(gy, py, w))
    got = {r.metric: r for r in BT.bootstrap_standard(gold, preds, ["m"], B=B, seed="s").collect()}
    for metric, (point, *reps) in want.items():
        assert abs(got[metric].score - point) < 1e-9
        near(got[metric], reps)


def test_comprehensive_replicates_weigh_items(spark):
    """Binary and stance metrics from items weighted one by one; labels outside the classes count as misses."""
    cb, n, B = default_codebook(), 60, 40
    stance = ("pro", "anti", "neutral/unclear", "odd")

    def answer(i, shift):
        return {d.key: stance[(i * (1 + shift) + k) % 4] if d.categorical == "stance" else ("yes", "no")[(i + i * shift // 3 + k) % 2]
                for k, d in enumerate(cb.dimensions)}

    rows = [(str(i), answer(i, 0), answer(i, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "meta_id string, gold map<string,string>, json map<string,string>")
    preds = df.selectExpr("'m' AS model", "meta_id", "true AS parsed", "json")
    got = {r.metric: r for r in BT.bootstrap_comprehensive(df.select("meta_id", "gold"), preds, ["m"], B=B, seed=3).collect()}
    assert len(got) == 20
    weights = [np.array([weight(3, b, i) for i in range(n)]) for b in range(B)]
    one = np.ones(n)
    for key, metric in SC.BINARY_METRIC.items():
        g, p = (np.array([r[c][key] == "yes" for r in rows]) for c in (1, 2))
        assert abs(got[metric].score - f1(g, p, one)) < 1e-9
        near(got[metric], [f1(g, p, w) for w in weights])
    for key, prefix in SC.STANCE_PREFIX.items():
        g, p = (np.array([r[c][key] for r in rows]) for c in (1, 2))
        keep = np.isin(g, SC.STANCE_CLASSES)
        macro = lambda w: sum(f1(g == c, p == c, w * keep) for c in SC.STANCE_CLASSES) / 3  # noqa: E731, B023
        assert abs(got[f"{prefix}_f1_macro"].score - macro(one)) < 1e-9
        near(got[f"{prefix}_f1_macro"], [macro(w) for w in weights])


def test_weights_do_not_depend_on_partitions(spark):
    """400,000 items in two layouts: the same weights, of mean 1, and one row of weight 1 per item for the point scores."""
    items = spark.range(0, 400_000, numPartitions=7).select(F.col("id").cast("string").alias("meta_id"))
    seen = []
    for parts in (3, 40):
        w = BT.replicate_weights(items.repartition(parts), 1, "s")
        assert w.filter("b = -1 AND w = 1").count() == 400_000
        w = w.filter("b = 0")
        seen.append(w.agg(F.count("*"), F.count_distinct("meta_id"), F.sum("w"), F.sum(F.xxhash64("meta_id", "w") % 1000)).first())
    rows, ids, total, _ = seen[0]
    assert seen[0] == seen[1] and rows == ids
    assert abs(rows / 400_000 - (1 - math.exp(-1))) < 0.005 and abs(total / 400_000 - 1) < 0.01


def test_replicate_table_does_not_grow_with_labels(spark):
    """Answers with a text of their own each: the confusion table of the replicates stays as small."""
    cb = default_codebook()
    df = spark.range(300).select(F.col("id").cast("string").alias("meta_id"), F.create_map(*[x for d in cb.dimensions for x in (
        F.lit(d.key), F.concat(F.lit("text "), F.col("id").cast("string")))]).alias("gold")).withColumn("json", F.col("gold"))
    cols = df.select(F.lit("m").alias("model"), "meta_id", "gold", "json")
    assert BT.comprehensive_item_confusion(SC.comprehensive_answers(cols), 5, 1).count() == 6 * len(cb.dimensions)


def test_intervals_from_cells_remain(spark):
    """by='cells' draws from sufficient statistics: the same point scores and about the same intervals."""
    df = spark.range(2000).select(F.col("id").cast("string").alias("meta_id"), *[F.create_map(
        F.lit("china_stance_score"), (F.pmod(F.col("id") * a, F.lit(201)).cast("double") / 100 - 1).cast("string"),
        F.lit("china_sensitive"), F.when(F.pmod(F.col("id") * a, F.lit(7)) < 3, "yes").otherwise("no")).alias(c)
        for c, a in (("gold", 37), ("json", 45))])
    preds = df.selectExpr("'m' AS model", "meta_id", "true AS parsed", "json")
    a, b = ({r.metric: r for r in BT.bootstrap_standard(df.select("meta_id", "gold"), preds, ["m"], B=800, by=by).collect()}
            for by in ("items", "cells"))
    for m in ("stance_R2", "stance_pos_F1", "ch_sensitive_F"):
        assert abs(a[m].score - b[m].score) < 1e-9
        width = b[m].ci_high - b[m].ci_low
        assert max(abs(a[m].ci_low - b[m].ci_low), abs(a[m].ci_high - b[m].ci_high)) < 0.2 * width
