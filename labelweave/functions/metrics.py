"""Evaluation metrics as aggregate Column expressions (F3: A7–A10).

All metrics reduce to sums, so they run as hash aggregates with map-side
partials; an optional weight column turns them into bootstrap-replicate
metrics (weights = how often a row was drawn).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _w(weight: Column | None) -> Column:
    return weight if weight is not None else F.lit(1)


def _wsum(cond: Column, weight: Column | None) -> Column:
    return F.sum(F.when(cond, _w(weight)).otherwise(F.lit(0)))


def f1_from_counts(tp: Column, fp: Column, fn: Column, n: Column) -> Column:
    """F1 = 2tp / (2tp + fp + fn); 0 when undefined (zero_division=0), null
    when there are no rows."""
    den = 2 * tp + fp + fn
    return (F.when(n == 0, F.lit(None).cast("double"))
            .when(den == 0, F.lit(0.0)).otherwise((2 * tp).cast("double") / den))


def f1_binary(gold_pos: Column, pred_pos: Column, weight: Column | None = None) -> Column:
    """Binary F1 of the positive class. Null predicates count as
    negative."""
    g = F.coalesce(gold_pos, F.lit(False))
    p = F.coalesce(pred_pos, F.lit(False))
    tp = _wsum(g & p, weight)
    fp = _wsum(~g & p, weight)
    fn = _wsum(g & ~p, weight)
    n = F.sum(_w(weight))
    return f1_from_counts(tp, fp, fn, F.coalesce(n, F.lit(0)))


def f1_yes(gold_label: Column, pred_label: Column, weight: Column | None = None) -> Column:
    """F1 on 'yes' (anything else is 'not yes')."""
    return f1_binary(gold_label == "yes", pred_label == "yes", weight)


def r2(gold: Column, pred: Column, weight: Column | None = None) -> Column:
    """Coefficient of determination over pairs where both are present;
    null with fewer than two pairs; constant gold -> 1 if perfect else 0."""
    mask = gold.isNotNull() & pred.isNotNull() & ~F.isnan(gold) & ~F.isnan(pred)
    if weight is None:
        n = F.count(F.when(mask, F.lit(1)))
        here = mask
        sst = F.var_pop(F.when(mask, gold)) * n
        ssr = F.sum(F.when(mask, (gold - pred) * (gold - pred)))
    else:
        here = mask & (weight > 0)
        w = F.when(mask, weight.cast("double"))
        n = F.sum(w)
        sg = F.sum(w * gold)
        sst = F.sum(w * gold * gold) - sg * sg / n
        ssr = F.sum(w * (gold - pred) * (gold - pred))
    return (F.when(F.coalesce(n, F.lit(0)) < 2, F.lit(None).cast("double"))
            .when(F.min(F.when(here, gold)) == F.max(F.when(here, gold)), F.when(ssr == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(1 - ssr / sst))


def multiclass_f1(gold: Column, pred: Column, labels: list[str],
                  weight: Column | None = None) -> dict[str, Column]:
    """A10: one-vs-rest F1 per label over rows whose gold is in ``labels``
    (predictions outside the set count as misses); macro = plain mean.
    Returns {label: F1 Column, 'macro': Column}."""
    keep = gold.isin(*labels)
    n = _wsum(keep, weight)
    out = {}
    for lab in labels:
        tp = _wsum(keep & (gold == lab) & (pred == lab), weight)
        fp = _wsum(keep & (gold != lab) & (F.coalesce(pred, F.lit("")) == lab), weight)
        fn = _wsum(keep & (gold == lab) & (F.coalesce(pred, F.lit("")) != lab), weight)
        out[lab] = f1_from_counts(tp, fp, fn, n)
    macro = sum(out.values()) / len(labels)
    out["macro"] = macro
    return out
