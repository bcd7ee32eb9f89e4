"""Token, cost and usage summaries.

Token counts are column expressions over the message array (no Python on
the default path); a tokenizer callable can be plugged in as an Arrow-batched
pandas UDF (F2). Percentiles are exact (``percentile``, linear
interpolation); ``approx=True`` switches to ``percentile_approx`` for very
large inputs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — defaults of the cost model.
CHARS_PER_TOKEN = 4.0
TRAIN_PRICE_PER_M = 25.0
INFER_IN_PRICE_PER_M = 0.15
INFER_OUT_PRICE_PER_M = 0.60
AVG_INPUT_TOKENS = 932
AVG_OUTPUT_TOKENS = 308
IMAGE_TILE = 560
IMAGE_TILE_TOKENS = 1601
# ---------------------------------------------------------------------------


def text_tokens(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """A16 heuristic: max(1, round_half_even(chars / cpt)); 0 for empty/null."""
    n = F.length(text)
    est = F.greatest(F.lit(1), F.bround(n / F.lit(chars_per_token), 0).cast("long"))
    return F.when(text.isNull() | (n == 0), F.lit(0).cast("long")).otherwise(est)


def record_tokens(messages: Column, parts: Column | None = None,
                  chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """Sum over messages of the string content (or, for multimodal
    messages, the text parts)."""
    def total(ms: Column) -> Column:
        return F.aggregate(ms, F.lit(0).cast("long"), lambda acc, m: acc + text_tokens(m["content"], chars_per_token))

    s = total(messages)
    if parts is None:
        return s
    p = F.aggregate(F.coalesce(parts, F.array().cast("array<struct<type:string,text:string>>")),
                    F.lit(0).cast("long"), lambda acc, x: acc + text_tokens(x["text"], chars_per_token))
    # the parts hold the text of the user message: count it there only
    rest = total(F.filter(messages, lambda m: m["role"] != "user"))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, rest + p).otherwise(s)


def tokenizer_udf(count_fn: Callable[[str], int]):
    """plug a tokenizer in as a vectorised pandas UDF (str -> token count)."""
    @F.pandas_udf("long")
    def _count(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: int(count_fn(t)) if t else 0)
    return _count


def tally(records: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Examples, total, avg, min, max tokens per file/table."""
    t = F.col(tokens_col)
    return records.agg(F.count(F.lit(1)).alias("examples"), F.sum(t).alias("tokens_total"),
                       (F.sum(t) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_per_example"),
                       F.coalesce(F.min(t), F.lit(0)).alias("min_per_example"),
                       F.coalesce(F.max(t), F.lit(0)).alias("max_per_example"))


def cost_estimate(train_tally: DataFrame, val_tally: DataFrame | None = None, epochs: int = 1,
                  include_val: bool = False, train_rate: float = TRAIN_PRICE_PER_M,
                  infer_calls: int | None = None, in_tokens: int = AVG_INPUT_TOKENS,
                  out_tokens: int = AVG_OUTPUT_TOKENS, in_rate: float = INFER_IN_PRICE_PER_M,
                  out_rate: float = INFER_OUT_PRICE_PER_M, keep: bool = False) -> DataFrame:
    """Charged training tokens = (train + optional val) x max(epochs, 1);
    training cost; optional inference cost in / out. ``keep``: the tally's other
    columns stay in the row."""
    val = 0
    if val_tally is not None and include_val:
        val = val_tally.first()["tokens_total"] or 0     # one scalar
    more = [c for c in train_tally.columns if c != "tokens_total"] if keep else []
    t = train_tally.select(*more, F.col("tokens_total").alias("train_tokens"),
                           F.lit(val).cast("long").alias("val_tokens"))
    charged = (F.col("train_tokens") + F.col("val_tokens")) * F.lit(max(epochs, 1))
    out = t.select(*more, "train_tokens", "val_tokens", charged.alias("charged_training_tokens"),
                   (charged / 1e6 * train_rate).alias("training_cost"))
    if infer_calls is not None:
        ci = in_tokens * infer_calls / 1e6 * in_rate
        co = out_tokens * infer_calls / 1e6 * out_rate
        out = out.select("*", F.lit(infer_calls).alias("infer_calls"),
                         F.lit(ci).alias("infer_cost_in"), F.lit(co).alias("infer_cost_out"),
                         F.lit(ci + co).alias("infer_cost_total"))
    return out


def image_tokens(height: Column, width: Column) -> Column:
    """min(2, max(H div 560, 1)) * min(2, max(W div 560, 1)) * 1601."""
    def tiles(x):
        return F.least(F.lit(2), F.greatest(F.floor(x / IMAGE_TILE), F.lit(1)))
    return (tiles(height) * tiles(width) * IMAGE_TILE_TOKENS).cast("long")


def usage_distribution(usage: DataFrame, approx: bool = False) -> DataFrame:
    """For prompt and completion tokens: mean, median, p90, p99, min,
    max; totals, both ratios and the number of calls with usage present."""
    def stats(c: str, pre: str):
        x = F.col(c)
        if approx:
            q = F.percentile_approx(x, [0.5, 0.9, 0.99], 10000)
        else:
            q = F.percentile(x, [0.5, 0.9, 0.99])
        return [F.avg(x).alias(f"{pre}_mean"), q[0].alias(f"{pre}_median"), q[1].alias(f"{pre}_p90"),
                q[2].alias(f"{pre}_p99"), F.min(x).alias(f"{pre}_min"), F.max(x).alias(f"{pre}_max"),
                F.sum(x).alias(f"{pre}_total")]
    a = usage.agg(F.count(F.lit(1)).alias("calls"),
                  F.count("completion_tokens").alias("with_usage"),
                  *stats("prompt_tokens", "prompt"), *stats("completion_tokens", "completion"))
    return a.select("*",
                    (F.col("prompt_total") + F.col("completion_total")).alias("tokens_total"),
                    (F.col("prompt_total") / F.col("completion_total")).alias("input_output_ratio"),
                    (F.col("completion_total") / F.col("prompt_total")).alias("output_input_ratio"))
