"""Quality rules with adaptive cutoffs (operator 10).

Every text gets a few counts. For each language and source a mergeable quantile
sketch of each ratio, and of each ratio's denominator, is built: a histogram
whose buckets are exact below 64 and keep six significant binary digits above (relative error under
1/32). Bucket counts add up, so sketches of partitions merge in the shuffle,
and the sketch of all groups together is the sum of the groups' sketches. Only texts that pass the
fixed base rules enter the sketches.

There is no fixed cutoff. A group's cutoffs are read from its own sketch, to which the
pooled sketch is added with the weight of ``PRIOR`` texts: a large group speaks for itself, a small one leans on
the others, without a switch between the two. The cutoff of a ratio is

    tail + MARGIN * max(tail - median, unit)

where ``tail`` is the rule's upper quantile and ``unit`` what one more count adds to
the ratio of a short text (lower quartile of the denominator). So the margin follows the
spread of the group's upper half, and where that is zero - most texts have no symbol at all - it is a few
counts of a short text. Cutoffs are then joined to the rows.

Defined cases: a null or empty text has no words, all counts 0, and is
rejected by the base rule (fewer than 50 words). A null language or source is a
group of its own. Repeated rows count each time; a ratio equal to its cutoff passes. A text of any length is
read whole. An empty table gives an empty result; a group without a text that passes the base rules has no cutoffs.
Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.llm import textkit as T
from labelweave.llm.common import add_columns, cut, table, without
from labelweave.llm.registry import query

# ratio -> (numerator, denominator, factor, upper quantile in percent). The quantile says how many of the texts
# that pass the base rules may share the trait without making it ordinary.
RULES = {
    "symbols": ("n_symbols", "word_chars", 1000, 90),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 95),
    "repeats": ("n_repeat_words", "n_words", 1000, 99),
    "word_len": ("word_chars", "n_words", 10, 90),
}
DENOMINATORS = tuple(dict.fromkeys(den for _, den, _, _ in RULES.values()))
MARGIN = 3
PRIOR = 200
MAX_BROADCAST_GROUPS = 10_000
SALTS = 64

COUNTS = ("n_words long, word_chars long, n_symbols long, n_lines long, "
          "n_dup_lines long, n_repeat_words long")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LINE = np.arange(256) != 0x0A


def _per_doc(doc: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.bincount(doc, minlength=n).astype(np.int64))


def count_slice(col: pa.Array) -> dict[str, pa.Array]:
    """The counts of each text of a slice."""
    f = T.flat(col)
    token = T.IS_TOKEN[f.data]
    w = T.runs(f, token)
    h = T.run_hashes(f.data, w)
    doc_of = np.repeat(np.arange(f.n), np.diff(f.off))
    chars = token & ((f.data & 0xC0) != 0x80)

    # lines with a word, equal to an earlier line of the text
    ln = T.runs(f, _LINE[f.data])
    upto = np.zeros(len(f.data) + 1, np.int64)
    np.cumsum(token, out=upto[1:])
    some = upto[ln.end] > upto[ln.start]
    line_doc, line_hash = ln.doc[some], T.run_hashes(f.data, ln)[some]
    distinct, _ = T.unique_by_doc(line_doc, line_hash)
    n_lines = np.bincount(line_doc, minlength=f.n)

    # words in three-word windows that the text has more than once
    g, ok = T.grams(h, 3), T.inside(w.doc, 3)
    at = np.flatnonzero(ok)
    order = at[np.lexsort((g[at], w.doc[at]))]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        eq = (g[order[1:]] == g[order[:-1]]) & (w.doc[order[1:]] == w.doc[order[:-1]])
        same[1:] |= eq
        same[:-1] |= eq
    hit = np.zeros(len(h), bool)
    for j in range(3):
        hit[order[same] + j] = True

    return {
        "n_words": pa.array(w.counts.astype(np.int64)),
        "word_chars": _per_doc(doc_of[chars], f.n),
        "n_symbols": _per_doc(doc_of[_SYMBOL[f.data]], f.n),
        "n_lines": pa.array(n_lines.astype(np.int64)),
        "n_dup_lines": pa.array((n_lines - np.bincount(distinct, minlength=f.n)).astype(np.int64)),
        "n_repeat_words": _per_doc(w.doc[hit], f.n),
    }


def counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the counts and ``base_failed`` to the rows."""
    out = add_columns(docs, COUNTS, text_col,
                      lambda b: count_slice(b.column(b.schema.get_field_index(text_col))), keep)
    return out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _ratio(rule: str):
    num, den, factor, _ = RULES[rule]
    return F.expr(f"{factor} * {num} div greatest({den}, 1L)")


def sketch(counted: DataFrame, by: list[str]) -> DataFrame:
    """Bucket counts per group and measure (the ratios and their denominators); sketches merge by adding ``n``."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), _ratio(r).alias("v")) for r in RULES],
                    *[F.struct(F.lit(d).alias("rule"), F.col(d).alias("v")) for d in DENOMINATORS])
    return (counted.filter("NOT base_failed").select(*by, F.explode(pairs).alias("p"))
            .select(*by, "p.rule", F.expr(
                "CASE WHEN p.v < 64 THEN p.v ELSE shiftleft(shiftright(p.v, length(bin(p.v)) - 6), length(bin(p.v)) - 6) END"
            ).alias("bucket"))
            .groupBy(*by, "rule", "bucket").agg(F.count(F.lit(1)).alias("n")))


def _leaning(groups: DataFrame, by: list[str]) -> DataFrame:
    """Bucket weights per group: its own counts, and the pooled counts with the weight of ``PRIOR`` texts.

    Weights are whole numbers: own counts x all texts + PRIOR x pooled counts. The pooled sketch is a
    table of fixed size (buckets x measures), so a group gets that many rows at most."""
    pooled = groups.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    pooled = pooled.withColumn("all", F.sum("n").over(Window.partitionBy("rule")))
    whole = "decimal(38,0)"
    own = groups.join(pooled.select("rule", "all").distinct(), "rule").select(
        *by, "rule", "bucket", (F.col("n").cast(whole) * F.col("all")).cast(whole).alias("w"))
    measures = F.array(*[F.lit(m) for m in [*RULES, *DENOMINATORS]])
    others = groups.select(*by).distinct().select(*by, F.explode(measures).alias("rule")).join(pooled, "rule").select(
        *by, "rule", "bucket", (F.col("n").cast(whole) * PRIOR).cast(whole).alias("w"))
    return own.unionByName(others).groupBy(*by, "rule", "bucket").agg(F.sum("w").cast(whole).alias("w"))


def thresholds(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per language and source with the cutoff of each rule."""
    by = [lang_col, source_col]
    weights = _leaning(cut(sketch(counted, by), "quality-sketch"), by)
    key = ", ".join([*[f"`{c}`" for c in by], "rule"])
    cum = weights.selectExpr(*[f"`{c}`" for c in by], "rule", "bucket", f"sum(w) OVER (PARTITION BY {key} ORDER BY bucket) AS upto",
                             f"sum(w) OVER (PARTITION BY {key}) AS total")

    def quantile(percent) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("bucket")))

    tails = F.create_map(*[F.lit(x) for r, (_, _, _, tail) in RULES.items() for x in (r, tail)])
    q = cum.withColumn("tail", F.coalesce(F.try_element_at(tails, F.col("rule")), F.lit(50))).groupBy(*by, "rule").agg(
        quantile(25).alias("low"), quantile(50).alias("mid"), quantile(F.col("tail")).alias("high"))
    at = lambda measure, what: F.max(F.when(F.col("rule") == measure, F.col(what)))
    cuts = []
    for r, (_, den, factor, _) in RULES.items():
        least = F.greatest(at(den, "low"), F.lit(1))
        unit = F.floor((least + (factor - 1)) / least).cast("long")        # factor / least, rounded up
        cuts.append((at(r, "high") + MARGIN * F.greatest(at(r, "high") - at(r, "mid"), unit)).alias(f"max_{r}"))
    return cut(q.groupBy(*by).agg(*cuts), "quality-thresholds")


def apply(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Rows with their counts, the cutoffs used and ``kept``."""
    base = list(dict.fromkeys([*(keep if keep is not None else docs.columns), lang_col, source_col]))
    docs = without(docs, ["kept", "base_failed", *[f"max_{r}" for r in RULES]], [text_col, lang_col, source_col])
    base = [c for c in base if c in docs.columns]
    left = counts(docs, text_col, base)
    if text_col in base:        # counting again is cheaper than writing the texts
        each = thresholds(counts(docs, text_col, [lang_col, source_col]), lang_col, source_col)
    else:
        left = cut(left, "quality-counts")
        each = thresholds(left, lang_col, source_col)
    each = each.select(F.col(lang_col).alias("_l"), F.col(source_col).alias("_s"), *[f"max_{r}" for r in RULES])
    same = left[lang_col].eqNullSafe(F.col("_l")) & left[source_col].eqNullSafe(F.col("_s"))
    if each.count() <= MAX_BROADCAST_GROUPS:
        joined = left.join(F.broadcast(each), same, "left")
    else:  # many groups: shuffle, with the rows of a large group spread over salts
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in base if c != text_col]), F.lit(SALTS)))
        each = each.withColumn("_salt2", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        same = (left[lang_col].eqNullSafe(F.col("_l")) & left[source_col].eqNullSafe(F.col("_s"))
                & (left["_salt"] == F.col("_salt2")))
        joined = left.join(each, same, "left").drop("_salt", "_salt2")
    verdict = F.lit(True)
    for r in RULES:
        verdict = verdict & F.coalesce(_ratio(r) <= F.col(f"max_{r}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & verdict).drop("_l", "_s")


_TOK = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_TOK}') AS ws
  FROM documents),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT i + j) AS n
        FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1), range(3) t(j)
        GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '{_TOK}') GROUP BY r),
c AS (
  SELECT w.r, doc_id, lang, source, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        {", ".join(f"{f} * {n} // greatest({d}, 1) AS v_{r}" for r, (n, d, f, _) in RULES.items())} FROM c),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS rule, {x} AS v FROM b WHERE NOT base_failed"
                          for m, x in [*[(r, f"v_{r}") for r in RULES], *[(d, d) for d in DENOMINATORS]])}),
s AS (SELECT lang, source, rule,
        CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket,
        count(*) AS n FROM v GROUP BY ALL),
a AS (SELECT rule, bucket, sum(n) AS n FROM s GROUP BY ALL),
o AS (SELECT lang, source, rule, bucket, sum(w) AS w FROM (
        SELECT lang, source, rule, bucket, n::HUGEINT * (SELECT sum(a.n) FROM a WHERE a.rule = s.rule) AS w FROM s
        UNION ALL
        SELECT lang, source, rule, bucket, {PRIOR} * n::HUGEINT FROM (SELECT DISTINCT lang, source FROM s), a) GROUP BY ALL),
q AS (SELECT lang, source, rule, min(bucket) FILTER (100 * upto >= 25 * total) AS low, min(bucket) FILTER (100 * upto >= 50 * total) AS mid,
        min(bucket) FILTER (100 * upto >= CASE rule {" ".join(f"WHEN '{r}' THEN {x[3]}" for r, x in RULES.items())} ELSE 50 END * total) AS high
      FROM (SELECT *, sum(w) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto,
                   sum(w) OVER (PARTITION BY lang, source, rule) AS total FROM o) GROUP BY ALL),
th AS (SELECT r.lang, r.source, r.rule, r.high + {MARGIN} * greatest(r.high - r.mid, (f.factor + greatest(d.low, 1) - 1) // greatest(d.low, 1)) AS cut
       FROM q r JOIN (VALUES {", ".join(f"('{r}', '{x[1]}', {x[2]})" for r, x in RULES.items())}) f(rule, den, factor) USING (rule)
       JOIN q d ON d.rule = f.den AND d.lang IS NOT DISTINCT FROM r.lang AND d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(
           f"coalesce(v_{r} <= (SELECT max(cut) FROM th WHERE th.rule = '{r}' AND th.lang IS NOT DISTINCT FROM b.lang AND th.source IS NOT DISTINCT FROM b.source), true)"
           for r in RULES)} AS kept
FROM b
"""


@query("op10_quality_rules", SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and adaptive verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return apply(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
