"""Adaptive cutoffs of the quality rules against brute force, and what a group's own distribution does."""
import collections
import random

from pyspark.sql import functions as F

from labelweave.llm import quality_rules as Q
from tests.llm.conftest import table
from tests.llm.test_operators import both


def bucket(v):
    if v < 64:
        return v
    drop = v.bit_length() - 6
    return v >> drop << drop


def brute_cutoffs(rows):
    """rows: (group, counts) of texts that pass the base rules."""
    def measures(c):
        out = {r: f * c[n] // max(c[d], 1) for r, (n, d, f, _) in Q.RULES.items()}
        return out | {d: c[d] for d in Q.DENOMINATORS}

    hist = collections.defaultdict(collections.Counter)
    for g, c in rows:
        for m, v in measures(c).items():
            hist[g, m][bucket(v)] += 1
            hist[None, m][bucket(v)] += 1
    cuts = {}
    for g in {g for g, _ in rows}:
        def quantile(m, percent, g=g):
            weight = collections.Counter()
            for b, n in hist[g, m].items():
                weight[b] += n * len(rows)
            for b, n in hist[None, m].items():
                weight[b] += n * Q.PRIOR
            upto = 0
            for b in sorted(weight):
                upto += weight[b]
                if 100 * upto >= percent * sum(weight.values()):
                    return b
        for r, (_, den, factor, tail) in Q.RULES.items():
            high = quantile(r, tail)
            unit = -(-factor // max(quantile(den, 25), 1))
            cuts[g, r] = high + Q.MARGIN * max(high - quantile(r, 50), unit)
    return cuts


def brute_kept(rows):
    fine = [((r.lang, r.source), r.asDict()) for r in rows if not r.base_failed]
    cuts = brute_cutoffs(fine)
    return {id(r): not r.base_failed and all(
        f * r[n] // max(r[d], 1) <= cuts[(r.lang, r.source), rule] for rule, (n, d, f, _) in Q.RULES.items()) for r in rows}


def test_verdicts_by_brute_force(spark, odd):
    for docs in (both(spark, odd), both(spark, odd).withColumn("source", F.lit(None).cast("string")), table(spark, "documents")):
        rows = Q.apply(docs).collect()
        want = brute_kept(rows)
        assert [r.kept for r in rows] == [want[id(r)] for r in rows]
        assert {r.kept for r in rows} == {True, False}


def test_a_group_decides_its_own_verdict(spark):
    """The same text passes among texts like it and fails among others; with its source unknown it goes by what is common."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    prose = lambda: " ".join(rng.sample(words, 80))
    marked = lambda: " ".join(w + ("$" if k % 4 == 0 else "") for k, w in enumerate(rng.sample(words, 80)))
    same = marked()
    rows = [(k, prose(), "news") for k in range(900)] + [(1000 + k, marked(), "code") for k in range(900)]
    rows += [(5000, same, "news"), (5001, same, "code"), (5002, same, "tiny"), (5003, prose(), "tiny"), (5004, prose(), "code")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in Q.apply(d, keep=["doc_id", "source"]).collect()}
    assert not got[5000].kept and got[5001].kept
    assert got[5002].kept and got[5003].kept and got[5004].kept       # a group of two leans on all texts, half of which are marked
    assert got[5000].max_symbols < got[5002].max_symbols
    merged = Q.apply(d.withColumn("source", F.lit("x")), keep=["doc_id"]).filter("doc_id = 5000").first()
    assert merged.kept
    few = spark.createDataFrame([r for r in rows if r[2] != "code"], "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    assert not Q.apply(few, keep=["doc_id"]).filter("doc_id = 5002").first().kept     # without the marked texts a group of two leans on prose


def test_sketches_merge(spark):
    """The pooled sketch is the sum of the groups'; any partitioning gives the same cutoffs."""
    docs = table(spark, "documents").select("doc_id", "text", "lang", "source")
    seen = [sorted(map(str, Q.thresholds(Q.counts(docs.repartition(n), keep=["lang", "source"])).collect())) for n in (1, 7)]
    assert seen[0] == seen[1]


def test_many_groups_are_joined_by_shuffle(spark, odd, monkeypatch):
    docs = both(spark, odd)
    want = sorted(str((r.doc_id, r.kept, r.max_symbols)) for r in Q.apply(docs, keep=["doc_id"]).collect())
    monkeypatch.setattr(Q, "MAX_BROADCAST_GROUPS", 0)
    assert sorted(str((r.doc_id, r.kept, r.max_symbols)) for r in Q.apply(docs, keep=["doc_id"]).collect()) == want
