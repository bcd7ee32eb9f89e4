"""The pipeline on odd rows, on documents whose columns have the operators' names, and on an empty table."""
import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelweave.llm import packing
from tests.llm.conftest import SF0001, table

CLASHING = ["kept", "base_failed", "max_symbols", "n_words", "sid", "_id", "class_id", "hit_spans", "item_ids", "contaminated", "base", "spans",
            "text_key", "k1", "part", "unfinished", "sequence_id", "c0", "c1", "_text", "label"]


@pytest.fixture(scope="module")
def docs(spark, odd):
    """Documents and odd rows (nulls everywhere, empty and long texts, repeated rows) with extra columns."""
    plain = table(spark, "documents").unionByName(
        odd.filter("doc_id IS NULL OR doc_id <> 8").select("doc_id", "text", "lang", "source", "n_chars"))
    return plain.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])


def key(r):
    return str(r.doc_id), r.sid


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF0001)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    before = collections.Counter(key(r) for r in docs.collect())
    rows = out.collect()
    assert not collections.Counter(key(r) for r in rows) - before
    assert all(r[c] == f"{c}:{r.doc_id if r.doc_id is not None else '-'}" for r in rows for c in CLASHING)
    plain = stage(spark, docs.drop(*CLASHING), SF0001).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in plain) == sorted((str(r.doc_id), str(r.text)) for r in rows)
    assert stage(spark, docs.filter("false"), SF0001).count() == 0


def test_whole_pipeline_on_odd_rows(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF0001).collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF0001).collect()
    want = collections.Counter((r.doc_id, np.array(tok.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes())
                               for r in kept.collect())
    assert all(n == 1 for n in want.values())          # near copies have gone, with them repeated rows
    got = collections.defaultdict(list)
    for p in pieces:
        got[p.doc_id, p.doc_tokens].append((p.start, bytes(p.ids), p.length))
    read = collections.Counter()
    for (doc, n), parts in got.items():
        ids = b"".join(x for _, x, _ in sorted(parts))
        assert len(ids) == 4 * n == 4 * sum(k for _, _, k in parts)
        read[doc, ids] += 1
    assert read == want and len(want) > 20


def test_packing_names(spark, odd):
    got = packing.pack(odd.withColumnsRenamed({"lang": "part", "labels": "ids", "score": "offset"}))
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and got.count() >= odd.count()
    with pytest.raises(ValueError, match="result column"):
        packing.pack(odd.withColumnRenamed("doc_id", "part"), id_col="part")
