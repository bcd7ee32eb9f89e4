"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read back as the next
one's documents. All but the last return the columns of ``documents``.

Defined cases, for every stage: columns beyond those of ``documents`` are kept as they are, whatever their
names; a column ``n_chars`` is counted anew after the personal data went. A null or empty text fails the base rule of
the first stage; given to a later stage it stays (no words, no hits, no copies, packed as the end id alone). A text of any length is
taken whole. Of repeated rows or rows that tie, the near-copy stage keeps the one with the smallest id (null ids
last), then the first by its JSON text. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import decontaminate, ngram_join, packing, pii, quality_rules
from labelweave.llm.common import bare
from labelweave.session import checkpoint_dir, configure


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or an adaptive cutoff rejects go."""
    plain, (text, lang, source) = bare(docs, "text", "lang", "source")
    return quality_rules.apply(plain, text, lang, source).filter("kept").select(*plain.columns).toDF(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return ngram_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain, (text,) = bare(docs, "text")
    found = decontaminate.decontaminate(plain, benchmark, text)
    return found.filter("NOT contaminated").select(*plain.columns).toDF(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, disclosing words are generalised or removed; ``n_chars`` follows the text."""
    plain, (text,) = bare(docs, "text")
    clean = pii.sanitise(plain, text).select(*plain.columns).toDF(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("ngram_join", ngram_join_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# the stages of similarity and tokens are beyond SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder."""
    configure(spark)
    home = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
