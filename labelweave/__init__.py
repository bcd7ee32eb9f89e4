"""labelweave — label, parse and evaluate datasets as Spark DataFrame jobs.

Layout:
  sources/    readers and writers (JSONL, CSV, Parquet, frames) and the
              driver-table stand-ins used by tests and the query catalogue
  functions/  Column-expression builders (normalisers, JSON repair,
              validation, metric aggregates) — no Python UDFs
  operators/  DataFrame -> DataFrame operators (split, records, parse,
              merge, scoring, bootstrap, compare, usage, inference)
  plans/      the registered query catalogue (Spark plan + DuckDB oracle)
  streaming/  Structured Streaming variants (monitor, parse, merge)
"""

from labelweave.session import configure, get_session  # noqa: F401
from labelweave.codebook import Codebook, default_codebook  # noqa: F401

__all__ = ["configure", "get_session", "Codebook", "default_codebook"]
