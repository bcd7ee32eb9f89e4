"""Shared pieces of the operators: reading tables, cutting lineage, adding columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelweave.session import checkpoint_dir

WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


def word_list(c):
    """The contract's words of a text column (null: none), as an array."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(WORD_RE), F.lit(0))


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at a
    table that outlives any executor. The folder is the session's checkpoint folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/labelweave-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_hash(c, mod: int):
    """crc32 of the id as text, mod ``mod``: the contract's held-out folds."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(mod))


def without(df: DataFrame, names: list[str], needed: list[str]) -> DataFrame:
    """Drop input columns that a result column replaces; the operator's inputs may not be among them."""
    low = {n.lower() for n in names}
    if clash := [c for c in needed if c.lower() in low]:
        raise ValueError(f"input columns {clash} have the names of result columns")
    return df.drop(*[c for c in df.columns if c.lower() in low])


def bare(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ..., and the new names of the ``needed`` ones: no column can clash
    with an operator's. ``.toDF(*df.columns)`` gives the names back."""
    own = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*own), [own[df.columns.index(c)] for c in needed]


def add_columns(df: DataFrame, new: str, text_col: str,
                fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
                keep: list[str] | None = None, slicer=None) -> DataFrame:
    """Append the columns of schema ``new``, computed by ``fn`` on slices of Arrow batches.

    ``keep``: input columns of the result (default all). Input columns that have
    the name of a new one are replaced."""
    from labelweave.llm import textkit

    add = StructType.fromDDL(new)
    df = without(df, add.names, [text_col])
    cols = keep if keep is not None else df.columns
    df = df.select(*dict.fromkeys([*cols, text_col]))
    out = StructType([df.schema[c] for c in cols] + list(add.fields))
    names = [f.name for f in add.fields]
    cut_up = slicer or textkit.slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in cut_up(whole, text_col):
                got = fn(b)
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index(c)) for c in cols] + [got[n] for n in names],
                    names=[*cols, *names])
        pa.default_memory_pool().release_unused()       # the worker serves other tasks next

    return df.mapInArrow(run, out)
