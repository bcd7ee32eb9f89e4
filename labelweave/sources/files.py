"""File sources and sinks.

Readers return DataFrames with explicit schemas where the shape is known
(raw / parsed / merged predictions, chat records); ids are always read as
strings so 19-digit ids never pass through a float.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from fnmatch import fnmatchcase
from functools import reduce
from itertools import groupby, islice

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.functions.jsonfix import JSON_OPTS
from labelweave.functions.text import compute_once, norm_columns, strip_ws

RAW_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("meta_id", T.StringType()),
    T.StructField("raw", T.StringType()), T.StructField("attempt", T.IntegerType()),
    T.StructField("latency_s", T.DoubleType()), T.StructField("model", T.StringType()),
    T.StructField("finish_reason", T.StringType()), T.StructField("truncated", T.BooleanType()),
    T.StructField("max_tokens_used", T.IntegerType()), T.StructField("group_id", T.StringType())])

PARSED_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("meta_id", T.StringType()),
    T.StructField("original_meta_id", T.StringType()), T.StructField("parsed", T.BooleanType()),
    T.StructField("raw", T.StringType()), T.StructField("json", T.MapType(T.StringType(), T.StringType())),
    T.StructField("group_id", T.StringType()), T.StructField("mode", T.StringType())])

MERGED_SCHEMA = T.StructType([
    T.StructField("meta_id", T.StringType()), T.StructField("parsed", T.BooleanType()),
    T.StructField("complete", T.BooleanType()),
    T.StructField("groups_present", T.ArrayType(T.StringType())),
    T.StructField("json", T.MapType(T.StringType(), T.StringType()))])

RECORD_SCHEMA = T.StructType([
    T.StructField("meta_id", T.StringType()), T.StructField("group_id", T.StringType()),
    T.StructField("original_meta_id", T.StringType()),
    # content is read as a string; list content comes back as its JSON text
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))])

SEPARATORS = (",", "\t", ";", "|")


class JsonlError(ValueError):
    pass


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without U+2028/U+2029, with their file, the file part they were read from and a number that
    counts up inside the part."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"),
        F.monotonically_increasing_id().alias("_nr"),
        F.replace(F.replace("value", F.lit("\u2028"), F.lit("")), F.lit("\u2029"), F.lit("")).alias("_line"))


def _with_line_numbers(bad: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``line_no`` to some of ``lines``: lines per file part are counted, and a prefix sum per file gives the
    number of the part's first line. One row per file part is shuffled, no line."""
    parts = lines.groupBy("_file", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_nr").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_file", "_part", "_first", before.alias("_before"))
    return bad.join(parts, ["_file", "_part"]).withColumn("line_no", F.col("_before") + F.col("_nr") - F.col("_first") + 1)


_END = "$labelweave-end$"


def read_jsonl_parts(spark: SparkSession, path: str,
                     schema: T.StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines as file, line_no, line). A line is good if it is exactly one JSON object; blank lines are skipped.

    A line is parsed once, as the first element of a list whose second element is a mark: only if the
    line is one value does the mark come second. The record is that first element."""
    lines = _json_lines(spark, path)
    if schema is None:
        schema = spark.read.json(path).schema
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.ArrayType(T.StructType([*schema.fields, T.StructField(_END, T.StringType())]))
    body = F.col("_body")
    parsed = F.from_json(F.concat(F.lit("["), body, F.lit(',{"%s":""}]' % _END)), marked, JSON_OPTS)
    whole = compute_once(lines.filter(F.ltrim("_line", F.lit("\r\n")) != ""), _body=strip_ws("_line"))
    whole = whole.select("*", F.explode(F.array(F.struct(
        F.when(body.startswith("{") & body.endswith("}"), parsed).alias("a")))).alias("_p"))
    end = F.get("_p.a", F.lit(1))
    ok = F.coalesce((F.size("_p.a") == 2) & end[_END].isNotNull() & F.get("_p.a", F.lit(0))[_END].isNull(), F.lit(False))
    first = F.get("_p.a", F.lit(0))
    good = whole.filter(ok).select(*[first[f.name].alias(f.name) for f in schema.fields])
    bad = _with_line_numbers(whole.filter(~ok), lines)
    return good, bad.select(F.col("_file").alias("file"), "line_no", F.col("_line").alias("line"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None,
               strict: bool = True) -> DataFrame:
    """JSON lines; U+2028/U+2029 removed, blank lines skipped. With ``strict``
    a line that is not exactly one JSON object raises with its file, number and text
    (first offenders only — the check is one filtered job); without, such
    lines are left out (``read_jsonl_parts`` returns them)."""
    good, bad = read_jsonl_parts(spark, path, schema)
    if strict:
        first = bad.limit(3).collect()
        if first:
            raise JsonlError(_told(first))
    return good


def _told(bad: list) -> str:
    return "invalid JSON: " + "; ".join(f"{r['file']}:{r['line_no']}: {r['line'][:200]!r}" for r in bad)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with explicit nulls (Spark drops null fields by default)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def sniff_delimiter(spark: SparkSession, path: str, sample_chars: int = 2048) -> str:
    """Pick among , TAB ; | from the first ``sample_chars`` characters:
    the candidate present with the same count on every sampled line (most
    occurrences first); default ','."""
    head = spark.read.text(path).select(F.substring("value", 1, sample_chars + 1).alias("value")).limit(sample_chars).collect()
    text = "\n".join(r["value"] for r in head)[:sample_chars]           # that many characters need no more lines
    lines = [ln for ln in text.split("\n") if ln.strip()]
    if len(lines) > 1 and not text.endswith("\n"):
        lines = lines[:-1]
    best, best_n = ",", 0
    for sep in SEPARATORS:
        counts = [ln.count(sep) for ln in lines]
        if counts and counts[0] > 0 and len(set(counts)) == 1 and counts[0] > best_n:
            best, best_n = sep, counts[0]
    return best


_BAD = "_corrupt_row"
# types a column may get, narrowest first: (type, what its values look like)
CSV_TYPES = (
    ("int", r"^[+-]?[0-9]{1,9}$"),
    ("bigint", r"^[+-]?[0-9]{1,18}$"),
    ("double", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^(NaN|[+-]?Inf(inity)?)$"),
    ("boolean", r"^(?i)(true|false)$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}.*$"),
)


def _odd_values(c: Column, kind: str, looks: str) -> Column:
    """Number of values that are not of a type."""
    return F.count_if(c.isNotNull() & ~(c.rlike(looks) & c.try_cast(kind).isNotNull()))


def read_csv_parts(spark: SparkSession, path: str, sep: str | None = None, infer: bool = False,
                   multi_line: bool = False, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, bad rows as ``line``) of a header CSV.

    Tolerance ladder over whole files, not over their first row: quoted
    reading if no row has too few or too many fields, else without quoting and
    with '\\' as escape, else, if nothing fits then, quoted reading again. Rows
    that do not fit the rung taken are returned, never dropped. Columns stay
    strings unless ``infer`` (types from all rows, found in the same pass that counts the rows of a rung).
    Files are split among
    tasks unless ``multi_line`` (line breaks inside quotes) is asked for.
    ``names``: column names of files without a header."""
    def reader(**opts):
        r = spark.read.option("header", names is None).option("multiLine", multi_line)
        for k, v in {"sep": sep, **opts}.items():
            r = r if v is None else r.option(k, v)
        return r

    def rung(**opts):
        cols = names or reader(**opts).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cols, _BAD]])
        # without pruning: a reader of some columns would not notice that a row has too many
        df = reader(**opts, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, columnPruning=False).schema(schema).csv(path)
        # the reader wants another column next to that of bad rows: every use reads the first one too
        read = F.coalesce(F.length(F.col(f"`{cols[0]}`")) >= 0, F.lit(True))
        bad = read & F.col(_BAD).isNotNull()
        found = []
        for k, c in enumerate(cols if infer else []):
            value = F.when(~bad, F.col(f"`{c}`"))
            found += [F.count(value).alias(f"n{k}"), *[_odd_values(value, kind, looks).alias(f"{kind}{k}") for kind, looks in CSV_TYPES]]
        n = df.agg(F.count_if(bad).alias("bad"), F.count_if(read & ~bad).alias("good"), *found).first()
        return cols, df, read, bad, n

    chosen = rung()
    if chosen[4]["bad"]:
        plain = rung(quote="", escape="\\")
        chosen = plain if plain[4]["good"] else chosen
    cols, df, read, bad, n = chosen
    types = {}
    for k, c in enumerate(cols if infer else []):
        fits = next((kind for kind, _ in CSV_TYPES if n[f"n{k}"] and not n[f"{kind}{k}"]), None)
        if fits:
            types[c] = fits
    good = df.filter(read & ~bad).select(*[
        F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in cols])
    return good, df.filter(bad).select(F.col(_BAD).alias("line"))


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Some line holds an odd number of quotes: a quoted field goes on in the next line."""
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    return bool(spark.read.text(path).filter(odd).limit(1).count())


def read_csv(spark: SparkSession, path: str, sep: str | None = None, infer: bool = False,
             multi_line: bool = False) -> DataFrame:
    """The rows of ``read_csv_parts``."""
    return read_csv_parts(spark, path, sep, infer, multi_line)[0]


def read_label_csv(spark: SparkSession, path: str, video_col: str = "video",
                   stance_col: str | None = None) -> DataFrame:
    """S4 + S6: read; if the header looks broken (all digits) or required
    columns are missing, re-read with the sniffed delimiter."""
    df = read_csv(spark, path, infer=True)
    cols = df.columns
    broken = cols and all(c.isdigit() for c in cols)
    has_stance = any(c in cols for c in ("china_stance_score", "pol", stance_col) if c)
    if broken or video_col not in cols or not has_stance:
        df = read_csv(spark, path, sep=sniff_delimiter(spark, path), infer=True)
    return df


def load_table(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """S3: by extension; column names normalised (P1). A CSV file is split among tasks unless some
    quoted field holds a line break; with ``multi_line`` None one scan of its lines finds out."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".parquet":
        return norm_columns(spark.read.parquet(path))
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    return norm_columns(read_csv(spark, path, multi_line=multi_line))


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite") -> None:
    """Header CSV; QUOTE_ALL with '\\' escape when asked.
    Complex columns are serialised as JSON text first."""
    out = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                      if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(f.name)
                      for f in df.schema.fields])
    w = out.write.mode(mode).option("header", True)
    if quote_all:
        w = w.option("quoteAll", True).option("escape", "\\")
    w.csv(path)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    """Sink by extension (parquet | csv | jsonl)."""
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        write_csv(df, path, quote_all=True, mode=mode)
    elif fmt in ("jsonl", "json"):
        write_jsonl(df, path, mode)
    else:
        raise ValueError(f"unsupported output format {fmt!r}")


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path for Python's own file calls if Spark takes it from the local (or a mounted) file system, else None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{[\]^]""")


def write_small_files(df: DataFrame, path: str, keys: list[str], tasks: int) -> None:
    """``df.write.partitionBy(*keys).text(path)`` for about as many files as rows: rows (keys, ``value``) are dealt by the first key
    to ``tasks`` tasks, and all values of the same keys become the lines of one file.

    On a local or mounted file system Python writes them: without its native library Hadoop starts a process per file to
    set permissions and adds a file of checksums, tens of milliseconds each. A file is written under a hidden
    name and then renamed, so another attempt of its task replaces it whole."""
    text = [F.col(k).cast("string") for k in keys]
    rows = df.select(*[F.when(t != "", t).alias(k) for k, t in zip(keys, text, strict=True)], "value").repartition(tasks, keys[0])
    root = local_path(df.sparkSession, path)
    if root is None:
        rows.write.partitionBy(*keys).text(path)
        return
    os.makedirs(root)
    run = uuid.uuid4().hex

    def folder_of(key, value):
        """As Spark names the folder of a partition."""
        return f"{key}=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__")

    def write(batches):
        import pyarrow as pa

        context, n = TaskContext.get(), 0
        name = f"part-{context.partitionId():05d}-{run}.txt"
        hidden = f".{name}.{context.taskAttemptId()}"
        lines = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for of, same in groupby(lines, lambda row: row[:-1]):
            folder = "/".join([root, *map(folder_of, keys, of)])
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{hidden}", "wb") as file:
                for row in same:
                    file.write((row[-1] or "").encode() + b"\n")
            os.replace(f"{folder}/{hidden}", f"{folder}/{name}")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.sortWithinPartitions(*keys, "value").mapInArrow(write, "n long").agg(F.sum("n")).collect()


_FILES_AT_ONCE, _BYTES_AT_ONCE = 10_000, 16 << 20


def read_small_files(spark: SparkSession, path: str, glob: str, tasks: int | None = None) -> DataFrame:
    """``path`` and ``content`` of every file at any depth under a folder whose name fits ``glob``, as the source
    ``binaryFile`` reads them: without empty files and those whose name, or a folder's, begins with '.', or with '_' and has no '='.

    That source holds every file's status on the driver and reads 32 files a task at most, as each counts 4 MB; it remains for
    other than local or mounted file systems and for patterns beyond * and ?. There Python lists and reads: each task takes its
    share of the entries of ``path`` and lists all below them; the files found are dealt anew, so neither the driver nor one
    task holds the list."""
    root = local_path(spark, path)
    if root is None or re.search(r"[*?{}\[\]\\]", path) or re.search(r"[{}\[\]\\]", glob) or not os.path.isdir(root):
        return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    at_once, most = _FILES_AT_ONCE, _BYTES_AT_ONCE

    def below(folder, share=None):
        with os.scandir(folder) as entries:
            for e in entries:
                if share is not None and zlib.crc32(os.fsencode(e.name)) % tasks != share:
                    continue
                hidden = e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_")
                if e.is_dir():
                    if not hidden or e.name.startswith(("_metadata", "_common_metadata")):
                        yield from below(e.path)
                elif not hidden and fnmatchcase(e.name, glob):
                    yield e.path

    def listed(batches):
        import pyarrow as pa

        found = (f for b in batches for share in b.column(0).to_pylist() for f in below(root, share))
        while names := list(islice(found, at_once)):
            yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})

    def read(batches):
        import pyarrow as pa

        def batch():
            return pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "content": pa.array(contents, pa.binary())})

        names, contents, size = [], [], 0
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with open(name, "rb") as file:
                content = file.read()
            if not content:
                continue
            names.append(f"file:{name}")
            contents.append(content)
            size += len(content)
            if size >= most or len(names) >= at_once:
                yield batch()
                names, contents, size = [], [], 0
        if names:
            yield batch()

    # of an RDD, whose size counts as unknown: by the size of a range all contents would be planned as a broadcast
    shares = spark.createDataFrame(spark.sparkContext.parallelize([(k,) for k in range(tasks)], tasks), "share int")
    names = shares.mapInArrow(listed, "path string")
    return names.repartition(tasks, "path").mapInArrow(read, "path string, content binary")


def model_name(path: str) -> str:
    """File name without its endings, other characters than word characters, '.' and '-' as '_'."""
    stem = os.path.basename(path.rstrip("/"))
    for ending in (".jsonl", ".parsed"):
        stem = stem.removesuffix(ending)
    return re.sub(r"[^\w.\-]+", "_", stem).strip("_") or "model"


def model_names(paths: list[str]) -> list[str]:
    """S12 + W6: one unique name per path; a taken name gets the next free number."""
    taken: set[str] = set()
    plain = [model_name(p) for p in paths]
    out = []
    for name in plain:
        new = name if name not in taken else next(
            c for k in range(2, len(paths) + 2) if (c := f"{name}_{k}") not in taken and c not in plain)
        taken.add(new)
        out.append(new)
    return out


def read_predictions(spark: SparkSession, paths: list[str], schema: T.StructType = PARSED_SCHEMA) -> DataFrame:
    """S12 + U1: one DataFrame of several models' prediction files with a
    ``model`` column (one scan per file, unioned by name). Bad lines of any file raise; all files are checked in one job."""
    parts = [read_jsonl_parts(spark, p, schema) for p in paths]
    bad = reduce(DataFrame.unionByName, [b for _, b in parts]).limit(3).collect()
    if bad:
        raise JsonlError(_told(bad))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        good.withColumn("model", F.lit(name)) for (good, _), name in zip(parts, model_names(paths), strict=True)])
