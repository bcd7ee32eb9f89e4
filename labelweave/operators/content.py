"""Polymorphic message content: a string, or a list of image and text parts.

In a DataFrame a message is ``struct<role, content, parts>``: ``content`` holds a
string, ``parts`` a list, and at most one of the two is set. In a JSON line there
is one field ``content`` whose value is the string, the list or null. Reading
takes the value as a VARIANT, so a string that looks like a list stays a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.text import strip_ws
from labelweave.sources.files import read_jsonl_parts

PART_T = "struct<type:string,text:string,image_url:struct<url:string>>"
MESSAGE_T = f"struct<role:string,content:string,parts:array<{PART_T}>>"
LINE_T = "meta_id string, group_id string, original_meta_id string, messages array<struct<role:string,content:variant>>"


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"),
                    F.lit(None).cast("struct<url:string>").alias("image_url"))


def union_messages(records: DataFrame) -> DataFrame:
    """Records of ``build_records``, whose images are in a side column ``parts``, with the parts inside the
    user message: images in frame order, then the text. Without images the content stays a string."""
    parts = F.col("parts") if "parts" in records.columns else F.lit(None)
    parts = parts.cast(f"array<{PART_T}>")
    one = F.transform("messages", lambda m: F.struct(
        m["role"].alias("role"),
        F.when((m["role"] == "user") & parts.isNotNull(), F.lit(None)).otherwise(m["content"]).alias("content"),
        F.when(m["role"] == "user", parts).alias("parts")))
    return records.withColumn("messages", one).drop("parts")


def _json_string(c: Column) -> Column:
    """A JSON string literal, or null as ``null``."""
    obj = F.to_json(F.struct(c.alias("v")))         # {"v":"..."}
    inner = F.transform(F.array(obj), lambda o: F.substring(o, F.lit(6), F.length(o) - 6))[0]     # the JSON is made once
    return F.when(c.isNull(), F.lit("null")).otherwise(inner)


def message_json(m: Column) -> Column:
    content = F.when(m["parts"].isNotNull(), F.to_json(m["parts"])).otherwise(_json_string(m["content"]))
    return F.concat(F.lit('{"role":'), _json_string(m["role"]), F.lit(',"content":'), content, F.lit("}"))


def record_json(records: DataFrame, nulls: bool = False) -> Column:
    """One line per record: its other columns in order (null ones only with ``nulls``), then its messages."""
    other = [c for c in records.columns if c != "messages"]
    head = F.to_json(F.struct(*other), {"ignoreNullFields": str(not nulls).lower()}) if other else F.lit("{}")
    messages = F.when(F.col("messages").isNull(), F.lit("null")).otherwise(F.concat(
        F.lit("["), F.array_join(F.transform("messages", message_json), ","), F.lit("]")))
    open_end = F.substring(head, F.lit(1), F.length(head) - 1)
    return F.concat(open_end, F.when(F.length(head) > 2, F.lit(",")).otherwise(F.lit("")),
                    F.lit('"messages":'), messages, F.lit("}"))


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chat records as JSON lines; ``content`` is a string or a list, whichever the message has."""
    rows = union_messages(records) if "parts" not in records.schema["messages"].dataType.elementType.names else records
    rows.select(record_json(rows).alias("value")).write.mode(mode).text(path)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chat records, bad lines); messages are ``struct<role, content, parts>``. Content that is neither a string nor a list
    of parts is kept as its JSON text."""
    good, bad = read_jsonl_parts(spark, path, LINE_T)

    def message(m):
        kind = F.schema_of_variant(m["content"])
        parts = F.when(kind.startswith("ARRAY"), F.try_variant_get(m["content"], "$", f"array<{PART_T}>"))
        text = F.when(kind == "STRING", F.variant_get(m["content"], "$", "string")).when(
            (kind != "VOID") & parts.isNull(), F.to_json(m["content"]))
        return F.struct(m["role"].alias("role"), text.alias("content"), parts.alias("parts"))

    return good.withColumn("messages", F.transform("messages", message)), bad


def message_text(m: Column) -> Column:
    """The text of a message: its string, or its text parts joined by a blank line."""
    texts = F.filter(F.transform(m["parts"], lambda p: F.when(p["type"] == "text", p["text"])), lambda t: t.isNotNull())
    return F.when(m["parts"].isNotNull(), F.array_join(texts, "\n\n")).otherwise(F.coalesce(m["content"], F.lit("")))


def user_text(messages: Column) -> Column:
    """The texts of the user messages joined by a blank line, stripped; lists give their text parts."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    return strip_ws(F.array_join(F.transform(users, message_text), "\n\n"))


def force_parts(records: DataFrame) -> DataFrame:
    """If any message of any record is a list, every other content becomes a list of one text part."""
    some = records.filter(F.exists("messages", lambda m: m["parts"].isNotNull())).limit(1).count()
    if not some:
        return records
    return records.withColumn("messages", F.transform("messages", lambda m: F.struct(
        m["role"].alias("role"), F.lit(None).cast("string").alias("content"),
        F.coalesce(m["parts"], F.array(text_part(F.coalesce(m["content"], F.lit(""))))).alias("parts"))))
