"""Structured Streaming path for answers that land over time (ST1–ST3).

- ``watch``           (ST1): polls the landing folder with triggers that drain
  what has arrived, and stops when the expected number has landed or when the
  count has stayed the same for a number of polls. The count, the last count
  and the polls without change live in the query's checkpoint folder, so a
  watch that is started again goes on where it was.
- ``progress_query``  (ST1): the running count of landed answers vs. the
  expected total (complete-mode aggregate) that ``watch`` is built on.
- ``parse_stream``    (ST2): each micro-batch is parsed with the batch
  operator and appended to a parsed sink and a quarantine sink. Writes go to
  ``<out>/batch_id=<id>`` with overwrite, so a replayed batch after a failure
  rewrites the same folder (idempotent, exactly-once with the checkpoint).
- ``merge_stream``    (ST3): per-item group completeness by event time, with
  bounded state (one entry per dimension group). An item comes out when its
  last group arrives, again as a correction when a later answer changes it, and
  as a partial record when the watermark passes its time-out; then its state
  goes. ``latest_merged`` keeps the last record of each item.

Event time is the time a row carries (``arrived``) or else the time its file
was written. The watermark only moves with data, so a feed that ends is closed
by ``close_landing``: one row without an answer whose time lies past every time-out.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor,
                                                            StatefulProcessorHandle, TimerValues)

from labelweave.codebook import Codebook, default_codebook
from labelweave.operators.parse import parse_predictions
from labelweave.sources.files import RAW_SCHEMA

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
LANDING_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField("arrived", T.TimestampType())])


def raw_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The landing folder's answers, with ``arrived`` (the row's own time, else the time its file was written)."""
    r = spark.readStream.schema(LANDING_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(landing_dir).withColumn("arrived", F.coalesce("arrived", F.col("_metadata.file_modification_time")))


def close_landing(spark: SparkSession, landing_dir: str, at: datetime) -> None:
    """Tell the streams that the feed has ended: a row without an answer, of time ``at``, moves the watermark."""
    rows = spark.createDataFrame([(at,)], "arrived timestamp").coalesce(1)
    rows.write.mode("append").json(landing_dir)


def progress_query(raw: DataFrame, expected: int) -> DataFrame:
    """ST1: landed / expected as a running aggregate. A row without position, id and answer (``close_landing``) does not count."""
    some = [F.col(c).cast("string") for c in ("idx", "meta_id", "raw") if c in raw.columns]
    return raw.agg(F.count(F.coalesce(*some)).alias("landed")).select(
        "landed", F.lit(expected).alias("expected"),
        (100.0 * F.col("landed") / F.lit(max(expected, 1))).alias("progress_pct"),
        (F.col("landed") >= F.lit(expected)).alias("done"))


def parse_stream(raw: DataFrame, out_dir: str, checkpoint: str, cb: Codebook | None = None,
                 group_mode: str | None = None, available_now: bool = True):
    """ST2: parse each micro-batch; parsed rows to ``out_dir/parsed``, bad
    rows to ``out_dir/quarantine``. Returns the started query."""
    cb = cb or default_codebook()

    def handle(batch: DataFrame, batch_id: int) -> None:
        p = parse_predictions(batch, cb, group_mode).persist()
        try:
            p.write.mode("overwrite").parquet(f"{out_dir}/parsed/batch_id={batch_id}")
            (p.filter(~F.col("parsed")).select("idx", "meta_id", "group_id", "raw")
             .write.mode("overwrite").parquet(f"{out_dir}/quarantine/batch_id={batch_id}"))
        finally:
            p.unpersist()

    w = raw.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")
    return w.start()


POLLS = "poll int, landed long, expected long, unchanged int, progress_pct double, reason string"


def watch(raw: Callable[[], DataFrame], home: str, expected: int, idle_polls: int = 10, poll_seconds: float = 60.0,
          sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """ST1: poll until ``expected`` answers have landed or ``idle_polls`` polls in a row brought none.

    ``raw`` makes the stream that is polled; ``home`` is a shared folder of this watch. A poll is one run of the counting query that
    drains what has landed. Returns one row per poll (also kept in ``home``); ``reason`` of the
    last one is 'expected' or 'idle', of the others null."""
    spark = raw().sparkSession
    path = f"{home}/polls"

    def known() -> list[Row]:
        try:
            return spark.read.schema(POLLS).parquet(path).orderBy("poll").collect()     # one row per poll
        except Exception as e:  # noqa: BLE001 - the first poll finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def count() -> int:
        seen: list[int] = []

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.select("landed").write.mode("overwrite").parquet(f"{home}/landed/batch={batch_id}")
            seen.append(batch_id)

        (progress_query(raw(), expected).writeStream.outputMode("complete").foreachBatch(keep)
         .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination())
        if seen:
            return spark.read.parquet(f"{home}/landed/batch={max(seen)}").first()["landed"]
        return polls[-1]["landed"] if polls else 0

    polls = known()
    while not polls or polls[-1]["reason"] is None:
        if polls:
            sleep(poll_seconds)
        landed = count()
        last = polls[-1] if polls else None
        unchanged = last["unchanged"] + 1 if last and last["landed"] == landed else 0
        reason = "expected" if landed >= expected else "idle" if unchanged >= idle_polls else None
        row = (len(polls) + 1, landed, expected, unchanged, 100.0 * landed / max(expected, 1), reason)
        one = spark.createDataFrame([row], POLLS)
        one.coalesce(1).write.mode("append").parquet(path)
        polls.append(one.first())
    return spark.read.schema(POLLS).parquet(path)


_SAID = ("meta_id string, version int, at_ms long, complete boolean, groups_present array<string>, "
         "missing_groups array<string>, json map<string,string>")
MERGE_OUT = _SAID.replace("at_ms long", "as_of timestamp")


class GroupMerge(StatefulProcessor):
    """State of one item: per group the first position, and the last answer with its position; and what was said last."""

    def __init__(self, expected: list[str], timeout_ms: int) -> None:
        self.expected, self.timeout_ms = expected, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "group_id string", "first long, pos long, text string, json string")
        self.said = handle.getValueState("said", "version int, record string")

    def close(self) -> None:
        pass

    def _held(self) -> dict[str, tuple]:
        return {k[0]: tuple(v) for k, v in self.answers.iterator()}      # at most one entry a group

    def _say(self, meta_id: str, answers: dict[str, tuple], at: int, partly: bool) -> Iterator[Row]:
        present = sorted(g for g in answers if g)
        missing = [g for g in self.expected if g not in present]
        if missing and not partly:
            return
        merged: dict[str, str] = {}
        # groups in the order of their first answers, those without a position before all others
        for _, a in sorted(answers.items(), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
            merged.update(json.loads(a[3]))
        record = json.dumps([present, merged])
        before = self.said.get() if self.said.exists() else None
        if before and before[1] == record:
            return
        version = before[0] + 1 if before else 1
        self.said.update((version, record))
        yield Row(meta_id=meta_id, version=version, at_ms=at, complete=not missing,
                  groups_present=present, missing_groups=missing, json=merged)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held, at = self._held(), 0
        changed = set()
        for r in rows:
            g = r.group_id or ""
            first, pos, text, answer = held.get(g, (None, None, None, None))
            if answer is None or (r.pos, r.text) >= (pos, text):
                pos, text, answer = r.pos, r.text, r.answer
            if r.idx is not None:
                first = r.idx if first is None else min(first, r.idx)
            held[g] = (first, pos, text, answer)
            changed.add(g)
            at = max(at, r.at_ms)
        for g in changed:
            self.answers.updateValue((g,), held[g])
        for t in list(self.handle.listTimers()):
            at = max(at, t - self.timeout_ms)
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at + self.timeout_ms)
        yield from self._say(key[0], held, at, False)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._say(key[0], self._held(), expiredTimerInfo.getExpiryTimeInMs(), True)
        self.answers.clear()
        self.said.clear()


def merge_stream(parsed: DataFrame, cb: Codebook | None = None, group_mode: str = "by-category",
                 timeout_ms: int = 10 * 60 * 1000, delay: str = "1 minute", time_col: str = "arrived") -> DataFrame:
    """ST3: merged records of a stream of parsed answers, by event time.

    An item's time-out runs from its latest answer. Answers without an id are left out; those without a
    position come before all others, among them by their text, as in the batch fold. Rows older
    than the watermark (the latest time less ``delay``) are dropped by Spark. An answer that comes after
    its item's time-out starts the item anew. Needs the RocksDB state store, which is set on the session."""
    cb = cb or default_codebook()
    expected = sorted(g.group_id for g in cb.group_configs(group_mode))
    parsed.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    usable = (F.col("parsed") & (F.coalesce(F.size("json"), F.lit(0)) > 0)
              & F.col("original_meta_id").isNotNull() & (F.col("original_meta_id") != ""))
    # a condition without the time column would be pushed below the watermark, and rows without an answer could not move
    # it; no time is before the one named here, so this keeps the condition above and changes nothing
    usable = F.coalesce(usable, F.lit(False)) | (F.unix_millis(time_col) < F.lit(-(1 << 62)))
    rows = parsed.withWatermark(time_col, delay).filter(usable).select(
        "original_meta_id", "group_id", F.col("idx").cast("long").alias("idx"),
        F.coalesce(F.col("idx").cast("long"), F.lit(-(1 << 63))).alias("pos"),
        F.when(F.col("idx").isNull(), F.to_json(F.struct("json"))).otherwise("").alias("text"),
        F.to_json("json").alias("answer"), F.unix_millis(time_col).alias("at_ms"), time_col)
    said = rows.groupBy("original_meta_id").transformWithState(
        GroupMerge(expected, timeout_ms), T.StructType.fromDDL(_SAID), "Append", "EventTime")
    return said.withColumn("at_ms", F.timestamp_millis("at_ms")).withColumnRenamed("at_ms", "as_of")


def latest_merged(said: DataFrame) -> DataFrame:
    """The last record of each item."""
    cols = [c for c in said.columns if c != "meta_id"]
    return said.groupBy("meta_id").agg(F.max_by(F.struct(*cols), F.struct("as_of", "version")).alias("r")).select("meta_id", "r.*")
