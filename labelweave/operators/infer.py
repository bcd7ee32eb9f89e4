"""Batched model scoring through a pluggable callable (F1).

``score_batches`` runs the model over Arrow batches with a bounded window of
calls in flight per task; repartition the records to set the number of tasks. Each row: call, and on failure retry with linear back-off
(``base_sleep * attempt``); when the answer looks truncated, append a
re-emit instruction and grow the token budget (``min(int(cur * growth), cap)``);
after the last attempt the row carries ``<<REQUEST FAILED: ...>>`` instead
of failing the job. The per-row loop is the model call itself — the only
Python on this path.
"""

from __future__ import annotations

import itertools
import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelweave.operators.records import prompt_messages

OUT_SCHEMA = ("idx long, meta_id string, raw string, attempt int, latency_s double, model string, "
              "finish_reason string, truncated boolean, max_tokens_used int, group_id string")

# fixed instruction appended before a retry of a truncated answer
REEMIT = "Your previous answer was cut off. Send only the final minified JSON object again, nothing else."

OUT_ROWS = 256       # answers handed on at a time

ModelFn = Callable[[list[dict], int], tuple[str, str | None]]


@dataclass(frozen=True)
class RetryPolicy:
    max_tokens: int = 128
    retries: int = 3
    base_sleep: float = 1.0
    retry_on_truncation: bool = True
    growth: float = 1.5
    max_tokens_cap: int = 1024


def looks_truncated(text: str | None, finish_reason: str | None) -> bool:
    """P39 inside a call: cut by the token limit, empty, an object left open, or ending in the middle of one."""
    if (finish_reason or "").lower() == "length" or not isinstance(text, str) or text == "":
        return True
    body = re.sub(r"^[\s\S]*?```(?:json|JSON)?\s*([\s\S]*?)\s*```[\s\S]*$", r"\1", text)
    return body.count("{") > body.count("}") or body.rstrip()[-1:] in tuple("{[:,")


@dataclass
class Call:
    """State of one prompt: what was tried, and what to do next."""

    policy: RetryPolicy
    messages: list[dict]
    budget: int
    attempt: int = 0

    def retry_after(self, cut: bool, error: Exception | None) -> float | None:
        """Seconds to wait before another attempt, None to stop; grows the budget of a cut answer."""
        last = self.attempt >= self.policy.retries if error else self.attempt > self.policy.retries
        if last or not (cut or error):
            return None
        if cut:
            self.messages = [*self.messages, {"role": "system", "content": REEMIT}]
            self.budget = min(int(self.budget * self.policy.growth), self.policy.max_tokens_cap)
        return self.policy.base_sleep * self.attempt


def _call_one(fn: ModelFn, msgs: list[dict], policy: RetryPolicy, sleep=time.sleep):
    call = Call(policy, msgs, policy.max_tokens)
    wait: float | None = 0.0
    while wait is not None:
        if call.attempt:
            sleep(wait)
        call.attempt += 1
        began, budget, error, text, reason = time.time(), call.budget, None, None, None
        try:
            text, reason = fn(call.messages, budget)
        except Exception as e:  # noqa: BLE001
            error = e
        took = round(time.time() - began, 3)
        cut = error is None and policy.retry_on_truncation and looks_truncated(text, reason)
        wait = call.retry_after(cut, error)
    if error:
        return f"<<REQUEST FAILED: {error}>>", call.attempt, took, None, None, call.budget
    return text, call.attempt, took, reason, cut, budget


def score_batches(records: DataFrame, model_fn: ModelFn, model: str,
                  policy: RetryPolicy = RetryPolicy(), in_flight: int = 1) -> DataFrame:
    """chat records (idx, meta_id, messages[, group_id]) -> raw answers.

    A task keeps up to ``in_flight`` calls running (in threads: a call waits for
    its answer, it does not compute). Answers come out in the order of the
    rows; a further row is only read when the oldest call has ended, so a slow
    answer holds back the reading and a task never holds more than ``in_flight`` rows
    besides its batch. Calls at once over the cluster: running tasks x ``in_flight``."""
    prompts = records.select(
        F.col("idx").cast("long").alias("idx"), F.col("meta_id").cast("string").alias("meta_id"),
        (F.col("group_id") if "group_id" in records.columns else F.lit(None).cast("string")).alias("group_id"),
        F.to_json(prompt_messages(F.col("messages"), "drop_last_if_assistant")).alias("prompt"))
    schema = to_arrow_schema(T.StructType.fromDDL(OUT_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for at in range(0, b.num_rows, OUT_ROWS):
                    yield from b.slice(at, OUT_ROWS).to_pylist()

        def ask(r: dict) -> tuple:
            text, att, lat, fr, tr, cur = _call_one(model_fn, json.loads(r["prompt"]) if r["prompt"] else [], policy)
            return r["idx"], r["meta_id"], text, att, lat, model, fr, tr, cur, r["group_id"]

        for done in itertools.batched(in_order(ask, rows(), in_flight), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)],
                                             schema=schema)

    return prompts.mapInArrow(run, OUT_SCHEMA)


def in_order(fn: Callable, rows: Iterator, most: int) -> Iterator:
    """fn(row) of every row, in order, with at most ``most`` running at a time."""
    if most <= 1:
        yield from map(fn, rows)
        return
    with ThreadPoolExecutor(most) as pool:
        running: deque = deque()
        try:
            for r in rows:
                if len(running) == most:
                    yield running.popleft().result()
                running.append(pool.submit(fn, r))
            while running:
                yield running.popleft().result()
        finally:
            for f in running:
                f.cancel()


def echo_model(messages: list[dict], max_tokens: int) -> tuple[str, str | None]:
    """Deterministic stand-in model for tests and the catalogue: answers from
    the user text length; answers cut at 24 characters when the budget is the
    initial 128 and the length is a multiple of 5 (exercises the retry)."""
    user = next((m.get("content") or "" for m in messages if m.get("role") == "user"), "")
    n = len(user)
    stance = ((n * 37) % 201 - 100) / 100
    sens = "yes" if n % 3 == 0 else "no"
    ans = '{"china_stance_score":%s,"china_sensitive":"%s"}' % (repr(stance), sens)
    if n % 5 == 0 and max_tokens <= 128:
        return ans[:24], "length"
    return ans, "stop"
