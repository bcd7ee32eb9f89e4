"""Chat formatting in budgeted windows (operator 12).

A conversation becomes windows of at most ``budget`` tokens. Every turn is in
exactly one window as new; a later window opens with the conversation's system
turn and as many of the turns just before it as fit ``history`` tokens. Only the
texts of new assistant turns are under the loss mask, so a repeated target is
context and is learnt once.

Template: ``<<SYS>>text<</SYS>>``, ``[INST]text[/INST]`` and ``<s>text</s>`` for
system, user and assistant, ``[ROLE]role[:]text[/ROLE]`` for any other role, each
followed by a line break. Inside a text backslashes are doubled and a backslash
is put after the first character of each control string, so no text can forge a
mark and ``unescape`` gives it back.

1. Turns are dealt by ranges of (conversation, turn), so a conversation of any
   length spreads over tasks. Each task formats its turns, counts their tokens
   and sums them up from the start of the conversation or of the range. Only a
   conversation that goes on from an earlier range needs a carry: at most one a
   range, a table no longer than the number of ranges, which is broadcast.
2. The exact prefix sums cut a conversation into segments of ``SEGMENT`` budgets.
   A segment also gets the turns just before it (the history) and the system
   turn; it is the largest thing that a task holds.
3. Inside a segment each window's end is found by a search in the prefix sums.

Line breaks between turns are white space to the tokenizer, so the tokens of a
window are the sum of its turns'. ``read_back`` parses windows again.

Defined cases: a null text is empty, a null role is the empty role, rows with a
null conversation are one conversation. Turns that tie are ordered by role, then
by a hash of the text, null turns first; a repeated row is a turn of its own. A
text of any length stays whole: a turn beyond the budget makes a window of its
own, marked ``over_budget``. Only a conversation's very first turn is kept as its
system turn; a later one is a turn like others. An empty table gives an empty
result. Extra columns are ignored, whatever their names; a conversation column
named like a result column is an error.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelweave.llm.common import cut, table
from labelweave.llm.packing import TextIds
from labelweave.llm.registry import query

BUDGET = 2048
HISTORY = 256
SEGMENT = 64            # budgets of one segment
_AT_ONCE = 2000         # turns formatted at a time

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[:]", "[/ROLE]")
_CONTROL = re.compile("|".join(re.escape(m) for m in [*sum(MARKS.values(), ()), *OTHER]))
_TURN = re.compile("|".join(
    [f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}\n" for role, (a, b) in MARKS.items()]
    + [f"{re.escape(OTHER[0])}(?P<role>.*?){re.escape(OTHER[1])}(?P<other>.*?){re.escape(OTHER[2])}\n"]), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its (escaped) text starts and ends in it."""
    body = escape(text)
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    return f"{head}{body}{tail}\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        kind = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a formatted conversation")
    return turns


def spans(tokens: np.ndarray, first: int, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """Windows over turns in order: (first repeated turn, first new turn, end).

    ``first``: the first turn that may be new; those before it are history only.
    ``system``: tokens of the system turn that each window retains."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    out, i, n = [], first, len(tokens)
    while i < n:
        lead = int(np.searchsorted(total, total[i] - history))
        fits = int(np.searchsorted(total, total[i + 1] + system - budget))     # later starts leave room for turn i
        lead = min(i, max(lead, fits))
        end = int(np.searchsorted(total, total[lead] + budget - system, "right")) - 1
        end = max(end, i + 1)
        out.append((lead, i, end))
        i = end
    return out


_TURNS = ("role string, form string, body_from int, body_to int, tokens long, part int, row_in_part long, "
          "pos long, before long")


def _counted(ranged: DataFrame, spec) -> DataFrame:
    """Format each turn, count its tokens and sum them up inside the task's range."""
    schema = StructType([ranged.schema["conv"], *StructType.fromDDL(_TURNS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        text_ids = TextIds(spec.value)
        part, row, now, pos, before = TaskContext.get().partitionId(), 0, object(), 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, _AT_ONCE):
                b = whole.slice(at, _AT_ONCE)
                convs = b.column("conv").to_pylist()
                roles = [r or "" for r in b.column("role").to_pylist()]
                made = [format_turn(r, t or "") for r, t in zip(roles, b.column("text").to_pylist(), strict=True)]
                forms = pa.array([m[0] for m in made], pa.string())
                counts = [n - 1 for _, _, off in text_ids(forms) for n in np.diff(off).tolist()]     # less the end id
                places, sums = [], []
                for c, n in zip(convs, counts, strict=True):
                    if c != now:
                        now, pos, before = c, 0, 0
                    places.append(pos)
                    sums.append(before)
                    pos += 1
                    before += n
                n = len(convs)
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv"), pa.array(roles, pa.string()), forms,
                     pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32()),
                     pa.array(counts, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()),
                     pa.array(places, pa.int64()), pa.array(sums, pa.int64())], names=schema.names)
                row += n

    return ranged.mapInArrow(run, schema)


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their number and prefix sum in the whole conversation."""
    heads = turns.filter("row_in_part = 0").select(F.col("conv").alias("head")).distinct()     # one a range
    crossing = turns.select("conv", "part", "tokens").join(F.broadcast(heads), F.col("conv").eqNullSafe(F.col("head")), "left_semi")
    each = crossing.groupBy("conv", "part").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    so_far = "OVER (PARTITION BY conv ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = each.selectExpr("conv AS _c", "part AS _p", f"sum(t) {so_far} AS t0", f"sum(n) {so_far} AS n0").filter("n0 > 0")
    same = turns["conv"].eqNullSafe(F.col("_c")) & (turns["part"] == F.col("_p"))
    return turns.join(F.broadcast(carry), same, "left").selectExpr(
        "conv", "role", "form", "body_from", "body_to", "tokens", "pos + coalesce(n0, 0) AS turn_no",
        "before + coalesce(t0, 0) AS before")


_WINDOW = ("window long, n_new long, n_repeated long, n_tokens long, over_budget boolean, text string, "
           "loss array<struct<start:long,end:long>>")


def _windows(rows: DataFrame, conv_col: str, budget: int, history: int) -> DataFrame:
    """Rows come sorted by conversation, segment and turn; a segment's rows are held at a time."""
    out = StructType.fromDDL(_WINDOW)
    schema = StructType([rows.schema["conv"], *out.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def of_segment(conv, turns: list[dict]) -> Iterator[tuple]:
        turns = [t for k, t in enumerate(turns) if k == 0 or t["turn_no"] != turns[k - 1]["turn_no"]]
        head = turns[0] if turns[0]["turn_no"] == 0 and turns[0]["role"] == "system" else None
        rest = turns[1:] if head else turns
        tokens = np.array([t["tokens"] for t in rest], np.int64)
        first = sum(not t["new"] for t in rest)
        cost = head["tokens"] if head else 0
        found = spans(tokens, first, cost, budget, history)
        if head and head["new"] and not found:
            found = [(0, 0, 0)]      # the system turn alone
        for lead, i, end in found:
            opens = bool(head and head["new"] and i == 0)      # the window that says the system turn first
            used = ([head] if head else []) + rest[lead:end]
            repeated = i - lead + (1 if head and not opens else 0)
            text, loss, at = [], [], 0
            for k, t in enumerate(used):
                if k >= repeated and t["role"] == "assistant":
                    loss.append({"start": at + t["body_from"], "end": at + t["body_to"]})
                text.append(t["form"])
                at += len(t["form"])
            n = sum(t["tokens"] for t in used)
            yield (conv, used[repeated]["turn_no"], len(used) - repeated, repeated, n, n > budget, "".join(text), loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready, size = None, [], [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*ready, strict=True))
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            ready.clear()
            return got

        for whole in batches:
            for at in range(0, whole.num_rows, _AT_ONCE):
                for t in whole.slice(at, _AT_ONCE).to_pylist():
                    if held and (t["conv"], t["segment"]) != key:
                        ready.extend(of_segment(key[0], held))
                        held = []
                    key = t["conv"], t["segment"]
                    held.append(t)
                    size += len(t["form"])
                    if ready and size > 1 << 20:
                        size = 0
                        yield batch()
        if held:
            ready.extend(of_segment(key[0], held))
        if ready:
            yield batch()

    return rows.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def format_chats(turns: DataFrame, tokenizer: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY,
                 segment: int = SEGMENT) -> DataFrame:
    """One row per window: ``window`` (number of its first new turn), ``n_new``, ``n_repeated``, ``n_tokens``,
    ``over_budget``, ``text`` and ``loss`` (code points from, to). ``tokenizer``: a file of the ``tokenizers`` library."""
    if conv_col.lower() in StructType.fromDDL(_WINDOW).names:
        raise ValueError(f"the conversation column has the name of a result column: {conv_col}")
    if not 0 <= history < budget:
        raise ValueError("history must be smaller than the budget")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:     # a file of the driver, of fixed size
        spec = turns.sparkSession.sparkContext.broadcast(f.read())
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                        F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("nr"))
    order = ["conv", "turn", "role", "tie", "nr"]        # equal rows may change places, the result stays
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")
    placed = _placed(cut(_counted(ranged, spec), "turns", compression="zstd"))
    span = segment * budget
    placed = placed.withColumn("segment", F.expr(f"before div {span}"))
    goes = F.expr(f"CASE WHEN before >= (segment + 1) * {span} - {history} THEN array(struct(segment, true AS new), "
                  "struct(segment + 1 AS segment, false AS new)) ELSE array(struct(segment, true AS new)) END")
    own = placed.withColumn("to", F.explode(goes)).select(
        "conv", "to.segment", "to.new", "turn_no", "role", "form", "body_from", "body_to", "tokens")
    later = placed.filter("segment > 0").select(F.col("conv").alias("_c"), F.col("segment").alias("_s")).distinct()
    heads = placed.filter("turn_no = 0 AND role = 'system'").join(later, F.col("conv").eqNullSafe(F.col("_c"))).select(
        "conv", F.col("_s").alias("segment"), F.lit(False).alias("new"), "turn_no", "role", "form", "body_from", "body_to", "tokens")
    dealt = own.unionByName(heads).repartition("conv", "segment").sortWithinPartitions("conv", "segment", "turn_no")
    return _windows(dealt, conv_col, budget, history)


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation what its windows say: number and digest of the turns, and of the text under the loss mask.

    A digest takes a conversation's turns in order, so one task streams a conversation; it holds one window."""
    rows = (windows.select(F.col(conv_col).alias("conv"), "window", "n_repeated", "text", "loss")
            .repartition("conv").sortWithinPartitions("conv", "window"))
    schema = StructType([rows.schema["conv"], *StructType.fromDDL(
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [()] * len(arrow)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for whole in batches:
            for at in range(0, whole.num_rows, _AT_ONCE):
                for w in whole.slice(at, _AT_ONCE).to_pylist():
                    if w["conv"] != now:
                        close()
                        now, state = w["conv"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, text in parse(w["text"])[w["n_repeated"]:]:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    for s in w["loss"]:
                        said = unescape(w["text"][s["start"]: s["end"]])
                        state[2] += len(said)
                        state[3].update(said.encode())
                    state[4] += len(w["text"])
                    state[5] += 1
                yield batch()
        close()
        yield batch()

    return rows.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


@query("op12_chat_format")
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted windows of every conversation say, and of one whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(format_chats(rows.unionByName(extra)))
