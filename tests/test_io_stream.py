"""Sources / sinks and the streaming path."""
import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from labelweave.sources import files as IO
from labelweave.sources import standins as S
from labelweave.streaming import monitor as ST


def test_jsonl_roundtrip_and_errors(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.jsonl")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(json.dumps({"idx": 1, "meta_id": "7", "raw": "x\u2028y"}, ensure_ascii=False) + "\n\n")
        fh.write(json.dumps({"idx": 2, "meta_id": "8", "raw": None}) + "\n")
    df = IO.read_jsonl(spark, p, IO.RAW_SCHEMA).orderBy("idx").collect()
    assert [r.raw for r in df] == ["xy", None]
    out = os.path.join(tmpdir_path, "out")
    IO.write_jsonl(spark.createDataFrame(df, IO.RAW_SCHEMA), out)
    line = spark.read.text(out).first().value
    assert '"raw":null' in line or '"raw":"xy"' in line
    bad = os.path.join(tmpdir_path, "bad.jsonl")
    with open(bad, "w") as fh:
        fh.write('{"idx": 1}\n{"idx": 2,\n')
    with pytest.raises(IO.JsonlError):
        IO.read_jsonl(spark, bad, IO.RAW_SCHEMA)


def test_csv_sniff_and_label_read(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "labels.csv")
    with open(p, "w") as fh:
        fh.write("video;pol;sensitive;collective_action;english;mandarin;spanish;other_lang;no_language\n")
        fh.write("a/1234567890.mp4;0.5;1;0;1;0;0;0;0\n")
        fh.write("a/1234567891.mp4;-0.5;0;1;1;0;0;0;0\n")
    assert IO.sniff_delimiter(spark, p) == ";"
    df = IO.read_label_csv(spark, p)
    assert "pol" in df.columns and df.count() == 2
    from labelweave.operators.split import stratified_split
    assert stratified_split(df).count() == 2


def test_model_names():
    assert IO.model_names(["out/preds_a.parsed.jsonl", "x/preds_a.parsed.jsonl", "y/b c.jsonl", "z/.jsonl"]) == \
        ["preds_a", "preds_a_2", "b_c", "model"]
    assert IO.model_names(["x/a.jsonl", "y/a.jsonl", "z/a_2.jsonl"]) == ["a", "a_3", "a_2"]


def test_table_sinks(spark, tmpdir_path):
    df = spark.createDataFrame([("1", {"k": "v"}, ["a"])], "id string, json map<string,string>, g array<string>")
    for ext in ("parquet", "csv", "jsonl"):
        IO.write_table(df, os.path.join(tmpdir_path, f"t.{ext}"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "t.parquet")).count() == 1
    row = spark.read.option("header", True).option("escape", "\\").csv(os.path.join(tmpdir_path, "t.csv")).first()
    assert json.loads(row.json) == {"k": "v"}


GROUPED = "original_meta_id string, group_id string, idx long, parsed boolean, json map<string,string>, arrived timestamp"
T0 = datetime.datetime(2024, 1, 1)


def _land(spark, path, rows):
    """Rows (item, group, position, answer, minutes) as one more file of the landing folder."""
    made = [(i, g, p, a is not None, a, T0 + datetime.timedelta(minutes=m)) for i, g, p, a, m in rows]
    spark.createDataFrame(made, GROUPED).coalesce(1).write.mode("append").parquet(path)


def _merge_once(spark, base, **options):
    """Drain what has landed; the same checkpoint goes on where the last call ended."""
    landed = spark.readStream.schema(GROUPED).parquet(f"{base}/landing")
    merged = ST.merge_stream(landed, group_mode="binary", delay="0 seconds", **options)
    (merged.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
     .trigger(availableNow=True).start().awaitTermination())
    return [tuple(r) for r in spark.read.schema(ST.MERGE_OUT).parquet(f"{base}/out").orderBy("meta_id", "as_of", "version").select(
        "meta_id", "version", "complete", "json").collect()]


def test_stream_merge_by_event_time(spark, tmpdir_path):
    """Complete items as they complete, corrections, partial items on time-out, state that goes, null positions."""
    a, b = {"china_related": "yes"}, {"hate_speech": "no"}
    _land(spark, f"{tmpdir_path}/landing", [("1", "china", 1, a, 0), ("1", "content", 2, b, 0), ("2", "china", 3, a, 0),
                                            ("3", "china", None, {"china_related": "old"}, 0), ("3", "content", None, b, 0), (None, "china", 9, a, 0),
                                            ("", "china", 9, a, 0), ("4", "china", 4, None, 0)])
    said = _merge_once(spark, tmpdir_path)
    assert said == [("1", 1, True, {**a, **b}), ("3", 1, True, {"china_related": "old", **b})]
    # a later answer corrects, an equal one says nothing, a position beats none
    _land(spark, f"{tmpdir_path}/landing", [("1", "china", 5, {"china_related": "no"}, 1), ("3", "content", 6, b, 1)])
    _land(spark, f"{tmpdir_path}/landing", [("3", "china", 0, a, 2)])
    said = _merge_once(spark, tmpdir_path)
    assert ("1", 2, True, {"china_related": "no", **b}) in said and ("3", 2, True, {**a, **b}) in said and len(said) == 4
    # the feed ends: item 2 comes out as it is
    _land(spark, f"{tmpdir_path}/landing", [(None, None, None, None, 600)])
    said = _merge_once(spark, tmpdir_path)
    assert ("2", 1, False, a) in said and len(said) == 5
    # its state has gone: an answer after the time-out starts anew
    _land(spark, f"{tmpdir_path}/landing", [("2", "content", 8, b, 601), ("2", "china", 8, a, 601)])
    said = _merge_once(spark, tmpdir_path)
    assert said.count(("2", 1, True, {**a, **b})) == 1 and len(said) == 6
    last = {r.meta_id: r.complete for r in ST.latest_merged(spark.read.schema(ST.MERGE_OUT).parquet(f"{tmpdir_path}/out")).collect()}
    assert last == {"1": True, "2": True, "3": True}


def test_stream_merge_equals_batch_fold(spark, tmpdir_path):
    """Raw answers landed in three files, parsed and merged by the stream, the feed closed: the batch fold of all items."""
    from labelweave.operators.merge import merge_groups
    from labelweave.operators.parse import parse_predictions
    landing = os.path.join(tmpdir_path, "landing")
    raw = S.d_grouped(spark, SF0001).withColumn("idx", F.when(F.col("idx") % 5 == 0, F.lit(None)).otherwise(F.col("idx")))
    raw.repartition(3).write.json(landing)
    ST.close_landing(spark, landing, datetime.datetime.now() + datetime.timedelta(days=1))
    parsed = parse_predictions(ST.raw_stream(spark, landing, 1), group_mode="binary")
    merged = ST.merge_stream(parsed, group_mode="binary")
    (merged.writeStream.format("parquet").option("path", f"{tmpdir_path}/out").option("checkpointLocation", f"{tmpdir_path}/ck")
     .trigger(availableNow=True).start().awaitTermination())
    got = {r.meta_id: (r.complete, list(r.groups_present), r.json) for r in
           ST.latest_merged(spark.read.schema(ST.MERGE_OUT).parquet(f"{tmpdir_path}/out")).collect()}
    batch = merge_groups(parse_predictions(raw, group_mode="binary"), group_mode="binary").collect()
    assert got == {r.meta_id: (r.complete, list(r.groups_present), r.json) for r in batch}
    assert {c for c, _, _ in got.values()} == {True, False}


def test_watch_goes_on_after_a_restart(spark, tmpdir_path):
    landing, home = f"{tmpdir_path}/landing", f"{tmpdir_path}/watch"
    land = lambda n: spark.range(n).selectExpr("id AS idx").write.mode("append").json(landing)
    land(3)

    class Stop(Exception):
        pass

    def stop(_):
        raise Stop
    raw = lambda: ST.raw_stream(spark, landing)
    with pytest.raises(Stop):       # the driver goes after the first poll
        ST.watch(raw, home, 10, idle_polls=3, sleep=stop)
    slept = []
    rows = ST.watch(raw, home, 10, idle_polls=3, poll_seconds=7, sleep=slept.append).orderBy("poll").collect()
    assert [(r.poll, r.landed, r.unchanged, r.reason) for r in rows] == [
        (1, 3, 0, None), (2, 3, 1, None), (3, 3, 2, None), (4, 3, 3, "idle")] and slept == [7, 7, 7]
    land(7)
    again = ST.watch(raw, f"{tmpdir_path}/watch2", 10, idle_polls=3, sleep=stop).collect()
    assert [(r.landed, r.reason, r.progress_pct) for r in again] == [(10, "expected", 100.0)]


def test_calls_in_flight(spark):
    """Calls of a task overlap, answers keep the order of the rows, retries work in the threads."""
    import threading
    import time

    from labelweave.operators import infer as INF
    seen, busy, most = [], [0], [0]
    lock = threading.Lock()

    def slow(x):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
        time.sleep(0.02 if x % 7 else 0.1)
        with lock:
            busy[0] -= 1
        return x

    def rows():
        for k in range(60):
            seen.append(k)
            yield k
    began = time.time()
    out = []
    for x in INF.in_order(slow, rows(), 8):
        out.append(x)
        assert len(seen) <= x + 9               # reading waits for the oldest call
    assert out == list(range(60)) and 2 <= most[0] <= 8 and time.time() - began < 60 * 0.02
    with pytest.raises(ZeroDivisionError):
        list(INF.in_order(lambda x: 1 // (x - 3), iter(range(9)), 4))

    def model(messages, max_tokens):
        import time
        n = int(messages[0]["content"])
        time.sleep(0.05)
        if n % 4 == 0 and len(messages) == 1:
            return '{"a":', "length"            # cut: asked again with more room
        if n % 5 == 0:
            raise RuntimeError("down")
        return f'{{"a":{n}}}', "stop"
    recs = spark.range(0, 40, 1, 2).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("meta_id"), F.array(F.struct(
        F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    policy = INF.RetryPolicy(retries=2, base_sleep=0.0)
    plain = INF.score_batches(recs, model, "m", policy).drop("latency_s").collect()
    threads = INF.score_batches(recs, model, "m", policy, in_flight=10).drop("latency_s").collect()
    assert threads == plain and [r.idx for r in threads] == list(range(40))
    assert {r.attempt for r in threads} == {1, 2} and sum("FAILED" in r.raw for r in threads) == 8


def test_progress_query(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "l2")
    S.d_raw(spark, SF0001).write.json(landing)
    q = (ST.progress_query(ST.raw_stream(spark, landing), expected=1000).writeStream.format("memory")
         .queryName("lw_progress").outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.table("lw_progress").first()
    assert r.landed == S.d_raw(spark, SF0001).count() and r.expected == 1000


def test_file_roundtrip_scoring(spark, tmpdir_path):
    """S2 -> S12 -> A12: parsed predictions written as JSONL per model, read
    back with model names from the file names, scored like the in-memory run."""
    from pyspark.sql import functions as F
    from labelweave.operators import records as RC, scoring as SC
    from labelweave.operators.parse import parse_predictions
    parsed = parse_predictions(S.d_raw(spark, SF0001))
    paths = []
    for m in ("m_alpha", "m_beta"):
        p = os.path.join(tmpdir_path, f"preds_{m}.parsed.jsonl")
        IO.write_jsonl(parsed.filter(F.col("model") == m).drop("model").select(
            "idx", "meta_id", "original_meta_id", "parsed", "raw", "json", "group_id", "mode"), p)
        paths.append(p)
    back = IO.read_predictions(spark, paths)
    gold = SC.gold_table(RC.build_records(S.d_items(spark, SF0001)))
    a = {(r.model, r.metric): r.score for r in SC.score_standard(gold, back, ["preds_m_alpha", "preds_m_beta"]).collect()}
    b = {(f"preds_{r.model}", r.metric): r.score for r in SC.score_standard(gold, parsed, ["m_alpha", "m_beta"]).collect()}
    assert a == b


def test_csv_ladder_keeps_bad_rows(spark, tmpdir_path):
    """A bad row far down the file is returned, not fatal and not dropped."""
    import os
    p = os.path.join(tmpdir_path, "t.csv")
    lines = ["id,text"] + [f"{i},word{i}" for i in range(300)]
    lines[201] = "200,too,many,fields"
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    good, bad = IO.read_csv_parts(spark, p, infer=True)
    assert good.count() == 299 and good.select("id").distinct().count() == 299
    assert [r["line"] for r in bad.collect()] == ["200,too,many,fields"]
    assert dict(good.dtypes)["id"] == "int"


def test_csv_line_breaks_in_quotes(spark, tmpdir_path):
    import os
    p = os.path.join(tmpdir_path, "q.csv")
    with open(p, "w") as f:
        f.write('id,text\n1,"a\nb"\n2,"c, d"\n')
    good, bad = IO.read_csv_parts(spark, p, multi_line=True)
    assert sorted((r["id"], r["text"]) for r in good.collect()) == [("1", "a\nb"), ("2", "c, d")]
    assert bad.count() == 0


def test_jsonl_one_object_per_line(spark, tmpdir_path):
    import os
    p = os.path.join(tmpdir_path, "x.jsonl")
    bad_lines = ['{"idx":1} garbage', '{"idx":2}{"idx":3}', '{"idx":4}],[{"idx":5}', '{"idx":6},{"idx":7}', '[{"idx":8}]', '{"idx":']
    with open(p, "w") as f:
        f.write("\n".join(['{"idx":0,"s":"]}"}', "", *bad_lines, ' {"idx":9,"s":null} ']) + "\n")
    good, bad = IO.read_jsonl_parts(spark, p, "idx long, s string")
    assert sorted(r["idx"] for r in good.collect()) == [0, 9]
    assert sorted(r["line"] for r in bad.collect()) == sorted(bad_lines)


def test_line_numbers_across_file_parts(spark, tmpdir_path):
    """A file that many tasks read, two files, blank lines: every bad line has its number in its file."""
    want = set()
    for name, n in (("a", 400), ("b", 57)):
        with open(os.path.join(tmpdir_path, f"{name}.jsonl"), "w") as f:
            for k in range(1, n + 1):
                bad = k % 13 == 5
                f.write("" if k % 11 == 0 and not bad else f'{{"idx":{k},"s":"{"x" * (k % 50)}"' + ("" if bad else "}"))
                f.write("\n")
                if bad:
                    want.add((f"{name}.jsonl", k))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        good, bad = IO.read_jsonl_parts(spark, tmpdir_path, "idx long, s string")
        assert good.rdd.getNumPartitions() > 10
        assert {(os.path.basename(r.file), r.line_no) for r in bad.collect()} == want
        with pytest.raises(IO.JsonlError, match=r"jsonl:\d+: "):
            IO.read_jsonl(spark, tmpdir_path, "idx long, s string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_jsonl_fields_of_another_type(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.jsonl")
    with open(p, "w") as f:
        f.write('{"idx":"abc","s":"x"}\n{"idx":4,"s":[1,{"a":2}]}\n{"s":"y","idx":5,"more":1}\n')
    good, bad = IO.read_jsonl_parts(spark, p, "idx long, s string")
    assert [tuple(r) for r in good.collect()] == [(None, "x"), (4, '[1,{"a":2}]'), (5, "y")] and bad.count() == 0


def test_csv_types_from_all_rows(spark, tmpdir_path):
    """Types come from every row, in the pass that counts them; an odd value far down makes a column a string."""
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w") as f:
        f.write("a,b,c,d,e,f,g,h\n")
        for k in range(500):
            f.write(f"{k},{10**12 + k},{k / 4},{'true' if k % 2 else 'FALSE'},2024-01-{k % 28 + 1:02d},2024-01-01 10:{k % 60:02d}:00,{k if k != 433 else 'x'},\n")
    good, bad = IO.read_csv_parts(spark, p, infer=True)
    assert dict(good.dtypes) == {"a": "int", "b": "bigint", "c": "double", "d": "boolean", "e": "date", "f": "timestamp", "g": "string", "h": "string"}
    assert good.count() == 500 and bad.count() == 0 and good.filter("g = 'x'").count() == 1
    none, _ = IO.read_csv_parts(spark, p, infer=False)
    assert {t for _, t in none.dtypes} == {"string"}


def test_tables_are_split_unless_quotes_hold_breaks(spark, tmpdir_path):
    for name, text in (("plain", "word"), ("breaks", "a\nb")):
        df = spark.createDataFrame([(f"{k}", f'{text} "{k}"') for k in range(300)], "id string, t string").coalesce(1)
        IO.write_csv(df, f"{tmpdir_path}/{name}.csv", quote_all=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        plain, breaks = IO.load_table(spark, f"{tmpdir_path}/plain.csv"), IO.load_table(spark, f"{tmpdir_path}/breaks.csv")
        assert plain.rdd.getNumPartitions() > 1 == breaks.rdd.getNumPartitions()
        assert plain.count() == breaks.count() == 300 and breaks.filter("t LIKE 'a\\nb %'").count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
