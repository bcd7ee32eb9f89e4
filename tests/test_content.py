"""Polymorphic content through JSON lines and back; frames of dropped items; list labels; two-pass parse; brace tokens."""
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from labelweave.codebook import BINARY, LABEL_LIST, NUMERIC_01, Codebook, Dimension
from labelweave.functions import jsonfix as J
from labelweave.operators import content as C
from labelweave.operators import records as RC
from labelweave.operators.parse import extract_json, parse_predictions
from labelweave.operators.scoring import gold_table
from labelweave.sources import standins as S
from tests.conftest import SF0001

IMAGE = ("image_url", None, ("data:image/jpeg;base64,/9j/",))


def test_union_content_round_trip(spark, tmpdir_path):
    rows = [("1", [("user", 'say "[1,2]"\né😀 ', None), ("assistant", '[{"type":"text"}]', None)]),
            ("2", [("user", None, [IMAGE, IMAGE, ("text", "look\\ here", None)]), ("assistant", None, None)]),
            ("3", None), ("4", []), ("5", [(None, "", None), ("user", "null", None), ("user", "5", None)]), ("6", [("user", None, [])])]
    d = spark.createDataFrame(rows, f"meta_id string, messages array<{C.MESSAGE_T}>")
    C.write_records(d, f"{tmpdir_path}/r")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmpdir_path}/r").collect()]
    two = next(x for x in lines if x["meta_id"] == "2")["messages"]
    assert two[0]["content"][2] == {"type": "text", "text": "look\\ here"} and two[1]["content"] is None
    good, bad = C.read_records(spark, f"{tmpdir_path}/r")
    want = {r.meta_id: r.messages for r in d.collect()}
    want["1"][0] = want["1"][0].__class__(role="user", content='say "[1,2]"\né😀', parts=None)       # line separators are dropped on reading
    assert {r.meta_id: r.messages for r in good.collect()} == want and bad.count() == 0
    texts = {r[0]: r[1] for r in good.select("meta_id", C.user_text(F.col("messages"))).collect()}
    assert texts["2"] == "look\\ here" and texts["5"] == "null\n\n5" and texts["6"] == ""
    forced = {r.meta_id: r.messages for r in C.force_parts(good).collect()}
    assert forced["5"][1].parts[0].text == "null" and forced["5"][1].content is None and len(forced["2"][0].parts) == 3
    plain = good.filter("meta_id IN ('1', '5')")
    assert C.force_parts(plain).collect() == plain.collect()


def test_odd_content_is_kept(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "o.jsonl"), "w") as f:
        f.write('{"meta_id":"1","messages":[{"role":"user","content":{"a":1}},{"role":"user"},{"role":"user","content":[1,"b"]}]}\n{"meta_id":\n')
    good, bad = C.read_records(spark, tmpdir_path)
    m = good.first().messages
    assert m[0].content == '{"a":1}' and m[1].content is None and (m[2].content or m[2].parts is not None)
    assert [(r.line_no, r.line) for r in bad.collect()] == [(2, '{"meta_id":')]


def test_frames_of_dropped_items_are_not_encoded(spark, tmpdir_path):
    """base64 runs above the join with the kept ids."""
    os.makedirs(f"{tmpdir_path}/000000000001")
    with open(f"{tmpdir_path}/000000000001/frame_1.jpg", "wb") as f:
        f.write(b"x")
    recs = RC.build_records(S.d_items(spark, SF0001), frames=RC.read_frames(spark, tmpdir_path))
    lines = recs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    encode = next(k for k, x in enumerate(lines) if "base64" in x)
    semi = next(k for k, x in enumerate(lines) if "LeftSemi" in x)
    assert encode < semi       # nearer to the root of the plan
    rich = C.union_messages(recs)
    one = rich.filter("meta_id = '000000000001'").first().messages[1]
    assert one.content is None and [p.type for p in one.parts] == ["image_url", "text"]
    assert rich.filter("meta_id <> '000000000001'").first().messages[1].parts is None


def test_gold_of_long_texts_only(spark):
    recs = RC.build_records(S.d_items(spark, SF0001))
    kept = gold_table(recs, 400).count()
    lengths = [len(r.messages[1].content) for r in recs.collect()]
    assert kept == sum(n >= 400 for n in lengths) and 0 < kept < len(lengths)
    assert gold_table(C.union_messages(recs), 400).count() == kept


def test_label_lists(spark):
    cb = Codebook([Dimension("langs", "", "", LABEL_LIST, LABEL_LIST, allowed=("en", "es", "none"), exclusive="none"),
                   Dimension("on", "", "", BINARY, NUMERIC_01)], {}, {})
    cases = {'["en"]': True, '["es","en"]': True, '["none"]': True, '["none","en"]': False, "[]": False, '["xx"]': False,
             '"en"': False, "null": False, "7": False, '[["en"]]': False, '["en",null]': False}
    raw = spark.createDataFrame([(i, f'{{"langs":{c},"on":"yes"}}') for i, c in enumerate(cases)], "idx long, raw string")
    got = {r.raw[9:-12]: r.parsed for r in parse_predictions(raw, cb).collect()}
    assert got == cases
    assert "list of 'en' | 'es' | 'none'" in RC.group_prompt(cb, cb.group_configs("single")[0])


@pytest.mark.parametrize("mode", [None, "binary"])
def test_passes_agree(spark, mode):
    """Two passes give what one ladder over every row gives, whichever way the second gets its rows."""
    raw = S.d_raw(spark, SF0001) if mode is None else S.d_grouped(spark, SF0001)
    rows = {}
    for how in ("none", "scan", "table"):
        p = parse_predictions(raw, group_mode=mode, first_pass=how)
        rows[how] = sorted((r.idx, r.model, r.meta_id, r.parsed, r.mode, str(sorted((r.json or {}).items()))) for r in p.collect())
    assert rows["none"] == rows["scan"] == rows["table"] and len({r[4] for r in rows["none"]}) > 1


def test_clean_answers_skip_the_ladder(spark):
    """An answer that is not the same twice (a model's) is in exactly one pass."""
    raw = spark.range(2000).select(F.col("id").alias("idx"), F.when(F.rand() < 0.5, F.lit('{"hate_speech":"no"}')).otherwise(
        F.lit('so: {"hate_speech":"no"}')).alias("raw"))
    p = parse_predictions(raw)
    assert p.count() == 2000 and p.select("idx").distinct().count() == 2000 and p.filter("NOT parsed").count() == 0
    plan = p._jdf.queryExecution().optimizedPlan().toString().split("\n")
    union = next(k for k, x in enumerate(plan) if "Union" in x)
    folds = [k for k, x in enumerate(plan) if "aggregate(sequence(1," in x or "aggregate([1,2" in x or "inline" in x and "aggregate(" in x]
    assert union == 0 or all(k > union for k in folds)
    with pytest.raises(ValueError, match="first_pass"):
        parse_predictions(raw, first_pass="x")


def blocks_by_character(s):
    """Every top-level block, one character at a time."""
    out, depth, in_str, esc, start = [], 0, False, False, 0
    for i, ch in enumerate(s):
        if depth == 0:
            if ch == "{":
                depth, start, in_str, esc = 1, i, False, False
        elif in_str:
            if esc:
                esc = False
            elif ch == "\\":
                esc = True
            elif ch == '"':
                in_str = False
        elif ch == '"':
            in_str = True
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                out.append(s[start: i + 1])
    return out


def test_brace_tokens(spark):
    rng = random.Random(2)
    parts = ["{", "}", '"', "\\", '\\"', "a", "é😀", " ", '{"a":1}', "\n", "[", '"x":"}"', "\\\\", "text "]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))),) for _ in range(3000)] + [("",), ("x" * 5000,), (None,)]
    d = spark.createDataFrame(rows, "t string")
    for r in d.select("t", J.last_balanced_block(F.col("t")).alias("last"), J.balanced_blocks(F.col("t")).alias("every")).collect():
        want = blocks_by_character(r.t) if r.t is not None else None
        assert r.every == want and r.last == (want[-1] if want else None), r.t
    assert extract_json(F.lit("x")) is not None


def test_frame_files_are_written_by_many_tasks(spark):
    """records_multimodal: a file per frame, and the few bytes of all frames are not left to one task."""
    from glob import glob

    from labelweave.plans.feature_queries import q_records_multimodal
    from labelweave.session import checkpoint_dir
    found = f"{checkpoint_dir(spark).removeprefix('file:')}/frames-*/frames/item=*/frame=*/part-*"
    before = set(glob(found))
    rows = q_records_multimodal(spark, SF0001).collect()
    names = set(glob(found)) - before
    assert len(names) >= sum(r.n_images for r in rows) > 0
    assert len({re.search(r"/part-(\d+)-", n).group(1) for n in names}) > spark.sparkContext.defaultParallelism


def test_strip_is_no_regex_and_a_line_is_stripped_once(spark, tmpdir_path):
    """Every character up to U+FFFF strips as with the regex of Unicode white space; reading JSON lines scans no line by regex."""
    from labelweave.functions.text import strip_ws
    from labelweave.sources.files import read_jsonl_parts
    d = spark.range(1, 0x10000).filter("id < 55296 OR id > 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    d = d.select(F.concat("c", F.lit("a "), "c", F.lit("b"), "c", F.lit(" "), "c").alias("t"))
    was = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    got = d.select(F.count("*"), F.count_if(strip_ws("t") != was), F.count_if(strip_ws("t") == "t")).first()
    assert got[0] == 0xFFFF - 2048 and got[1] == 0
    one = spark.createDataFrame([("  \n\t  ",), ("",), (None,)], "t string").select(strip_ws("t")).collect()
    assert [r[0] for r in one] == ["", "", None]
    spark.createDataFrame([('{"a":"x y"}',), (" \t",), (" {\"a\":\"2\"} ",), ("{} {}",)], "value string").write.text(f"{tmpdir_path}/x")
    good, bad = read_jsonl_parts(spark, f"{tmpdir_path}/x", "a string")
    assert sorted(r.a for r in good.collect()) == ["2", "xy"] and sorted(r.line for r in bad.collect()) == [" \t", "{} {}"]
    assert "regexp_replace" not in good._jdf.queryExecution().executedPlan().toString()


def small_file_rows(spark):
    odd = ["a/b", "a b", "ä😀", 'q"#%\'*:=?\\{[]^}~', "\x01\x1f\x7f", "", None, "0", "-1", ".hidden", "_x"]
    rows = [(v, n, f"{n} of {v}\nsecond") for v in odd for n in (10, 2, None)] + [("0", 2, "again"), ("0", 2, None), ("0", 2, "")]
    return spark.createDataFrame(rows, "item string, frame int, value string")


def test_small_files_are_written_as_spark_does(spark, tmpdir_path):
    """Folders, files and lines of write_small_files are those of Spark's writer: odd, empty, null and repeated keys."""
    from glob import glob

    from labelweave.sources.files import write_small_files
    d = small_file_rows(spark)
    write_small_files(d, f"{tmpdir_path}/ours", ["item", "frame"], 5)
    d.repartition(5, "item").write.partitionBy("item", "frame").text(f"{tmpdir_path}/spark")

    def found(path):
        out = []
        for f in glob(f"{path}/**/part-*", recursive=True, include_hidden=True):
            with open(f, "rb") as file:
                out.append((os.path.relpath(os.path.dirname(f), path), sorted(file.read().split(b"\n"))))
        return sorted(out)

    # Spark deals null and "" as two keys, whose files then lie in one folder; here they are one file
    default = "item=__HIVE_DEFAULT_PARTITION__"
    ours, spark_s = found(f"{tmpdir_path}/ours"), found(f"{tmpdir_path}/spark")
    assert [x for x in ours if default not in x[0]] == [x for x in spark_s if default not in x[0]]
    lines = lambda rows: sorted((f, x) for f, text in rows if default in f for x in text if x)
    assert lines(ours) == lines(spark_s) != []
    with pytest.raises(Exception, match="exists"):
        write_small_files(d, f"{tmpdir_path}/ours", ["item", "frame"], 5)
    write_small_files(d.limit(0), f"{tmpdir_path}/none", ["item", "frame"], 5)
    assert os.listdir(f"{tmpdir_path}/none") == []


def test_small_files_are_read_as_spark_does(spark, tmpdir_path):
    """Paths and bytes are those of the source binaryFile: nested, hidden, empty and linked files, odd names, other patterns."""
    from labelweave.sources.files import read_small_files
    names = ["a/frame_1.jpg", "a/frame_10.jpg", "a/frame_2.png", "a/.frame_1.jpg", "a/_frame_1.jpg", "frame_3.jpg", "b/c/d/frame_4.jpg",
             "_x/frame_1.jpg", "_x=1/frame_1.jpg", ".h/frame_1.jpg", "e f/ä%20#😀/frame_5.jpg", "g/frame_6.jpg._COPYING_", "g/frame_.jpg",
             "_metadata_x/frame_1.jpg", "a/_metadata.jpg", "many/frame_7.jpg", "g/Frame_1.jpg", "g/frame_1.JPG", "g/frame_8.jpg/frame_9.jpg"]
    for k, n in enumerate(names):
        os.makedirs(os.path.dirname(f"{tmpdir_path}/in/{n}"), exist_ok=True)
        with open(f"{tmpdir_path}/in/{n}", "wb") as f:
            f.write(b"\x00\xff" * k)
    os.symlink(f"{tmpdir_path}/in/a", f"{tmpdir_path}/in/linked")
    os.makedirs(f"{tmpdir_path}/in/empty")

    def both(path, glob):
        want = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        got = read_small_files(spark, path, glob)
        rows = [sorted((r.path, bytes(r.content)) for r in d.select("path", "content").collect()) for d in (got, want)]
        assert rows[0] == rows[1], glob
        return len(rows[0])

    assert both(f"{tmpdir_path}/in", "frame_*.jpg") == 10
    assert both(f"file://{tmpdir_path}/in/", "frame_?.jpg") and both(f"file:{tmpdir_path}/in", "*") and both(f"{tmpdir_path}/in/empty", "*") == 0
    assert both(f"{tmpdir_path}/in", "frame_[13].jpg") and both(f"{tmpdir_path}/in/[ab]", "*.jpg") and both(f"{tmpdir_path}/in", "{f,F}*.jpg")
    assert both(f"{tmpdir_path}/in/frame_3.jpg", "*") == 1
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        read_small_files(spark, f"{tmpdir_path}/nowhere", "*").collect()


def test_frames_start_no_process_and_are_not_listed_on_the_driver(spark):
    """records_multimodal: no checksum file (for whose rights and those of the data file Hadoop starts processes) lies beside a
    frame, and frames are not read by the source that holds the status of every file on the driver and 32 files a task."""
    from glob import glob

    from labelweave.plans.feature_queries import q_records_multimodal
    from labelweave.session import checkpoint_dir
    top = checkpoint_dir(spark).removeprefix("file:")
    before = set(glob(f"{top}/frames-*"))
    q_records_multimodal(spark, SF0001).collect()
    (base,) = set(glob(f"{top}/frames-*")) - before
    files = glob(f"{base}/frames/item=*/frame=*/*", include_hidden=True)
    assert files and all(os.path.basename(f).startswith("part-") for f in files)
    found = RC.read_frames(spark, f"{base}/frames", "part-*", r"/item=([^/]+)/", r"/frame=([0-9]+)/")
    assert found.count() == len(files) and "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    # however few files there are, their contents are no broadcast before their size is known
    plan = RC.build_records(S.d_items(spark, SF0001), frames=found)._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and not re.search("BroadcastHashJoin .*LeftOuter, BuildRight.*\\n.*item_id", plan)
    assert re.search(r"SortMergeJoin \[meta_id[^]]*\], \[item_id[^]]*\], LeftOuter", plan)
