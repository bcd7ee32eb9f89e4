"""Parser unit cases (FIXTURES part C extra rows + SURVEY §7.4/§7.5 decisions)."""
import json

import pytest
from pyspark.sql import functions as F

from labelweave.codebook import default_codebook
from labelweave.functions import jsonfix as J
from labelweave.operators.parse import extract_json, parse_predictions


def run(spark, texts, group_mode=None, gids=None, strategy="ladder"):
    rows = [(i, t, (gids[i] if gids else None)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, g string")
    e = extract_json(F.col("t"), default_codebook(), group_mode, False, True, F.col("g"), strategy)
    out = df.select("i", e.alias("r")).orderBy("i").collect()
    return [(dict(r.r.json) if r.r else None, r.r.mode if r.r else "none") for r in out]


def test_strict_and_modes(spark):
    obj = '{"china_stance_score":0.5,"china_sensitive":"yes","collective_action":"no"}'
    res = run(spark, [obj, "```json\n" + obj + "\n```", "Sure.\n" + obj,
                      '{"draft":1} then ' + obj, "Hmm {not closed. Final: " + obj, "", None])
    modes = [m for _, m in res]
    assert modes == ["strict", "codefence_stripped", "balanced_block", "balanced_block",
                     "pattern_match", "none", "none"]
    assert res[0][0] == {"china_stance_score": "0.5", "china_sensitive": "yes", "collective_action": "no"}


def test_repairs(spark):
    texts = [
        '{"china_stance_score:0.5","china_sensitive":"no"}',            # J7 value inside key quotes
        '{"china_stance_score:0,"china_sensitive":"no"}',               # Q20: repaired by us
        '{"china_sensitive":"no","inauthentic:0,"hate_speech":"no"}',   # Q20 second text
        '{"china_stance_score":0.4.0e-1,"china_sensitive":"no"}',       # J6 scientific
        '{"china_stance_score":0.2,"china_sensitive":"no","news_segments":"..."}',  # J9 -> invalid value
        '{"china_stance_score":0.1,"china_sensitive":"no",}',           # J10
        '0.1 1 0 0 0 0 0',                                               # J5
    ]
    res = run(spark, texts)
    assert res[0][0]["china_stance_score"] == "0.5"
    assert res[1][0] == {"china_stance_score": "0", "china_sensitive": "no"}
    assert res[2][0]["inauthentic_content"] == "0" and res[2][0]["hate_speech"] == "no"
    assert abs(float(res[3][0]["china_stance_score"]) - 0.04) < 1e-12
    assert res[4][1] == "none"          # "truncated" is not a valid yes/no value
    assert res[5][1] == "strict"
    assert len(res[6][0]) == 7


def test_strictness(spark):
    texts = [
        "{'china_sensitive':'yes'}",                             # single quotes rejected everywhere
        '{"china_sensitive":"yes"} trailing words',               # trailing text: not strict, balanced ok
        '{"china_sensitive":"yes","china_sensitive":"no"}',      # duplicate keys, last wins
        '{"china_sensitive":true}',                               # booleans are invalid (stated difference)
        '{"china_stance_score":9,"china_sensitive":"no"}',       # Q1: stance range enforced
        '{"china_stance_score":NaN,"china_sensitive":"no"}',     # N2: NaN stance is not a number in range
        'note {"a":"x}y\\"{","china_sensitive":"no"}',            # brace / escaped quote inside strings
        '{"china_sensitive":"no"}]',                             # ']' after the object
    ]
    res = run(spark, texts)
    assert res[0][1] == "none"
    assert res[1][1] == "balanced_block"
    assert res[2][0] == {"china_sensitive": "no"}
    assert res[3][1] == "none"
    assert res[4][1] == "none"
    assert res[5][1] == "none"
    assert res[6][0] == {"china_sensitive": "no"} and res[6][1] == "balanced_block"
    assert res[7][1] == "balanced_block"


def test_standardise_and_gate(spark):
    full = {"china_related": "no", "china_ccp_government": "Neutral", "china_people_culture": "pro",
            "china_technology_development": "anti", "china_sensitive": "yes", "collective_action": "no",
            "hate_speech": "no", "harmful_content": "no", "news_segments": "yes",
            "inauthentic_content": "no", "derivative_content": "no", "0": 1, "harm?": "yes"}
    res = run(spark, [json.dumps(full)])
    m, mode = res[0]
    assert mode == "strict"
    assert m["china_ccp_government"] == "" and m["china_sensitive"] == ""   # gate blanks
    assert "0" not in m
    assert m["harmful_content"] == "yes"           # later alias overrides the canonical key


def test_group_validation(spark):
    a = '{"china_related":"yes","china_ccp_government":"neutral","china_people_culture":"pro",' \
        '"china_technology_development":"anti"}'
    b_missing = '{"china_sensitive":"yes"}'
    res = run(spark, [a, b_missing, b_missing], group_mode="by-category", gids=["A", "B", None])
    assert res[0][1] == "strict" and res[0][0]["china_ccp_government"] == "neutral/unclear"
    assert res[1][1] == "none"            # group B needs both keys
    assert res[2][1] == "strict"          # no group: partial validation


def test_simple_strategy(spark):
    obj = '{"china_stance_score":0.5,"china_sensitive":"yes"}'
    res = run(spark, [obj, "```\n" + obj + "\n```", 'x {"china_sensitive":"maybe"} ' + obj + " y"],
              strategy="simple")
    assert [m for _, m in res] == ["strict", "tail", "balanced_block"]


def test_brace_fold_unicode(spark):
    s = 'é😀 {"k":"😀"} z {"x":1}'
    df = spark.createDataFrame([(s,)], "t string")
    r = df.select(J.last_balanced_block(F.col("t")).alias("b"),
                  J.balanced_blocks(F.col("t")).alias("all")).first()
    assert r.b == '{"x":1}'
    assert r["all"] == ['{"k":"😀"}', '{"x":1}']


def test_parse_predictions_invariants(spark):
    from labelweave.sources.standins import d_raw
    raw = d_raw(spark, "/root/testdata/sf0.001")
    p = parse_predictions(raw)
    n_in = raw.count()
    ok = p.filter("parsed").count()
    bad = p.filter("NOT parsed").count()
    assert ok + bad == n_in
    # compound ids split on the last mark
    df = spark.createDataFrame([(1, "a__group_x__group_B", '{"china_sensitive":"no","collective_action":"no"}')],
                               "idx long, meta_id string, raw string")
    r = parse_predictions(df, group_mode="by-category").first()
    assert r.original_meta_id == "a__group_x" and r.group_id == "B" and r.parsed


@pytest.mark.parametrize("text,expected", [
    ("{\"a\": 1", True), ("ok", False), ("```json\n{\"a\":1}\n```", False), ("{\"a\":", True), ("", True)])
def test_truncation_column(spark, text, expected):
    from labelweave.functions.text import looks_truncated
    from labelweave.operators.infer import looks_truncated as py_trunc
    r = spark.createDataFrame([(text,)], "t string").select(looks_truncated(F.col("t"), F.lit("stop"))).first()[0]
    assert r == expected == py_trunc(text, "stop")
