"""All spans of the sanitisation against brute force; time in proportion to a text's length; secrets; discounted evidence."""
import collections
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from labelweave.llm import pii
from tests.llm.conftest import table
from tests.llm.test_operators import LOW, PII, WORD, both, pii_brute

SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,20}[_-])?(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|"
                    r"credentials?)[\"']?[ \t\n\x0b\f\r]{0,4}[:=][ \t\n\x0b\f\r]{0,4}[\"']?([A-Za-z0-9+/_-]{16,}=*)", re.IGNORECASE | re.ASCII)


def entities(t):
    out = [(s, n, e, k, t[s:e]) for s, n, e, k in pii_brute(t)]
    for m in SECRET.finditer(t or ""):
        v = m[1]
        if len(set(v[:200])) >= 8 and re.search("[0-9]", v) and re.search("[A-Za-z]", v):
            out.append((m.start(1), 4, m.end(1), "secret", v))
    return sorted(out)


def name(kind, v):
    return f"{kind}:" + (re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v if kind == "secret" else v.lower())


def wilson(hits, n, z=1.645):
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def brute_spans(texts):
    """text -> all spans (start, kind_no, end, kind)."""
    texts = list(dict.fromkeys(t for t in texts if t is not None))
    words = {t: [(m.start(), m.end(), m[0]) for m in WORD.finditer(t.translate(LOW))] for t in texts}
    nt = collections.Counter(w for t in texts for w in {w for _, _, w in words[t]})
    where = collections.defaultdict(set)
    found = {t: entities(t) for t in texts}
    for t in texts:
        for _, _, _, k, v in found[t]:
            where[name(k, v)].add(t)
    total, out = len(texts), {}
    told = collections.defaultdict(dict)
    for held in where.values():
        nc = len(held)
        ic = -math.log2(nc / total)
        ntc = collections.Counter(w for t in held for w in {w for _, _, w in words[t] if not re.fullmatch("[0-9]+", w)})
        for w, n in ntc.items():
            share = math.log2(total * wilson(n, nt[w]) / nc) / ic if ic > 0 else 0
            if share >= 0.8:
                for t in held:
                    told[t][w] = max(share, told[t].get(w, 0))
    for t in texts:
        base = [(s, n, e, k) for s, n, e, k, _ in found[t]]
        more = [(s, 5 if told[t][w] >= 0.95 else 6, e, "removed" if told[t][w] >= 0.95 else "generalised")
                for s, e, w in words[t] if w in told[t] and not any(b[0] < e and s < b[2] for b in base)]
        out[t] = sorted(base + more)
    return out


def masked(t, spans):
    masks = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[SECRET]", "", "[WORD]"]
    out, at = [], 0
    for s, n, e, _ in spans:
        if s >= at:
            out += [t[at:s], masks[n]]
        at = max(at, e)
    return "".join(out) + t[at:]


@pytest.fixture(scope="module")
def texts(spark, odd):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé😀") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    body = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(400):
        t = body(rng.randint(5, 30))
        if i % 8 == 0:
            t = f"{t} p{i % 5} jo{i % 3}@ex.org {body(4)} 1.2.3.{i % 4}{body(2)}"
        if i % 9 == 0:
            t += f'. TOKEN = "{rng.getrandbits(160):040x}" word{i % 4}@x.de é+49 30 1234567 {i % 6}'
        if i % 10 == 0:
            t = f"api_key: {'ab12' * 6} {t} secret = short1 password=aaaaaaaaaaaaaaaa1 my-token='A1b2C3d4E5f6G7h8=='"
        rows.append((50_000 + i, t, "en", "s"))
    rows += [(60_000, rows[8][1], "en", "s"), (60_000, rows[8][1], "en", "s"), (60_001, "4111111111111111@x.yy token:4111111111111111a", "en", "s")]
    return both(spark, odd.filter("doc_id <> 8 OR doc_id IS NULL")).unionByName(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))


def test_all_spans_by_brute_force(texts):
    rows = pii.find(texts, keep=["doc_id", "text"]).collect()
    want = brute_spans([r.text for r in rows])
    kinds = collections.Counter()
    for r in rows:
        assert [(s.start, s.kind_no, s.end, s.kind) for s in r.spans] == want.get(r.text, []), r.text
        assert [s.kind for s in r.base] == [s.kind for s in r.spans if s.kind in PII]
        assert all(r.text[s.start: s.end].translate(LOW) == s.value.translate(LOW) for s in r.spans)
        kinds.update(s.kind for s in r.spans)
    assert set(kinds) == {*PII, "secret", "removed", "generalised"}, kinds
    clean = {r.doc_id: r.text for r in pii.sanitise(texts.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    one = texts.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    want = brute_spans([r.text for r in one])
    assert clean == {r.doc_id: r.text if r.text is None else masked(r.text, want[r.text]) for r in one}


def test_secrets(spark):
    cases = {'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"': 1, "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI1K7MDENG5bPxRfiCY": 1,
             "the token is here: nothing": 0, "password: aaaaaaaaaaaaaaaaaaaaaaa1": 0, "tokens = 04dbebab91ab85687d33eeaaf9ac6": 0,
             "secret = abcdefghijklmnopqrstuvwxyz": 0, "secret = 12345678901234567890": 0, "Private-Key:'MIIEvQIBADANBgkqhkiG9w0B'": 1}
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.text: [s.value for s in r.spans if s.kind == "secret"] for r in pii.find(d).collect()}
    assert {t: len(v) for t, v in got.items()} == cases
    assert "04dbebab" not in " ".join(r.text for r in pii.sanitise(d).collect() if r.doc_id == 0)


def test_evidence_counts(spark):
    """A word of one text and one beside the identifier in ten texts: the first is generalised, the second removed."""
    rows = [(i, f"zorblax once{i} wrote to jo@ex.org about the list") for i in range(10)]
    rows += [(100 + i, f"somebody wrote to them about the list {i}") for i in range(3000)]
    rows += [(9000, "solitary wrote about the list to al@ex.org")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert out[9000] == "[WORD] wrote about the list to [EMAIL]"
    assert all(out[i] == f" [WORD] wrote to [EMAIL] about the list" or out[i] == f" once{i} wrote to [EMAIL] about the list" for i in range(10))


@pytest.mark.parametrize("kind", ["emails", "words"])
def test_time_grows_with_the_length(spark, kind):
    """A text twice as long takes about twice as long: 100,000 e-mails or words in one text."""
    made = {"emails": lambda n: " ".join(f"u{k}@ex{k % 977}.org" for k in range(n)),
            "words": lambda n: "jo@ex.org " + " ".join(f"w{k * 7919 % 100_003}" for k in range(n))}[kind]
    other = [(k, f"some text {k}") for k in range(50)]
    took = []
    for n in (1000, 50_000, 100_000):
        d = spark.createDataFrame([*other, (99, made(n))], "doc_id long, text string")
        began = time.time()
        r = pii.sanitise(d).filter("doc_id = 99").first()
        took.append(time.time() - began)
        assert "@" not in r.text
    assert took[2] - took[0] < 3.5 * max(took[1] - took[0], 1.0), took


def test_many_rows_of_one_text(spark):
    docs = table(spark, "documents").select("doc_id", "text").limit(50)
    hot = spark.range(3000).selectExpr("id + 1000000 AS doc_id", "'write to jo@ex.org now' AS text")
    got = pii.find(docs.unionByName(hot), keep=["doc_id"]).filter("doc_id >= 1000000")
    assert got.count() == 3000 and got.select(F.col("spans").cast("string")).distinct().count() == 1
