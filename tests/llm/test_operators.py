"""Each operator against a brute-force version, and on odd rows and empty tables."""
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.llm import (
    decontaminate,
    gam_quality,
    html_extract,
    langid,
    licenses,
    ngram_join,
    packing,
    pii,
    quality_rules,
    toxicity,
)
from tests.llm.conftest import SF001, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOW))


def both(spark, odd):
    """Small table and odd rows together."""
    docs = table(spark, "documents").select("doc_id", "text", "lang", "source")
    return docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000).select("doc_id", "text", "lang", "source"))


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_operators_on_odd_and_empty_rows(spark, odd, none):
    bench = table(spark, "benchmark")
    model = langid.train(odd)
    tox = toxicity.train(odd.withColumn("toxic", F.lit(1)))
    gam = gam_quality.train(odd.withColumn("quality", F.lit(1)))
    runs = {
        "licenses": lambda d: licenses.scan(d), "langid": lambda d: langid.predict(d, model),
        "toxicity": lambda d: toxicity.predict(d, tox), "gam": lambda d: gam_quality.predict(d, gam),
        "rules": lambda d: quality_rules.apply(d), "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "no items": lambda d: decontaminate.decontaminate(d, bench.filter("false")),
        "pii": lambda d: pii.find(d), "sanitise": lambda d: pii.sanitise(d), "join": lambda d: ngram_join.join(d)["rows"],
        "html": lambda d: html_extract.extract(d.withColumnRenamed("text", "html")),
    }
    for name, run in runs.items():
        assert run(odd).count() == odd.count(), name
        assert run(none).count() == 0, name
    assert packing.pack(none).count() == 0 and ngram_join.keep_one(none).count() == 0
    assert langid.train(none)[0] == [] and langid.predict(odd, langid.train(none)).filter("lang_pred <> 'und'").count() == 0
    und = {r.doc_id for r in langid.predict(odd, model).filter("lang_pred = 'und'").collect()}
    assert {3, 4, 5} <= und and 1 not in und


def test_licenses(spark, odd):
    texts = ["Under the MIT License, MIT license.", "GNU General Public License", "apache\nLICENSE version 2", "mit licensed",
             "permission is hereby granted, free of charge, to any person getting a copy of this software"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    labels = {k: sorted({m.label for m in r.matches}) for k, r in got.items()}
    assert labels == {0: ["mit"], 1: ["gpl"], 2: ["apache"], 3: [], 4: ["mit"]}
    assert [m.start for m in got[0].matches if m.base] == [2, 4] and 0.8 <= got[4].matches[0].share < 1
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for r in licenses.scan(both(spark, odd)).select("doc_id", "text", "n_words", "matches").collect():
        w = words(r.text)
        at = sorted((i, k) for k, p in phrases.items() for i in range(len(w)) if w[i: i + len(p)] == p)
        assert r.n_words == len(w) and at == sorted((m.start, m.label) for m in r.matches if m.base)


def test_packing(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = both(spark, odd).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = packing.pack(docs.repartition(3)).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for doc_id, text in rows(docs):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted(by[doc_id], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes()
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
    total = pad = 0
    for s in seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s])[:-1])
        n = sum(r.length for r in s)
        assert n <= 2048
        total, pad = total + n, pad + 2048 - n
    assert pad <= 0.01 * total + 2 * 2048
    assert packing.pack(odd).select("doc_id", "start").count() >= odd.count()      # null and repeated ids too


def brute_windows(docs, items, window=10):
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            grams[tuple(w[k: k + n])].add(str(i))
    sizes = {len(g) for g in grams}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k: k + n])) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[g]
        yield d, len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 24, 4000])
def test_decontaminate(spark, odd, block_bytes):
    docs = both(spark, odd)
    extra = spark.createDataFrame([(900, "erer the"), (901, "WORD"), (902, ""), (903, None), (904, "erer the")], "item_id long, text string")
    bench = table(spark, "benchmark").unionByName(extra)
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r.item_ids)) for r in
                 decontaminate.decontaminate(docs, bench, block_bytes=block_bytes, keep=["doc_id"]).collect())
    assert got == sorted((d or -1, n, h, f) for d, n, h, f in brute_windows(rows(docs), items))
    assert any(x[2] for x in got)


def test_quality_counts(spark, odd):
    for r in quality_rules.counts(both(spark, odd)).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = collections.Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
        rep = {i + j for i in range(len(w) - 2) if seen[tuple(w[i: i + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def pii_brute(t):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PII.items()) for m in re.finditer(p, t or "") if pii_valid(k, m[0]))


def test_pii_spans(spark, odd):
    texts = ["a@b.c._x@d.e and 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1", "é😀 x@y.zz, +1 (555) 123-4567 4111-1111 1111 1111 41111111111111112",
             "@@a@b..c a@b.c@d.e 4111 1111 1111 1112", "+1.2.3.4.5.6.7.8.9.0 +12", "0" * 400]
    docs = both(spark, odd.filter("doc_id <> 8")).unionByName(spark.createDataFrame(
        [(50_000 + i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    for r in pii.find(docs, keep=["doc_id", "text"]).collect():
        assert [(s.start, s.kind_no, s.end, s.kind) for s in r.base] == pii_brute(r.text)


def test_pii_discloses(spark):
    """A word that stands only beside one person's address is removed there; common words stay."""
    text = [(i, f"note {i} the agent zorblax wrote from jo@ex.org about item {i} of the list") for i in range(8)]
    text += [(100 + i, f"the agent {i} wrote about item {i} of the list and more {i}") for i in range(60)]
    d = spark.createDataFrame(text, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert all("zorblax" not in out[i] and "[EMAIL]" in out[i] and "the agent" in out[i] for i in range(8))
    assert all(out[i] == t for i, t in text if i >= 100)


def test_pii_discloses_from_one_text(spark):
    """A word of no other text is generalised beside an identifier of one text, as one text is little evidence; a word that another
    text has too stays."""
    text = [(0, "the agent zorblax blix wrote from jo@ex.org about the list")]
    text += [(1, "the agent blix wrote about the list")]
    text += [(100 + i, f"the agent {i} wrote from home about the list") for i in range(3000)]
    d = spark.createDataFrame(text, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert out[0] == "the agent [WORD] blix wrote from [EMAIL] about the list"
    assert all(out[i] == t for i, t in text if i)


def test_pii_discloses_over_whole_texts(spark):
    """A word far from the identifier, behind long words, is a candidate; texts are counted alike for n(t) and n(t, c)."""
    far = " ".join(["wrote", "x" * 200, "about the list"] * 10)
    text = [(i, f"zorblax {far} and asked jo@ex.org or 4.4.4.4") for i in range(2)]
    text += [(100 + i, f"the agent {i} asked and {far} or {i} more") for i in range(3000)]
    d = spark.createDataFrame(text, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert out[0] == out[1] == f"[WORD] {far} and asked [EMAIL] or [IP]"
    assert all(out[i] == t for i, t in text if i >= 100)


def brute_links(docs, k=5, least=0.8):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append(frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    where = collections.defaultdict(list)
    up, links = list(range(len(docs))), collections.Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in enumerate(sets):
        shared = collections.Counter(e for g in s for e in where[g])
        for g in s:
            where[g].append(d)
        for e, n in shared.items():
            if n >= least * (len(s) + len(sets[e]) - n) - 1e-9:
                links[d] += 1
                links[e] += 1
                a, b = sorted((root(d), root(e)))
                up[b] = a
    low = {}
    for d in range(len(docs)):
        ids = low.setdefault(root(d), [])
        if docs[d][0] is not None:
            ids.append(docs[d][0])
    return sorted((docs[d][0] if docs[d][0] is not None else -1, min(low[root(d)], default=-1), links[d]) for d in range(len(docs)))


@pytest.mark.parametrize("options", [{}, {"small_bucket": 2, "block_bytes": 4000}])
def test_ngram_join(spark, odd, options):
    docs = both(spark, odd)
    base = "one two three four five six seven eight nine ten " * 6
    near = [(70_000 + i, base + " ".join(f"w{j}" for j in range(60)) + f" x{i % 9}" + " tail" * (i % 3), "en", "s") for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string, lang string, source string"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links)
                 for r in ngram_join.join(docs, **options)["rows"].collect())
    assert got == brute_links(rows(docs))
    if not options:
        assert ngram_join.keep_one(docs.filter("doc_id IS NOT NULL")).count() == len({c for d, c, _ in got if d >= 0})


def test_bands():
    for s, recall in ((0.8, 0.999), (0.7, 0.99), (0.9, 0.9999)):
        b, r = ngram_join.bands_for(s, recall)
        assert 1 - (1 - s ** r) ** b >= recall


PAGE = ("<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body class=has-sidebar><div class='page with-sidebar'>"
        "<nav><a>Home</a></nav><div class=ad>Buy</div><article><header>By me</header><h1>Head &amp; line</h1><p>First <b>bold</b>\n text.<p>Second&nbsp;one"
        "<form>mail</form><div id='comments'><p>nice</p></div></article><aside>more</aside></div><footer>&copy;</footer>")


def test_html():
    assert html_extract.main_text(PAGE) == "Head & line\n\nFirst bold text.\n\nSecond one"
    plain = "<div><a>x</a><a>y</a><a>z</a></div><div><p>" + "Long text here. " * 20 + "</p><p>Short.</p></div><div><a>q</a><a>r</a></div>"
    assert html_extract.main_text(plain) == ("Long text here. " * 20).strip() + "\n\nShort."
    for broken in (None, "", "   ", "<", "<p", "<!--", "<p>a" * 3000, "</div>" * 1000, "<div>" * 5000 + "x", "&am", "<script>"):
        assert isinstance(html_extract.main_text(broken), str)


def test_langid_prior(spark):
    """A text that fits two languages alike goes to the one with more labelled texts, and the prior is theirs."""
    d = spark.createDataFrame([(i, "same words here", "zz" if i < 9 else "aa") for i in range(10)], "doc_id long, text string, lang string")
    langs, logs = langid.train(d)
    assert langs == ["aa", "zz"] and np.allclose(np.exp(logs[:, -1]), [1.5 / 11, 9.5 / 11])
    even = np.zeros_like(logs)
    even[:, -1] = logs[:, -1]
    x = spark.createDataFrame([(0, "q")], "doc_id long, text string")
    assert langid.predict(x, (langs, even)).first().lang_pred == "zz"


def test_held_out_accuracy(spark):
    from labelweave.llm import queries
    docs = table(spark, "documents", SF001)
    lang = queries.queries()["op7_langid"](spark, SF001).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    for name, col in (("op4_toxicity", "toxic"), ("op9_gam_quality", "quality")):
        df = queries.queries()[name](spark, SF001)
        assert df.count() == docs.count() and df.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
        got = df.join(table(spark, "labels", SF001), "doc_id").filter("held_out")
        assert got.agg(F.avg((F.col("predicted") == F.col(col)).cast("int"))).first()[0] > 0.93


def test_pipeline_against_brute_force(spark):
    """Every stage on what its predecessor kept."""
    import corpus_pipeline
    from tests.llm.conftest import SF0001

    docs = table(spark, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF0001)
        assert out.columns == docs.columns
        before = {r.doc_id: r for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()}
        if name == "quality_rules":
            want = {r.doc_id for r in quality_rules.apply(docs).filter("kept").collect()}
        elif name == "ngram_join":
            want = {c for _, c, _ in brute_links(rows(docs))}
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
            want = {d for d, _, hit, _ in brute_windows(rows(docs), items) if not hit}
        else:
            want = set(before)
            for d, r in after.items():
                assert not pii_brute(r.text) and r.n_chars == len(r.text)
                assert pii_brute(before[d].text) or r.text == before[d].text
        assert set(after) == want, name
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    parts = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, SF0001).collect():
        assert len(p.ids) == 4 * p.length
        parts[p.doc_id].append((p.start, bytes(p.ids)))
    assert {d: b"".join(x for _, x in sorted(v)) for d, v in parts.items()} == {
        r.doc_id: np.array(tok.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes() for r in docs.collect()}


def test_queries_match_their_sql(spark):
    import duckdb

    from labelweave.llm import queries
    from tests.llm.conftest import SF0001
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    digest = lambda cols, data: hashlib.md5(repr(sorted(
        tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in data)).encode()).hexdigest()
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, SF0001), con.execute(sql)
        assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest([c[0] for c in want.description], want.fetchall()), name
