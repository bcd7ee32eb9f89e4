"""Information-theoretic sanitisation of personal data (operator 5).

1. Direct identifiers (e-mail, IP, card and phone numbers) are found by their
   patterns, and secrets as long mixed values behind a key word and a sign, all as code-point spans.
2. Each distinct identifier or secret is a protected entity ``c``. From the whole corpus
   come, counted over distinct texts, n(c), n(t), n(t, c) (texts that hold word
   ``t`` and c, however far apart) and N. The share of c's information that t
   discloses is ``PMI(t, c) / IC(c)`` with ``IC = -log2(n(c) / N)`` and
   ``PMI = log2(N P(c|t) / n(c))``, where P(c|t) is not n(t,c) / n(t) itself but the lower end
   of its Wilson interval: little evidence counts for less, also that of a single text.
3. In texts that hold c, words with at least ``REMOVE_AT`` of its information
   are removed and words with at least ``GENERALISE_AT`` generalised, wherever
   they stand outside the identifiers. Every entity and pair counts. Copies of a text count once.

All steps are DataFrame expressions, joins, windows and pre-aggregated counts: no Python
runs on the executors. Only texts with an entity are cut into rows of matches and words; their places are running
sums of lengths in a window per text, and words that overlap an identifier fall out in one ordered
pass, so the work for a text grows with its length however many matches it holds. Words of the whole
corpus are counted for the vocabulary of those texts alone. Spark broadcasts tables that are written first only below
its threshold; the vocabulary is broadcast if it is measured to be below ``VOCABULARY_BYTES``.

The patterns use possessive forms that match the same spans without
backtracking, so very long texts stay linear and the regex stack stays flat.

Defined cases: a null text is empty: no spans, and it stays null in the output;
repeated rows are treated alike; spans that start together go by kind, as listed; an empty table gives an empty
result; input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.llm.common import WORD_RE, ascii_lower, cut, table, without
from labelweave.llm.registry import query

# kind -> (character that must occur, pattern), in the order of the contract
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9]){13,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# a key word, a sign, and a value of 16 or more characters; the value is the span
SECRET, REMOVED, GENERALISED = "secret", "removed", "generalised"
_VALUE = r"[A-Za-z0-9+/_-]{16,}+=*+"
SECRET_RE = (r"(?i)(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,20}[_-])?(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|"
             rf"credentials?)[\"']?\s{{0,4}}[:=]\s{{0,4}}[\"']?{_VALUE}")
DISTINCT = 8              # a secret has so many different characters, digits and letters among them
FOUND = [*KINDS, SECRET]
ORDER = [*FOUND, REMOVED, GENERALISED]
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", SECRET: "[SECRET]", REMOVED: "", GENERALISED: "[WORD]"}
COMMON = 1000             # words of more than one in so many texts are joined by broadcast
REMOVE_AT = 0.95
GENERALISE_AT = 0.8
Z = 1.645                 # of the Wilson interval: 95 percent, one side
VOCABULARY_BYTES = 32 << 20
KEY = ["k1", "k2"]        # two hashes of a text; one of 64 bits would repeat within some 1e9 texts
_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string,from:int,to:int,covered:int>>"


def with_key(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(7), text))


def _pattern(kind: str) -> str:
    return SECRET_RE if kind == SECRET else KINDS[kind][1]


def _there(text: Column, kind: str) -> Column:
    """The pattern matches; most texts fail the search for a character that it needs."""
    if kind == SECRET:
        return (text.contains("=") | text.contains(":")) & text.rlike(SECRET_RE)
    needs, pattern = KINDS[kind]
    return text.contains(needs) & text.rlike(pattern) if needs else text.rlike(pattern)


def _matches(text: Column, kind: str) -> Column:
    """Every match of a kind with its number and the lengths, in code points and bytes, of the match and of the gap before it."""
    pattern = _pattern(kind)
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(values, F.slice(gaps, 1, F.greatest(F.size(values), F.lit(0))), lambda v, g: F.struct(
        v.alias("value"), F.length(g).alias("gap"), F.octet_length(g).alias("gap_bytes")))
    found = F.transform(pairs, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nr"), x["value"].alias("value"),
                                                     x["gap"].alias("gap"), x["gap_bytes"].alias("gap_bytes")))
    none = F.array().cast("array<struct<kind:string,nr:int,value:string,gap:int,gap_bytes:int>>")
    return F.when(_there(text, kind), found).otherwise(none)


def _located(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Adds start, end (code points) and from, to (bytes): running sums of the lengths in each text's pieces."""
    so_far = Window.partitionBy(*KEY, *by).orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size, octets = F.length("value"), F.octet_length("value")
    ends = pieces.withColumn("end", F.sum(F.col("gap") + size).over(so_far).cast("int")).withColumn(
        "to", F.sum(F.col("gap_bytes") + octets).over(so_far).cast("int"))
    return ends.withColumn("start", F.col("end") - size).withColumn("from", F.col("to") - octets).drop("nr", "gap", "gap_bytes")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(
            F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(v))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == SECRET:
        return (F.size(F.array_distinct(F.split(F.substring(v, 1, 200), ""))) >= DISTINCT) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return F.lit(True)


def located_entities(texts: DataFrame) -> DataFrame:
    """Spans of identifiers and secrets, a row each: k1, k2, kind, value, start, end, from, to. ``texts``: k1, k2, text, each text once."""
    found = texts.select(*KEY, F.explode(F.concat(*[_matches(F.col("text"), k) for k in FOUND])).alias("m")).select(*KEY, "m.*")
    rows = _located(found, ["kind"])
    tail = F.when(F.col("kind") == SECRET, F.regexp_extract("value", _VALUE + "$", 0)).otherwise(F.col("value"))
    rows = rows.withColumn("tail", tail)       # a secret without its key word; the value is ASCII
    rows = rows.select(*KEY, "kind", F.col("tail").alias("value"), (F.col("end") - F.length("tail")).alias("start"), "end",
                       (F.col("to") - F.octet_length("tail")).alias("from"), "to")
    ok = None
    for k in FOUND:
        ok = F.when(F.col("kind") == k, _valid(k, F.col("value"))) if ok is None else ok.when(F.col("kind") == k, _valid(k, F.col("value")))
    return rows.filter(ok)


def lower_end(hits: Column, n: Column) -> Column:
    """Lower end of the Wilson interval of the rate hits / n."""
    p, z = hits / n, F.lit(Z)
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing_words(texts: DataFrame, copies: DataFrame, entities: DataFrame, words: DataFrame) -> DataFrame:
    """(k1, k2, word, action) of the words that disclose an entity of a text.

    ``texts``: k1, k2, text of all rows; ``copies``: k1, k2, m; ``entities``: spans of ``located_entities``;
    ``words``: k1, k2, word of the texts with an entity. Entities of the very same texts share all
    their counts and form one group."""
    total = float(copies.count())
    value = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("value"))).when(
        F.col("kind") == SECRET, F.col("value")).otherwise(F.lower("value"))
    each = cut(entities.select(*KEY, F.concat_ws(":", "kind", value).alias("entity")).distinct(), "pii-entities")
    # a set of texts is known by its size and two sums of hashes, which merge in the shuffle
    n_entity = each.groupBy("entity").agg(
        F.count(F.lit(1)).alias("nc"), F.bit_xor("k1").alias("x"), F.bit_xor("k2").alias("y"))
    n_entity = n_entity.select("entity", "nc", F.concat_ws(":", "nc", "x", "y").alias("group"))
    held = cut(each.join(n_entity, "entity").select(*KEY, "group", "nc").distinct(), "pii-held")
    top = float(held.agg(F.max("nc")).first()[0] or 0)

    # as P(c|t) <= n(c) / n(t), the share of a word of more texts than this stays below GENERALISE_AT
    def most(nc):
        return 1.000001 * total * F.pow(nc / F.lit(max(total, 1.0)), F.lit(GENERALISE_AT))

    in_texts = words.filter(~F.col("word").rlike("^[0-9]+$")).distinct()
    here = cut(in_texts.select("word").distinct(), "pii-vocabulary")
    size = here.agg(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()[0]
    known = F.broadcast(here) if size <= VOCABULARY_BYTES else here
    # n(t) over distinct texts: a row counts as one over the number of rows with its text
    weighed = texts.join(copies.filter("m > 1"), KEY, "left").select(
        (1 / F.coalesce("m", F.lit(1))).alias("weight"), ascii_lower(F.col("text")).alias("low"))
    n_word = weighed.select("weight", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(WORD_RE), F.lit(0)))).alias("word"))
    if size <= VOCABULARY_BYTES:       # else after the counts, which are far fewer than the words
        n_word = n_word.join(known, "word", "left_semi")
    n_word = n_word.groupBy("word").agg(F.round(F.sum("weight")).alias("nt"))
    n_word = cut(n_word.join(known, "word", "left_semi"), "pii-words")
    # words of many texts (at most COMMON times the words of a text) go first, so that no key is hot in the next join
    common = n_word.filter((F.col("nt") > most(F.lit(top))) & (F.col("nt") > total / COMMON)).select("word")
    rare = n_word.filter(F.col("nt") <= most(F.lit(top)))
    pairs = (in_texts.join(F.broadcast(common), "word", "left_anti").join(rare, "word")
             .join(held, KEY).filter(F.col("nt") <= most(F.col("nc"))))
    both = pairs.groupBy("group", "nc", "word", "nt").agg(F.count(F.lit(1)).alias("ntc"))
    ic = -F.log2(F.col("nc") / F.lit(total))
    pmi = F.log2(F.lit(total) * lower_end(F.col("ntc"), F.col("nt")) / F.col("nc"))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0)
    told = cut(both.withColumn("share", share).filter(F.col("share") >= GENERALISE_AT).select("group", "word", "share"), "pii-disclosing")
    return held.join(told, "group").groupBy(*KEY, "word").agg(
        F.when(F.max("share") >= REMOVE_AT, REMOVED).otherwise(GENERALISED).alias("action"))


def spans_by_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, spans) of the texts with an entity; spans as an array by start, then kind."""
    texts = with_key(docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL"), F.col("text")).select(*KEY, "text")
    copies = cut(texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m")), "pii-copies")
    text = F.col("text")
    some = None
    for kind in FOUND:
        one = _there(text, kind)
        some = one if some is None else some | one
    hits = cut(texts.filter(some).dropDuplicates(KEY), "pii-found")
    entities = cut(located_entities(hits), "pii-spans")
    # the words of the texts with an entity, with their places
    low = ascii_lower(text)
    pairs = F.zip_with(F.regexp_extract_all(low, F.lit(WORD_RE), F.lit(0)), F.split(low, WORD_RE, -1), lambda w, g: F.struct(
        w.alias("value"), F.length(g).alias("gap"), F.octet_length(g).alias("gap_bytes")))
    words = hits.join(entities.select(*KEY).distinct(), KEY, "left_semi").select(
        *KEY, F.posexplode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("nr", "w"))
    words = cut(_located(words.select(*KEY, "nr", "w.*"), []).withColumnRenamed("value", "word"), "pii-places")
    told = disclosing_words(texts, copies, entities, words.select(*KEY, "word"))
    at = words.join(told, [*KEY, "word"]).withColumnsRenamed({"action": "kind", "word": "value"})
    every = entities.unionByName(at)
    # a word falls out if an identifier that starts before the word's end ends after its start
    own = F.col("kind").isin(*FOUND)
    ordered = Window.partitionBy(*KEY).orderBy(F.when(own, F.col("start")).otherwise(F.col("end")), own).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("_upto", F.max(F.when(own, F.col("end"))).over(ordered)).filter(
        own | F.coalesce(F.col("_upto") <= F.col("start"), F.lit(True)))
    kind_no = F.create_map(*[F.lit(x) for k, n in enumerate(ORDER) for x in (n, k)])
    before = Window.partitionBy(*KEY).orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("kind_no", F.try_element_at(kind_no, F.col("kind"))).withColumn(
        "covered", F.coalesce(F.max("to").over(before), F.lit(0)))
    fields = ["start", "kind_no", "end", "kind", "value", "from", "to", "covered"]
    return every.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("spans"))


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``base`` (identifiers only) and ``spans`` (all): arrays of start, kind_no, end, kind, value, by start,
    then kind; ``from`` and ``to`` are the byte offsets, ``covered`` the end of the spans before."""
    cols = keep if keep is not None else docs.columns
    docs = without(docs, ["base", "spans"], [text_col])
    cols = [c for c in cols if c in docs.columns]
    per_text = cut(spans_by_text(docs, text_col), "pii-texts").withColumnsRenamed({"k1": "_t1", "k2": "_t2"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*cols, F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2"))
    rows = rows.join(per_text, (F.col("_k1") == F.col("_t1")) & (F.col("_k2") == F.col("_t2")), "left")
    spans = F.coalesce("spans", F.array().cast(_SPAN))
    base = F.filter(spans, lambda s: s["kind_no"] < len(KINDS))
    return rows.select(*cols, base.alias("base"), spans.alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with identifiers and secrets masked and disclosing words generalised or removed."""
    cols = docs.columns
    found = find(docs, text_col)
    masks = F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])

    def rebuilt(raw: Column) -> Column:
        def between(start: Column, stop: Column) -> Column:
            return F.substring(raw, start + 1, stop - start).cast("string")

        pieces = F.transform("spans", lambda s: F.when(s["from"] >= s["covered"], F.concat(
            between(s["covered"], s["from"]), F.try_element_at(masks, s["kind"]))).otherwise(""))
        last = F.element_at("spans", -1)
        return F.concat(F.array_join(pieces, ""), between(F.greatest(last["to"], last["covered"]), F.octet_length(raw)))

    # the bytes are bound once: a cast inside the lambda would copy the whole text for each span
    new = F.transform(F.array(F.col(text_col).cast("binary")), rebuilt)[0]
    new = F.when(F.size("spans") > 0, new).otherwise(F.col(text_col))
    return found.withColumn(text_col, new).select(*[c for c in cols if c in found.columns])


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    private = F.size(F.filter("spans", lambda s: s["kind_no"] < len(FOUND))).cast("long")
    return found.select("doc_id", *[_number(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
                        _number(SECRET).alias("n_secret"), private.alias("n_private"))
