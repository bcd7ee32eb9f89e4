"""Tolerant JSON extraction, repair, standardisation and validation as
Column expressions (J1–J17).

Design: a model answer is parsed into ``map<string,string>`` with
``from_json`` (values keep their JSON text; types are applied at use from
the codebook). Every repair is a ``regexp_replace``; the balanced-brace
scan is a ``F.aggregate`` fold over the braces, quotes and backslashes of the text. Repairs
are applied cumulatively and a parse is attempted after each one; the
first success wins. Both the repair cascade and the extraction ladder are
folds over a step index (``F.aggregate``), so each sub-expression appears
once in the plan and later steps are skipped lazily once one succeeds;
intermediate values are bound once with a one-element ``transform``
("let").
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelweave.codebook import (BINARY, BINARY_STRICT, LABEL_LIST, NUMERIC_01, NUMERIC_STANCE, STANCE,
                                 Codebook, Group)
from labelweave.functions.text import strip_ws, to_double

MAP_T = "map<string,string>"
ARR_T = "array<map<string,string>>"
# strict JSON: Spark's reader is lenient about single quotes by default
JSON_OPTS = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false",
             "allowComments": "false", "allowNumericLeadingZeros": "false",
             "allowBackslashEscapingAnyCharacter": "false", "mode": "PERMISSIVE"}

END_MARK = "$labelweave-end$"     # key of the object that follows a text in ``strict_parse``

# ---------------------------------------------------------------------------
# FIXED VALUES — repair patterns (Java regex syntax), applied in this order.
CODE_FENCE = r"```(?:json|JSON)?(?U)\s*([\s\S]*?)\s*```"
TAIL_JSON = r"(?s)(\{.*\})(?U)\s*$"
SPACE_SEPARATED = r"^(?U)\s*(-?\d+(?:\.\d+)?(?:\s+-?\d+(?:\.\d+)?){6})\s*$"
DOUBLE_DECIMAL_SCI = (r"(\d+\.\d+)\.0e-1", "$1e-1")
DOUBLE_DECIMAL = (r"(\d+\.\d+)\.0+(?=[\s,}\]])", "$1")
# malformed keys: (pattern, replacement). The two special cases come first so
# the generic rules cannot eat their closing quote; the third rule repairs a
# value left inside the key quotes when the next key follows directly.
MALFORMED_KEY_RULES = [
    (r'"china_stance_score:0":"0"', '"china_stance_score":0'),
    (r'"inauthentic:0,"', '"inauthentic_content":0,"'),
    (r'"([a-z_]+):([^",]*),"(?=[a-z_])', '"$1":$2,"'),
    (r'"([a-z_]+):([^"]*)"(\s*:\s*)"([^"]*)"', '"$1":$2'),
    (r'"([a-z_]+):([^"]*)"(?=\s*[,}])', '"$1":$2'),
    (r'"inauthentic:([^"]*)"', '"inauthentic_content":$1'),
    (r'"hate:([^"]*)"', '"hate_speech":$1'),
    (r'"harmful:([^"]*)"', '"harmful_content":$1'),
    (r'"news:([^"]*)"', '"news_segments":$1'),
    (r'([,{]\s*)inauthentic:(\d)', '$1"inauthentic_content":$2'),
    (r'([,{]\s*)hate:(\d)', '$1"hate_speech":$2'),
    (r'([,{]\s*)harmful:(\d)', '$1"harmful_content":$2'),
    (r'([,{]\s*)news:(\d)', '$1"news_segments":$2'),
    (r'"inauthentic:0,', '"inauthentic_content":0,'),
    (r'([,{]\s*)(harmful0)(\s*:)', '$1"harmful_content"$3'),
    (r'([,{]\s*)(hate0)(\s*:)', '$1"hate_speech"$3'),
    (r'([,{]\s*)(news0)(\s*:)', '$1"news_segments"$3'),
    (r'([,{]\s*)(inauthentic0)(\s*:)', '$1"inauthentic_content"$3'),
    (r'"china_stance"(\s*:)', '"china_stance_score"$1'),
]
TRUNC_DANGLING = r":\s*$|:\s*,"
TRUNC_ENDS_DIGIT = r"^\{[^}]*\d+\s*$"
TRUNC_ENDS_COMMA = r"^\{[^}]*,\s*$"
TRUNC_ENDS_PAIR = r'^\{[^}]*"[^"]*":\d+\.?\d*\s*$'
PLACEHOLDER = (r'"\.\.\."|"…"', '"truncated"')
TRAILING_COMMA = (r",\s*([}\]])", "$1")
# keys searched by the last-resort pattern rung when a record has no group
PATTERN_KEYS = ("china_stance_score", "china_ccp_government", "china_sensitive")
# ---------------------------------------------------------------------------


def let(expr: Column, fn: Callable[[Column], Column]) -> Column:
    """Bind ``expr`` once and use it several times inside ``fn``."""
    return F.transform(F.array(expr), fn)[0]


# --- J1 / J4 ---------------------------------------------------------------

def strip_code_fence(s: Column) -> Column:
    """Content of the first code fence, else the text unchanged."""
    return F.when(s.rlike(CODE_FENCE), F.regexp_extract(s, CODE_FENCE, 1)).otherwise(s)


def tail_json(s: Column) -> Column:
    """From the first '{' whose text ends with '}' (+ spaces) to the end."""
    return F.when(s.rlike(TAIL_JSON), F.regexp_extract(s, TAIL_JSON, 1))


# --- J2 / J3: balanced-brace fold ------------------------------------------

# a token: other text, if any, and the brace, quote or backslash that ends it
BRACE_TOKEN = r'[^{}"\\]*[{}"\\]'


def brace_scan(s: Column, every: bool = False) -> Column:
    """Fold over the tokens of ``s``: top-level ``{...}`` blocks, string and
    escape aware. Outside a block only '{' matters; an unclosed block runs to
    the end and is not reported. Text after the last token cannot close a block.

    Returns array<struct<s,e>> of the last block (or of ``every`` block),
    1-based inclusive code-point positions. A token is one step, so plain text
    costs nothing per character.
    """
    def state(a, t, depth=None, in_str=False, esc=None, start=None, blocks=None):
        return F.struct((a["pos"] + F.length(t)).alias("pos"),
                        (a["depth"] if depth is None else depth).alias("depth"),
                        F.lit(in_str).alias("in_str"),
                        (F.lit(False) if esc is None else esc).alias("esc"),
                        (a["start"] if start is None else start).alias("start"),
                        (a["blocks"] if blocks is None else blocks).alias("blocks"))

    def step(a, t):
        end = a["pos"] + F.length(t)
        block = F.array(F.struct(a["start"].alias("s"), end.alias("e")))
        blocks = F.concat(a["blocks"], block) if every else block
        outside = F.when(t.endswith("{"), state(a, t, F.lit(1), start=end)).otherwise(state(a, t))
        string = (F.when(a["esc"] & (F.length(t) == 1), state(a, t, in_str=True))
                  .when(t.endswith('"'), state(a, t))
                  .otherwise(state(a, t, in_str=True, esc=t.endswith("\\"))))
        return (F.when(a["depth"] == 0, outside).when(a["in_str"], string)
                .when(t.endswith('"'), state(a, t, in_str=True))
                .when(t.endswith("{"), state(a, t, a["depth"] + 1))
                .when(t.endswith("}") & (a["depth"] == 1), state(a, t, F.lit(0), blocks=blocks))
                .when(t.endswith("}"), state(a, t, a["depth"] - 1))
                .otherwise(state(a, t)))

    init = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(False).alias("in_str"), F.lit(False).alias("esc"),
                    F.lit(0).alias("start"), F.array().cast("array<struct<s:int,e:int>>").alias("blocks"))
    return F.aggregate(F.regexp_extract_all(s, F.lit(BRACE_TOKEN), 0), init, step, lambda a: a["blocks"])


def _block(s: Column, b: Column) -> Column:
    return F.substring(s, b["s"], b["e"] - b["s"] + 1)


def last_balanced_block(s: Column) -> Column:
    """Text of the last complete top-level {...} block, or null."""
    return let(brace_scan(s), lambda found: F.when(F.size(found) > 0, _block(s, found[0])))


def balanced_blocks(s: Column) -> Column:
    """J3 building block: every complete top-level block, in order."""
    return F.transform(brace_scan(s, every=True), lambda b: _block(s, b))


# --- strict parse ------------------------------------------------------------

def strict_parse(s: Column) -> Column:
    """Parse a JSON object text into map<string,string>, as strictly as a
    standard JSON loader: the whole (whitespace-trimmed) text must be exactly
    one object. Returns null otherwise.

    Spark's reader ignores trailing text after the first value, so the text is
    parsed as the first element of an array whose second element is a mark:
    only if the text is exactly one value does the mark come second.
    """
    def body(t):
        arr = F.from_json(F.concat(F.lit("["), t, F.lit(',{"%s":""}]' % END_MARK)), ARR_T, JSON_OPTS)
        return F.when(t.startswith("{") & t.endswith("}"), let(arr, lambda a: F.when(
            (F.size(a) == 2) & F.coalesce(F.map_contains_key(F.get(a, F.lit(1)), F.lit(END_MARK)), F.lit(False)),
            F.get(a, F.lit(0)))))
    return let(strip_ws(s), body)


# --- J5–J10 repairs ----------------------------------------------------------

def fix_space_separated(s: Column, keys: tuple[str, ...]) -> Column:
    """Exactly len(keys) numbers separated by spaces -> object."""
    n = len(keys)
    pat = SPACE_SEPARATED.replace("{6}", "{%d}" % (n - 1))

    def build(parts):
        pieces = [F.lit("{")]
        for i, k in enumerate(keys):
            pieces += [F.lit(("," if i else "") + '"' + k + '":'), parts[i]]
        pieces.append(F.lit("}"))
        return F.concat(*pieces)
    return F.when(s.rlike(pat), let(F.split(strip_ws(s), r"(?U)\s+"), build)).otherwise(s)


def fix_double_decimal(s: Column) -> Column:
    """0.4.0e-1 -> 0.4e-1 (=0.04); 0.0.0 -> 0.0."""
    s = F.regexp_replace(s, DOUBLE_DECIMAL_SCI[0], DOUBLE_DECIMAL_SCI[1])
    return F.regexp_replace(s, DOUBLE_DECIMAL[0], DOUBLE_DECIMAL[1])


def fix_malformed_keys(s: Column, rules=MALFORMED_KEY_RULES) -> Column:
    """Ordered regex rule table folded into one expression."""
    for pat, rep in rules:
        s = F.regexp_replace(s, pat, rep)
    return s


def fix_truncated(s: Column) -> Column:
    """Drop dangling ':' then close an object cut after a number or comma."""
    s = F.regexp_replace(s, TRUNC_DANGLING, "")
    return (F.when(s.rlike(TRUNC_ENDS_DIGIT), F.concat(strip_ws(s), F.lit("}")))
            .when(s.rlike(TRUNC_ENDS_COMMA),
                  F.concat(strip_ws(F.regexp_replace(s, ",+$", "")), F.lit("}")))
            .when(s.rlike(TRUNC_ENDS_PAIR), F.concat(strip_ws(s), F.lit("}")))
            .otherwise(s))


def fix_placeholders(s: Column) -> Column:
    """J9: "..." / "…" -> "truncated"."""
    return F.regexp_replace(s, PLACEHOLDER[0], PLACEHOLDER[1])


def fix_trailing_commas(s: Column) -> Column:
    """J10."""
    return F.regexp_replace(s, TRAILING_COMMA[0], TRAILING_COMMA[1])


def repair_parse(s: Column, cb: Codebook) -> Column:
    """Parse; else repair cumulatively (J5, J6, J7, J8, J9, J10) and
    retry after each step. First successful parse wins.

    Written as a fold over the step index so each repair and the parser
    appear once in the plan; once a step parses, later steps are skipped
    (the CASE is evaluated lazily).
    """
    steps = [
        lambda x: x,
        (lambda x: fix_space_separated(x, cb.space_separated_keys)) if cb.space_separated_keys
        else (lambda x: x),
        fix_double_decimal,
        fix_malformed_keys,
        fix_truncated,
        fix_placeholders,
        fix_trailing_commas,
    ]
    init = F.struct(s.alias("s"), F.lit(None).cast(MAP_T).alias("m"))

    def step(acc, i):
        prev = acc["s"]
        cur = None
        for n, fn in enumerate(steps):
            cur = F.when(i == n, fn(prev)) if cur is None else cur.when(i == n, fn(prev))
        nxt = let(cur, lambda c: F.struct(
            c.alias("s"), F.when((i == 0) | (c != prev), strict_parse(c)).alias("m")))
        return F.when(acc["m"].isNotNull(), acc).otherwise(nxt)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), init, step)["m"]


# --- J12 standardise, J13 gate, J14–J16 validate ----------------------------

def _lit_map(d: dict[str, str]) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def standardize(m: Column, cb: Codebook) -> Column:
    """Rename known spellings to canonical keys, drop every other key,
    and fold stance answers to the canonical neutral form / lower case."""
    alias = _lit_map(cb.alias_map())
    renamed = F.map_filter(
        F.transform_keys(m, lambda k, v: F.coalesce(F.try_element_at(alias, k), F.lit(""))),
        lambda k, v: k != "")
    stance_keys = [d.key for d in cb.dimensions if d.categorical == STANCE]
    if not stance_keys:
        return renamed
    neutral = list(cb.stance_neutral_forms)

    def fold(k, v):
        t = F.lower(strip_ws(v))
        nv = (F.when(t.isin(*neutral), F.lit(cb.stance_neutral))
              .when(t.isin("pro", "anti"), t).otherwise(v))
        return F.when(k.isin(*stance_keys), nv).otherwise(v)
    return F.transform_values(renamed, fold)


def _num(v: Column) -> Column:
    return to_double(v)


def _in_range(v: Column, lo: float, hi: float) -> Column:
    x = _num(v)
    return F.coalesce((x >= lo) & (x <= hi), F.lit(False))


def _yn_field(v: Column) -> Column:
    return F.coalesce(v.isin("yes", "no", "cannot_determine"), F.lit(False)) | _in_range(v, 0.0, 1.0)


def _yes_no_only(v: Column) -> Column:
    return F.coalesce(v.isin("yes", "no"), F.lit(False)) | _in_range(v, 0.0, 1.0)


_STANCE_STRICT = ("pro", "anti", "neutral/unclear")
_STANCE_LOOSE = ("pro", "anti", "neutral", "neutral/unclear", "cannot_determine")


def _domain(kind: str, v: Column, level: str) -> Column:
    """level: 'complete' (all dims present), 'partial', or 'group'."""
    if kind == STANCE:
        allowed = _STANCE_STRICT if level == "complete" else _STANCE_LOOSE
        return F.coalesce(v.isin(*allowed), F.lit(False))
    if kind == BINARY_STRICT:
        return _yes_no_only(v) if level in ("complete", "group") else _yn_field(v)
    if kind == BINARY:
        return _yn_field(v)
    if kind == NUMERIC_STANCE:
        return _in_range(v, -1.0, 1.0)
    if kind == NUMERIC_01:
        return _in_range(v, 0.0, 1.0)
    raise ValueError(kind)


def label_list(v: Column, allowed: tuple[str, ...], exclusive: str | None) -> Column:
    """A JSON list of strings, not empty, every one allowed; the exclusive value stands alone.

    Map values hold a list's JSON text, so a string that spells a list passes like the list."""
    found = F.from_json(v, "array<string>", JSON_OPTS)
    ok = (F.size(found) > 0) & F.forall(found, lambda x: F.coalesce(x.isin(*allowed), F.lit(False)))
    if exclusive is not None:
        ok = ok & ((F.size(found) == 1) | ~F.array_contains(found, exclusive))
    return F.coalesce(F.when(v.startswith("["), ok), F.lit(False))


def _has(m: Column, k: str) -> Column:
    return F.map_contains_key(m, F.lit(k))


def _get(m: Column, k: str) -> Column:
    return F.try_element_at(m, F.lit(k))


def complete_record(m: Column, cb: Codebook) -> Column:
    cond = F.lit(True)
    for k in cb.keys:
        cond = cond & _has(m, k)
    return cond


def _kind_domain(kind: Column, v: Column, level: str) -> Column:
    """``_domain`` with the label type as a Column (one copy in the plan
    instead of one per dimension)."""
    stance = _STANCE_STRICT if level == "complete" else _STANCE_LOOSE
    strict_bin = _yes_no_only(v) if level in ("complete", "group") else _yn_field(v)
    return (F.when(kind == STANCE, F.coalesce(v.isin(*stance), F.lit(False)))
            .when(kind == BINARY_STRICT, strict_bin)
            .when(kind == BINARY, _yn_field(v))
            .when(kind == NUMERIC_STANCE, _in_range(v, -1.0, 1.0))
            .when(kind == NUMERIC_01, _in_range(v, 0.0, 1.0))
            .otherwise(F.lit(False)))


def _lists_ok(m: Column, cb: Codebook) -> Column:
    """Present list labels are inside their domains (true without such dimensions)."""
    ok = F.lit(True)
    for d in cb.dimensions:
        if d.categorical == LABEL_LIST:
            ok = ok & (~_has(m, d.key) | label_list(_get(m, d.key), d.allowed, d.exclusive))
    return ok


def valid_ungrouped(m: Column, cb: Codebook, strict: bool = True) -> Column:
    """All dimensions present -> strict domains; some present -> check
    only the present ones; none -> invalid. With ``strict`` a present legacy
    stance score must also be a number in [-1, 1].

    Written over the map entries with a literal key -> label-type map, so the
    domain checks appear once in the plan whatever the codebook size."""
    kinds = _lit_map({d.key: d.categorical for d in cb.dimensions if d.categorical != LABEL_LIST})
    dims = F.array(*[F.lit(k) for k in cb.keys])
    entries = F.map_entries(m)
    complete = F.size(F.array_except(dims, F.map_keys(m))) == 0
    complete_ok = F.forall(entries, lambda e: F.try_element_at(kinds, e["key"]).isNull()
                           | _kind_domain(F.try_element_at(kinds, e["key"]), e["value"], "complete"))
    partial_ok = F.forall(entries, lambda e: F.try_element_at(kinds, e["key"]).isNull()
                          | _kind_domain(F.try_element_at(kinds, e["key"]), e["value"], "partial"))
    any_present = F.size(F.array_intersect(dims, F.map_keys(m))) > 0
    if strict and "china_stance_score" in cb.legacy_keys:
        k = "china_stance_score"
        partial_ok = partial_ok & (~_has(m, k) | _in_range(_get(m, k), -1.0, 1.0))
    return (F.when(m.isNull() | ~_lists_ok(m, cb), F.lit(False))
            .when(complete, F.coalesce(complete_ok, F.lit(False)))
            .when(any_present, F.coalesce(partial_ok, F.lit(False))).otherwise(F.lit(False)))


def valid_group(m: Column, cb: Codebook, group: Group, numeric: bool = False) -> Column:
    """Every key of the group present and inside its domain."""
    cond = F.lit(True)
    for k in group.dims:
        d = cb.dim(k)
        kind = d.numeric if numeric else d.categorical
        inside = (label_list(_get(m, k), d.allowed, d.exclusive) if kind == LABEL_LIST
                  else _domain(kind, _get(m, k), "group"))
        cond = cond & _has(m, k) & inside
    return F.when(m.isNull(), F.lit(False)).otherwise(cond)


def validator(cb: Codebook, group_mode: str | None, numeric: bool, strict: bool,
              group_id: Column) -> Callable[[Column], Column]:
    """Per-row validator: the row's group (if known in ``group_mode``) decides
    the schema, else the ungrouped rules apply (J14/J15, JN7 as a literal
    CASE on the codebook — no join needed)."""
    groups = cb.group_configs(group_mode) if group_mode and group_mode != "single" else []

    def check(m: Column) -> Column:
        if not groups:
            return valid_ungrouped(m, cb, strict)
        expr = None
        for g in groups:
            cond = group_id == F.lit(g.group_id)
            v = valid_group(m, cb, g, numeric)
            expr = F.when(cond, v) if expr is None else expr.when(cond, v)
        return expr.otherwise(valid_ungrouped(m, cb, strict))
    return check


def apply_gates(m: Column, cb: Codebook) -> Column:
    """On complete records, a gate value blanks dependent dimensions."""
    for g in cb.gates:
        blanked = list(g.blanked)
        hit = complete_record(m, cb) & F.coalesce(_get(m, g.dim) == F.lit(g.value), F.lit(False))
        m = F.when(hit, F.transform_values(
            m, lambda k, v: F.when(k.isin(*blanked), F.lit("")).otherwise(v))).otherwise(m)
    return m


def pattern_candidate(text: Column, key: str) -> Column:
    """J17 rung 4: last brace-free object containing "key" that no other
    brace follows."""
    pat = r'\{[^{}]*"' + _java_quote(key) + r'"[^{}]*\}(?=[^{}]*$)'
    return F.when(text.rlike(pat), F.regexp_extract(text, pat, 0))


def _java_quote(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r"\.[]{}()*+?^$|" else ch)
    return "".join(out)
