"""License scan with a positional rare-token index (operator 1).

Templates are runs of words that name or grant a license, from two words to whole license texts. The corpus
document frequency of every template word is counted once; each template is
indexed under the rarest word (highest IDF) of its mandatory key phrase, with
the word's position. A text looks up the index words it holds; every posting
gives one possible start of one template (position in the text less position
in the template). At that start the mandatory phrase must stand word for word,
and at least ``MIN_SHARE`` of the template's words at their relative positions.
Since every match holds its key phrase, and every key phrase its index word, the
choice of index words decides the cost only, never the result.

Everything is DataFrame expressions; no shuffle but the word counts, whose rows
are bounded by the template vocabulary.

Defined cases: a null or empty text has no words and no match (score 0); matches
may overlap, every place counts; of equally rare words of a key phrase the first is the index word; a text of any
length is read whole; repeated rows are scanned each; an empty table
gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import WORD_RE, table, without, word_list
from labelweave.llm.registry import query


@dataclass(frozen=True)
class Template:
    label: str
    text: str        # all words
    key: str         # mandatory words, part of the text
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD_RE, self.text.lower())

    @property
    def key_at(self) -> int:
        words, key = self.words, re.findall(WORD_RE, self.key)
        return next(i for i in range(len(words)) if words[i: i + len(key)] == key)


# FIXED VALUES: the base phrases and their labels
BASE = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
)
# wording of well-known notices
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0", "apache license version"),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("gpl", "licensed under the gnu general public license", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)
# whole headers and license texts; members of a family are told apart by their mandatory words and by where the rest stands
_MIT_DISCLAIMER = """
the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any
claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the
software or the use or other dealings in the software."""
_BSD_CONDITIONS = """
redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """
3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_DISCLAIMER = """
this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not
limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright
holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not
limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any
theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of
this software, even if advised of the possibility of such damage."""
HEADERS = (
    Template("mit-text", """
permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the
following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the
software.""" + _MIT_DISCLAIMER, "granted free of charge"),
    Template("mit-0", """
permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so."""
             + _MIT_DISCLAIMER, "furnished to do so the software is provided"),
    Template("bsd-2-clause", _BSD_CONDITIONS + _BSD_DISCLAIMER, "with the distribution this software is provided"),
    Template("bsd-3-clause", _BSD_CONDITIONS + _BSD_THIRD + _BSD_DISCLAIMER, "neither the name of the copyright holder"),
    Template("isc-text", """
permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. the software is provided "as is" and the author disclaims all
warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be
liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits,
whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this
software.""", "with or without fee is hereby granted provided"),
    Template("apache-2.0-header", """
licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may
obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing,
software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or
implied. see the license for the specific language governing permissions and limitations under the license.""",
             "you may not use this file except in compliance with the license"),
    Template("gpl-header", """
this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by
the free software foundation, either version 3 of the license, or (at your option) any later version. this program is distributed in the
hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular
purpose. see the gnu general public license for more details. you should have received a copy of the gnu general public license along with
this program.""", "under the terms of the gnu general public license"),
    Template("lgpl-header", """
this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as
published by the free software foundation; either version 2.1 of the license, or (at your option) any later version. this library is
distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness
for a particular purpose. see the gnu lesser general public license for more details.""", "under the terms of the gnu lesser general public license"),
    Template("mpl-2.0-header", """
this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this
file, you can obtain one at http://mozilla.org/mpl/2.0/.""", "subject to the terms of the mozilla public license"),
    Template("zlib", """
this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages
arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions""", "alter it and redistribute it freely"),
)
TEMPLATES = BASE + NOTICES + HEADERS
MIN_SHARE = 0.8


def word_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Number of texts with each word of the vocabulary, over the whole corpus."""
    seen = F.array_intersect(word_list(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(seen).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["n"] for r in rows}     # at most one row per vocabulary word


def index_words(templates: tuple[Template, ...], frequency: dict[str, int]) -> dict[str, list[tuple[Template, int]]]:
    """Rare word -> postings (template, position of the word)."""
    index: dict[str, list[tuple[Template, int]]] = {}
    for t in templates:
        key = t.key.split()
        rare = min(range(len(key)), key=lambda i: (frequency.get(key[i], 0), i))
        index.setdefault(key[rare], []).append((t, t.key_at + rare))
    return index


def _posting(t: Template, at: int) -> Column:
    return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(at).alias("at"),
                    F.array(*map(F.lit, t.words)).alias("words"), F.lit(t.key_at).alias("key_at"),
                    F.lit(len(t.key.split())).alias("key_len"))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
         templates: tuple[Template, ...] = TEMPLATES, min_share: float = MIN_SHARE) -> DataFrame:
    """Rows with ``n_words`` and ``matches``: array of (start, label, base, share), words counted from 0."""
    cols = keep if keep is not None else docs.columns
    docs = without(docs, ["n_words", "matches", "_words", "_at"], [text_col])
    cols = [c for c in cols if c in docs.columns]
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    index = index_words(templates, word_frequencies(docs, text_col, vocabulary))
    postings = F.create_map(*[x for w, p in sorted(index.items()) for x in (
        F.lit(w), F.array(*[_posting(t, at) for t, at in p]))])
    rare = sorted(index)

    def place(i: Column) -> Column:
        return F.transform(postings[F.get("_words", i)], lambda p: F.struct((i - p["at"]).alias("start"), p.alias("p")))

    def check(c: Column) -> Column:
        here = F.slice("_words", c["start"] + 1, F.size(c["p"]["words"]))
        equal = F.zip_with(here, c["p"]["words"], lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
        key = F.slice(equal, c["p"]["key_at"] + 1, c["p"]["key_len"])
        count = F.aggregate(equal, F.lit(0), lambda s, x: s + x)
        return F.struct(c["start"].cast("long").alias("start"), c["p"]["label"].alias("label"), c["p"]["base"].alias("base"),
                        (count / F.size(c["p"]["words"])).alias("share"), F.forall(key, lambda x: x == 1).alias("key"))

    rows = docs.select(*cols, word_list(F.col(text_col)).alias("_words"))
    at = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_at", at)
    found = F.filter(F.flatten(F.transform("_at", place)), lambda c: c["start"] >= 0)
    good = F.filter(F.transform(found, check), lambda m: m["key"] & (m["share"] >= min_share))
    slim = F.transform(good, lambda m: F.struct(m["start"], m["label"], m["base"], m["share"]))
    none = F.array().cast("array<struct<start:bigint,label:string,base:boolean,share:double>>")
    return rows.withColumn("n_words", F.size("_words").cast("long")).withColumn(
        "matches", F.when(F.size("_at") > 0, slim).otherwise(none)).select(*cols, "n_words", "matches")


def _rows_sql(templates: tuple[Template, ...]) -> str:
    out = []
    for k, t in enumerate(templates):
        n = len(t.key.split())
        out += [f"({k}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {n}, {i}, '{w}', {str(t.key_at <= i < t.key_at + n).lower()})"
                for i, w in enumerate(t.words)]
    return ", ".join(out)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_RE}') AS ws
           FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
t AS (SELECT * FROM (VALUES {_rows_sql(TEMPLATES)}) x(tid, label, base, n, key_n, spot, word, is_key)),
m AS (SELECT r, tid, any_value(label) AS label, bool_or(base) AS base, pos - spot AS start, count(*) / any_value(n) AS share
      FROM w JOIN t USING (word) GROUP BY r, tid, pos - spot
      HAVING count(*) FILTER (is_key) = any_value(key_n) AND count(*) / any_value(n) >= {MIN_SHARE} AND pos - spot >= 0),
s AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM m GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN s USING (r)
"""


@query("op1_licenses", SQL)
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                       F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                       labels(base).alias("base_labels"), labels("matches").alias("labels"),
                       F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"))
