"""The stand-in views of ``labelweave.sources.standins`` written as DuckDB SQL
CTEs, so every oracle reads only the base tables. Each constant is one CTE
body; ``with_views`` prepends the ones a query names.
"""

from __future__ import annotations

PAD = "lpad(CAST({c} AS VARCHAR), 12, '0')"

VIEWS: dict[str, str] = {}

VIEWS["d_labels"] = """
  SELECT l.doc_id,
         'v/' || lpad(CAST(l.doc_id AS VARCHAR), 12, '0') || '.mp4' AS video,
         CASE WHEN l.doc_id % 29 = 0 THEN NULL
              ELSE CAST((l.doc_id * 37) % 201 - 100 AS DOUBLE) / 100 END AS china_stance_score,
         CAST(l.toxic AS DOUBLE) AS sensitive,
         CAST(l.quality AS DOUBLE) AS collective_action,
         CAST(coalesce(d.lang, '') = 'en' AS DOUBLE) AS english,
         CAST(coalesce(d.lang, '') = 'zh' AS DOUBLE) AS mandarin,
         CAST(coalesce(d.lang, '') = 'es' AS DOUBLE) AS spanish,
         CAST(coalesce(d.lang, '') NOT IN ('en', 'zh', 'es') AS DOUBLE) AS other_lang,
         CAST(coalesce(d.n_chars, 0) < 100 AS DOUBLE) AS no_language
  FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id
"""

# split pipeline with the default parameters (seed 7, caps 100/50, frac 0.7)
VIEWS["split_l0"] = """
  SELECT regexp_extract(video, '([0-9]{10,})\\.mp4', 1) AS meta_id,
         CAST(china_stance_score AS DOUBLE) AS china_stance_score,
         sensitive, collective_action, english, mandarin, spanish, other_lang, no_language
  FROM d_labels
  WHERE video IS NOT NULL AND regexp_extract(video, '([0-9]{10,})\\.mp4', 1) <> ''
    AND china_stance_score IS NOT NULL
"""
VIEWS["split_b"] = """
  SELECT *,
    CASE WHEN china_stance_score < CAST(-0.33 AS DOUBLE) THEN 'neg'
         WHEN china_stance_score > CAST(0.33 AS DOUBLE) THEN 'pos' ELSE 'neu' END AS stance_bucket,
    CASE WHEN sensitive >= CAST(0.5 AS DOUBLE) THEN 'yes' ELSE 'no' END AS sensitive_bucket,
    CASE WHEN collective_action >= CAST(0.5 AS DOUBLE) THEN 'yes' ELSE 'no' END AS collective_bucket
  FROM split_l0
"""
VIEWS["split_r"] = """
  SELECT *,
    row_number() OVER (PARTITION BY stance_bucket, sensitive_bucket, collective_bucket
                       ORDER BY md5(meta_id || '-SPLIT-7'), meta_id) AS rn,
    count(*) OVER (PARTITION BY stance_bucket, sensitive_bucket, collective_bucket) AS c
  FROM split_b
"""
VIEWS["split_a"] = """
  SELECT *,
    LEAST(100, CASE WHEN c <= 2 THEN 1 ELSE GREATEST(1, CAST(ROUND(c * 0.7) AS INTEGER)) END,
          CASE WHEN c >= 2 THEN c - 1 ELSE 1 END) AS train_n
  FROM split_r
"""
VIEWS["split_out"] = """
  SELECT *, LEAST(50, GREATEST(0, c - train_n)) AS val_n,
         CASE WHEN rn <= train_n THEN 'train' ELSE 'val' END AS split
  FROM split_a
  WHERE rn <= train_n + LEAST(50, GREATEST(0, c - train_n))
"""

# raw answers: known values per (model, doc) — FIXTURES part C
VIEWS["raw_expect"] = """
  SELECT l.doc_id, m.model, lpad(CAST(l.doc_id AS VARCHAR), 12, '0') AS meta_id, l.doc_id % 15 AS cls,
    CAST(CASE WHEN (l.doc_id * m.prime) % 100 < m.pct THEN -((l.doc_id * 37) % 201 - 100)
              ELSE (l.doc_id * 37) % 201 - 100 END AS DOUBLE) / 100 AS s,
    CASE WHEN (l.toxic = 1) <> ((l.doc_id * m.prime) % 100 < m.pct) THEN 'yes' ELSE 'no' END AS y,
    CASE WHEN (l.quality = 1) <> ((l.doc_id * m.prime) % 100 < m.pct) THEN 'yes' ELSE 'no' END AS c
  FROM labels l CROSS JOIN (VALUES ('m_alpha', 7919, 15), ('m_beta', 104729, 30)) m(model, prime, pct)
"""
VIEWS["parse_expect"] = """
  SELECT model, meta_id, doc_id AS idx, cls NOT IN (12, 13) AS parsed,
    CASE WHEN cls = 1 THEN 'codefence_stripped' WHEN cls IN (2, 3) THEN 'balanced_block'
         WHEN cls IN (12, 13) THEN 'none' WHEN cls = 14 THEN 'pattern_match' ELSE 'strict' END AS mode,
    CASE WHEN cls IN (11, 12, 13) THEN NULL ELSE s END AS stance,
    CASE WHEN cls IN (12, 13) THEN NULL WHEN cls = 10 THEN CASE WHEN y = 'yes' THEN '1' ELSE '0' END
         WHEN cls = 11 THEN '' ELSE y END AS sensitive,
    CASE WHEN cls IN (6, 7, 12, 13) THEN NULL WHEN cls = 10 THEN CASE WHEN c = 'yes' THEN '1' ELSE '0' END
         ELSE c END AS collective,
    CASE WHEN cls IN (12, 13) THEN NULL WHEN cls IN (6, 7) THEN 2 WHEN cls = 10 THEN 7
         WHEN cls = 11 THEN 11 ELSE 3 END AS n_keys,
    cls, s, y, c
  FROM raw_expect
"""
# two-group answers merged per item (group 'china' always, 'content' unless
# missing or unparseable, 'china' answered again when doc_id % 13 = 0)
VIEWS["grouped_expect"] = """
  SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS meta_id, doc_id,
    (doc_id % 11 <> 0 AND doc_id % 7 <> 3) AS has_content,
    CASE WHEN doc_id % 13 = 0 AND doc_id % 2 = 0 THEN 'no' ELSE 'yes' END AS related,
    CASE WHEN doc_id % 3 = 0 THEN 'pro' WHEN doc_id % 3 = 1 THEN 'anti' ELSE 'neutral/unclear' END AS gov,
    CASE WHEN doc_id % 13 = 0 THEN 'cannot_determine' WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS sensitive,
    CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 3 AND doc_id % 5 = 0 THEN 'cannot_determine'
         WHEN quality = 1 THEN 'yes' ELSE 'no' END AS collective,
    CASE WHEN NOT (doc_id % 11 <> 0 AND doc_id % 7 <> 3) THEN NULL
         WHEN doc_id % 6 = 0 THEN 'yes' ELSE 'no' END AS hate
  FROM labels
"""
# comprehensive gold (source-column values, as labelled)
VIEWS["comp_gold"] = """
  SELECT lpad(CAST(l.doc_id AS VARCHAR), 12, '0') AS meta_id, l.doc_id,
    CASE WHEN l.doc_id % 4 = 0 THEN 'no' ELSE 'yes' END AS china_related,
    CASE WHEN l.doc_id % 3 = 0 THEN 'pro' WHEN l.doc_id % 3 = 1 THEN 'anti' ELSE 'neutral/unclear' END AS stance_gov,
    CASE WHEN l.doc_id % 9 < 3 THEN 'pro' WHEN l.doc_id % 9 < 6 THEN 'anti' ELSE 'neutral' END AS stance_culture,
    CASE WHEN l.doc_id % 5 = 0 THEN 'anti' WHEN l.doc_id % 5 = 1 THEN 'pro' ELSE 'Neutral/Unclear' END AS stance_tech,
    CASE WHEN l.toxic = 1 THEN 'yes' ELSE 'no' END AS sensitive,
    CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS collective_action,
    CASE WHEN l.doc_id % 6 = 0 THEN 'yes' ELSE 'no' END AS hate_speech,
    CASE WHEN l.doc_id % 7 = 0 THEN 'yes' WHEN l.doc_id % 7 = 1 THEN 'cannot_determine' ELSE 'no' END AS harmful,
    CASE WHEN d.lang = 'en' THEN 'yes' ELSE 'no' END AS news,
    CASE WHEN l.doc_id % 10 = 3 THEN 'yes' ELSE 'no' END AS inauthentic,
    CASE WHEN l.doc_id % 8 = 5 THEN 'yes' ELSE 'no' END AS derivative
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""
# standard gold of the built validation records (stance present, text valid)
VIEWS["std_gold"] = """
  SELECT lpad(CAST(l.doc_id AS VARCHAR), 12, '0') AS meta_id,
    GREATEST(-1.0, LEAST(1.0, l.china_stance_score)) AS g_stance,
    CASE WHEN l.sensitive >= 0.5 THEN 'yes' ELSE 'no' END AS g_sens,
    CASE WHEN l.collective_action >= 0.5 THEN 'yes' ELSE 'no' END AS g_coll
  FROM d_labels l JOIN documents d ON l.doc_id = d.doc_id
  WHERE l.china_stance_score IS NOT NULL
"""

ORDER = ["d_labels", "split_l0", "split_b", "split_r", "split_a", "split_out", "raw_expect",
         "parse_expect", "grouped_expect", "comp_gold", "std_gold"]


def with_views(names: list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` (and their prerequisites, in
    dependency order) followed by ``body``."""
    need = set(names)
    changed = True
    while changed:
        changed = False
        for n in list(need):
            for m in VIEWS:
                if m not in need and m != n and _refs(VIEWS[n], m):
                    need.add(m)
                    changed = True
    order = [n for n in ORDER if n in need] + [n for n in VIEWS if n in need and n not in ORDER]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    b = body.lstrip()
    if b[:4].upper() == "WITH":  # merge the query's own CTEs into one WITH
        return f"WITH {ctes},\n{b[4:]}"
    return f"WITH {ctes}\n{body}"


def _refs(sql: str, name: str) -> bool:
    import re
    return re.search(rf"\b{name}\b", sql) is not None
