"""Importing this module registers every query of the subpackage."""

from labelweave.llm import (  # noqa: F401
    centroids,
    chat,
    decontaminate,
    gam_quality,
    html_extract,
    langid,
    licenses,
    negatives,
    ngram_join,
    packing,
    pii,
    quality_rules,
    toxicity,
)
from labelweave.llm.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
