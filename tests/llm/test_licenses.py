"""Whole license texts: members of a family are told apart, changed words are tolerated, key phrases are not."""
import random

import pytest

from labelweave.llm import licenses as L


def labels(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: {m.label for m in r.matches} for r in L.scan(d).collect()}


def test_whole_texts(spark):
    texts = [f"/* Copyright 2020 Someone. {t.text.upper()} */ int main() {{}}" for t in L.HEADERS]
    got = labels(spark, texts)
    for k, t in enumerate(L.HEADERS):
        assert {x.label for x in L.HEADERS} & got[k] == {t.label}, t.label
    at = {t.label: k for k, t in enumerate(L.HEADERS)}
    assert "mit" in got[at["mit-text"]] and "mit" in got[at["mit-0"]] and "bsd" in got[at["bsd-3-clause"]]
    assert "gpl" in got[at["gpl-header"]] and "lgpl" in got[at["lgpl-header"]] and "apache" in got[at["apache-2.0-header"]]


@pytest.mark.parametrize("share", [0.1, 0.35])
def test_changed_words(spark, share):
    """A tenth of the words outside the key phrase may differ; a third may not."""
    rng = random.Random(5)
    texts = []
    for t in L.HEADERS:
        words, key = t.words, len(t.key.split())
        hidden = [w if t.key_at <= i < t.key_at + key or rng.random() >= share else "xx" for i, w in enumerate(words)]
        texts.append(" ".join(hidden))
    got = labels(spark, texts)
    assert all((t.label in got[k]) == (share < 0.2) for k, t in enumerate(L.HEADERS))


def test_key_phrases_are_mandatory(spark):
    texts = []
    for t in L.HEADERS:
        words = t.words
        words[t.key_at] = "zz"
        texts.append(" ".join(words))
    got = labels(spark, texts)
    assert all(t.label not in got[k] for k, t in enumerate(L.HEADERS))


def test_index_words_change_the_cost_only(spark):
    """Whichever key word is the rarest, the matches are the same."""
    texts = [t.text for t in L.TEMPLATES]
    first = labels(spark, texts)
    again = labels(spark, texts + ["granted free of charge"] * 50 + ["license"] * 90)
    assert all(first[k] == again[k] for k in first)
