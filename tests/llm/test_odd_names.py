"""Pipeline stages on tables whose other columns are called like their helpers."""

from __future__ import annotations

import random

import pytest

from taquilla.llm import near_dedup, quality_model, substring_dedup

NAMES = ["own_id", "pieces", "edges", "gone_id", "stated_size", "__id", "__pieces", "__gone", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in NAMES)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))
    rng = random.Random(3)
    prose = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(120)) for _ in range(4)]
    texts = [None, "", *prose, prose[0], prose[1] + " one more"]
    odd = ["12", "no number", None, "", "7", "x", "1", "2"]
    rows = [(i, t, "en", *NAMES[:-1], odd[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_near_copies_go(docs):
    found = near_dedup.without_copies(docs)
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 1, 2, 3, 4, 5]


def test_passages_go(docs):
    found = substring_dedup.without_repeats(docs)
    assert found.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in found.collect()}
    assert len(texts) == 8 and texts[0] is None and texts[6] == "" and texts[7].split() == ["one", "more"]
    assert {tuple(r[n] for n in NAMES[:-1]) for r in found.collect()} == {tuple(NAMES[:-1])}


def test_sizes_that_are_no_numbers(docs):
    machine = quality_model.Machine()
    assert quality_model.score(docs, machine).count() == 8
    found = quality_model.without_rejected(docs, machine)
    assert found.columns == docs.columns and found.count() == 8
