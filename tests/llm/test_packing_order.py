"""Packing does not depend on the order of the rows, and merges over several tasks."""

from __future__ import annotations

import collections
import random

import public_tokenizers
import pytest

from taquilla.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 64


@pytest.fixture(scope="module", autouse=True)
def steps(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))


def check_places(found):
    by_sequence = collections.defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= LIMIT
    return len(by_sequence)


def ordered(spark, large, small):
    """Documents just above half of a sequence first, then those that fit beside them."""
    texts = ["a " * 36] * large + ["b " * 18] * small
    rows = [(i, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")


def test_short_documents_after_long_ones_fill_their_sequences(spark):
    found = packing.pack(ordered(spark, 600, 500), VOCABULARY, LIMIT, group=200).collect()
    assert len({r.doc_id for r in found}) == 1100
    whole = len(packing.best_fit([r.length for r in found], LIMIT))
    # six groups, each a fair share of both kinds
    assert check_places(found) <= whole + 6


def test_bins_of_several_merge_tasks_are_whole(spark):
    rng = random.Random(2)
    rows = [(i, "c " * rng.randrange(1, 40)) for i in range(400)]
    docs = spark.createDataFrame([*rows, *[(None, "")] * 200], "doc_id long, text string")
    found = packing.pack(docs, VOCABULARY, LIMIT, group=20, fan_in=2, hosts=3).collect()
    assert len(found) == 600 and sum(r.doc_id is None for r in found) == 200
    groups = 30
    assert check_places(found) <= len(packing.best_fit([r.length for r in found], LIMIT)) + groups
