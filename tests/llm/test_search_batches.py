"""Queries of a block are scored together, on shards of one language where the table names languages."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from taquilla.llm import search


@pytest.fixture(scope="module", autouse=True)
def steps(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))


@pytest.mark.parametrize("sizes", [{}, {"TOGETHER": 3}, {"SCORED_CELLS": 1, "MOST_OPENED": 1}, {"MOST_CELLS": 0}])
def test_many_queries_at_once_equal_each_by_itself(monkeypatch, sizes):
    rng = np.random.default_rng(5)
    words = [[b"t%d" % x for x in rng.zipf(1.3, 50) % 800] for _ in range(700)] + [[], [b"t1"], [b"t1"]]
    scored, all_scores = [], search.Shard._all_scores

    def counted(self, *given):
        scored.append(given[-1])
        return all_scores(self, *given)

    monkeypatch.setattr(search.Shard, "_all_scores", counted)
    for name, size in sizes.items():
        monkeypatch.setattr(search, name, size)
    shard = search.Shard(search.indexed(np.arange(len(words)) // 2, words), 40.0)
    terms = np.r_[shard.terms, shard.terms.max() + np.arange(1, 9, dtype=np.uint64)]  # some in no document
    asked = [np.sort(rng.choice(len(terms), n, replace=False)) for n in (1, 5, 40, 300, 40, 2)]
    asked.append(np.arange(len(terms) - 3, len(terms)))
    weights = [rng.random(len(a)) + 1e-6 for a in asked]
    ends = np.cumsum([0, *map(len, asked)])
    block = search._Asked(ends, terms, np.concatenate(asked).astype(np.int32), np.concatenate(weights))
    own = np.array([-1, 3, 0, 7, -1, 2, 1])
    each = [shard.top(int(o), shard.places(terms[a]), w, 10) for o, a, w in zip(own, asked, weights, strict=True)]
    assert dict(shard.tops(own, block, 10, np.zeros(7))) == {i: e for i, e in enumerate(each) if e}
    assert dict(shard.each_top(own, block, 10, np.zeros(7))) == {i: e for i, e in enumerate(each) if e}
    assert sum(scored) == 7 and (sizes or len(scored) == 1)
    floors = np.array([-e[3][0] - 1e-6 if len(e) > 3 else 0.0 for e in each])
    above = dict(shard.tops(own, block, 10, floors))
    for i, (every, floor) in enumerate(zip(each, floors, strict=True)):
        wanted = [x for x in every if -x[0] >= floor]
        assert above.get(i, [])[: len(wanted)] == wanted


def test_no_documents():
    shard = search.Shard(search.indexed(np.empty(0, np.int64), []), 1.0)
    block = search._Asked(np.array([0, 1]), np.array([5], np.uint64), np.array([0], np.int32), np.ones(1))
    assert [*shard.tops(np.array([1]), block, 3, np.zeros(1))] == []


def test_documents_of_one_language_share_shards(spark):
    rows = [(i, f"w{i} " + "of the same length as all", f"l{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kinds = docs.withColumn("kind", search._kind(docs)).withColumn("row", F.monotonically_increasing_id())
    sizes = dict(kinds.groupBy("kind").agg(F.count("*")).collect())
    dealt = kinds.withColumn("shard", search._shard(sizes, 12)).groupBy("shard", "lang").count().collect()
    shards = collections.defaultdict(dict)
    for r in dealt:
        shards[r["shard"]][r["lang"]] = r["count"]
    assert sorted(shards) == [*range(12)] and max(sum(s.values()) for s in shards.values()) < 100
    assert sum(len(s) == 1 for s in shards.values()) >= 9
    other = docs.withColumnRenamed("lang", "language")
    assert {r[0] for r in other.select(search._kind(other)).collect()} == {0}

    def found(given):
        asked = given.where("doc_id % 7 = 0")
        return sorted(map(tuple, search.search(given, asked, 4, shard_bytes=2_000).collect()))

    assert found(docs) == found(other)
