"""Search with many shards and many blocks of queries."""

from __future__ import annotations

import random

import pytest

from taquilla.llm import search


@pytest.fixture(scope="module", autouse=True)
def steps(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))


def prose(n, seed):
    rng = random.Random(seed)
    return [
        (i, " ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, 60))))
        for i in range(n)
    ]


def test_small_shards_and_blocks_give_the_same_result(spark):
    rows = prose(120, 1) + [(5, "w1 w2 w3 other"), (5, "w7 w7"), (None, "w1"), (200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = docs.where("doc_id % 3 <> 0 or doc_id = 201")

    def found(**sizes):
        frame = search.search(docs, asked, 6, **sizes)
        rows = frame.select("query_id", "rank", "doc_id", "score").collect()
        return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in rows)

    whole = found()
    assert whole and found(shard_bytes=900, asked_bytes=2_000) == whole


def test_queries_are_sent_in_blocks_and_shards_indexed_once(spark, monkeypatch):
    docs = spark.createDataFrame(prose(40, 2), "doc_id long, text string")
    sizes, indexes, sent, found = [], [], search._sent, search._found

    def counted(session, block):
        own = sent(session, block)
        sizes.append(sum(x.nbytes for x in own.value[2:]))
        return own

    def read(index, *rest):
        indexes.append(tuple(index.inputFiles()))
        return found(index, *rest)

    monkeypatch.setattr(search, "_sent", counted)
    monkeypatch.setattr(search, "_found", read)
    result = search.search(docs, docs, 3, shard_bytes=2_000, asked_bytes=4_000)
    assert len(sizes) > 2 and max(sizes) < 3 * 4_000
    assert len(set(indexes)) == 1
    plan = result._jdf.queryExecution().analyzed().toString()
    assert "CoGroups" not in plan and "Join" not in plan


def test_rows_of_one_id_are_spread_over_shards(spark):
    rows = spark.range(400).selectExpr("id as row", "7L as doc_id")
    counts = [r["count"] for r in search._dealt(rows, 8, "shard").groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) < 100
