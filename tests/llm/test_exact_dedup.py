"""Exact dedup against plain Python, the index across sessions, and its plan."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from taquilla.llm import exact_dedup
from taquilla.llm.common import shared_folder

SCHEMA = "doc_id long, text string, place string, digest int, kept string"


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def invented():
    texts = [None, "", " ", "\n\t ", "a b", "a  b", "a\x0bb", "a\x1cb", "a\xa0b", "A b", " a b", "é" * 50_000]
    rows = [(i * 7 % 50, t, "p", i, "k") for i, t in enumerate(texts * 2)]
    rows += [(100 + i, "hot text", "p", i, "k") for i in range(300)]
    rows += [(99, "hot  text", "p", 1, "k"), (5, "twice", "p", 1, "k"), (5, "twice", "p", 1, "k")]
    rows += [(None, "hot text", "p", 1, "k"), (None, "no id", "p", 1, "k"), (None, "no id", "p", 2, "k")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))
    return spark.createDataFrame(invented(), SCHEMA).repartition(5)


@pytest.mark.parametrize("loads", [1, 3, 7])
def test_groups_equal_plain_python(docs, loads):
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in invented():
        groups[normalised(text)].append(doc_id)
    found = exact_dedup.exact_duplicates(docs, loads).collect()
    assert len(found) == len(invented())
    expected = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        expected += [(i, min(known) if known else None, len(ids), sha) for i in ids]
    none_last = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=none_last) == sorted(
        expected, key=none_last
    )
    stay = collections.Counter(r.text_sha256 for r in found if r.kept)
    assert set(stay.values()) == {1} and len(stay) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_rows_that_stay_keep_their_columns(docs):
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({normalised(t) for _, t, *_ in invented()})


def test_empty_table(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(none).collect() == []
    assert exact_dedup.without_copies(none).collect() == []


def test_a_reopened_index_takes_only_new_texts(spark, docs):
    folder = shared_folder(spark)
    first = exact_dedup.DigestIndex.create(spark, folder, 6)
    rows = exact_dedup.digests(docs)
    first.add(rows)
    texts = len({normalised(t) for _, t, *_ in invented()})
    assert first.rows().count() == texts
    spark.sql(f"DROP TABLE {first.name}")
    again = exact_dedup.DigestIndex.open(spark, folder)
    assert again.buckets == 6
    again.add(rows)
    assert again.rows().count() == texts
    later = spark.createDataFrame([(1000, "hot\ttext"), (1001, "brand new"), (1002, "brand  new")], "doc_id long, text string")
    load = again.add(exact_dedup.digests(later))
    assert [(r.keep_id) for r in again.rows().where(F.col("load") == load).collect()] == [1001]
    assert again.rows().count() == texts + 1


def test_the_index_is_not_shuffled(spark, docs):
    index = exact_dedup.DigestIndex.create(spark, shared_folder(spark), 6)
    rows = exact_dedup.digests(docs)
    index.add(rows)
    plan = index.fresh(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    scan = plan[: plan.index(f".{index.name}")]
    assert "Bucketed: true" in plan
    assert "Exchange" not in scan[scan.rindex("+- Sort") :]
    nodes = " ".join(line.strip() for line in plan.splitlines())
    assert not re.search("Python|Arrow|Pandas", nodes)
