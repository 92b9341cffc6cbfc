"""Pages by counted ranges against a plain sort."""

from __future__ import annotations

import random

import pytest

from taquilla.plans.pages import RANGES, page_of, page_range


def keys(kind):
    rng = random.Random(1)
    found = rng.sample(range(10**6), 3000)
    if kind == "text":
        return [f"k{k:07d}" if k % 2 else f"\u00e9{k}" for k in found]
    return found


@pytest.mark.parametrize("kind", ["long", "text"])
def test_pages_equal_a_plain_sort(spark, kind):
    all_keys = [*keys(kind), None]
    rows = spark.createDataFrame([(k, "x") for k in all_keys], f"id {'long' if kind == 'long' else 'string'}, v string")
    ordered = sorted((k for k in all_keys if k is not None), reverse=True) + [None]
    for page, limit in ((1, 10), (37, 40), (76, 40), (500, 40)):
        found, total = page_of(rows, "id", page, limit, most_sorted=50)
        assert total == 3001
        assert [r["id"] for r in found.collect()] == ordered[(page - 1) * limit : page * limit]


def test_a_deep_page_sorts_one_range(spark):
    rows = spark.range(200_000)
    found, skip, total = page_range(rows, "id", 150_000, 20, most_sorted=5_000)
    held = rows.where(found.holds("id")).count()
    assert total == 200_000 and held < 100 * 200_000 / RANGES and skip + 20 <= held
    page, _ = page_of(rows, "id", 7501, 20, most_sorted=5_000)
    assert [r["id"] for r in page.collect()] == list(range(49_999, 49_979, -1))


def test_equal_keys_and_empty_tables(spark):
    same = spark.createDataFrame([(5,)] * 300, "id long")
    assert page_of(same, "id", 2, 20, most_sorted=10)[0].count() == 20
    assert page_of(same.limit(0), "id", 1, 20)[0].collect() == []
