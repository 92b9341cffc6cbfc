"""What is broadcast or written as the sides of joins grow."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from taquilla.operators import writes
from taquilla.plans import sizing


@pytest.mark.parametrize(
    ("driver", "executor", "most"),
    [("512m", "10g", 32 << 20), ("1g", "10g", 32 << 20), ("16g", "10g", 32 << 20), ("16g", "256m", 16 << 20)],
)
def test_a_broadcast_fits_the_driver_too(driver, executor, most):
    given = {"spark.driver.memory": driver, "spark.executor.memory": executor}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: given.get(name, default)))
    assert sizing.most_broadcast_bytes(session) == most


def test_a_large_side_is_merged_whatever_its_files_say(spark, monkeypatch):
    gone = spark.range(100)
    assert "strategy=broadcast" in joined(spark, sizing.measured_side(gone))
    monkeypatch.setattr(sizing, "PART_OF_HEAP", 1 << 24)  # 64 bytes of 1 GB
    assert "strategy=merge" in joined(spark, sizing.measured_side(gone))


def joined(spark, side):
    plan = spark.range(1000).join(side, "id", "left_anti")._jdf.queryExecution().optimizedPlan()
    return plan.toString()


def test_a_large_fold_of_patches_is_not_written(spark, make_tables, monkeypatch):
    t = make_tables(tickets=[{"id": f"K{i}"} for i in range(20)])
    patches = spark.range(40).select(
        F.concat(F.lit("K"), (F.col("id") % 20).cast("string")).alias("id"),
        F.col("id").cast("int").alias("seq"),
        F.array(F.lit("state")).alias("set_fields"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("state"),
    )
    monkeypatch.setattr(sizing, "PART_OF_HEAP", 1 << 24)  # 64 bytes of 1 GB
    monkeypatch.setattr(sizing, "cut_lineage", lambda df: pytest.fail("written"))
    patched = writes.patch_rows("tickets", t.tickets, patches)
    assert {r["id"]: r["state"] for r in patched.collect()} == {f"K{i}": f"s{i + 20}" for i in range(20)}


@pytest.mark.parametrize(("hot", "sorts_in_maps"), [(0, False), (60, True)])
def test_a_large_fold_of_single_patches_sorts_them_after_they_are_dealt(
    spark, make_tables, monkeypatch, hot, sorts_in_maps
):
    t = make_tables(tickets=[{"id": f"K{i}"} for i in range(100)])
    number = F.greatest(F.col("id") - hot, F.lit(0)).cast("string")
    patches = spark.range(100 + hot).select(
        F.concat(F.lit("K"), number).alias("id"),
        F.col("id").cast("int").alias("seq"),
        F.array(F.when(F.col("id") % 2 == 0, "state").otherwise("price")).alias("set_fields"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("state"),
        F.lit(None).cast("decimal(10,2)").alias("price"),
    )
    monkeypatch.setattr(sizing, "PART_OF_HEAP", 1 << 24)  # 64 bytes of 1 GB
    monkeypatch.setattr(sizing, "KEY_BUCKETS", 4)
    patched = writes.patch_rows("tickets", t.tickets, patches)
    plan = patched._jdf.queryExecution().executedPlan().toString()
    partial, dealt = plan.index("partial_max_by"), plan.index("REPARTITION_BY_COL") if not sorts_in_maps else -1
    assert ("REPARTITION_BY_COL" in plan) != sorts_in_maps
    assert sorts_in_maps or partial < dealt  # the plan is told from its end
    found = {r["id"]: (r["state"], r["price"]) for r in patched.collect()}
    before = {r["id"]: (r["state"], r["price"]) for r in t.tickets.collect()}
    for i in range(1, 100):
        state, price = before[f"K{i}"]
        assert found[f"K{i}"] == ((f"s{i + hot}", price) if (i + hot) % 2 == 0 else (state, None))
