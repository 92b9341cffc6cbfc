"""Tables in versions: what readers see, which files a rewrite touches, and racing writers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, frame
from taquilla.operators.stored import delete_stored, patch_stored, settle_stored, stored_table
from taquilla.sources.schemas import schemas
from taquilla.sources.versions import StoredTable, VersionTaken


def ticket(i, day="2024-01-05", match="M1", state="vendido"):
    return {
        "id": f"T{i:05d}", "id_users": "U1", "id_matches": match, "id_transaction": "X1",
        "ticket_code": f"C{i}", "state": state, "purchased_at": at(f"{day}T10:00:00"),
    }


@pytest.fixture
def tickets(spark, tmp_path):
    return stored_table(spark, str(tmp_path), "tickets", schemas()["tickets"])


def test_versions_are_read_whole(spark, tickets):
    assert tickets.read().collect() == [] and tickets.latest() == 0
    assert tickets.append(frame(spark, "tickets", [ticket(1), ticket(2, "2024-02-06")])) == 1
    assert tickets.append(frame(spark, "tickets", [ticket(3)])) == 2
    assert {r["id"] for r in tickets.read().collect()} == {"T00001", "T00002", "T00003"}
    assert {r["id"] for r in tickets.read(1).collect()} == {"T00001", "T00002"}
    # a load without a version is never read
    tickets._write(frame(spark, "tickets", [ticket(9)]))
    assert tickets.read().count() == 3
    days = {r["id"]: r["purchase_month"] for r in tickets.read().collect()}
    assert days["T00002"] == dt.date(2024, 2, 1)
    assert tickets.append(frame(spark, "tickets", [])) == 3 and tickets.read().count() == 3


def test_month_filters_skip_folders(spark, tickets):
    tickets.append(frame(spark, "tickets", [ticket(i, f"2024-{1 + i:02d}-05") for i in range(5)]))
    late = tickets.read().where(F.col("purchase_month") >= F.lit(dt.date(2024, 4, 1)))
    assert "PartitionFilters: [isnotnull(purchase_month" in late._jdf.queryExecution().toString()
    assert late.count() == 2


def test_of_two_writers_one_fails(spark, tickets):
    tickets.append(frame(spark, "tickets", [ticket(1)]))
    files = tickets.files(1)
    assert tickets._commit(files, 1) == 2
    with pytest.raises(VersionTaken):
        tickets._commit(files, 1)
    assert tickets.latest() == 2 and tickets.read().count() == 1


def test_a_hot_month_is_split_by_its_bytes(spark, tickets):
    rows = spark.range(60_000).select(
        *[
            {
                "id": F.sha2(F.col("id").cast("string"), 256).alias("id"),
                "price": F.lit(1).alias("price"),
                "purchased_at": F.when(F.col("id") % 10 < 9, F.lit("2024-01-01"))
                .otherwise(F.concat(F.lit("2024-"), F.lpad((F.col("id") % 11 + 2).cast("string"), 2, "0"), F.lit("-07")))
                .cast("timestamp_ntz").alias("purchased_at"),
            }.get(f.name, F.lit("x").alias(f.name) if f.dataType.simpleString() == "string" else F.lit(1).alias(f.name))
            for f in schemas()["tickets"].fields
        ]
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        tickets.append(rows.repartition(8))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before) if before else spark.conf.unset(
            "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        )
    per_day = {}
    for r in tickets.files().collect():
        per_day.setdefault(r["file"].split("purchase_month=")[1][:10], []).append(r["rows"])
    assert len(per_day["2024-01-01"]) >= 4 and sum(map(sum, per_day.values())) == 60_000
    assert max(per_day["2024-01-01"]) < 0.3 * sum(per_day["2024-01-01"])


def test_rewrites_touch_only_files_with_the_keys(spark, tickets):
    for d in range(1, 7):
        tickets.append(frame(spark, "tickets", [ticket(100 * d + i, f"2024-{d:02d}-01", f"M{d}") for i in range(5)]))
    before = {r["file"] for r in tickets.files().collect()}
    patches = spark.createDataFrame(
        [("T00301", 1, ["state"], "usado"), ("T00302", 1, ["state"], None), ("T99999", 1, ["state"], "usado")],
        "id string, seq int, set_fields array<string>, state string",
    )
    version, touched = patch_stored(tickets, "tickets", patches)
    after = {r["file"] for r in tickets.files().collect()}
    assert version == 7 and len(touched) == 1 and "2024-03-01" in touched[0]
    assert before - after == set(touched) and len(after) == len(before)
    states = {r["id"]: r["state"] for r in tickets.read().collect()}
    assert len(states) == 30 and states["T00301"] == "usado" and states["T00302"] is None
    assert {s for i, s in states.items() if i not in ("T00301", "T00302")} == {"vendido"}
    # keys of no row, by another column, leave everything as it is
    nobody = spark.createDataFrame([("nobody",), (None,)], "id_users string")
    assert tickets.rewrite(nobody, "id_users", lambda rows: rows.limit(0)) == (7, [])
    # the bitmap tells that no file can hold a key within the range of ids
    inside = spark.createDataFrame([("T00350",)], "id string")
    assert tickets.files().where(tickets._may_hold(inside, "id")).count() == 0
    assert tickets.files().where(tickets._may_hold(patches, "id")).count() == 1


def test_delete_by_foreign_key_keeps_null_keys(spark, tickets):
    tickets.append(frame(spark, "tickets", [ticket(1), {**ticket(2), "id_matches": None}, ticket(3, match="M2")]))
    tickets.append(frame(spark, "tickets", [ticket(4, "2024-02-01", "M2")]))
    _, touched = delete_stored(tickets, spark.createDataFrame([("M1",), (None,)], "id_matches string"), "id_matches")
    assert len(touched) == 1
    assert {r["id"] for r in tickets.read().collect()} == {"T00002", "T00003", "T00004"}
    _, touched = delete_stored(tickets, spark.createDataFrame([("M2",)], "id_matches string"), "id_matches")
    assert len(touched) == 2 and {r["id"] for r in tickets.read().collect()} == {"T00002"}


def test_settlement_rewrites_tickets_and_matches(spark, tickets, tmp_path):
    matches = stored_table(spark, str(tmp_path), "matches", schemas()["matches"])
    matches.append(frame(spark, "matches", [{"id": "M1", "state": "programado"}, {"id": "M2", "state": None}, {"id": "M3", "state": "finalizado"}]))
    tickets.append(frame(spark, "tickets", [ticket(1), ticket(2, state="cancelado"), ticket(3, "2024-03-01", "M3")]))
    settle_stored(matches, tickets, spark.createDataFrame([("M1",), ("M3",), ("M9",)], "id string"))
    assert {r["id"]: r["state"] for r in matches.read().collect()} == {"M1": "finalizado", "M2": None, "M3": "finalizado"}
    assert {r["id"]: r["state"] for r in tickets.read().collect()} == {
        "T00001": "usado", "T00002": "cancelado", "T00003": "vendido",
    }


def test_a_table_without_days(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), spark.range(1).schema)
    table.append(spark.range(10))
    assert table.read().count() == 10 and table.schema.names == ["id"]
