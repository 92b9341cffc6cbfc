"""Deletes by many keys leave rows in their tasks, and summaries of files sort no rows."""

from __future__ import annotations

import pytest

from tests.conftest import at, frame
from taquilla.operators import stored
from taquilla.plans import sizing
from taquilla.sources import versions
from taquilla.sources.schemas import schemas
from taquilla.sources.versions import StoredTable


def ticket(i):
    user = None if i % 10 == 9 else f"U{i % 300}"
    return {"id": f"K{i}", "id_users": user, "state": "vendido", "purchased_at": at(f"2024-0{1 + i % 3}-05T10:00:00")}


@pytest.fixture
def written(monkeypatch):
    """Of every write, whether rows are dealt anew, and the file list it gives."""
    seen, write = [], StoredTable._write

    def kept(self, rows, lie_well=False):
        files = write(self, rows, lie_well)
        seen.append((not lie_well, files))
        return files

    monkeypatch.setattr(StoredTable, "_write", kept)
    monkeypatch.setattr(versions, "LEAST_READ", 0)
    return seen


# bits: ample; so few that keys that stay are marked too; and more than may be sent
@pytest.mark.parametrize("bits, in_place", [((16, 32_768), True), ((1, 64), True), ((16, 1 << 24), False)])
def test_many_keys_are_marked(spark, tmp_path, monkeypatch, written, bits, in_place):
    tickets = stored.stored_table(spark, str(tmp_path), "tickets", schemas()["tickets"])
    rows = [ticket(i) for i in range(900)]
    tickets.append(frame(spark, "tickets", rows))
    monkeypatch.setattr(sizing, "MOST_SENT", 4_100)
    monkeypatch.setattr(stored, "BITS_PER_KEY", bits[0])
    monkeypatch.setattr(stored, "BLOCK_BITS", bits[1])
    gone = {f"U{u}" for u in range(300) if u % 2} | {f"V{u}" for u in range(40)}
    keys = spark.createDataFrame([(u,) for u in sorted(gone) * 2] + [(None,)], "id_users string")
    _, touched = stored.delete_stored(tickets, keys, "id_users")
    assert touched and [dealt for dealt, _ in written] == [True, not in_place]
    left = sorted(r["id"] for r in tickets.read().collect())
    assert left == sorted(r["id"] for r in rows if r["id_users"] not in gone)


def test_many_keys_of_another_type(spark, tmp_path, monkeypatch, written):
    table = StoredTable(spark, str(tmp_path / "t"), spark.range(1).schema)
    table.append(spark.range(400))
    monkeypatch.setattr(sizing, "MOST_SENT", 4_100)
    stored.delete_stored(table, spark.range(300).selectExpr("cast(id as int) id"))
    assert [dealt for dealt, _ in written] == [True, True]
    assert sorted(r["id"] for r in table.read().collect()) == [*range(300, 400)]


def test_summaries_of_files_sort_no_rows(spark, tmp_path, written):
    tickets = stored.stored_table(spark, str(tmp_path), "tickets", schemas()["tickets"])
    tickets.append(frame(spark, "tickets", [ticket(i) for i in range(30)]))
    plan = written[0][1]._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Sort" not in plan
    assert sum(r["rows"] for r in tickets.files().collect()) == 30
