"""Rewrites of large files leave rows in the tasks that read them."""

from __future__ import annotations

from tests.conftest import at, frame
from taquilla.operators import stored
from taquilla.sources import versions
from taquilla.sources.schemas import schemas


def ticket(i, match):
    return {"id": f"K{i}", "id_matches": match, "state": "vendido", "purchased_at": at(f"2024-0{1 + i % 3}-05T10:00:00")}


def test_large_rewrites_leave_rows_in_their_tasks(spark, tmp_path, monkeypatch):
    kept = {name: stored.stored_table(spark, str(tmp_path), name, schemas()[name]) for name in ("matches", "tickets")}
    kept["tickets"].append(frame(spark, "tickets", [ticket(i, [None, "M1", "M2"][i // 3 % 3]) for i in range(27)]))
    kept["matches"].append(frame(spark, "matches", [{"id": "M1", "state": "programado"}]))
    assert all(r["file"].endswith(".zstd.parquet") for r in kept["tickets"].files().collect())
    dealt, write = [], versions.StoredTable._write

    def seen(self, rows, lie_well=False):
        dealt.append(not lie_well)
        return write(self, rows, lie_well)

    monkeypatch.setattr(versions.StoredTable, "_write", seen)
    monkeypatch.setattr(versions, "LEAST_READ", 0)
    stored.settle_stored(kept["matches"], kept["tickets"], spark.createDataFrame([("M1",)], "id string"))
    assert dealt == [False, False]
    stored.delete_stored(kept["tickets"], spark.createDataFrame([("M2",), (None,)], "id_matches string"), "id_matches")
    assert dealt == [False, False, False]
    rows = [(r["id_matches"], r["state"]) for r in kept["tickets"].read().collect()]
    assert sorted(rows, key=str) == [("M1", "usado")] * 9 + [(None, "vendido")] * 9
    # small files are brought together again
    monkeypatch.undo()
    monkeypatch.setattr(versions.StoredTable, "_write", seen)
    stored.delete_stored(kept["tickets"], spark.createDataFrame([("M1",)], "id_matches string"), "id_matches")
    assert dealt[-1] and kept["tickets"].read().count() == 9
