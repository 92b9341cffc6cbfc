"""Rows are moved before columns are added to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import at
from taquilla.operators import listings
from taquilla.sources.binding import StarFolder, tickets


def place(df, *texts):
    """Where lines with these texts are in the optimized plan: an operator is above its input."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [next(i for i, line in enumerate(lines) if text in line) for text in texts]


def _join(df, key):
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return next(i for i, line in enumerate(lines) if "Join LeftOuter" in line and key in line)


def test_buyers_are_added_before_the_rows_get_wide(spark, make_tables):
    t = make_tables(
        users=[{"id": "U1", "name": "Ana"}],
        matches=[{"id": "M1", "id_team_local": "T1", "id_team_visitor": "T1"}],
        tickets=[{"id": "K1", "id_users": "U1", "id_matches": "M1"}, {"id": "K2"}],
        transactions=[{"id": "X1", "id_users": "U1", "id_matches": "M1"}, {"id": "X2"}],
    )
    for listed in (listings.ticket_listing(t, is_admin=True), listings.transaction_listing(t, is_admin=True)):
        assert _join(listed, "match_id") < _join(listed, "id_users")
        assert sorted((r["id"][1], r["user_name"], r["match_id"]) for r in listed.collect()) == [
            ("1", "Ana", "M1"), ("2", None, None),
        ]
    names = listings.transaction_listing(t, is_admin=True).columns
    facts = listings.transaction_listing(t, user_id="U1").columns
    assert names == ["id_users", *[c for c in facts if c != "id_users"], "user_name", "user_last_name", "user_email"]


def test_ticket_ids_are_made_after_the_join(spark, tmp_path):
    spark.createDataFrame(
        [(1, 2, 3, 1, 5.0, 10.0, "N", "O")],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_returnflag string, l_linestatus string",
    ).withColumn("l_shipdate", F.lit(at("2001-05-05T00:00:00"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    sold = tickets(StarFolder(spark, str(tmp_path)))
    made, joined = place(sold, "concat_ws", "Join LeftOuter")
    assert made < joined
    row = sold.first()
    assert (row["id"], row["ticket_code"], row["id_users"]) == ("1-1-2-3-2001-05-05", "1-1-2-3-2001-05-05", 7)
