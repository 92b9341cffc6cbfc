"""Every registered query against its SQL on the smallest test folder, and plan shapes."""

from __future__ import annotations

from pathlib import Path

import pytest

from taquilla.operators import dashboard, listings, simulations, users
from taquilla.plans.sizing import input_bytes, lookup_side
from taquilla.sources.binding import AS_OF, StarFolder, bind
from verification.compare import differences, duck_connection
from verification.oracle_sql import oracle_sql
from verification.registry import queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test folder")


@pytest.fixture(scope="module")
def connection():
    return duck_connection(FOLDER)


def test_every_query_has_its_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, connection, name):
    assert differences(spark, connection, FOLDER, name) is None


@pytest.mark.parametrize(
    "name",
    ["page_events", "check_references_tickets"] + sorted(n for n in queries() if n.endswith(("_one", "_own"))),
)
def test_entries_have_rows(spark, name):
    assert not queries()[name](spark, FOLDER).isEmpty()


@pytest.fixture(scope="module")
def bound(spark):
    return bind(StarFolder(spark, FOLDER))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unused_buyers_are_not_read(bound):
    assert "orders.parquet" not in plan(dashboard.stand_comparison(bound))
    assert "o_custkey" in plan(users.user_stand_distribution(bound))


def test_day_filters_reach_the_scan(bound):
    assert "GreaterThanOrEqual(l_shipdate,2001-07-01T00:00)" in plan(
        dashboard.daily_monthly_stats(bound, AS_OF)
    )


def test_rank_is_limited_before_the_shuffle(bound):
    text = plan(users.user_recent_purchases(bound))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_the_key_reaches_the_scan(bound):
    for df in (
        simulations.match_scoreboard(bound, 4),
        simulations.match_event_summary(bound, 4),
        simulations.match_timeline(bound, 4),
    ):
        assert "EqualTo(s_suppkey,4)" in plan(df) and "max_by" not in plan(df)
    assert "EqualTo(o_orderkey,1)" in plan(listings.transaction_details(bound, 1))


def test_no_operator_forms_all_pairs(spark):
    for name, query in queries().items():
        if name.startswith(("dashboard_document", "admit")):
            continue  # these run jobs; their parts are covered by the others
        text = plan(query(spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_lookups_are_broadcast_only_below_the_threshold(spark, bound):
    teams = bound.teams
    assert 0 < input_bytes(teams) < 100_000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        assert "hint" in lookup_side(teams)._jdf.queryExecution().logical().toString().lower()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
        assert lookup_side(teams) is teams
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert lookup_side(teams) is teams
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
