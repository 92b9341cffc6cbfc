"""Every operator over the test binding, with outputs both engines can print alike.

Decimals become doubles, dates and timestamps text; nested values are flattened or joined
into text. The operators themselves return typed and nested columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.operators import (
    admission,
    checks,
    dashboard,
    listings,
    matches,
    occupancy,
    reports,
    simulations,
    stored,
    users,
    writes,
)
from taquilla.session import prepare, step_folder
from taquilla.sources.binding import AS_OF, StarFolder, bind
from taquilla.sources.schemas import TABLE_ORDER
from taquilla.sources.tables import Tables
from taquilla.sources.versions import StoredTable
from verification import incoming
from verification.oracle_sql import (
    NULLABLE_WHOLE,
    ONE_MATCH,
    ONE_TEAM,
    ONE_TRANSACTION,
    ONE_USER,
)

NOW = dt.datetime(2001, 7, 15, 12, 0, 0)


def printable(df: DataFrame) -> DataFrame:
    def shown(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def _match_catalog(t: Tables, match_id=None) -> DataFrame:
    price = F.col("stand_price")
    return matches.match_catalog(t, match_id).select(
        "id",
        "match_date",
        "match_hour",
        "state",
        "stadium",
        F.col("local.name").alias("local_name"),
        F.col("local.city").alias("local_city"),
        F.col("local.created_at").alias("local_created_at"),
        F.col("visitor.name").alias("visitor_name"),
        F.col("visitor.foundation").alias("visitor_foundation"),
        price["id"].alias("price_id"),
        price["id_match"].alias("price_match"),
        price["price"].alias("price"),
        price["stand"]["name"].alias("stand_name"),
        price["stand"]["total_capacity"].alias("stand_capacity"),
        price["stand"]["created_at"].alias("stand_created_at"),
    )


def _match_history(t: Tables) -> DataFrame:
    history = matches.match_history(t)
    return history.select(
        *[c for c in history.columns if c != "result"],
        F.col("result.local_goals").alias("result_local_goals"),
        F.col("result.visitor_goals").alias("result_visitor_goals"),
    )


def _transaction_details(t: Tables, tx_id=None) -> DataFrame:
    details = listings.transaction_details(t, tx_id)
    return details.select(
        *[c for c in details.columns if c != "ticket"],
        F.col("ticket.id").alias("ticket_id"),
        F.col("ticket.price").alias("price"),
        F.col("ticket.list_price").alias("list_price"),
        F.col("ticket.stand_name").alias("stand_name"),
    )


def _match_scoreboard(t: Tables, match_id=None) -> DataFrame:
    board = simulations.match_scoreboard(t, match_id)

    def side(name: str) -> list[Column]:
        s = F.col(name)
        return [
            s["team"]["name"].alias(f"{name}_name"),
            s["goals"].alias(f"{name}_goals"),
            s["goals_by_half"]["second_half"].alias(f"{name}_goals_second_half"),
            s["possession"].alias(f"{name}_possession"),
            s["shots_on_goal"].alias(f"{name}_shots"),
            s["yellow_cards"].alias(f"{name}_yellow"),
            s["red_cards"].alias(f"{name}_red"),
        ]

    return board.select(
        "id",
        "match_id",
        "score",
        F.col("first_half.score").alias("first_half"),
        F.col("second_half.score").alias("second_half"),
        *side("local"),
        *side("visitor"),
        "state",
        "date",
        "stadium",
    )


def _all_ids(t: Tables) -> DataFrame:
    """(table_name, id) of every row of every table."""
    parts = [
        t[name].select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id"))
        for name in TABLE_ORDER
    ]
    return reduce(DataFrame.unionByName, parts)


def _delete_teams(t: Tables) -> DataFrame:
    gone = t.teams.filter(F.col("city") == "ASIA").select("id")
    return _all_ids(writes.delete_cascade(t, "teams", gone))


def _delete_users(t: Tables) -> DataFrame:
    gone = t.users.filter(F.col("identification_type") == "TI").select("id")
    return _all_ids(writes.delete_cascade(t, "users", gone))


def _played(t: Tables) -> DataFrame:
    return t.matches.filter(F.col("match_date") < F.lit(AS_OF)).select("id")


def _settled(t: Tables) -> tuple[Tables, DataFrame]:
    return writes.settle_matches(t, _played(t))


def _settled_rows(t: Tables) -> DataFrame:
    after, _ = _settled(t)
    return after.matches.select(
        F.lit("matches").alias("table_name"), F.col("id").cast("string").alias("id"), "state"
    ).unionByName(after.tickets.select(F.lit("tickets").alias("table_name"), "id", "state"))


def _stored(t: Tables, folder: str, name: str) -> StoredTable:
    """A table of the binding as the first version of a stored one."""
    table = stored.stored_table(t.spark, folder, name, t[name].schema)
    table.append(t[name])
    return table


def _append_tickets(t: Tables, star: StarFolder) -> DataFrame:
    """The given tickets and those of the admitted requests, appended and read back."""
    table = _stored(t, step_folder(t.spark), "tickets")
    table.append(admission.admit_purchases(t, _requests(t, star)).tickets)
    return table.read().drop(stored.PURCHASE_MONTH)


def _patch_stored(t: Tables, star: StarFolder) -> DataFrame:
    table = _stored(t, step_folder(t.spark), "transactions")
    stored.patch_stored(table, "transactions", incoming.transaction_patches(star), is_admin=True)
    return table.read()


def _settle_stored(t: Tables) -> DataFrame:
    folder = step_folder(t.spark)
    kept = {name: _stored(t, folder, name) for name in ("matches", "tickets")}
    stored.settle_stored(kept["matches"], kept["tickets"], _played(t))
    parts = [
        table.read().select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id"), "state")
        for name, table in kept.items()
    ]
    return parts[0].unionByName(parts[1])


def _delete_stored(t: Tables) -> DataFrame:
    table = _stored(t, step_folder(t.spark), "tickets")
    gone = t.users.filter(F.col("identification_type") == "TI").select(F.col("id").alias("id_users"))
    stored.delete_stored(table, gone, "id_users")
    return table.read().drop(stored.PURCHASE_MONTH)


def _ticket_one(t: Tables) -> DataFrame:
    first = t.tickets.agg(F.min("id")).first()[0]
    return listings.ticket_listing(t, ticket_id=first, is_admin=True)


def _cascade(t: Tables, table: str, gone: Column) -> DataFrame:
    return _all_ids(writes.delete_cascade(t, table, t[table].filter(gone).select("id")))


def _requests(t: Tables, star: StarFolder) -> DataFrame:
    return incoming.purchase_requests(star)


OPERATORS: dict[str, Callable[[Tables, StarFolder], DataFrame]] = {
    "daily_monthly_stats": lambda t, s: dashboard.daily_monthly_stats(t, AS_OF),
    "upcoming_matches": lambda t, s: dashboard.upcoming_matches(t, AS_OF),
    "upcoming_count": lambda t, s: dashboard.upcoming_count(t, AS_OF),
    "stand_comparison": lambda t, s: dashboard.stand_comparison(t),
    "sales_trend": lambda t, s: dashboard.sales_trend(t, AS_OF),
    "daily_revenue": lambda t, s: dashboard.daily_revenue(t, AS_OF),
    "general_summary": lambda t, s: dashboard.general_summary(t, AS_OF),
    "dashboard_document": lambda t, s: dashboard.dashboard_json(t, AS_OF),
    "report_total_stats": lambda t, s: reports.total_stats(t),
    "report_capacity": lambda t, s: reports.capacity(t),
    "report_match_details": lambda t, s: reports.match_details(t),
    "report_revenue_by_stand": lambda t, s: reports.revenue_by_stand(t),
    "report_revenue_by_day": lambda t, s: reports.revenue_by_day(t),
    "report_most_popular_stand": lambda t, s: reports.most_popular_stand(t),
    "report_tickets_by_stand": lambda t, s: reports.tickets_by_stand(t),
    "report_top_matches": lambda t, s: reports.top_matches(t),
    "report_totals": lambda t, s: reports.report_totals(t),
    "sales_report_totals": lambda t, s: reports.sales_report(t)["totalStats"],
    "sales_report_tickets_by_stand": lambda t, s: reports.sales_report(t)["ticketsByStand"],
    "sales_report_matches": lambda t, s: reports.sales_report(t)["matchesDetails"],
    "match_catalog": lambda t, s: _match_catalog(t),
    "match_history": lambda t, s: _match_history(t),
    "match_history_summary": lambda t, s: matches.match_history_summary(t),
    "user_purchase_summary": lambda t, s: users.user_purchase_summary(t),
    "user_match_history": lambda t, s: users.user_match_history(t),
    "user_stand_distribution": lambda t, s: users.user_stand_distribution(t),
    "user_recent_purchases": lambda t, s: users.user_recent_purchases(t),
    "match_occupancy": lambda t, s: occupancy.match_occupancy(t),
    "match_stand_summary": lambda t, s: occupancy.match_stand_summary(t),
    "match_stand_totals": lambda t, s: occupancy.match_stand_totals(t),
    "ticket_listing": lambda t, s: listings.ticket_listing(t, is_admin=True),
    "transaction_listing": lambda t, s: listings.transaction_listing(t, is_admin=True),
    "transaction_details": lambda t, s: _transaction_details(t),
    "match_scoreboard": lambda t, s: _match_scoreboard(t),
    "match_timeline": lambda t, s: simulations.match_timeline(t),
    "match_event_summary": lambda t, s: simulations.match_event_summary(t),
    "match_event_summary_literal": lambda t, s: simulations.match_event_summary(t, literal=True),
    "paged_listing_simulations": lambda t, s: listings.paged_listing(
        t, "match_simulations", page=2, limit=20
    ),
    "paged_listing_events": lambda t, s: listings.paged_listing(
        t, "simulations_events", page=3, limit=50
    ),
    "paged_listing_deep": lambda t, s: listings.paged_listing(
        t, "simulations_events", page=7, limit=50, most_sorted=60
    ),
    # the last page holds the simulations with events
    "page_events": lambda t, s: listings.page_events(
        t, page=-(-t.match_simulations.count() // 20), limit=20
    ),
    "simulation_events": lambda t, s: simulations.simulation_events(t),
    "simulation_with_events": lambda t, s: simulations.simulation_with_events(t),
    "entity_listing_teams": lambda t, s: listings.entity_listing(t, "teams"),
    "entity_listing_stands": lambda t, s: listings.entity_listing(t, "soccer_stands"),
    "entity_listing_simulations": lambda t, s: listings.entity_listing(t, "match_simulations"),
    "entity_listing_users": lambda t, s: listings.entity_listing(t, "users"),
    "apply_defaults_transactions": lambda t, s: writes.apply_defaults(
        "transactions", incoming.raw_transactions(s), NOW
    ),
    "apply_defaults_matches": lambda t, s: writes.apply_defaults(
        "matches", incoming.raw_matches(s), NOW
    ),
    "apply_defaults_tickets": lambda t, s: writes.apply_defaults(
        "tickets", incoming.raw_tickets(t.tickets), NOW
    ),
    "apply_defaults_simulations": lambda t, s: writes.apply_defaults(
        "match_simulations", incoming.raw_simulations(t.match_simulations), NOW
    ),
    "patch_tickets": lambda t, s: writes.patch_rows(
        "tickets", t.tickets, incoming.ticket_patches(t.tickets)
    ),
    "patch_rows": lambda t, s: writes.patch_rows(
        "transactions", t.transactions, incoming.transaction_patches(s), is_admin=True
    ),
    "delete_cascade_teams": lambda t, s: _delete_teams(t),
    "delete_cascade_users": lambda t, s: _delete_users(t),
    "delete_cascade_matches": lambda t, s: _cascade(t, "matches", F.col("id") % 6 == 0),
    "delete_cascade_stands": lambda t, s: _cascade(t, "soccer_stands", F.col("name") == "Norte"),
    "delete_cascade_prices": lambda t, s: _cascade(
        t, "match_stand_prices", F.col("id_match") % 5 == 0
    ),
    "delete_cascade_transactions": lambda t, s: _cascade(
        t, "transactions", F.col("number_tickets") == 2
    ),
    "settle_matches": lambda t, s: _settled(t)[1],
    "settle_matches_rows": lambda t, s: _settled_rows(t),
    "provision_prices": lambda t, s: writes.provision_prices(t.matches, t.soccer_stands, NOW),
    "admit_purchases": lambda t, s: admission.admit_purchases(t, _requests(t, s)).decisions,
    "admit_purchases_tickets": lambda t, s: admission.admit_purchases(t, _requests(t, s)).tickets,
    "append_tickets": _append_tickets,
    "patch_stored": _patch_stored,
    "settle_stored": lambda t, s: _settle_stored(t),
    "delete_stored": lambda t, s: _delete_stored(t),
    "check_required_requests": lambda t, s: checks.check_required(
        "purchase_requests", _requests(t, s)
    ),
    "check_required_events": lambda t, s: checks.check_required(
        "simulations_events", incoming.incoming_events(s)
    ),
    "check_domain_events": lambda t, s: checks.check_domain(
        "simulations_events", t.simulations_events
    ),
    "check_domain_users": lambda t, s: checks.check_domain("users", incoming.incoming_users(s)),
    "check_domain_tickets": lambda t, s: checks.check_domain(
        "tickets", incoming.renamed_states(t.tickets)
    ),
    "check_domain_matches": lambda t, s: checks.check_domain("matches", incoming.raw_matches(s)),
    "check_references": lambda t, s: checks.check_references(
        t, "simulations_events", incoming.incoming_events(s)
    ),
    "check_references_requests": lambda t, s: checks.check_references(
        t, "purchase_requests", _requests(t, s)
    ),
    "check_references_tickets": lambda t, s: checks.check_references(
        t, "tickets", incoming.incoming_tickets(t.tickets)
    ),
    "check_unique": lambda t, s: checks.check_unique("users", incoming.incoming_users(s), t.users),
    "check_unique_tickets": lambda t, s: checks.check_unique(
        "tickets", incoming.reissued_tickets(t.tickets), t.tickets
    ),
    "check_shape": lambda t, s: checks.check_shape("users", incoming.incoming_users(s)),
    "check_rules_requests": lambda t, s: checks.check_rules("purchase_requests", _requests(t, s)),
    "check_rules_matches": lambda t, s: checks.check_rules("matches", incoming.raw_matches(s)),
    "check_settlement": lambda t, s: checks.check_settlement(t, _played(t)),
    # one key or one owner
    "match_catalog_one": lambda t, s: _match_catalog(t, ONE_MATCH),
    "user_match_history_own": lambda t, s: users.user_match_history(t, ONE_USER),
    "user_stand_distribution_own": lambda t, s: users.user_stand_distribution(t, ONE_USER),
    "user_recent_purchases_own": lambda t, s: users.user_recent_purchases(t, ONE_USER),
    "ticket_listing_own": lambda t, s: listings.ticket_listing(t, user_id=ONE_USER),
    "transaction_listing_own": lambda t, s: listings.transaction_listing(t, user_id=ONE_USER),
    "transaction_details_one": lambda t, s: _transaction_details(t, ONE_TRANSACTION),
    "match_scoreboard_one": lambda t, s: _match_scoreboard(t, ONE_MATCH),
    "match_timeline_one": lambda t, s: simulations.match_timeline(t, ONE_MATCH),
    "match_event_summary_one": lambda t, s: simulations.match_event_summary(t, ONE_MATCH),
    "simulation_events_one": lambda t, s: simulations.simulation_events(t, 100 * ONE_MATCH),
    "user_purchase_summary_one": lambda t, s: users.user_purchase_summary(t, ONE_USER),
    "match_occupancy_one": lambda t, s: occupancy.match_occupancy(t, ONE_MATCH),
    "match_stand_summary_one": lambda t, s: occupancy.match_stand_summary(t, ONE_MATCH),
    "match_stand_totals_one": lambda t, s: occupancy.match_stand_totals(t, ONE_MATCH),
    "ticket_one": lambda t, s: _ticket_one(t),
    "transaction_one": lambda t, s: listings.transaction_listing(
        t, tx_id=ONE_TRANSACTION, is_admin=True
    ),
    "entity_listing_one": lambda t, s: listings.entity_listing(t, "teams", ONE_TEAM),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def query(name: str):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            star = StarFolder(spark, sf_dir)
            shown = printable(OPERATORS[name](bind(star), star))
            doubles = {c: F.col(c).cast("double") for c in NULLABLE_WHOLE.get(name, ())}
            return shown.withColumns(doubles) if doubles else shown

        return run

    return {name: query(name) for name in OPERATORS}
