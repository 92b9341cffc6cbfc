"""Listings of tickets, transactions and plain entities; pages of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taquilla.functions.text import seat_text
from taquilla.plans.dimensions import with_match, with_stand
from taquilla.plans.nesting import with_children
from taquilla.plans.pages import MOST_SORTED, page_of
from taquilla.sources.tables import Tables, only, owner_scope

HIDDEN_USER_COLUMNS = ("password",)
STAND_FIELDS = ("list_price", "id_stand", "stand_name", "capacity", "stand_description")
MATCH_LISTING = [
    "match_id",
    "match_date",
    "match_hour",
    "match_stadium",
    "match_state",
    "id_team_local",
    "local_name",
    "local_image_url",
    "id_team_visitor",
    "visitor_name",
    "visitor_image_url",
]


def _with_user(t: Tables, rows: DataFrame) -> DataFrame:
    """Add the buyer. Before other columns are added: beyond a broadcast this join moves the rows."""
    buyers = t.users.select(
        F.col("id").alias("id_users"),
        F.col("name").alias("user_name"),
        F.col("last_name").alias("user_last_name"),
        F.col("email").alias("user_email"),
    )
    return rows.join(buyers, "id_users", "left")


def ticket_listing(
    t: Tables, user_id=None, ticket_id=None, is_admin: bool = False
) -> DataFrame:
    """Tickets with match, teams, stand and seat text.

    For an administrator all tickets, with the buyer; else those of ``user_id``, newest
    first.
    """
    scoped = owner_scope(only(t.tickets, "id", ticket_id), user_id, is_admin)
    bought = _with_user(t, scoped) if is_admin else scoped
    listed = with_match(t, with_stand(t, bought, *STAND_FIELDS), MATCH_LISTING)
    columns = [
        "id",
        "ticket_code",
        "price",
        "state",
        "row",
        "seat",
        seat_text(F.col("row"), F.col("seat")).alias("seat_info"),
        "purchased_at",
        *MATCH_LISTING,
        "id_match_stand_price",
        *STAND_FIELDS,
    ]
    if is_admin:
        buyer = ["id_users", "user_name", "user_last_name", "user_email"]
        return listed.select(*columns, "id_transaction", *buyer)
    return listed.select(*columns).orderBy(F.desc_nulls_first("purchased_at"), "id")


def transaction_listing(
    t: Tables, user_id=None, tx_id=None, is_admin: bool = False
) -> DataFrame:
    """Transactions with their match; for an administrator all, with the buyer."""
    scoped = owner_scope(only(t.transactions, "id", tx_id), user_id, is_admin)
    if not is_admin:
        return with_match(t, scoped, MATCH_LISTING)
    facts = ["id_users", *[c for c in scoped.columns if c != "id_users"], *MATCH_LISTING]
    buyer = ["user_name", "user_last_name", "user_email"]
    return with_match(t, _with_user(t, scoped), MATCH_LISTING).select(*facts, *buyer)


def transaction_details(t: Tables, tx_id=None) -> DataFrame:
    """A row per ticket of a transaction, with match and teams; without tickets one row."""
    transactions = only(t.transactions, "id", tx_id).select(
        F.col("id").alias("id_transaction"), "id_matches", "total_amount", "number_tickets"
    )
    tickets = only(t.tickets, "id_transaction", tx_id).select(
        "id", "id_transaction", "id_match_stand_price", "price", "ticket_code"
    )
    items = ["id", "id_match_stand_price", "price", "ticket_code", "list_price", "id_stand", "stand_name"]
    seated = with_stand(t, tickets, "list_price", "id_stand", "stand_name").select(
        "id_transaction", F.struct(*items).alias("ticket")
    )
    facts = [c for c in MATCH_LISTING if c != "match_state"]
    described = with_match(t, transactions, facts)
    detailed = with_children(described, seated, "id_transaction").select(
        F.col("id_transaction").alias("id"), "total_amount", "number_tickets", *facts, "ticket"
    )
    return detailed if tx_id is None else detailed.orderBy("ticket.id")


def entity_listing(t: Tables, table: str, key=None) -> DataFrame:
    """All rows or one row of a table; users come without their password."""
    return only(t[table], "id", key).drop(*HIDDEN_USER_COLUMNS)


def paged_listing(
    t: Tables, table: str, page: int = 1, limit: int = 20, most_sorted: int = MOST_SORTED
) -> DataFrame:
    """One page of a table by id descending, with the total number of rows."""
    wanted, total = page_of(entity_listing(t, table), "id", page, limit, most_sorted)
    return wanted.withColumn("total", F.lit(total).cast("long"))


def page_events(t: Tables, page: int = 1, limit: int = 20) -> DataFrame:
    """The events of the simulations on one page."""
    shown = paged_listing(t, "match_simulations", page, limit).select(
        F.col("id").alias("id_match_simulations")
    )
    return t.simulations_events.join(shown, "id_match_simulations", "left_semi")
