"""Incoming rows for the write side, derived from the whole of the given tables.

Each frame mixes good rows with rows that break the rules under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taquilla.sources.binding import SEASON_START, StarFolder, has_price


def purchase_requests(star: StarFolder) -> DataFrame:
    """One request per order: some invalid, some for places that are gone."""
    key, user = F.col("o_orderkey"), F.col("o_custkey")
    match, stand = user % 40, key % 5
    return star("orders").select(
        F.concat(F.lit("R"), key.cast("string")).alias("id"),
        F.when(key % 97 != 0, user).alias("id_users"),
        F.when(key % 53 == 0, match + 1_000_000_000).otherwise(match).alias("id_matches"),
        F.when((key % 7 != 0) & has_price(match, stand), match * 10 + stand).alias(
            "id_match_stand_price"
        ),
        key.alias("id_transaction"),
        F.when(key % 89 != 0, F.col("o_totalprice").cast("decimal(10,2)")).alias("price"),
        (key % 13).cast("int").alias("quantity"),
        F.col("o_orderdate").alias("requested_at"),
    )


def incoming_tickets(tickets: DataFrame) -> DataFrame:
    """The tickets, some with keys that no row has."""
    key = F.col("id_transaction")
    wrong = {"id_users": 101, "id_matches": 103, "id_match_stand_price": 107, "id_transaction": 109}
    return tickets.withColumns(
        {
            column: F.when(key % every == 0, F.col(column) + 1_000_000_000_000).otherwise(F.col(column))
            for column, every in wrong.items()
        }
    )


def raw_transactions(star: StarFolder) -> DataFrame:
    """Transactions as sent, with empty and zero values."""
    key = F.col("o_orderkey")
    return star("orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("id_users"),
        F.when(key % 4 != 0, F.col("o_custkey") % 10).alias("id_matches"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
        F.when(key % 11 != 0, (key % 3).cast("int")).alias("number_tickets"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).otherwise("").alias("payment_method"),
        F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("REF"), key.cast("string"))).alias(
            "reference"
        ),
        F.when(key % 3 == 0, "USD").when(key % 3 == 1, "").alias("currency"),
        F.when(key % 6 != 0, F.col("o_orderdate")).alias("created_at"),
    )


def raw_matches(star: StarFolder) -> DataFrame:
    """Matches as sent: dates as day/month/year, ISO, with the year first, or missing."""
    key = F.col("s_suppkey")
    day = F.date_add(F.lit(SEASON_START), ((key * 37) % 120).cast("int"))
    written = (
        F.when(key % 4 == 0, F.date_format(day, "d/M/yyyy"))
        .when(key % 4 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 4 == 2, F.date_format(day, "yyyy/MM/dd"))
    )
    return star("supplier").select(
        key.alias("id"),
        F.col("s_nationkey").cast("bigint").alias("id_team_local"),
        (key % 25).alias("id_team_visitor"),
        written.alias("match_date"),
        F.when(key % 3 == 0, "").otherwise("19:30:00").alias("match_hour"),
        F.when(key % 5 == 0, "").when(key % 5 == 1, "aplazado").otherwise("programado").alias(
            "state"
        ),
        F.col("s_name").alias("stadium"),
    )


def transaction_patches(star: StarFolder) -> DataFrame:
    """Two rounds of patches to every transaction, with explicit NULLs and a barred field."""
    key = F.col("o_orderkey")
    orders = star("orders")
    first = orders.select(
        key.alias("id"),
        F.lit(1).alias("seq"),
        F.array(F.lit("currency"), F.lit("reference"), F.lit("created_at")).alias("set_fields"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("P"), key.cast("string")).alias("reference"),
        F.lit(None).cast("string").alias("payment_method"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    second = orders.select(
        key.alias("id"),
        F.lit(2).alias("seq"),
        F.when(key % 2 == 0, F.array(F.lit("payment_method")))
        .otherwise(F.array(F.lit("reference")))
        .alias("set_fields"),
        F.lit("EUR").alias("currency"),
        F.lit(None).cast("string").alias("reference"),
        F.lit(None).cast("string").alias("payment_method"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    return first.unionByName(second)


def incoming_events(star: StarFolder) -> DataFrame:
    """Match events as sent; some name a team or a simulation that is not there."""
    user = F.col("user_id")
    return star("events").select(
        F.col("event_id").alias("id"),
        (user % 30).alias("id_teams"),
        (100 * (user % 7)).alias("id_match_simulations"),
        F.when(F.col("event_id") % 10 != 0, F.floor("value").cast("int")).alias("minute"),
        F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias(
            "type_event"
        ),
        F.when(F.col("event_type") != "error", F.col("props")).alias("player"),
    )


def incoming_users(star: StarFolder) -> DataFrame:
    """Registrations: repeated and taken identities, short and malformed fields."""
    key = F.col("c_custkey")
    name = F.col("c_name")
    return star("customer").select(
        (key + 1_000_000_000).alias("id"),
        F.when(key % 3 == 0, F.concat(F.lower(name), F.lit("@example.com")))
        .when(key % 3 == 1, F.concat(F.lower("c_mktsegment"), F.lit("@example.com")))
        .otherwise(F.concat(name, F.lit("@nowhere")))
        .alias("email"),
        F.when(key % 4 == 0, "short").otherwise("long enough").alias("password"),
        F.when(key % 9 == 0, "A").otherwise(name).alias("name"),
        F.when(key % 2 == 0, F.col("c_mktsegment")).alias("last_name"),
        (key * 7 % 5000).cast("string").alias("identification"),
        F.when(key % 5 == 0, "PP").otherwise("CC").alias("identification_type"),
        F.when(key % 6 == 0, "root").otherwise("usuario").alias("rol"),
    )


def renamed_states(tickets: DataFrame) -> DataFrame:
    """The tickets, some in a state that the domain does not have."""
    odd = F.col("id_transaction") % 113 == 0
    return tickets.withColumn("state", F.when(odd, "devuelto").otherwise(F.col("state")))


def reissued_tickets(tickets: DataFrame) -> DataFrame:
    """New tickets whose codes are taken, shared by the tickets of a sale, missing or new."""
    key = F.col("id_transaction")
    return tickets.select(
        F.concat(F.lit("N"), "id").alias("id"),
        F.when(key % 4 == 0, F.col("ticket_code"))
        .when(key % 4 == 1, F.concat(F.lit("sale"), key.cast("string")))
        .when(key % 4 == 2, F.concat(F.lit("N"), "id"))
        .alias("ticket_code"),
    )


def raw_tickets(tickets: DataFrame) -> DataFrame:
    """The tickets as sent: without state, moment or place here and there."""
    key = F.col("id_transaction")
    return tickets.withColumns(
        {
            "state": F.when(key % 3 != 0, F.col("state")),
            "purchased_at": F.when(key % 5 != 0, F.col("purchased_at")),
            "id_match_stand_price": F.when(key % 7 != 0, F.col("id_match_stand_price")),
        }
    )


def raw_simulations(simulations: DataFrame) -> DataFrame:
    """The simulations as sent: cards and goals of a half missing, possession 0."""
    key = F.col("id_matches")
    return simulations.withColumns(
        {
            "local_yellow_cards": F.when(key % 2 == 0, F.col("local_yellow_cards")),
            "local_goals_first_half": F.when(key % 3 != 0, F.col("local_goals_first_half")),
            "visitor_possession": F.when(key % 4 == 0, F.lit(0))
            .otherwise(F.col("visitor_possession"))
            .cast("decimal(5,2)"),
            "created_at": F.when(key % 5 != 0, F.col("created_at")),
        }
    )


def ticket_patches(tickets: DataFrame) -> DataFrame:
    """A patch to two of three sales: state and price, and a seat, which may not change."""
    key = F.col("id_transaction")
    return tickets.where(key % 3 != 0).select(
        "id",
        F.lit(1).alias("seq"),
        F.when(key % 3 == 1, F.array(F.lit("state"), F.lit("seat")))
        .otherwise(F.array(F.lit("price")))
        .alias("set_fields"),
        F.lit("usado").alias("state"),
        (F.col("price") + 1).cast("decimal(10,2)").alias("price"),
        F.lit(0).alias("seat"),
    )
