"""Purchase statistics per user, over sold tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taquilla.functions.numeric import money_text, percent_text, percentage
from taquilla.functions.text import (
    NO_STAND,
    half_day_hour,
    long_date,
    purchase_date_text,
    purchase_moment_text,
    seat_text,
    versus,
)
from taquilla.plans.dimensions import match_facts, priced_stands, with_match, with_stand
from taquilla.plans.nesting import with_totals
from taquilla.plans.rollups import sold
from taquilla.plans.sizing import lookup_side
from taquilla.sources.tables import Tables, only

MONEY = "decimal(38,2)"
MICROS_PER_MONTH = 30 * 24 * 3600 * 1_000_000


def _bought(t: Tables, user_id) -> DataFrame:
    return only(sold(t.tickets), "id_users", user_id)


def _spending(t: Tables, tickets: DataFrame) -> DataFrame:
    """Per user: tickets, money, first and last purchase.

    ``total_spent`` adds the whole transaction once per ticket, as the original statistic
    does; ``total_spent_tickets`` adds ticket prices. Tickets are folded per transaction
    before the join, so a transaction of very many tickets is one row.
    """
    per_transaction = tickets.groupBy("id_users", "id_transaction").agg(
        F.count("*").alias("n"),
        F.sum("price").alias("price"),
        F.min("purchased_at").alias("first"),
        F.max("purchased_at").alias("last"),
    )
    amounts = t.transactions.select(F.col("id").alias("id_transaction"), "total_amount")
    return (
        per_transaction.join(amounts, "id_transaction", "left")
        .groupBy("id_users")
        .agg(
            F.sum("n").alias("total_tickets"),
            F.coalesce(F.sum(F.col("total_amount") * F.col("n")), F.lit(0))
            .cast(MONEY)
            .alias("total_spent"),
            F.sum("price").cast(MONEY).alias("total_spent_tickets"),
            F.min("first").alias("first_purchase"),
            F.max("last").alias("last_purchase"),
        )
    )


def _match_counts(t: Tables, tickets: DataFrame) -> DataFrame:
    pairs = tickets.select("id_users", F.col("id_matches").alias("id")).distinct()
    return (
        pairs.join(lookup_side(t.matches.select("id")), "id", "left_semi")
        .groupBy("id_users")
        .agg(F.count("*").alias("total_matches"))
    )


def _stand_counts(t: Tables, tickets: DataFrame) -> DataFrame:
    """(id_users, stand_name, n, last): tickets of a user per stand name."""
    per_price = tickets.groupBy(
        "id_users", F.col("id_match_stand_price").alias("id_price")
    ).agg(F.count("*").alias("n"), F.max("purchased_at").alias("last"))
    stands = priced_stands(t).select("id_price", "stand_name")
    return (
        per_price.filter(F.col("id_price").isNotNull())
        .join(lookup_side(stands), "id_price", "inner")
        .groupBy("id_users", "stand_name")
        .agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    )


def _favourites(t: Tables, tickets: DataFrame) -> DataFrame:
    """The stand a user bought most; of equals the one bought last, then the lowest name."""
    rank = F.struct(
        (-F.col("n")).alias("fewest"),
        (-F.unix_micros(F.col("last").cast("timestamp"))).alias("oldest"),
        F.col("stand_name"),
        F.col("n"),
    )
    best = _stand_counts(t, tickets).groupBy("id_users").agg(F.min(rank).alias("best"))
    return best.select(
        "id_users",
        F.col("best.stand_name").alias("favorite_stand"),
        F.col("best.n").alias("favorite_stand_count"),
    )


def user_purchase_summary(t: Tables, user_id=None) -> DataFrame:
    """Per user: totals, favourite stand, first and last purchase, months active.

    Users without tickets get zeros and NULLs.
    """
    tickets = _bought(t, user_id)
    users = only(t.users, "id", user_id).select(
        F.col("id").alias("id_users"), "name", "last_name", "email"
    )
    joined = (
        users.join(_spending(t, tickets), "id_users", "left")
        .join(_match_counts(t, tickets), "id_users", "left")
        .join(_favourites(t, tickets), "id_users", "left")
        .fillna(0, ["total_tickets", "total_matches"])
        .withColumns(
            {
                "total_spent": F.coalesce("total_spent", F.lit(0)).cast(MONEY),
                "total_spent_tickets": F.coalesce("total_spent_tickets", F.lit(0)).cast(MONEY),
            }
        )
    )
    has_match = F.col("total_matches") > 0
    average = F.when(
        has_match,
        F.col("total_spent").cast("decimal(28,2)") / F.col("total_matches").cast("decimal(20,0)"),
    )
    share = percentage(F.col("favorite_stand_count"), F.col("total_tickets"), 1)
    active = F.unix_micros(F.col("last_purchase").cast("timestamp")) - F.unix_micros(
        F.col("first_purchase").cast("timestamp")
    )
    bought = F.col("total_tickets") > 0
    return joined.withColumn("average_per_match", F.round(average, 2).cast(MONEY)).select(
        F.col("id_users").alias("user_id"),
        "name",
        "last_name",
        "email",
        "total_tickets",
        "total_matches",
        "total_spent",
        "total_spent_tickets",
        money_text(F.col("total_spent")).alias("total_spent_text"),
        "average_per_match",
        money_text(F.col("average_per_match")).alias("average_per_match_text"),
        "favorite_stand",
        "favorite_stand_count",
        percent_text(share.cast("decimal(10,1)")).alias("favorite_stand_percentage"),
        "first_purchase",
        "last_purchase",
        purchase_date_text(F.col("first_purchase")).alias("first_purchase_text"),
        purchase_date_text(F.col("last_purchase")).alias("last_purchase_text"),
        F.when(bought, F.coalesce(F.ceil(active / MICROS_PER_MONTH), F.lit(0)))
        .cast("int")
        .alias("months_active"),
    )


def user_match_history(t: Tables, user_id=None) -> DataFrame:
    """A row per ticket with its match, both teams, and the user's tickets and money there."""
    tickets = _bought(t, user_id).select(
        "id", "id_users", "id_matches", "id_match_stand_price", "price", "row", "seat", "purchased_at"
    )
    totals = {
        "tickets_count": F.count("*"),
        "total_spent_match": F.sum("price").cast(MONEY),
    }
    counted = with_totals(tickets, ["id_users", "id_matches"], totals)
    sides = [
        f"{side}_{field}" for side in ("local", "visitor") for field in ("name", "image_url")
    ]
    # texts of a match are made once per match, not per ticket
    facts = match_facts(t).withColumns(
        {
            "date_formatted": long_date(F.col("match_date")),
            "time_formatted": half_day_hour(F.col("match_hour")),
        }
    )
    history = with_stand(t, counted, "stand_name").join(
        lookup_side(facts), F.col("id_matches") == F.col("match_id")
    )
    shown = history.select(
        F.col("id_users").alias("user_id"),
        "match_id",
        F.col("id_team_local").alias("local_id"),
        F.col("id_team_visitor").alias("visitor_id"),
        *sides,
        F.col("match_date").alias("date"),
        "date_formatted",
        F.col("match_hour").alias("time"),
        "time_formatted",
        F.col("match_stadium").alias("stadium"),
        F.col("match_state").alias("state"),
        *totals,
        "purchased_at",
        F.col("id").alias("ticket_id"),
        F.coalesce("stand_name", F.lit(NO_STAND)).alias("stand"),
        "price",
        seat_text(F.col("row"), F.col("seat")).alias("seat_info"),
        purchase_moment_text(F.col("purchased_at")).alias("purchased_at_text"),
    )
    if user_id is None:
        return shown
    newest = [F.desc("purchased_at"), F.desc("ticket_id")]
    return shown.orderBy(F.desc_nulls_last("date"), "match_id", *newest)


def user_stand_distribution(t: Tables, user_id=None) -> DataFrame:
    """Per user and stand name: tickets and their share of all the user's tickets."""
    tickets = _bought(t, user_id)
    totals = tickets.groupBy("id_users").agg(F.count("*").alias("all_tickets"))
    shares = (
        _stand_counts(t, tickets)
        .join(totals, "id_users", "inner")
        .select(
            F.col("id_users").alias("user_id"),
            F.col("stand_name").alias("stand"),
            F.col("n").alias("count"),
            percent_text(
                percentage(F.col("n"), F.col("all_tickets"), 1).cast("decimal(10,1)")
            ).alias("percentage"),
        )
    )
    return shares if user_id is None else shares.orderBy(F.desc("count"), "stand")


def user_recent_purchases(t: Tables, user_id=None, k: int = 5) -> DataFrame:
    """The ``k`` latest tickets of each user.

    The rank limit is applied by every task before the shuffle, so of a user with very many
    tickets only ``k`` per task move; names are joined to the survivors.
    """
    newest = Window.partitionBy("id_users").orderBy(F.desc_nulls_first("purchased_at"), "id")
    latest = (
        _bought(t, user_id)
        .select(
            "id",
            "id_users",
            "id_matches",
            "id_match_stand_price",
            "ticket_code",
            "price",
            "purchased_at",
            F.row_number().over(newest).alias("position"),
        )
        .filter(F.col("position") <= k)
    )
    named = with_match(
        t,
        with_stand(t, latest, "stand_name"),
        ["local_name", "visitor_name", "match_date", "match_hour"],
    )
    shown = named.select(
        F.col("id_users").alias("user_id"),
        "position",
        "ticket_code",
        versus(F.col("local_name"), F.col("visitor_name")).alias("match"),
        F.concat(
            long_date(F.col("match_date")), F.lit(" a las "), half_day_hour(F.col("match_hour"))
        ).alias("date_time"),
        F.coalesce("stand_name", F.lit(NO_STAND)).alias("stand"),
        "price",
        "purchased_at",
        purchase_moment_text(F.col("purchased_at")).alias("purchased_at_text"),
    )
    return shown if user_id is None else shown.orderBy("position")
