"""Free places per match and per stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taquilla.functions.numeric import percentage
from taquilla.plans.dimensions import priced_stands
from taquilla.plans.rollups import sold, tickets_by_match, tickets_by_price
from taquilla.sources.tables import Tables, only

MONEY = "decimal(38,2)"


def match_occupancy(t: Tables, match_id=None) -> DataFrame:
    """Per match with stands: places, tickets in any state, shares, lowest price, status.

    The status compares whole numbers, so a match of zero places still gets one.
    """
    places = (
        only(priced_stands(t), "id_match", match_id)
        .groupBy("id_match")
        .agg(
            F.sum("capacity").alias("total_capacity"), F.min("list_price").alias("lowest_price")
        )
    )
    taken = tickets_by_match(only(t.tickets, "id_matches", match_id)).select("id_match", "tickets")
    capacity, available = F.col("total_capacity"), F.col("available_tickets")
    return (
        places.join(taken, "id_match", "left")
        .withColumn("tickets_sold", F.coalesce("tickets", F.lit(0)))
        .withColumn("available_tickets", capacity - F.col("tickets_sold"))
        .select(
            F.col("id_match").alias("match_id"),
            "total_capacity",
            "tickets_sold",
            "available_tickets",
            percentage(F.col("tickets_sold"), capacity).alias("occupancy_percentage"),
            "lowest_price",
            percentage(available, capacity).alias("available_percentage"),
            F.when(available == 0, "Agotadas")
            .when(available * 100 <= capacity * 15, "Pocos cupos")
            .otherwise("Disponibles")
            .alias("status"),
        )
    )


def match_stand_summary(t: Tables, match_id=None) -> DataFrame:
    """Per match, stand and list price: sold tickets, revenue at list price, availability."""
    prices = only(priced_stands(t), "id_match", match_id)
    sales = tickets_by_price(only(sold(t.tickets), "id_matches", match_id)).select(
        "id_price", "id_match", "tickets"
    )
    merged = (
        prices.join(sales, ["id_price", "id_match"], "left")
        .groupBy("id_match", "id_stand", "stand_name", "stand_description", "capacity", "list_price")
        .agg(
            F.coalesce(F.sum("tickets"), F.lit(0)).alias("tickets_sold"),
            F.coalesce(F.sum(F.col("list_price") * F.col("tickets")), F.lit(0))
            .cast(MONEY)
            .alias("revenue"),
        )
    )
    capacity, available = F.col("capacity"), F.col("tickets_available")
    summary = merged.withColumn("tickets_available", capacity - F.col("tickets_sold")).select(
        F.col("id_match").alias("match_id"),
        F.col("id_stand").alias("stand_id"),
        "stand_name",
        F.col("stand_description").alias("description"),
        capacity.alias("total_capacity"),
        F.col("list_price").alias("price"),
        "tickets_sold",
        "tickets_available",
        percentage(F.col("tickets_sold"), capacity).alias("occupancy_percentage"),
        "revenue",
        F.when(available == 0, "Sin disponibilidad")
        .when(available * 10 <= capacity * 3, "Pocas disponibles")
        .otherwise("Disponibles")
        .alias("availability"),
    )
    return summary if match_id is None else summary.orderBy("stand_name", "stand_id", "price")


def match_stand_totals(t: Tables, match_id=None) -> DataFrame:
    """Sums of the stand summary per match; a match without stands has zeros and no share."""
    sums = (
        match_stand_summary(t, match_id)
        .groupBy("match_id")
        .agg(
            F.sum("total_capacity").alias("total_capacity"),
            F.sum("tickets_sold").alias("tickets_sold"),
            F.sum("revenue").alias("total_revenue"),
        )
    )
    matches = only(t.matches, "id", match_id).select(F.col("id").alias("match_id"))
    capacity, tickets = F.col("total_capacity"), F.col("tickets_sold")
    return (
        matches.join(sums, "match_id", "left")
        .fillna(0, ["total_capacity", "tickets_sold"])
        .select(
            "match_id",
            "total_capacity",
            "tickets_sold",
            (capacity - tickets).alias("available_tickets"),
            percentage(tickets, capacity).alias("occupancy_percentage"),
            F.coalesce("total_revenue", F.lit(0)).cast(MONEY).alias("total_revenue"),
        )
    )
