"""Sales report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taquilla.functions.numeric import percentage, percentage_or_zero
from taquilla.functions.text import versus
from taquilla.plans.dimensions import with_teams
from taquilla.plans.rollups import (
    capacity_by_match,
    sales_by_stand,
    sold,
    tickets_by_match,
    tickets_by_price,
)
from taquilla.session import cut_lineage
from taquilla.sources.tables import Tables

MONEY = "decimal(38,2)"
NO_STAND_YET = "No disponible"


def total_stats(t: Tables, by_price: DataFrame | None = None) -> DataFrame:
    """One row: revenue and number of sold tickets."""
    if by_price is None:
        revenue, count = F.sum("price"), F.count("*")
    else:
        revenue, count = F.sum("revenue"), F.coalesce(F.sum("tickets"), F.lit(0))
    return (sold(t.tickets) if by_price is None else by_price).agg(
        F.coalesce(revenue, F.lit(0)).cast(MONEY).alias("total_revenue"),
        count.alias("total_tickets_sold"),
    )


def capacity(t: Tables) -> DataFrame:
    """One row: places over all matches.

    ``total_capacity`` counts two stands of equal size in one match once, as the original
    report does; ``total_capacity_all`` is the plain sum.
    """
    stands = t.soccer_stands.select(F.col("id").alias("id_stand"), "total_capacity")
    sizes = t.match_stand_prices.join(stands, "id_stand", "inner")
    # one pass: per (match, size) the size itself and how often it occurs
    per_size = sizes.groupBy("id_match", "total_capacity").agg(F.count("*").alias("n"))
    return per_size.agg(
        F.coalesce(F.sum("total_capacity"), F.lit(0)).alias("total_capacity"),
        F.coalesce(F.sum(F.col("total_capacity") * F.col("n")), F.lit(0)).alias(
            "total_capacity_all"
        ),
    )


def _with_sales(t: Tables, matches: DataFrame, by_price: DataFrame | None) -> DataFrame:
    if by_price is None:
        by_match = tickets_by_match(sold(t.tickets))
    else:
        by_match = by_price.groupBy("id_match").agg(
            F.sum("tickets").alias("tickets"), F.sum("revenue").alias("revenue")
        )
    sales = by_match.select(
        F.col("id_match").alias("match_id"),
        F.col("tickets").alias("tickets_sold"),
        F.col("revenue").alias("match_revenue"),
    )
    return (
        matches.withColumnRenamed("id", "match_id")
        .join(sales, "match_id", "left")
        .withColumns(
            {
                "tickets_sold": F.coalesce("tickets_sold", F.lit(0)),
                "match_revenue": F.coalesce("match_revenue", F.lit(0)).cast(MONEY),
            }
        )
    )


def _with_occupancy(
    t: Tables, matches: DataFrame, picked: DataFrame | None = None
) -> DataFrame:
    places = capacity_by_match(t, picked).select(
        F.col("id_match").alias("match_id"), F.col("capacity").alias("match_capacity")
    )
    return (
        with_teams(t, matches, "name")
        .join(places, "match_id", "left")
        .fillna(0, ["match_capacity"])
        .withColumn("match_name", versus(F.col("local_name"), F.col("visitor_name")))
        .withColumn(
            "occupancy_percentage",
            percentage_or_zero(F.col("tickets_sold"), F.col("match_capacity")),
        )
    )


def match_details(t: Tables, by_price: DataFrame | None = None) -> DataFrame:
    """Every match with sold tickets, revenue at ticket price, places and occupancy."""
    detailed = _with_occupancy(t, _with_sales(t, t.matches, by_price))
    return detailed.orderBy(F.desc_nulls_first("match_date"), "match_id").select(
        "match_id",
        "match_name",
        F.col("local_name").alias("local_team"),
        F.col("visitor_name").alias("visitor_team"),
        "match_date",
        "stadium",
        "state",
        "tickets_sold",
        "match_revenue",
        "match_capacity",
        "occupancy_percentage",
    )


def top_matches(t: Tables, k: int = 3, by_price: DataFrame | None = None) -> DataFrame:
    """The ``k`` matches with most sold tickets; names and places are added to those only."""
    order = (F.desc("tickets_sold"), F.desc_nulls_first("match_date"), F.asc("match_id"))
    best = _with_sales(t, t.matches, by_price).orderBy(*order).limit(k)
    return (
        _with_occupancy(t, best, best.select("match_id"))
        .orderBy(*order)
        .select(
            "match_id",
            "match_name",
            "tickets_sold",
            "match_revenue",
            "match_capacity",
            "occupancy_percentage",
        )
    )


def _stand_sales(t: Tables, by_price: DataFrame | None) -> DataFrame:
    """(stand_name, tickets_sold, stand_revenue), unsorted; stands of one name are merged."""
    if by_price is None:
        by_price = tickets_by_price(sold(t.tickets))
    sales = sales_by_stand(t, by_price)
    stands = t.soccer_stands.select(F.col("id").alias("id_stand"), F.col("name").alias("stand_name"))
    return (
        stands.join(sales, "id_stand", "left")
        .groupBy("stand_name")
        .agg(
            F.coalesce(F.sum("tickets"), F.lit(0)).alias("tickets_sold"),
            F.coalesce(F.sum("revenue"), F.lit(0)).cast(MONEY).alias("stand_revenue"),
        )
    )


def revenue_by_stand(t: Tables, by_price: DataFrame | None = None) -> DataFrame:
    return _stand_sales(t, by_price).orderBy(F.desc("stand_revenue"), "stand_name")


def revenue_by_day(t: Tables) -> DataFrame:
    """Revenue and number of transactions per day, from transactions of a positive amount."""
    return (
        t.transactions.filter(F.col("total_amount") > 0)
        .groupBy(F.to_date("created_at").alias("sale_date"))
        .agg(
            F.coalesce(F.sum("total_amount"), F.lit(0)).cast(MONEY).alias("daily_revenue"),
            F.count("id").alias("transactions_count"),
        )
        .orderBy(F.desc_nulls_first("sale_date"))
    )


def most_popular_stand(t: Tables, by_price: DataFrame | None = None) -> DataFrame:
    """One row: the stand name with most sold tickets, of equals the lowest name."""
    ranked = _stand_sales(t, by_price).orderBy(F.desc("tickets_sold"), "stand_name")
    best = ranked.select("stand_name").limit(1)
    return t.spark.range(1).select(
        F.coalesce(best.scalar(), F.lit(NO_STAND_YET)).alias("stand_name")
    )


def tickets_by_stand(t: Tables, by_price: DataFrame | None = None) -> DataFrame:
    """Per stand name its tickets and their share of all sold tickets, also those without a stand."""
    total = total_stats(t, by_price).select("total_tickets_sold")
    share = percentage(F.col("tickets_sold"), F.col("all_sold")).cast("decimal(10,2)")
    return (
        revenue_by_stand(t, by_price)
        .withColumn("all_sold", total.scalar())
        .select(
            "stand_name",
            F.col("tickets_sold").alias("ticket_count"),
            F.coalesce(share.cast("string"), F.lit("0.00")).alias("percentage"),
        )
    )


def report_totals(t: Tables, by_price: DataFrame | None = None) -> DataFrame:
    """One row: the head figures of the report."""
    figures = total_stats(t, by_price).select(
        F.col("total_revenue"),
        F.col("total_tickets_sold"),
        capacity(t).select("total_capacity").scalar().alias("total_capacity"),
        most_popular_stand(t, by_price).scalar().alias("most_popular_stand"),
    )
    return figures.select(
        "total_revenue",
        "total_tickets_sold",
        "total_capacity",
        percentage_or_zero(F.col("total_tickets_sold"), F.col("total_capacity")).alias(
            "total_occupancy_percentage"
        ),
        "most_popular_stand",
    )


def sales_report(t: Tables, k: int = 3) -> dict[str, DataFrame]:
    """All sections of the report, from one pass over the tickets.

    The sold tickets are folded per price row and match and the rollup is written out; the
    sections, which may be stored or shown one after the other, go on from it. The list of
    matches grows with the season, so the report is several frames and not one document.
    """
    by_price = cut_lineage(tickets_by_price(sold(t.tickets)))
    return {
        "totalStats": report_totals(t, by_price),
        "revenueByDay": revenue_by_day(t),
        "revenueByStand": revenue_by_stand(t, by_price),
        "ticketsByStand": tickets_by_stand(t, by_price),
        "topMatches": top_matches(t, k, by_price),
        "matchesDetails": match_details(t, by_price),
    }
