"""Dashboard sections. ``as_of`` stands for the current date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taquilla.functions.numeric import percentage_or_zero
from taquilla.functions.text import padded_date, versus, weekday_name
from taquilla.plans.dimensions import with_teams
from taquilla.plans.rollups import (
    active,
    capacity_by_match,
    sales_by_stand,
    sold,
    tickets_by_match,
    tickets_by_price,
)
from taquilla.session import cut_lineage
from taquilla.sources.tables import Tables, bought_since

MONEY = "decimal(38,2)"
TREND_DAYS = 7
REVENUE_DAYS = 30


def _money_sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY)


def recent_days(t: Tables, as_of: dt.date, days: int = REVENUE_DAYS) -> DataFrame:
    """A row per day of sale since ``days`` days ago or the first of the month.

    (day, tickets, todays_ids, revenue, transactions); what the sections below need of days.
    """
    today = F.to_date("purchased_at") == F.lit(as_of)
    first = min(as_of - dt.timedelta(days=days), as_of.replace(day=1))
    return (
        bought_since(sold(t.tickets), first)
        .groupBy(F.to_date("purchased_at").alias("day"))
        .agg(
            F.count("id").alias("tickets"),
            F.count_distinct(F.when(today, F.col("id"))).alias("todays_ids"),
            F.sum("price").alias("revenue"),
            F.count_distinct("id_transaction").alias("transactions"),
        )
    )


def _days_since(by_day: DataFrame, first: dt.date) -> DataFrame:
    return by_day.filter(F.col("day") >= F.lit(first))


def daily_monthly_stats(
    t: Tables, as_of: dt.date, by_day: DataFrame | None = None
) -> DataFrame:
    """One row: tickets and revenue of the day, revenue since the first of the month.

    Nothing older than the month is read. The rollup ``recent_days`` may be handed in instead.
    """
    if by_day is not None:
        is_today = F.col("day") == F.lit(as_of)
        return _days_since(by_day, as_of.replace(day=1)).agg(
            F.coalesce(F.sum("todays_ids"), F.lit(0)).alias("daily_tickets_sold"),
            _money_sum(F.when(is_today, F.col("revenue"))).alias("daily_revenue"),
            _money_sum(F.col("revenue")).alias("monthly_revenue"),
        )
    today = (F.col("purchased_at") >= F.lit(as_of)) & (
        F.col("purchased_at") < F.lit(as_of + dt.timedelta(days=1))
    )
    return bought_since(sold(t.tickets), as_of.replace(day=1)).agg(
        F.count_distinct(F.when(today, F.col("id"))).alias("daily_tickets_sold"),
        _money_sum(F.when(today, F.col("price"))).alias("daily_revenue"),
        _money_sum(F.col("price")).alias("monthly_revenue"),
    )


def _upcoming(t: Tables, as_of: dt.date) -> DataFrame:
    return active(t.matches).filter(F.col("match_date") >= F.lit(as_of))


def _by_kickoff() -> list[Column]:
    return [F.asc_nulls_last("match_date"), F.asc_nulls_last("match_hour")]


def upcoming_matches(
    t: Tables, as_of: dt.date, k: int = 10, sold_by_match: DataFrame | None = None
) -> DataFrame:
    """The next ``k`` active matches with their occupancy.

    The ``k`` matches are picked first; only their tickets are then counted. A rollup
    (id_match, tickets) may be handed in instead.
    """
    first = _upcoming(t, as_of).orderBy(*_by_kickoff(), "id").limit(k)
    picked = first.select(F.col("id").alias("match_id"))
    if sold_by_match is None:
        own = sold(t.tickets).join(picked, F.col("id_matches") == F.col("match_id"), "left_semi")
        sold_by_match = tickets_by_match(own)
    sold_tickets = sold_by_match.select(
        F.col("id_match").alias("match_id"), F.col("tickets").alias("tickets_sold")
    )
    places = capacity_by_match(t, picked).select(
        F.col("id_match").alias("match_id"), F.col("capacity").alias("total_capacity")
    )
    counted = (
        with_teams(t, first.withColumnRenamed("id", "match_id"), "name")
        .join(places, "match_id", "left")
        .join(sold_tickets, "match_id", "left")
        .fillna(0, ["total_capacity", "tickets_sold"])
    )
    share = percentage_or_zero(F.col("tickets_sold"), F.col("total_capacity"))
    return (
        counted.withColumn("occupancy_percentage", share)
        .orderBy(*_by_kickoff(), "match_id")
        .select(
            "match_id",
            versus(F.col("local_name"), F.col("visitor_name")).alias("match_name"),
            padded_date(F.col("match_date")).alias("formatted_date"),
            "match_hour",
            "stadium",
            "total_capacity",
            "tickets_sold",
            "occupancy_percentage",
            F.when(F.col("total_capacity") == 0, "Sin capacidad")
            .when(F.col("occupancy_percentage") >= 70, "Alto")
            .when(F.col("occupancy_percentage") >= 40, "Medio")
            .otherwise("Bajo")
            .alias("occupancy_level"),
        )
    )


def upcoming_count(t: Tables, as_of: dt.date) -> DataFrame:
    return _upcoming(t, as_of).agg(F.count("*").alias("upcoming_matches_count"))


def stand_comparison(t: Tables, sold_by_price: DataFrame | None = None) -> DataFrame:
    """Per stand: sold tickets of active matches against the places of one event."""
    if sold_by_price is None:
        sold_by_price = tickets_by_price(sold(t.tickets))
    running = active(t.matches).select(F.col("id").alias("id_match"))
    by_stand = sales_by_stand(t, sold_by_price.join(running, "id_match", "left_semi"))
    capacity, tickets = F.col("total_capacity"), F.col("tickets_sold")
    # levels compare whole numbers, so they see the share before rounding
    return (
        t.soccer_stands.select(F.col("id").alias("id_stand"), "name", "total_capacity")
        .join(by_stand, "id_stand", "left")
        .withColumn("tickets_sold", F.coalesce("tickets", F.lit(0)))
        .withColumn("occupancy_percentage", percentage_or_zero(tickets, capacity))
        .orderBy(F.desc_nulls_first("occupancy_percentage"), "name", "id_stand")
        .select(
            F.col("name").alias("stand_name"),
            "total_capacity",
            "tickets_sold",
            "occupancy_percentage",
            F.when(capacity == 0, "Sin capacidad")
            .when((capacity > 0) & (tickets * 100 >= capacity * 80), "Alto")
            .when((capacity > 0) & (tickets * 100 >= capacity * 50), "Medio")
            .otherwise("Bajo")
            .alias("occupancy_level"),
        )
    )


def sales_trend(
    t: Tables, as_of: dt.date, days: int = TREND_DAYS, by_day: DataFrame | None = None
) -> DataFrame:
    """Tickets and revenue per day since ``days`` days ago; days without sales are absent."""
    first = as_of - dt.timedelta(days=days)
    if by_day is not None:
        trend = _days_since(by_day, first).select(
            F.col("day").alias("sale_date"),
            F.col("tickets").alias("tickets_sold"),
            F.coalesce("revenue", F.lit(0)).cast(MONEY).alias("daily_revenue"),
        )
    else:
        trend = (
            bought_since(sold(t.tickets), first)
            .groupBy(F.to_date("purchased_at").alias("sale_date"))
            .agg(
                F.count("id").alias("tickets_sold"),
                _money_sum(F.col("price")).alias("daily_revenue"),
            )
        )
    return (
        trend.orderBy("sale_date")
        .select(
            "sale_date",
            weekday_name(F.col("sale_date")).alias("day_name"),
            "tickets_sold",
            "daily_revenue",
        )
    )


def daily_revenue(
    t: Tables, as_of: dt.date, days: int = REVENUE_DAYS, by_day: DataFrame | None = None
) -> DataFrame:
    """Revenue and distinct transactions per day since ``days`` days ago."""
    if by_day is not None:
        shown = _days_since(by_day, as_of - dt.timedelta(days=days)).select(
            F.col("day").alias("sale_date"),
            F.coalesce("revenue", F.lit(0)).cast(MONEY).alias("daily_revenue"),
            F.col("transactions").alias("transactions_count"),
        )
        return shown.orderBy(F.desc("sale_date"))
    recent = bought_since(sold(t.tickets), as_of - dt.timedelta(days=days))
    return (
        recent.groupBy(F.to_date("purchased_at").alias("sale_date"))
        .agg(
            _money_sum(F.col("price")).alias("daily_revenue"),
            F.count_distinct("id_transaction").alias("transactions_count"),
        )
        .orderBy(F.desc("sale_date"))
    )


def _sales_totals(t: Tables) -> DataFrame:
    return sold(t.tickets).agg(
        F.count("*").alias("tickets"), _money_sum(F.col("price")).alias("revenue")
    )


def general_summary(
    t: Tables,
    as_of: dt.date,
    totals: DataFrame | None = None,
    days: int = TREND_DAYS,
    by_day: DataFrame | None = None,
) -> DataFrame:
    """One row of overall counts. The daily average is over days that had sales."""
    if totals is None:
        totals = _sales_totals(t)
    first = as_of - dt.timedelta(days=days)
    if by_day is None:
        by_day = (
            bought_since(sold(t.tickets), first)
            .groupBy(F.to_date("purchased_at").alias("day"))
            .agg(F.count("id").alias("tickets"))
        )
    per_day = _days_since(by_day, first)
    average = per_day.agg(F.coalesce(F.avg("tickets"), F.lit(0.0)).alias("average"))
    return totals.select(
        active(t.matches).agg(F.count("*").alias("n")).scalar().alias("active_matches"),
        t.soccer_stands.agg(F.count("*").alias("n")).scalar().alias("total_stands"),
        F.col("tickets").alias("total_tickets_sold"),
        F.col("revenue").alias("total_revenue"),
        average.scalar().alias("avg_daily_sales"),
    )


def _rows(section: DataFrame, order: list[Column], fields: list[str], empty: bool) -> DataFrame:
    """A section as one array of structs in the given order; without rows it is [] or NULL."""
    item = F.struct(
        *[key.alias(f"key_{i}") for i, key in enumerate(order)], F.struct(*fields).alias("row")
    )
    rows = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["row"])
    shown = F.when(F.count("*") > 0, rows)
    if empty:
        kind = section.select(*fields).schema.simpleString()
        shown = F.coalesce(shown, F.array().cast(f"array<{kind}>"))
    return section.agg(shown.alias("rows"))


def dashboard_document(t: Tables, as_of: dt.date, k: int = 10) -> DataFrame:
    """All sections as one row of nested columns.

    The arrays hold at most ``k`` matches, one entry per stand and one per day of the last
    weeks; nothing in them grows with the sales. The sold tickets of all time are read once
    and folded per price row and match; three sections go on from that rollup. Those of the
    last weeks are read once more and folded per day; four sections go on from those days.
    """
    spark = t.spark
    by_day = cut_lineage(recent_days(t, as_of))
    by_price = cut_lineage(tickets_by_price(sold(t.tickets)))
    by_match = by_price.groupBy("id_match").agg(F.sum("tickets").alias("tickets"))
    totals = by_price.agg(
        F.coalesce(F.sum("tickets"), F.lit(0)).alias("tickets"),
        _money_sum(F.col("revenue")).alias("revenue"),
    )
    upcoming = upcoming_matches(t, as_of, k, by_match)
    match_fields = upcoming.columns
    dated = upcoming.join(
        t.matches.select(F.col("id").alias("match_id"), "match_date"), "match_id", "inner"
    )
    kickoff = [
        F.col("match_date"),
        F.col("match_hour").isNull(),
        F.col("match_hour"),
        F.col("match_id"),
    ]
    stands = stand_comparison(t, by_price)
    trend = sales_trend(t, as_of, by_day=by_day)
    revenue = daily_revenue(t, as_of, by_day=by_day)
    stats = daily_monthly_stats(t, as_of, by_day).select(
        F.struct(
            F.col("daily_tickets_sold").alias("ticketsSold"),
            F.col("daily_revenue").alias("revenue"),
            F.col("monthly_revenue").alias("monthlyRevenue"),
        )
    )
    by_share = [-F.col("occupancy_percentage"), F.col("stand_name")]
    newest_first = [F.date_diff(F.lit(as_of), "sale_date")]
    return spark.range(1).select(
        stats.scalar().alias("dailyStats"),
        F.struct(
            upcoming_count(t, as_of).scalar().alias("count"),
            _rows(dated, kickoff, match_fields, False).scalar().alias("matches"),
        ).alias("upcomingMatches"),
        _rows(stands, by_share, stands.columns, True).scalar().alias("standComparison"),
        _rows(trend, [F.col("sale_date")], trend.columns, True).scalar().alias("salesTrend"),
        _rows(revenue, newest_first, revenue.columns, True).scalar().alias("dailyRevenue"),
        general_summary(t, as_of, totals, by_day=by_day).select(F.struct("*")).scalar().alias("summary"),
    )


def dashboard_json(t: Tables, as_of: dt.date, k: int = 10) -> DataFrame:
    """The document with each section as JSON text; NULL fields are written out."""
    document = dashboard_document(t, as_of, k)
    return document.select(
        *[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in document.columns]
    )
