"""Match catalogue and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taquilla.functions.numeric import round_half_up
from taquilla.plans.dimensions import priced_stands, with_teams
from taquilla.plans.nesting import with_children
from taquilla.plans.rollups import latest_simulation, tickets_by_match
from taquilla.sources.schemas import CLOSED_STATES
from taquilla.sources.tables import Tables, only

MONEY = "decimal(38,2)"
TEAM_FIELDS = ("id_team_api", "name", "city", "stadium", "image_url", "foundation", "created_at")


def match_catalog(t: Tables, match_id=None) -> DataFrame:
    """A row per match and priced stand, with both teams; a match without prices has one row."""
    matches = only(t.matches, "id", match_id)
    stand = F.struct(
        F.col("id_stand").alias("id"),
        F.col("stand_name").alias("name"),
        F.col("capacity").alias("total_capacity"),
        F.col("stand_description").alias("description"),
        F.col("stand_created_at").alias("created_at"),
    )
    priced = only(priced_stands(t), "id_match", match_id).select(
        F.col("id_match").alias("id"),
        F.struct(
            F.col("id_price").alias("id"),
            "id_match",
            "id_stand",
            F.col("list_price").alias("price"),
            F.col("price_created_at").alias("created_at"),
            stand.alias("stand"),
        ).alias("stand_price"),
    )
    sides = {
        side: F.struct(
            F.col(f"id_team_{side}").alias("id"),
            *[F.col(f"{side}_{f}").alias(f) for f in TEAM_FIELDS],
        )
        for side in ("local", "visitor")
    }
    described = with_teams(t, matches, *TEAM_FIELDS).select(
        *t.matches.columns, *[value.alias(side) for side, value in sides.items()]
    )
    return with_children(described, priced, "id")


def match_history(t: Tables) -> DataFrame:
    """Closed matches with the count and revenue of tickets in any state, and the result."""
    closed = t.matches.filter(F.col("state").isin(*CLOSED_STATES))
    sales = tickets_by_match(t.tickets).select(
        F.col("id_match").alias("id"),
        F.col("tickets").alias("total_tickets_sold"),
        F.col("revenue").alias("total_revenue"),
    )
    results = latest_simulation(t).select(
        F.col("id_matches").alias("id"), "local_goals", "visitor_goals"
    )
    return (
        with_teams(t, closed, "name", "image_url")
        .join(sales, "id", "left")
        .join(results, "id", "left")
        .orderBy(F.desc_nulls_first("match_date"), "id")
        .select(
            "id",
            "match_date",
            "match_hour",
            "stadium",
            "state",
            F.coalesce("total_tickets_sold", F.lit(0)).alias("total_tickets_sold"),
            F.coalesce("total_revenue", F.lit(0)).cast(MONEY).alias("total_revenue"),
            F.col("id_team_local").alias("local_id"),
            "local_name",
            "local_image_url",
            F.col("id_team_visitor").alias("visitor_id"),
            "visitor_name",
            "visitor_image_url",
            F.when(
                F.col("local_goals").isNotNull(),
                F.struct("id", "local_goals", "visitor_goals"),
            ).alias("result"),
        )
    )


def match_history_summary(t: Tables) -> DataFrame:
    """One row: totals over the history and rounded averages per match."""
    closed = t.matches.filter(F.col("state").isin(*CLOSED_STATES)).select(
        F.col("id").alias("id_match")
    )
    totals = closed.join(tickets_by_match(t.tickets), "id_match", "left").agg(
        F.count("*").alias("total_matches"),
        F.coalesce(F.sum("tickets"), F.lit(0)).alias("total_tickets_sold"),
        F.coalesce(F.sum("revenue"), F.lit(0)).cast(MONEY).alias("total_revenue"),
    )
    matches = F.when(F.col("total_matches") > 0, F.col("total_matches")).cast("decimal(20,0)")

    def average(total: str):
        return F.coalesce(round_half_up(F.col(total).cast("decimal(28,2)") / matches), F.lit(0))

    return totals.select(
        "*",
        average("total_tickets_sold").alias("average_tickets_per_match"),
        average("total_revenue").alias("average_revenue_per_match"),
    )
