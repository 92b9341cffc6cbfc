"""Shared aggregates over the large tables.

Each groups the tickets by key columns before any join, so that what is shuffled is one
row per group and task. A match, user or price that holds a large share of all tickets
is folded on the map side and never meets one task as raw rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taquilla.sources.schemas import CLOSED_STATES, SOLD
from taquilla.sources.tables import Tables, only


def sold(tickets: DataFrame) -> DataFrame:
    return tickets.filter(F.col("state") == SOLD)


def active(matches: DataFrame) -> DataFrame:
    """Matches not yet closed; one without a state is not counted as active."""
    return matches.filter(~F.col("state").isin(*CLOSED_STATES))


def capacity_by_match(t: Tables, picked: DataFrame | None = None) -> DataFrame:
    """(id_match, capacity): places over all stands on sale for the match.

    With ``picked`` (column match_id) only for those matches.
    """
    stands = t.soccer_stands.select(F.col("id").alias("id_stand"), "total_capacity")
    prices = t.match_stand_prices
    if picked is not None:
        prices = prices.join(picked, F.col("id_match") == F.col("match_id"), "left_semi")
    return (
        prices.join(stands, "id_stand", "inner")
        .groupBy("id_match")
        .agg(F.sum("total_capacity").alias("capacity"))
    )


def tickets_by_match(tickets: DataFrame) -> DataFrame:
    """(id_match, tickets, revenue) of the given tickets."""
    return tickets.groupBy(F.col("id_matches").alias("id_match")).agg(
        F.count("*").alias("tickets"), F.sum("price").alias("revenue")
    )


def tickets_by_price(tickets: DataFrame) -> DataFrame:
    """(id_price, id_match, tickets, revenue); tickets without a stand have a NULL id_price."""
    return tickets.groupBy(
        F.col("id_match_stand_price").alias("id_price"), F.col("id_matches").alias("id_match")
    ).agg(F.count("*").alias("tickets"), F.sum("price").alias("revenue"))


def sales_by_stand(t: Tables, by_price: DataFrame) -> DataFrame:
    """(id_stand, tickets, revenue) from a rollup by price row."""
    prices = t.match_stand_prices.select(F.col("id").alias("id_price"), "id_stand")
    return (
        by_price.groupBy("id_price")
        .agg(F.sum("tickets").alias("tickets"), F.sum("revenue").alias("revenue"))
        .join(prices, "id_price", "inner")
        .groupBy("id_stand")
        .agg(F.sum("tickets").alias("tickets"), F.sum("revenue").alias("revenue"))
    )


def latest_simulations(t: Tables, match_id=None) -> DataFrame:
    """(id, match_id) of the simulation each match shows: its last, should it have several."""
    return (
        only(t.match_simulations, "id_matches", match_id)
        .groupBy(F.col("id_matches").alias("match_id"))
        .agg(F.max(F.struct("created_at", "id")).alias("last"))
        .select(F.col("last.id").alias("id"), "match_id")
    )


def latest_simulation(t: Tables, match_id=None) -> DataFrame:
    """The rows of the simulations that matches show."""
    shown = latest_simulations(t, match_id).select("id")
    return only(t.match_simulations, "id_matches", match_id).join(shown, "id", "left_semi").select(
        *t.match_simulations.columns
    )


def stacked_keys(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(id, field, key): the keys of several columns, without NULL, from one pass over the rows."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).alias("key")) for c in columns]
    )
    return (
        rows.select("id", F.explode(pairs).alias("k"))
        .select("id", "k.field", "k.key")
        .filter(F.col("key").isNotNull())
    )
