"""Joins that put names on key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taquilla.plans.sizing import lookup_side
from taquilla.sources.tables import Tables

NULL_BUCKETS = 1024


def with_teams(t: Tables, matches: DataFrame, *fields: str) -> DataFrame:
    """Add ``local_<field>`` and ``visitor_<field>``; an unknown team gives NULLs."""
    for side in ("local", "visitor"):
        side_teams = t.teams.select(
            F.col("id").alias(f"{side}_key"),
            *[F.col(f).alias(f"{side}_{f}") for f in fields],
        )
        matches = matches.join(
            lookup_side(side_teams), F.col(f"id_team_{side}") == F.col(f"{side}_key"), "left"
        ).drop(f"{side}_key")
    return matches


def priced_stands(t: Tables) -> DataFrame:
    """Price rows with their stand, under names that cannot clash with ticket columns."""
    stands = t.soccer_stands.select(
        F.col("id").alias("id_stand"),
        F.col("name").alias("stand_name"),
        F.col("total_capacity").alias("capacity"),
        F.col("description").alias("stand_description"),
        F.col("created_at").alias("stand_created_at"),
    )
    prices = t.match_stand_prices.select(
        F.col("id").alias("id_price"),
        "id_match",
        "id_stand",
        F.col("price").alias("list_price"),
        F.col("created_at").alias("price_created_at"),
    )
    return prices.join(stands, "id_stand", "inner")


def with_stand(t: Tables, tickets: DataFrame, *fields: str) -> DataFrame:
    """Add columns of ``priced_stands`` to rows holding ``id_match_stand_price``.

    Rows without a stand, possibly very many, all carry the same NULL key. A second key
    spreads them over buckets; it is 0 on every other row and on the price side, where it is
    written as a hash so that it stays part of the join key.
    """
    stands = priced_stands(t).select(
        F.col("id_price").alias("stand_key"),
        F.pmod(F.xxhash64("id_price"), F.lit(1)).alias("stand_bucket"),
        *fields,
    )
    bucket = F.when(
        F.col("id_match_stand_price").isNull(), F.pmod(F.xxhash64("id"), F.lit(NULL_BUCKETS))
    ).otherwise(0)
    return (
        tickets.withColumn("own_bucket", bucket)
        .join(
            lookup_side(stands),
            (F.col("id_match_stand_price") == F.col("stand_key"))
            & (F.col("own_bucket") == F.col("stand_bucket")),
            "left",
        )
        .drop("stand_key", "stand_bucket", "own_bucket")
    )


def match_facts(t: Tables) -> DataFrame:
    """Match and team columns under names that cannot clash with ticket columns."""
    plain = t.matches.select(
        F.col("id").alias("match_id"),
        "id_team_local",
        "id_team_visitor",
        "match_date",
        "match_hour",
        F.col("stadium").alias("match_stadium"),
        F.col("state").alias("match_state"),
    )
    return with_teams(t, plain, "name", "image_url")


def with_match(t: Tables, rows: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Add columns of ``match_facts`` to rows holding ``id_matches``."""
    facts = match_facts(t).select("match_id", *[c for c in columns if c != "match_id"])
    return rows.join(lookup_side(facts), F.col("id_matches") == F.col("match_id"), how)
