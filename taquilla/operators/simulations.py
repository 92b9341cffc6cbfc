"""Scoreboard, timeline and event counts of simulated matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taquilla.functions.numeric import percent_text
from taquilla.functions.text import match_half, score_text
from taquilla.plans.dimensions import with_match
from taquilla.plans.rollups import latest_simulation, latest_simulations
from taquilla.plans.sizing import lookup_side
from taquilla.sources.tables import Tables, only

# --- fixed values -----------------------------------------------------------------------
STORED_LABELS = {
    "goals": "Gol",
    "yellow_cards": "Tarjeta amarilla",
    "red_cards": "Tarjeta roja",
    "substitutions": "substitution",
}
# what the original summary compares with; stored events never carry these
ENGLISH_LABELS = {
    "goals": "goal",
    "yellow_cards": "yellow_card",
    "red_cards": "red_card",
    "substitutions": "substitution",
}
# ----------------------------------------------------------------------------------------


def _side(side: str) -> Column:
    """Team and statistics of one side."""
    possession = F.coalesce(F.col(f"{side}_possession").cast("string"), F.lit("null"))
    return F.struct(
        F.struct(
            F.col(f"id_team_{side}").alias("id"),
            F.col(f"{side}_name").alias("name"),
            F.col(f"{side}_image_url").alias("image_url"),
        ).alias("team"),
        F.col(f"{side}_goals").alias("goals"),
        F.struct(
            F.coalesce(f"{side}_goals_first_half", F.lit(0)).alias("first_half"),
            F.coalesce(f"{side}_goals_second_half", F.lit(0)).alias("second_half"),
        ).alias("goals_by_half"),
        percent_text(possession).alias("possession"),
        F.col(f"{side}_shots_on_goal").alias("shots_on_goal"),
        F.col(f"{side}_yellow_cards").alias("yellow_cards"),
        F.col(f"{side}_red_cards").alias("red_cards"),
    )


def _half_score(half: str) -> Column:
    local = F.coalesce(f"local_goals_{half}", F.lit(0))
    visitor = F.coalesce(f"visitor_goals_{half}", F.lit(0))
    return F.struct(
        local.alias("local"), visitor.alias("visitor"), score_text(local, visitor).alias("score")
    )


def match_scoreboard(t: Tables, match_id=None) -> DataFrame:
    """Per simulated match: score, score by half, statistics of both sides, match info."""
    simulations = latest_simulation(t, match_id)
    facts = ["match_state", "match_date", "match_stadium"]
    for side in ("local", "visitor"):
        facts += [f"id_team_{side}", f"{side}_name", f"{side}_image_url"]
    return with_match(t, simulations, facts).select(
        "id",
        F.col("id_matches").alias("match_id"),
        score_text(F.col("local_goals"), F.col("visitor_goals")).alias("score"),
        _half_score("first_half").alias("first_half"),
        _half_score("second_half").alias("second_half"),
        _side("local").alias("local"),
        _side("visitor").alias("visitor"),
        F.col("match_state").alias("state"),
        F.col("match_date").alias("date"),
        F.col("match_stadium").alias("stadium"),
    )


def _match_events(t: Tables, match_id) -> DataFrame:
    """Events of the simulation each match shows, with the match they belong to."""
    simulations = latest_simulations(t, match_id).withColumnRenamed("id", "id_match_simulations")
    return t.simulations_events.join(
        lookup_side(simulations), "id_match_simulations", "inner"
    )


def match_timeline(t: Tables, match_id=None) -> DataFrame:
    """Events with their half and team; of one match by minute."""
    side = t.teams.select(
        F.col("id").alias("id_teams"),
        F.col("name").alias("team_name"),
        F.col("image_url").alias("team_image_url"),
    )
    timeline = (
        _match_events(t, match_id)
        .join(lookup_side(side), "id_teams", "left")
        .select(
            "match_id",
            "id",
            "minute",
            match_half(F.col("minute")).alias("half"),
            F.col("type_event").alias("type"),
            "player",
            F.col("id_teams").alias("team_id"),
            "team_name",
            "team_image_url",
        )
    )
    return timeline if match_id is None else timeline.orderBy("minute", "id")


def match_event_summary(t: Tables, match_id=None, literal: bool = False) -> DataFrame:
    """Events per simulated match, in all and by kind.

    Kinds are compared with the stored labels; ``literal=True`` compares with the English
    ones of the original, which no stored event carries.
    """
    labels = ENGLISH_LABELS if literal else STORED_LABELS
    simulated = latest_simulations(t, match_id)
    # of one match only its events are read; of all matches every event is folded where it lies
    events = t.simulations_events if match_id is None else _match_events(t, match_id)
    counts = events.groupBy(F.col("id_match_simulations").alias("id")).agg(
        F.count("*").alias("total_events"),
        *[F.count_if(F.col("type_event") == text).alias(n) for n, text in labels.items()],
    )
    joined = simulated.join(counts, "id", "left").drop("id")
    return joined.fillna(0, ["total_events", *labels])


def simulation_events(t: Tables, simulation_id=None) -> DataFrame:
    """Stored events, of one simulation if asked for."""
    return only(t.simulations_events, "id_match_simulations", simulation_id)


def simulation_with_events(t: Tables, simulation_id=None) -> DataFrame:
    """Simulations with their events, one row each; a simulation without events is one row."""
    events = simulation_events(t, simulation_id).select(
        F.col("id_match_simulations").alias("id"),
        F.col("id").alias("event_id"),
        "id_teams",
        "minute",
        "type_event",
        "player",
        F.col("created_at").alias("event_created_at"),
    )
    return only(t.match_simulations, "id", simulation_id).join(events, "id", "left")
