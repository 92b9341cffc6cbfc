"""Schemas of the nine tables, their keys and their value rules.

Key columns are strings by default (UUID text); ``schemas(key)`` gives the same tables over
another key type, as no operator depends on it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------
MATCH_STATES = ("programado", "en_venta", "agotado", "en_curso", "finalizado", "cancelado")
CLOSED_STATES = ("finalizado", "cancelado")
TICKET_STATES = ("pendiente", "vendido", "anulado", "usado")
EVENT_TYPES = ("Gol", "Tarjeta amarilla", "Tarjeta roja")
IDENTIFICATION_TYPES = ("CC", "TI")
ROLES = ("administrador", "usuario")
SOLD = "vendido"
USED = "usado"
FINISHED = "finalizado"
# ----------------------------------------------------------------------------------------

# child table, its column, parent table; every one of them cascades on delete
FOREIGN_KEYS = (
    ("matches", "id_team_local", "teams"),
    ("matches", "id_team_visitor", "teams"),
    ("match_stand_prices", "id_match", "matches"),
    ("match_stand_prices", "id_stand", "soccer_stands"),
    ("transactions", "id_users", "users"),
    ("transactions", "id_matches", "matches"),
    ("match_simulations", "id_matches", "matches"),
    ("tickets", "id_users", "users"),
    ("tickets", "id_matches", "matches"),
    ("tickets", "id_match_stand_price", "match_stand_prices"),
    ("tickets", "id_transaction", "transactions"),
    ("simulations_events", "id_teams", "teams"),
    ("simulations_events", "id_match_simulations", "match_simulations"),
)

# parents before children
TABLE_ORDER = (
    "users",
    "teams",
    "soccer_stands",
    "matches",
    "match_stand_prices",
    "transactions",
    "match_simulations",
    "tickets",
    "simulations_events",
)

UNIQUE_COLUMNS = {
    "users": ("email", "identification"),
    "tickets": ("ticket_code",),
    "match_simulations": ("id_matches",),
}

TEXT_LIMITS = {
    "users": {
        "email": 100,
        "password": 255,
        "name": 100,
        "last_name": 100,
        "identification": 20,
        "identification_type": 10,
        "rol": 20,
    },
    "teams": {
        "id_team_api": 20,
        "name": 100,
        "city": 100,
        "stadium": 100,
        "image_url": 255,
        "foundation": 100,
    },
    "matches": {"state": 20, "stadium": 100},
    "soccer_stands": {"name": 50},
    "transactions": {"payment_method": 50, "reference": 150, "currency": 10},
    "tickets": {"ticket_code": 100, "state": 20},
    "simulations_events": {"type_event": 50},
}

COUNT_STATISTICS = (
    "local_yellow_cards",
    "visitor_yellow_cards",
    "local_red_cards",
    "visitor_red_cards",
    "local_shots_on_goal",
    "visitor_shots_on_goal",
)
HALF_GOALS = (
    "local_goals_first_half",
    "local_goals_second_half",
    "visitor_goals_first_half",
    "visitor_goals_second_half",
)


def schemas(key: T.DataType | None = None) -> dict[str, T.StructType]:
    key = key or T.StringType()
    text, whole, moment = T.StringType(), T.IntegerType(), T.TimestampNTZType()

    def table(*columns: tuple) -> T.StructType:
        # a third element False marks a column that may not be NULL
        return T.StructType(
            [T.StructField(c[0], c[1], c[2] if len(c) > 2 else True) for c in columns]
        )

    return {
        "users": table(
            ("id", key, False),
            ("email", text, False),
            ("password", text, False),
            ("name", text, False),
            ("last_name", text),
            ("identification", text),
            ("identification_type", text),
            ("rol", text),
            ("birthday", T.DateType()),
            ("address", text),
            ("created_at", moment),
            ("updated_at", moment),
        ),
        "teams": table(
            ("id", key, False),
            ("id_team_api", text, False),
            ("name", text, False),
            ("city", text),
            ("stadium", text, False),
            ("image_url", text),
            ("foundation", text, False),
            ("created_at", moment),
        ),
        "matches": table(
            ("id", key, False),
            ("id_team_local", key, False),
            ("id_team_visitor", key, False),
            ("match_date", T.DateType()),
            ("match_hour", text),
            ("state", text),
            ("stadium", text),
            ("created_at", moment),
            ("updated_at", moment),
        ),
        "soccer_stands": table(
            ("id", key, False),
            ("name", text, False),
            ("total_capacity", whole, False),
            ("description", text),
            ("created_at", moment),
        ),
        "match_stand_prices": table(
            ("id", key, False),
            ("id_match", key, False),
            ("id_stand", key, False),
            ("price", T.DecimalType(10, 2), False),
            ("created_at", moment),
        ),
        "transactions": table(
            ("id", key, False),
            ("id_users", key, False),
            ("id_matches", key),
            ("total_amount", T.DecimalType(12, 2), False),
            ("number_tickets", whole, False),
            ("payment_method", text),
            ("reference", text),
            ("currency", text),
            ("created_at", moment),
        ),
        "tickets": table(
            ("id", key, False),
            ("id_users", key, False),
            ("id_matches", key, False),
            ("id_match_stand_price", key),
            ("ticket_code", text),
            ("price", T.DecimalType(10, 2), False),
            ("row", whole),
            ("seat", whole),
            ("id_transaction", key, False),
            ("state", text, False),
            ("purchased_at", moment),
        ),
        "match_simulations": table(
            ("id", key, False),
            ("id_matches", key, False),
            ("local_goals", whole, False),
            ("visitor_goals", whole, False),
            *[(c, whole, False) for c in HALF_GOALS],
            ("local_possession", T.DecimalType(5, 2)),
            ("visitor_possession", T.DecimalType(5, 2)),
            *[(c, whole, False) for c in COUNT_STATISTICS],
            ("created_at", moment),
        ),
        "simulations_events": table(
            ("id", key, False),
            ("id_teams", key, False),
            ("id_match_simulations", key, False),
            ("minute", whole, False),
            ("type_event", text, False),
            ("player", text, False),
            ("created_at", moment),
        ),
    }
