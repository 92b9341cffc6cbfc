from __future__ import annotations

import datetime as dt
import sys
from functools import partial
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from taquilla.session import build_session  # noqa: E402
from taquilla.sources.schemas import TABLE_ORDER, schemas  # noqa: E402
from taquilla.sources.tables import Tables  # noqa: E402

MOMENT = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[4]",
        extra={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


DEFAULTS = {
    "users": {"password": "secret", "rol": "usuario", "created_at": MOMENT},
    "teams": {
        "id_team_api": "1",
        "stadium": "S",
        "foundation": "1900",
        "created_at": MOMENT,
    },
    "matches": {"created_at": MOMENT},
    "soccer_stands": {"created_at": MOMENT},
    "match_stand_prices": {"price": "50000.00", "created_at": MOMENT},
    "transactions": {"number_tickets": 1, "currency": "COP", "created_at": MOMENT},
    "tickets": {"state": "vendido", "purchased_at": MOMENT, "price": "100.00"},
    "match_simulations": {
        "local_goals": 0,
        "visitor_goals": 0,
        "local_goals_first_half": 0,
        "local_goals_second_half": 0,
        "visitor_goals_first_half": 0,
        "visitor_goals_second_half": 0,
        "local_yellow_cards": 0,
        "visitor_yellow_cards": 0,
        "local_red_cards": 0,
        "visitor_red_cards": 0,
        "local_shots_on_goal": 0,
        "visitor_shots_on_goal": 0,
        "created_at": MOMENT,
    },
    "simulations_events": {"minute": 1, "type_event": "Gol", "player": "P", "created_at": MOMENT},
}


def frame(spark, table: str, rows: list[dict]):
    """Rows of a table from dicts, with plain values for the columns not given."""
    from decimal import Decimal

    from pyspark.sql import types as T

    schema = schemas()[table]
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    def value(field, row):
        found = {**DEFAULTS[table], **row}.get(field.name)
        if found is not None and isinstance(field.dataType, T.DecimalType):
            return Decimal(str(found))
        return found

    return spark.createDataFrame([tuple(value(f, r) for f in loose.fields) for r in rows], loose)


@pytest.fixture
def make_tables(spark):
    """Nine micro tables from dicts of rows; tables not given are empty."""

    def build(**rows: list[dict]) -> Tables:
        return Tables(
            spark, **{name: partial(frame, spark, name, rows.get(name, [])) for name in TABLE_ORDER}
        )

    return build


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def one(df) -> dict:
    found = rows(df)
    assert len(found) == 1, found
    return found[0]
