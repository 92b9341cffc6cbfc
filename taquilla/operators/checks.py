"""Rules on incoming rows. Each check gives one row per violation: (id, field, rule)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.functions.numeric import falsy_number, falsy_text
from taquilla.plans.rollups import stacked_keys
from taquilla.plans.sizing import marked, measured_side, written_and_measured
from taquilla.sources.schemas import (
    EVENT_TYPES,
    FINISHED,
    FOREIGN_KEYS,
    IDENTIFICATION_TYPES,
    MATCH_STATES,
    ROLES,
    TABLE_ORDER,
    TEXT_LIMITS,
    TICKET_STATES,
    UNIQUE_COLUMNS,
)
from taquilla.sources.tables import Tables

# --- fixed values -----------------------------------------------------------------------
# a field that may not be missing, empty or zero / a field that may not be missing
NOT_FALSY = {
    "purchase_requests": ("id_users", "id_matches", "quantity"),
    "simulations_events": ("id_teams", "id_match_simulations", "type_event", "player"),
    "match_simulations": ("id_matches",),
    "matches": ("id_team_local", "id_team_visitor"),
    "transactions": (),
    "soccer_stands": ("name",),
    "teams": ("name", "stadium"),
}
NOT_MISSING = {
    "purchase_requests": ("price",),
    "simulations_events": ("minute",),
    "match_simulations": ("local_goals", "visitor_goals"),
    "transactions": ("total_amount",),
    "soccer_stands": ("total_capacity",),
}
DOMAINS = {
    "matches": {"state": MATCH_STATES},
    "tickets": {"state": TICKET_STATES},
    "simulations_events": {"type_event": EVENT_TYPES},
    "users": {"identification_type": IDENTIFICATION_TYPES, "rol": ROLES},
}
MINIMUM_LENGTHS = {"users": {"name": 2, "last_name": 2, "password": 6, "identification": 4}}
EMAIL_PATTERN = r"^[A-Za-z0-9._%+#'&*/=?^`{|}~!$-]+@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"
MOST_TICKETS_PER_REQUEST = 10
# ----------------------------------------------------------------------------------------

# a purchase request refers to what its tickets will refer to; the sale itself may still
# have to be recorded
_REQUEST_KEYS = tuple(
    ("purchase_requests", column, parent)
    for child, column, parent in FOREIGN_KEYS
    if child == "tickets" and parent != "transactions"
)


def _known(table: str) -> None:
    """A misspelt table would have no rules and pass every check."""
    if table != "purchase_requests" and table not in TABLE_ORDER:
        raise ValueError(f"no rules are known for a table {table!r}")


def _present(rows: DataFrame, columns: Iterable[str]) -> None:
    absent = [c for c in columns if c not in rows.columns]
    if absent:
        raise ValueError(f"the rows lack {', '.join(absent)}")


def _violations(rows: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One narrow pass over the rows for any number of (field, rule, condition)."""
    found = [
        F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))
        for field, rule, broken in rules
    ]
    if not found:
        return rows.select("id", F.lit("").alias("field"), F.lit("").alias("rule")).limit(0)
    return rows.select("id", F.explode(F.array_compact(F.array(*found))).alias("v")).select(
        "id", "v.field", "v.rule"
    )


def check_required(table: str, rows: DataFrame) -> DataFrame:
    """Mandatory fields. A key is missing when NULL or ''; a numeric key may be 0."""
    _known(table)
    def falsy(field: str) -> Column:
        dtype, column = rows.schema[field].dataType, F.col(field)
        if isinstance(dtype, T.StringType):
            return falsy_text(column)
        return column.isNull() if field.startswith("id_") else falsy_number(column)

    rules = [(f, "required", falsy(f)) for f in NOT_FALSY.get(table, ())]
    rules += [(f, "required", F.col(f).isNull()) for f in NOT_MISSING.get(table, ())]
    return _violations(rows, rules)


def check_domain(table: str, rows: DataFrame) -> DataFrame:
    """Enumerated columns; NULL is allowed."""
    _known(table)
    return _violations(
        rows,
        [
            (field, "not in list", ~F.col(field).isin(*values))
            for field, values in DOMAINS.get(table, {}).items()
        ],
    )


def check_references(t: Tables, table: str, rows: DataFrame) -> DataFrame:
    """Foreign keys that point at no row. NULL refers to nothing and is fine.

    All key columns go through one fold: a row per column and distinct key, however many rows
    hold it, is looked up among the ids of the parents, on the same partitioning. Only if keys
    are missing are the rows read a second time. Every key column must be there.
    """
    _known(table)
    parents = {
        column: parent
        for child, column, parent in (*FOREIGN_KEYS, *_REQUEST_KEYS)
        if child == table
    }
    _present(rows, parents)
    if not parents:
        return _violations(rows, [])
    referring = stacked_keys(rows, parents)
    known = [
        t[parent].select(F.lit(column).alias("field"), F.col("id").alias("key"))
        for column, parent in parents.items()
    ]
    missing, n, size = written_and_measured(
        referring.select("field", "key")
        .distinct()
        .join(reduce(DataFrame.unionByName, known), ["field", "key"], "left_anti")
    )
    if not n:
        return _violations(rows, [])
    names = F.create_map(*[F.lit(v) for pair in parents.items() for v in pair])
    return referring.join(marked(missing, size), ["field", "key"], "left_semi").select(
        "id", "field", F.concat(F.lit("no such row in "), names[F.col("field")]).alias("rule")
    )


def check_unique(table: str, rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Values of unique columns used twice in the batch or already in the table.

    Values are counted first, so one that very many rows share is a single row in the join
    that finds its owners.
    """
    _known(table)
    found = []
    for column in UNIQUE_COLUMNS.get(table, ()):
        if column not in rows.columns:
            continue
        valued = rows.select("id", F.col(column).alias("value")).filter(F.col("value").isNotNull())
        repeated = valued.groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        found.append(
            valued.join(measured_side(repeated.select("value")), "value", "left_semi").select(
                "id", F.lit(column).alias("field"), F.lit("repeated in batch").alias("rule")
            )
        )
        if existing is not None:
            # one row per stored value in question; a stored row is no clash with itself
            asked = measured_side(valued.select("value").distinct())
            owners = (
                existing.select("id", F.col(column).alias("value"))
                .join(asked, "value", "left_semi")
                .groupBy("value")
                .agg(F.min("id").alias("first"), F.max("id").alias("last"))
            )
            clash = valued.join(owners, "value", "inner").filter(
                (F.col("id") != F.col("first")) | (F.col("id") != F.col("last"))
            )
            found.append(
                clash.select(
                    "id", F.lit(column).alias("field"), F.lit("already in table").alias("rule")
                )
            )
    return reduce(DataFrame.unionByName, found) if found else _violations(rows, [])


def check_shape(table: str, rows: DataFrame) -> DataFrame:
    """E-mail form, text lengths, capacity; NULL is left to the required check."""
    _known(table)
    rules = []
    if table == "users" and "email" in rows.columns:
        rules.append(("email", "not an e-mail", ~F.col("email").rlike(EMAIL_PATTERN)))
    for field, least in MINIMUM_LENGTHS.get(table, {}).items():
        if field in rows.columns:
            rules.append((field, "too short", F.length(field) < least))
    if table == "soccer_stands":
        capacity = F.col("total_capacity")
        whole = capacity.cast("string").try_cast("int")
        bad = capacity.isNotNull() & (whole.isNull() | (whole < 0))
        rules.append(("total_capacity", "not a whole number from 0", bad))
    for field, most in TEXT_LIMITS.get(table, {}).items():
        if field in rows.columns:
            rules.append((field, "too long", F.length(field) > most))
    return _violations(rows, rules)


def check_rules(table: str, rows: DataFrame) -> DataFrame:
    """Rules between columns: two different teams, 1 to 10 tickets per request.

    Every column of a rule must be there; rows without it would pass unseen.
    """
    _known(table)
    if table == "matches":
        _present(rows, ("id_team_local", "id_team_visitor"))
        same = F.col("id_team_local") == F.col("id_team_visitor")
        return _violations(rows, [("id_team_visitor", "same team twice", same)])
    if table == "purchase_requests":
        _present(rows, ("quantity",))
        outside = ~F.col("quantity").between(1, MOST_TICKETS_PER_REQUEST)
        return _violations(rows, [("quantity", "not from 1 to 10", outside)])
    return _violations(rows, [])


def check_settlement(t: Tables, match_ids: DataFrame) -> DataFrame:
    """Why matches may not be settled: unknown, already finished, already simulated."""
    ids = match_ids.select("id").distinct()
    states = t.matches.select("id", "state")
    simulated = t.match_simulations.select(F.col("id_matches").alias("id")).distinct()

    def reason(rows: DataFrame, field: str, rule: str) -> DataFrame:
        return rows.select("id", F.lit(field).alias("field"), F.lit(rule).alias("rule"))

    finished = states.filter(F.col("state") == FINISHED)
    return (
        reason(ids.join(states, "id", "left_anti"), "id", "no such row in matches")
        .unionByName(reason(ids.join(finished, "id", "left_semi"), "state", "already finished"))
        .unionByName(reason(ids.join(simulated, "id", "left_semi"), "id", "already simulated"))
    )
