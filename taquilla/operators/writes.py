"""Batch transforms of the tables: defaults, patches, deletes, settlement, prices.

Each returns new table contents; storing them is up to ``sources.tables``.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.functions.numeric import falsy_number, falsy_text
from taquilla.functions.text import day_month_year
from taquilla.plans.dimensions import NULL_BUCKETS
from taquilla.plans.rollups import stacked_keys
from taquilla.plans.sizing import (
    folded_side,
    lookup_side,
    measured_side,
    most_broadcast_bytes,
    written_and_measured,
)
from taquilla.sources.schemas import (
    COUNT_STATISTICS,
    FINISHED,
    FOREIGN_KEYS,
    HALF_GOALS,
    SOLD,
    TABLE_ORDER,
    USED,
)
from taquilla.sources.tables import Tables

# --- fixed values -----------------------------------------------------------------------
PRICE_BY_STAND_NAME = {"Occidental": 80000, "Oriental": 70000, "Norte": 40000, "Sur": 45000}
OTHER_STAND_PRICE = 50000

# what takes the place of a missing, empty or zero value; None stands for NULL
FALSY_DEFAULTS = {
    "users": {"rol": "usuario", "birthday": None, "address": None},
    "teams": {"city": None, "image_url": None, "foundation": None},
    "matches": {"match_date": None, "match_hour": None, "state": None},
    "soccer_stands": {"description": None},
    "match_stand_prices": {},
    "transactions": {
        "id_matches": None,
        "number_tickets": 1,
        "payment_method": None,
        "reference": None,
        "currency": "COP",
    },
    "tickets": {"id_match_stand_price": None},
    "match_simulations": {
        "local_possession": None,
        "visitor_possession": None,
        **{c: 0 for c in COUNT_STATISTICS},
    },
    "simulations_events": {},
}
# what takes the place of NULL only
NULL_DEFAULTS = {
    "tickets": {"state": SOLD},
    "match_simulations": {c: 0 for c in HALF_GOALS},
}
CREATION_COLUMN = {"tickets": "purchased_at"}
DATE_TEXT_COLUMNS = {"matches": ("match_date",)}

_SIMULATION_FIELDS = (
    "id_matches",
    "local_goals",
    "visitor_goals",
    "local_possession",
    "visitor_possession",
    *COUNT_STATISTICS,
)
_PERSONAL_FIELDS = (
    "name",
    "last_name",
    "birthday",
    "address",
    "password",
    "email",
    "identification",
    "identification_type",
)
PATCHABLE = {
    "users": _PERSONAL_FIELDS,
    "teams": ("name", "city", "stadium", "image_url"),
    "soccer_stands": ("name", "total_capacity", "description"),
    "matches": (
        "id_team_local",
        "id_team_visitor",
        "match_date",
        "match_hour",
        "state",
        "stadium",
    ),
    "tickets": (
        "id_users",
        "id_matches",
        "id_match_stand_price",
        "ticket_code",
        "price",
        "state",
    ),
    "transactions": (
        "id_users",
        "id_matches",
        "total_amount",
        "number_tickets",
        "payment_method",
        "reference",
        "currency",
    ),
    "match_simulations": _SIMULATION_FIELDS,
    "simulations_events": ("id_teams", "id_match_simulations", "minute", "type_event", "player"),
}
ADMIN_PATCHABLE = {"users": (*_PERSONAL_FIELDS, "rol")}
# the administrator's forms of these tables take any column
ADMIN_FREE_TABLES = ("match_simulations", "simulations_events")
# ----------------------------------------------------------------------------------------


def _falsy(column: Column, dtype: T.DataType, is_key: bool) -> Column:
    if isinstance(dtype, T.StringType):
        return falsy_text(column)
    if isinstance(dtype, T.NumericType) and not is_key:
        return falsy_number(column)
    return column.isNull()


def apply_defaults(table: str, rows: DataFrame, now: dt.datetime) -> DataFrame:
    """New rows of a table with its defaults filled in.

    A falsy value is a missing one, '' in text and 0 in a number that is not a key. Dates
    may come as day/month/year text. ``now`` is the creation moment of rows without one.
    """
    dated = [c for c in DATE_TEXT_COLUMNS.get(table, ()) if c in rows.columns]
    rows = rows.withColumns({c: day_month_year(F.col(c)) for c in dated})
    filled = {}
    for field in rows.schema.fields:
        name, dtype, column = field.name, field.dataType, F.col(field.name)
        if name in FALSY_DEFAULTS[table]:
            default = F.lit(FALSY_DEFAULTS[table][name]).cast(dtype)
            is_key = name.startswith("id_")
            filled[name] = F.when(_falsy(column, dtype, is_key), default).otherwise(column)
        elif name in NULL_DEFAULTS.get(table, {}):
            filled[name] = F.coalesce(column, F.lit(NULL_DEFAULTS[table][name]).cast(dtype))
    created = CREATION_COLUMN.get(table, "created_at")
    if created in rows.columns:
        moment = F.lit(now).cast(rows.schema[created].dataType)
        filled[created] = F.coalesce(F.col(created), moment)
    return rows.withColumns(filled) if filled else rows


def patchable_fields(table: str, columns: list[str], is_admin: bool) -> list[str]:
    if is_admin and table in ADMIN_FREE_TABLES:
        return [c for c in columns if c != "id"]
    allowed = ADMIN_PATCHABLE.get(table) if is_admin else None
    return [c for c in (allowed or PATCHABLE[table]) if c in columns]


def patch_rows(
    table: str, rows: DataFrame, patches: DataFrame, is_admin: bool = False
) -> DataFrame:
    """A table after patches (id, seq, set_fields, and the values).

    Only fields named in ``set_fields`` and allowed for the table change; a named field
    without a value becomes NULL. Of several patches to one field the one of highest
    ``seq`` wins. Patches of one row are folded before the join.
    """
    fields = [f for f in patchable_fields(table, rows.columns, is_admin) if f in patches.columns]

    # of each field its order, NULL in a patch without it, and its value only where it has an order
    set_ = {"patch_id": F.col("id")}
    for i, field in enumerate(fields):
        order = F.when(F.array_contains("set_fields", field), F.col("seq"))
        set_ |= {f"order_{i}": order, f"value_{i}": F.when(order.isNotNull(), F.col(field))}

    def fold(some: DataFrame) -> DataFrame:
        # a row without the field has no order value and is passed over
        last = [
            F.max_by(F.struct(F.col(f"value_{i}").alias("value")), f"order_{i}").alias(f"new_{f}")
            for i, f in enumerate(fields)
        ]
        return some.groupBy("patch_id").agg(*last)

    folded = folded_side(patches.select(*[c.alias(n) for n, c in set_.items()]), "patch_id", fold)
    patched = rows.join(folded, F.col("id") == F.col("patch_id"), "left")

    def after(name: str) -> Column:
        if name not in fields:
            return F.col(name)
        given = F.col(f"new_{name}.value").cast(rows.schema[name].dataType)
        return F.when(F.col(f"new_{name}").isNotNull(), given).otherwise(F.col(name)).alias(name)

    return patched.select(*[after(name) for name in rows.columns])


def patches_without_row(rows: DataFrame, patches: DataFrame) -> DataFrame:
    wanted = measured_side(patches.select("id").distinct())
    found = rows.select("id").join(wanted, "id", "left_semi")
    return patches.join(found, "id", "left_anti")


def delete_cascade(t: Tables, table: str, ids: DataFrame) -> Tables:
    """The tables without the rows of ``ids`` (column id) and all that depends on them.

    Follows the foreign keys from parents to children. Only keys of rows that go are carried
    on. Of a table that others refer to, the ids that go are found in one narrow pass over all
    its key columns, and the rows are reduced by them; a table nothing refers to is reduced by
    its keys.
    """
    gone: dict[str, DataFrame] = {table: measured_side(ids.select("id").distinct())}
    kept = {}
    for name in TABLE_ORDER:
        rows = t[name]
        hits = {
            column: gone[parent]
            for child, column, parent in FOREIGN_KEYS
            if child == name and parent in gone
        }
        is_parent = any(parent == name for _, _, parent in FOREIGN_KEYS)
        if hits and is_parent and name != table:
            keys = [
                ids_.select(F.lit(column).alias("field"), F.col("id").alias("key"))
                for column, ids_ in hits.items()
            ]
            found = stacked_keys(rows, hits).join(
                measured_side(reduce(DataFrame.unionByName, keys)), ["field", "key"], "left_semi"
            )
            gone[name] = measured_side(found.select("id").distinct())
        if name in gone:
            kept[name] = rows.join(gone[name], "id", "left_anti").select(*rows.columns)
        elif hits:
            kept[name] = reduce(
                lambda left, hit: _without(left, *hit), hits.items(), rows
            )
    return t.with_tables(**kept)


def _without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among ``gone``. All NULL keys stay, spread over buckets."""
    bucket = F.when(
        F.col(column).isNull(), F.pmod(F.xxhash64("id"), F.lit(NULL_BUCKETS))
    ).otherwise(0)
    keys = gone.select(
        F.col("id").alias("gone_id"), F.pmod(F.xxhash64("id"), F.lit(1)).alias("gone_bucket")
    )
    is_gone = (F.col(column) == F.col("gone_id")) & (F.col("own_bucket") == F.col("gone_bucket"))
    return rows.withColumn("own_bucket", bucket).join(keys, is_gone, "left_anti").drop("own_bucket")


def settle_matches(t: Tables, match_ids: DataFrame) -> tuple[Tables, DataFrame]:
    """Finish the matches of ``match_ids`` (column id): their sold tickets become used.

    Gives the new tables and (match_id, tickets_updated). Matches already finished are
    passed over, as are ids of no match.
    """
    open_ids = lookup_side(
        t.matches.filter(~F.col("state").eqNullSafe(FINISHED))
        .join(match_ids.select("id").distinct(), "id", "left_semi")
        .select(F.col("id").alias("settled"))
    )
    is_settled = F.col("settled").isNotNull()
    matches = t.matches.join(open_ids, F.col("id") == F.col("settled"), "left").withColumn(
        "state", F.when(is_settled, FINISHED).otherwise(F.col("state"))
    )
    tickets = t.tickets.join(open_ids, F.col("id_matches") == F.col("settled"), "left").withColumn(
        "state", F.when(is_settled & (F.col("state") == SOLD), USED).otherwise(F.col("state"))
    )
    changed = (
        t.tickets.filter(F.col("state") == SOLD)
        .groupBy(F.col("id_matches").alias("settled"))
        .agg(F.count("*").alias("n"))
    )
    summary = open_ids.join(changed, "settled", "left").select(
        F.col("settled").alias("match_id"), F.coalesce("n", F.lit(0)).alias("tickets_updated")
    )
    settled = t.with_tables(matches=matches.drop("settled"), tickets=tickets.drop("settled"))
    return settled, summary


def stand_price(name: Column) -> Column:
    """The list price a stand starts with, by its name."""
    known = F.create_map(
        *[F.lit(v) for pair in PRICE_BY_STAND_NAME.items() for v in pair]
    )
    return F.coalesce(F.try_element_at(known, name), F.lit(OTHER_STAND_PRICE)).cast("decimal(10,2)")


def provision_prices(
    new_matches: DataFrame, stands: DataFrame, now: dt.datetime, block_bytes: int | None = None
) -> DataFrame:
    """One price row for every stand of every new match.

    The result is by definition matches times stands. The matches stay where they lie, so the
    tasks follow them; the stands come in blocks of about ``block_bytes``, each sent to all of
    them. The bound is that of any broadcast if none is given.
    """
    priced, n, size = written_and_measured(
        stands.select(F.col("id").alias("id_stand"), stand_price(F.col("name")).alias("price"))
    )
    if not n:
        raise ValueError("there are no stands to price")
    # half of the bound on average, as a hash deals them
    most = block_bytes or most_broadcast_bytes(stands.sparkSession)
    blocks = -(-2 * size // most) if size > most else 1

    def zero(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1))

    matches = new_matches.select(F.col("id").alias("id_match"), zero("id").alias("zero"))
    number = F.pmod(F.xxhash64("id_stand"), F.lit(blocks))
    parts = [
        matches.join(
            F.broadcast(priced.filter(number == block).withColumn("zero", zero("id_stand"))), "zero"
        )
        for block in range(blocks)
    ]
    key = F.concat_ws(":", F.col("id_match").cast("string"), F.col("id_stand").cast("string"))
    return reduce(DataFrame.unionByName, parts).select(
        F.md5(key).alias("id"),
        "id_match",
        "id_stand",
        "price",
        F.lit(now).cast("timestamp_ntz").alias("created_at"),
    )
