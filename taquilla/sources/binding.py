"""The nine tables derived from the star-schema Parquet files of a test folder.

The same derivations, as SQL, stand in ``verification/oracle_sql.py``.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taquilla.sources.schemas import MATCH_STATES
from taquilla.sources.tables import Tables

# --- fixed values -----------------------------------------------------------------------
AS_OF = dt.date(2001, 7, 15)
SEASON_START = dt.date(2001, 6, 1)
FILLER_MOMENT = dt.datetime(2001, 1, 1)
STAND_NAMES = ("Occidental", "Oriental", "Norte", "Sur", "Palco")
STAND_CAPACITIES = (80, 90, 55, 55, 300)
STAND_PRICES = (80000, 70000, 40000, 45000, 50000)
# ----------------------------------------------------------------------------------------


def _by_position(values: tuple, position: Column) -> Column:
    """The value at a 0-based position; NULL past the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def has_price(match: Column, stand: Column) -> Column:
    """Which (match, stand) pairs are on sale."""
    open_stand = (
        F.when(match % 3 == 0, stand < 4).when(match % 3 == 1, F.lit(True)).otherwise(stand.isin(1, 4))
    )
    return (match % 10 != 9) & open_stand


def _filler() -> Column:
    return F.lit(FILLER_MOMENT).cast("timestamp_ntz")


def _no_text() -> Column:
    return F.lit(None).cast("string")


STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
}


class StarFolder:
    """Opens single Parquet files of the folder, each once and without a schema scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._opened: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._opened:
            reader = self.spark.read.schema(STAR_SCHEMAS[name])
            self._opened[name] = reader.parquet(f"{self.path}/{name}.parquet")
        return self._opened[name]


def teams(star: StarFolder) -> DataFrame:
    nation, region = star("nation"), star("region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "inner").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_nationkey").cast("string").alias("id_team_api"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("city"),
        F.concat(F.lit("Estadio "), "n_name").alias("stadium"),
        _no_text().alias("image_url"),
        (F.lit(1900) + F.col("n_nationkey")).cast("string").alias("foundation"),
        _filler().alias("created_at"),
    )


def soccer_stands(star: StarFolder) -> DataFrame:
    key = F.col("r_regionkey")
    return star("region").select(
        key.cast("bigint").alias("id"),
        _by_position(STAND_NAMES, key).alias("name"),
        _by_position(STAND_CAPACITIES, key).alias("total_capacity"),
        F.concat(F.lit("Tribuna "), "r_name").alias("description"),
        _filler().alias("created_at"),
    )


def _fixtures(star: StarFolder) -> DataFrame:
    """Matches without the columns that come from the local team."""
    key, local = F.col("s_suppkey"), F.col("s_nationkey").cast("bigint")
    offset = ((key * 37) % 120).cast("int")
    return star("supplier").select(
        key.alias("id"),
        local.alias("id_team_local"),
        ((local + 1 + key % 24) % 25).alias("id_team_visitor"),
        F.date_add(F.lit(SEASON_START), offset).alias("match_date"),
        F.concat((12 + key % 10).cast("string"), F.lit(":30:00")).alias("match_hour"),
        _by_position(MATCH_STATES, key % 7).alias("state"),
    )


def matches(star: StarFolder) -> DataFrame:
    nation = star("nation").select(F.col("n_nationkey").cast("bigint").alias("home"), "n_name")
    fixtures = _fixtures(star)
    return fixtures.join(nation, fixtures.id_team_local == nation.home, "left").select(
        *fixtures.columns,
        F.concat(F.lit("Estadio "), "n_name").alias("stadium"),
        _filler().alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def match_stand_prices(star: StarFolder) -> DataFrame:
    match, stand = F.col("s_suppkey"), F.col("stand")
    return (
        star("supplier")
        .select("s_suppkey", F.explode(F.array(*[F.lit(s) for s in range(5)])).alias("stand"))
        .filter(has_price(match, stand))
        .select(
            (match * 10 + stand).alias("id"),
            match.alias("id_match"),
            stand.cast("bigint").alias("id_stand"),
            _by_position(STAND_PRICES, stand).cast("decimal(10,2)").alias("price"),
            _filler().alias("created_at"),
        )
    )


def users(star: StarFolder) -> DataFrame:
    key = F.col("c_custkey")
    return star("customer").select(
        key.alias("id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.lit("x").alias("password"),
        F.col("c_name").alias("name"),
        _no_text().alias("last_name"),
        key.cast("string").alias("identification"),
        F.when(key % 2 == 0, "CC").otherwise("TI").alias("identification_type"),
        F.when(key == 0, "administrador").otherwise("usuario").alias("rol"),
        F.lit(None).cast("date").alias("birthday"),
        _no_text().alias("address"),
        _filler().alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def transactions(star: StarFolder) -> DataFrame:
    return star("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("id_users"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 10).alias("id_matches"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
        (1 + F.col("o_orderkey") % 4).cast("int").alias("number_tickets"),
        F.col("o_orderpriority").alias("payment_method"),
        _no_text().alias("reference"),
        F.lit("COP").alias("currency"),
        F.col("o_orderdate").alias("created_at"),
    )


def tickets(star: StarFolder) -> DataFrame:
    # One row per order by construction, so Catalyst drops the join from every query that
    # does not ask for the buyer.
    buyers = (
        star("orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("id_users"))
    )
    line = star("lineitem")
    supplier, number = F.col("l_suppkey"), F.col("l_linenumber")
    match = F.when(number > 7 - 2 * (supplier % 4), supplier - supplier % 4).otherwise(supplier)
    stand = F.col("l_partkey") % 5
    returned, status = F.col("l_returnflag"), F.col("l_linestatus")
    # nested rather than flat, so that a test for one state folds down to the source column
    voided = F.when((returned == "A") & (status == "F"), "anulado").otherwise(
        F.when((returned == "A") & (status == "O"), "pendiente")
    )
    state = F.when(returned == "N", "vendido").otherwise(
        F.when(returned == "R", "usado").otherwise(voided)
    )
    ticket_id = F.concat_ws(
        "-",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").cast("string"),
    )
    # Joined as the source has them: ids and the like are made after the rows have moved. There is a
    # buyer row per sale, so the join is a merge at every size and the work grows with the sales.
    bought = line.join(buyers.hint("merge"), line.l_orderkey == buyers.o_orderkey, "left")
    return bought.select(
        ticket_id.alias("id"),
        "id_users",
        match.alias("id_matches"),
        F.when(has_price(match, stand), match * 10 + stand).alias("id_match_stand_price"),
        ticket_id.alias("ticket_code"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
        (F.col("l_quantity").cast("int") % 31).alias("row"),
        (1 + F.col("l_partkey") % 50).cast("int").alias("seat"),
        F.col("l_orderkey").alias("id_transaction"),
        state.alias("state"),
        F.col("l_shipdate").alias("purchased_at"),
    )


def match_simulations(star: StarFolder) -> DataFrame:
    key = F.col("s_suppkey")
    local, visitor = key % 5, F.floor(key / 2) % 4

    def whole(value: Column, name: str) -> Column:
        return value.cast("int").alias(name)

    possession = 35 + key % 31
    return (
        star("supplier")
        .filter(key % 2 == 0)
        .select(
            (key * 100).alias("id"),
            key.alias("id_matches"),
            whole(local, "local_goals"),
            whole(visitor, "visitor_goals"),
            whole(F.floor(local / 2), "local_goals_first_half"),
            whole(local - F.floor(local / 2), "local_goals_second_half"),
            whole(F.floor(visitor / 2), "visitor_goals_first_half"),
            whole(visitor - F.floor(visitor / 2), "visitor_goals_second_half"),
            possession.cast("decimal(5,2)").alias("local_possession"),
            (100 - possession).cast("decimal(5,2)").alias("visitor_possession"),
            whole(key % 6, "local_yellow_cards"),
            whole((key + 1) % 6, "visitor_yellow_cards"),
            whole(key % 3, "local_red_cards"),
            whole((key + 1) % 3, "visitor_red_cards"),
            whole(3 + key % 13, "local_shots_on_goal"),
            whole(3 + (key + 1) % 13, "visitor_shots_on_goal"),
            _filler().alias("created_at"),
        )
    )


def simulations_events(star: StarFolder) -> DataFrame:
    event = star("events").withColumn("match", 2 * (F.col("user_id") % 5))
    # at most the five matches 0, 2, 4, 6, 8
    sides = (
        _fixtures(star)
        .filter(F.col("id").isin(0, 2, 4, 6, 8))
        .select(F.col("id").alias("match"), "id_team_local", "id_team_visitor")
    )
    kind = F.col("event_type")
    return event.join(sides, "match", "left").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, F.col("id_team_local"))
        .otherwise(F.col("id_team_visitor"))
        .alias("id_teams"),
        (F.col("match") * 100).alias("id_match_simulations"),
        (1 + F.floor("value") % 90).cast("int").alias("minute"),
        F.when(kind == "purchase", "Gol")
        .when(kind == "click", "Tarjeta amarilla")
        .when(kind == "error", "Tarjeta roja")
        .otherwise(kind)
        .alias("type_event"),
        F.concat(F.lit("Jugador "), F.col("user_id").cast("string")).alias("player"),
        F.col("ts").alias("created_at"),
    )


BOUND = (
    users,
    teams,
    soccer_stands,
    matches,
    match_stand_prices,
    transactions,
    tickets,
    match_simulations,
    simulations_events,
)


def bind(star: StarFolder) -> Tables:
    return Tables(star.spark, **{table.__name__: partial(table, star) for table in BOUND})
