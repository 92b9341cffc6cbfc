"""The nine tables as DataFrames: scans, sinks and the key lookup."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.sources.schemas import TABLE_ORDER, schemas

# Stored tickets are laid out by this column, derived from purchased_at, so that a query
# over the last days opens only the folders of those days.
PURCHASE_DAY = "purchase_day"


class Tables:
    """The nine tables as attributes. Each is opened when first used, and only then."""

    def __init__(self, spark: SparkSession, **openers: Callable[[], DataFrame]):
        self.spark = spark
        self._openers = openers
        self._opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._openers:
            raise AttributeError(name)
        if name not in self._opened:
            self._opened[name] = self._openers[name]()
        return self._opened[name]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_tables(self, **changed: DataFrame) -> Tables:
        """The same tables with some replaced by the given frames."""
        kept = {name: partial(getattr, self, name) for name in self._openers}
        kept.update({name: partial(_same, df) for name, df in changed.items()})
        return Tables(self.spark, **kept)


def _same(df: DataFrame) -> DataFrame:
    return df


def read_tables(spark: SparkSession, path: str, key: T.DataType | None = None) -> Tables:
    """The nine tables stored under ``path``, with their declared schemas."""
    declared = schemas(key)

    def opener(name: str) -> DataFrame:
        schema = declared[name]
        if name == "tickets":
            schema = T.StructType([*schema.fields, T.StructField(PURCHASE_DAY, T.DateType())])
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    return Tables(spark, **{name: partial(opener, name) for name in TABLE_ORDER})


def write_table(name: str, rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows to a plain stored table, or write it to an empty ``path``.

    It must not be written over the folder it is computed from. ``sources.versions`` keeps tables
    whose readers see a change whole and whose rewrites touch only the files concerned.
    """
    if name == "tickets":
        laid_out = rows.withColumn(PURCHASE_DAY, F.to_date("purchased_at"))
        # Spark splits a day that holds a large share of all sales by its measured bytes, and
        # lets small days share a task.
        writer = laid_out.hint("rebalance", F.col(PURCHASE_DAY)).write.partitionBy(PURCHASE_DAY)
    else:
        writer = rows.write
    writer.mode(mode).parquet(f"{path}/{name}")


def write_tables(tables: Tables, path: str, mode: str = "errorifexists") -> None:
    for name in TABLE_ORDER:
        write_table(name, tables[name], path, mode)


def only(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one key; all rows where no key is asked for."""
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def owner_scope(df: DataFrame, caller, is_admin: bool, column: str = "id_users") -> DataFrame:
    """What a caller may see: everything for an administrator, else their own rows."""
    return df if is_admin else df.filter(F.col(column) == F.lit(caller))


def bought_since(tickets: DataFrame, day: dt.date) -> DataFrame:
    """Tickets bought on ``day`` or later, as plain literals that reach the scan."""
    condition: Column = F.col("purchased_at") >= F.lit(day)
    if PURCHASE_DAY in tickets.columns:
        condition = condition & (F.col(PURCHASE_DAY) >= F.lit(day))
    return tickets.filter(condition)
