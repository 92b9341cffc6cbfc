"""Appends, patches, deletes and settlements of tables kept in versions.

The rows come out of the same transforms as in ``writes`` and ``admission``; here they change only the
files that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.operators.writes import patch_rows
from taquilla.plans.sizing import marked, most_broadcast_bytes, written_and_measured
from taquilla.session import cut_lineage
from taquilla.sources.schemas import FINISHED, FOREIGN_KEYS, SOLD, USED
from taquilla.sources.versions import StoredTable

PURCHASE_MONTH = "purchase_month"
# Bits per key in the marks of keys too many to be sent, and in one of Spark's bitmaps: about one key
# of so many that stays is marked all the same.
BITS_PER_KEY = 16
BLOCK_BITS = 32_768
HASHED_TYPES = (T.LongType(), T.IntegerType(), T.StringType())


def stored_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> StoredTable:
    """A table in versions, looked up by its id and its foreign keys; tickets lie in months."""
    keys = ("id", *[column for child, column, _ in FOREIGN_KEYS if child == name])
    if name == "tickets":
        return StoredTable(spark, f"{folder}/{name}", schema, keys, PURCHASE_MONTH, "purchased_at")
    return StoredTable(spark, f"{folder}/{name}", schema, keys)


def patch_stored(
    table: StoredTable, name: str, patches: DataFrame, is_admin: bool = False
) -> tuple[int, list[str]]:
    """Patches (id, seq, set_fields, values), applied to the files that hold the patched rows."""
    return table.rewrite(patches, "id", lambda rows: patch_rows(name, rows, patches, is_admin))


def delete_stored(table: StoredTable, keys: DataFrame, key: str = "id") -> tuple[int, list[str]]:
    """Rows whose ``key`` is among ``keys`` go. Rows with a NULL key stay and meet no join.

    Keys too many to be sent are sent as bits of their hashes. A row whose bit is not set stays; of the keys
    whose bit is set, those that are not gone are few and sent too. So no row moves between tasks.
    """
    given = keys.select(F.col(key).alias("gone")).where("gone IS NOT NULL").distinct()
    kept, n_keys, size = written_and_measured(given)
    gone, most = marked(kept, size), most_broadcast_bytes(table.spark)
    if size <= most:
        return table.rewrite(keys, key, lambda rows: rows.join(gone, F.col(key) == F.col("gone"), "left_anti"), True)

    def rest(rows: DataFrame) -> DataFrame:
        keyed = rows.where(F.col(key).isNotNull()).join(gone, F.col(key) == F.col("gone"), "left_anti")
        return keyed.unionByName(rows.where(F.col(key).isNull()))

    blocks = max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))
    kind = kept.schema["gone"].dataType
    # equal keys have equal hashes if they are of one type
    if kind not in HASHED_TYPES or kind != table.schema[key].dataType or blocks * BLOCK_BITS > 8 * most:
        return table.rewrite(keys, key, rest)
    marks = cut_lineage(_marks(kept, blocks))

    def rest_in_place(rows: DataFrame) -> DataFrame:
        """Rows whose key has no mark, and those whose key has one and is not gone all the same."""
        alike = _with_mark(rows.select(F.col(key).alias("stays")), "stays", marks, blocks).where("is_marked")
        stays = alike.select("stays").distinct().join(gone, F.col("stays") == F.col("gone"), "left_anti")
        few, _, bytes_ = written_and_measured(stays)
        if bytes_ > most:
            return rest(rows)
        met = _with_mark(rows, key, marks, blocks).join(F.broadcast(few), F.col(key) == F.col("stays"), "left")
        return met.where(~F.col("is_marked") | F.col("stays").isNotNull()).drop("is_marked", "stays")

    return table.rewrite(keys, key, rest_in_place, in_place=True)


def _place(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks * BLOCK_BITS).cast("long"))


def _marks(keys: DataFrame, blocks: int) -> DataFrame:
    """A bit per hash of the keys ``gone``: a bitmap for each of ``blocks``, for a broadcast."""
    place = _place("gone", blocks)
    return keys.groupBy(F.floor(place / BLOCK_BITS).alias("mark_block")).agg(
        F.bitmap_construct_agg(F.pmod(place, F.lit(BLOCK_BITS))).alias("mark_bits")
    )


def _with_mark(rows: DataFrame, key: str, marks: DataFrame, blocks: int) -> DataFrame:
    """The rows with ``is_marked``: whether the bit of their key is set; never for NULL."""
    place = _place(key, blocks)
    at = F.pmod(place, F.lit(BLOCK_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("mark_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(at, F.lit(8)))
    is_set = F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    met = rows.join(F.broadcast(marks), F.floor(place / BLOCK_BITS) == F.col("mark_block"), "left")
    return met.withColumn("is_marked", F.col(key).isNotNull() & is_set).drop("mark_block", "mark_bits")


def settle_stored(
    matches: StoredTable, tickets: StoredTable, match_ids: DataFrame
) -> tuple[int, int]:
    """Finish matches that are not finished yet; their sold tickets become used."""
    not_yet = matches.read().where(~F.col("state").eqNullSafe(FINISHED))
    found = not_yet.join(match_ids.select("id").distinct(), "id", "left_semi").select("id")
    kept, _, size = written_and_measured(found)
    opened, is_sent = marked(kept, size), size <= most_broadcast_bytes(tickets.spark)
    settled = opened.select(F.col("id").alias("settled"))

    def finished(rows: DataFrame) -> DataFrame:
        met = rows.join(settled, F.col("id") == F.col("settled"), "left")
        state = F.when(F.col("settled").isNotNull(), FINISHED).otherwise(F.col("state"))
        return met.withColumn("state", state).drop("settled")

    def used(rows: DataFrame) -> DataFrame:
        met = rows.join(settled, F.col("id_matches") == F.col("settled"), "left")
        sold = F.col("settled").isNotNull() & (F.col("state") == SOLD)
        return met.withColumn("state", F.when(sold, USED).otherwise(F.col("state"))).drop("settled")

    # tickets first: if the second rewrite is never made, settling again finds the match open
    of_matches = opened.select(F.col("id").alias("id_matches"))
    last_tickets, _ = tickets.rewrite(of_matches, "id_matches", used, is_sent)
    last_matches, _ = matches.rewrite(opened, "id", finished, is_sent)
    return last_matches, last_tickets
