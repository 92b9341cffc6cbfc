"""Broadcast of the small side of a join, behind a check of its size.

Catalyst multiplies the sizes of joined inputs and cannot foresee how few keys a check or a
request batch comes down to. Left alone it would shuffle all tickets to look up a few
matches. The helpers mark a side only where its bytes are known; beyond their bounds the join
is left to sort-merge, whose skewed partitions are split at run time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.session import cut_lineage

# A hash table takes two to three times the bytes of its rows, and a task may hold several.
PART_OF_HEAP = 16
# As a hash table of keys, rows take five to six times their bytes, which the driver holds twice while
# it builds and cuts up the table, however large the executors are.
MOST_SENT = 32 << 20
# Parts of the keys whose rows are counted to see whether one may have many.
KEY_BUCKETS = 1024
_UNITS = {"b": 0, "k": 10, "": 20, "m": 20, "g": 30, "t": 40}


def most_broadcast_bytes(spark: SparkSession) -> int:
    """The bytes of rows that may be sent to every executor, by the lesser heap of driver and executors."""

    def heap(name: str) -> int:
        given = spark.conf.get(f"spark.{name}.memory", "1g").strip().lower()
        number, unit = re.fullmatch(r"(\d+)\s*([bkmgt]?)b?", given).groups()
        return int(number) << _UNITS[unit]

    return min(min(heap("driver"), heap("executor")) // PART_OF_HEAP, MOST_SENT)


def _value_bytes(column: Column, dtype: T.DataType) -> Column:
    """Bytes of a value in a row of Spark: eight, and what it has beside them."""
    if isinstance(dtype, T.StructType):
        parts = [_value_bytes(column[f.name], f.dataType) for f in dtype.fields]
        return sum(parts, F.lit(16))
    if isinstance(dtype, T.StringType):
        return 8 + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(dtype, T.BinaryType):
        return 8 + F.coalesce(F.length(column), F.lit(0))
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return 8 + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(8)


def input_bytes(df: DataFrame) -> int:
    """Size of the files and relations below ``df``, from plan statistics; runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def lookup_side(df: DataFrame) -> DataFrame:
    """A table with key lookups on it, marked if its inputs are below the broadcast threshold.

    Such a frame has no more rows than the table, so its inputs bound its size.
    """
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return F.broadcast(df) if input_bytes(df) <= most else df


def _all_bytes(df: DataFrame) -> Column:
    row = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("bytes")


def written_and_measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """A frame written to the checkpoint folder, its rows and their bytes, counted on the way."""
    seen = Observation()
    counted = F.count(F.lit(1)).alias("rows")
    kept = cut_lineage(df.observe(seen, counted, _all_bytes(df)))
    return kept, seen.get["rows"], seen.get["bytes"]


def marked(df: DataFrame, size: int) -> DataFrame:
    """A written frame of ``size`` bytes, marked for broadcast if they are few, else for a merge.

    Without the second mark Catalyst would go by the files the frame came from, whose bytes are
    compressed, and might send it all the same.
    """
    few = size <= most_broadcast_bytes(df.sparkSession)
    return F.broadcast(df) if few else df.hint("merge")


def measured_side(rows: DataFrame) -> DataFrame:
    """A frame written out, measured, and marked if it has few bytes.

    For frames that come out of a reduction of large tables and meet a large table again, such
    as the keys to delete, the values that break a rule, or the patches of a batch.
    """
    kept, _, size = written_and_measured(rows)
    return marked(kept, size)


def folded_side(
    rows: DataFrame, key: str, fold: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``rows`` folded to one row per ``key``, measured only if the fold may be few bytes.

    One pass counts rows and, approximately, keys in buckets of keys. A fold that is surely large is
    not written: the join then takes it as the fold has dealt it. A fold of values of any length sorts
    the rows of a task, which spills where a task reads many. So, where that would hardly make
    them fewer, the rows are dealt by key first and sorted once, in the parts the join has; if a bucket
    stands out, a key may have many rows, and tasks fold them before they are dealt.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).alias("bucket")
    counts = F.count(F.lit(1)).alias("n"), F.approx_count_distinct(key).alias("keys")
    seen = (
        rows.groupBy(bucket).agg(*counts, _all_bytes(rows))
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "keys", "bytes")],
             F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        .first()
    )
    likely = seen["bytes"] * min(seen["keys"], seen["n"]) // max(seen["n"], 1)
    if likely <= 2 * most_broadcast_bytes(rows.sparkSession):
        return measured_side(fold(rows))
    is_even = seen["most"] * KEY_BUCKETS < 2 * seen["n"]
    folds_little = seen["n"] < 3 * seen["keys"]
    return fold(rows.repartition(key) if is_even and folds_little else rows).hint("merge")
