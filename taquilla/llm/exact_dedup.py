"""Exact dedup on a persistent index of digests, bucketed and sorted by digest.

Texts are equal if they are identical once every run of the six ASCII white-space characters is
one space; NULL counts as empty. The index is a bucketed table in the shared folder with one row
per distinct text ever added: its SHA-256, and the row that stays for it. ``DigestIndex.add``
folds new rows to one per digest, map-side first, deals them like the buckets, and meets the
index in a sort-merge anti join, for which the index is neither shuffled nor rewritten; what has
no match is appended. A later session finds the index again with ``DigestIndex.open``.

``exact_duplicates`` adds a table in loads of ascending ids, so that the smallest id of equal texts
enters first, and looks every row up. A text that a third of all rows share is one row per task in
the fold; the rows themselves meet their group in a join of two written tables, whose hot
partitions Spark splits.

Columns and SQL only, no Python on the executors.

Defined results. NULL or empty text: equal to each other. NULL id: larger than any id, so it stays
only if no equal text has an id. Rows of one id and equal texts: members like any others, of
which exactly one stays. Empty table: no rows. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taquilla.llm.common import shared_folder, unused, written

# Loads in which ``exact_duplicates`` adds a table.
LOADS = 3
# A bucket holds about 200 MB of digests and ids when this many distinct texts fall into it.
TEXTS_PER_BUCKET = 4_000_000
LEAST_BUCKETS = 12


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def buckets_for(texts: int) -> int:
    return max(LEAST_BUCKETS, math.ceil(texts / TEXTS_PER_BUCKET))


class DigestIndex:
    """One row per distinct text: (digest, keep_id, load, place).

    ``load`` and ``place`` name the row that stays: the call of ``add`` it came with, and its
    place among the rows of that call.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.name = "digest_index_" + hashlib.md5(folder.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} "
            "(digest BINARY, keep_id BIGINT, load STRING, place BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{folder}/rows'"
        )

    @classmethod
    def create(cls, spark: SparkSession, folder: str, buckets: int) -> DigestIndex:
        """A new index; its number of buckets is kept beside its rows."""
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/spec")
        return cls(spark, folder, buckets)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> DigestIndex:
        """The index that another session has left in ``folder``."""
        return cls(spark, folder, spark.read.parquet(f"{folder}/spec").first()["buckets"])

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt like the buckets, so that a join leaves the index where it is."""
        return rows.repartition(self.buckets, "digest")

    def fresh(self, rows: DataFrame) -> DataFrame:
        """Of rows (digest, doc_id, place), the first per digest that the index does not hold."""
        order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "place")
        firsts = rows.groupBy("digest").agg(F.min(order).alias("first"))
        return (
            self._dealt(firsts)
            .join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
            .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.place").alias("place"))
        )

    def add(self, rows: DataFrame) -> str:
        """Append the new texts of rows (digest, doc_id, place); gives the name of the load."""
        load = uuid.uuid4().hex
        appended = self.fresh(rows).select("digest", "keep_id", F.lit(load).alias("load"), "place")
        appended.write.insertInto(self.name)
        return load

    def owners(self, digests: DataFrame) -> DataFrame:
        """Rows with distinct ``digest``, with the columns of the index beside them."""
        return self._dealt(digests).join(self.rows().hint("merge"), "digest")


def digests(docs: DataFrame, place: Column | None = None) -> DataFrame:
    """(doc_id, place, digest), written: a row's place must not change afterwards."""
    return written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.monotonically_increasing_id() if place is None else place).alias("place"),
            digest(F.col("text")).alias("digest"),
        )
    )


def _loads(rows: DataFrame, loads: int) -> list[Column]:
    """Conditions that split the rows by ascending id; rows without an id come last."""
    shares = [i / loads for i in range(1, loads)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 1000).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    bounds = [None, *cuts, None]
    found = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        condition = F.lit(True)
        if low is not None:
            condition = condition & (F.col("doc_id") >= low)
        if high is not None:
            condition = condition & (F.col("doc_id") < high)
        found.append(condition if high is not None else condition | F.col("doc_id").isNull())
    return found


def _verdicts(rows: DataFrame, loads: int) -> DataFrame:
    spark = rows.sparkSession
    index = DigestIndex.create(spark, shared_folder(spark), buckets_for(rows.count()))
    for condition in _loads(rows, loads):
        index.add(rows.where(condition))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = written(
        index.owners(sizes.where("group_size > 1")).select(
            "digest", "keep_id", F.col("place").alias("keep_place"), "group_size"
        )
    )
    alone = F.col("group_size").isNull()
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        "place",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("place") == F.col("keep_place"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, loads: int = LOADS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _verdicts(digests(docs), loads).drop("place")


def without_copies(docs: DataFrame, loads: int = LOADS) -> DataFrame:
    """The rows that stay, with all their columns."""
    place = unused("place", docs.columns)
    placed = written(docs.withColumn(place, F.monotonically_increasing_id()))
    verdicts = _verdicts(digests(placed, F.col(place)), loads)
    kept = verdicts.where("kept").select(F.col("place").alias(place))
    return placed.join(kept, place, "left_semi").drop(place)
