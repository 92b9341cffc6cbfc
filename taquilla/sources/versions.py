"""Versions of a stored table: appends and partial rewrites that a reader sees whole or not at all.

Below the folder of a table::

    data/load=<id>/[purchase_month=<day>/]*.parquet data files; once written they never change
    files/<id>/                                     the data files of one version, a row each
    versions/<n>                                    names the file list of version n

A version is there as soon as its last small file is, which the file system makes only if nobody
else has: of two writers who started from one version, the later gets ``VersionTaken`` and nothing of
its rows is ever read. A version is read by its file list, so neither half-written loads nor files
that a rewrite has replaced are seen; earlier versions stay readable.

The file list also tells what keys a file can hold: least and greatest value and a bitmap of their
hashes, for each key column. A rewrite passes over all files that cannot hold one of the keys asked for,
reads of the others the key column alone to learn which really do, and writes only those anew.

Spark sizes the files: rows are rebalanced by their folder, so a month that holds a large share of
all sales is split by its measured bytes, and small ones share a task. Files are sorted, so that a
condition on days passes over most of their row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.plans.sizing import input_bytes, measured_side

# bits of a file's bitmap: one block of Spark's bitmap functions
BITMAP_BITS = 32_768
# a set of keys that sets more bits than this is compared by its range alone
MOST_BITS_ASKED = 256
# rows are written where they lie if each core reads this many bytes, so that files stay as large
LEAST_READ = 32 << 20

LOAD = "load"


class VersionTaken(RuntimeError):
    """Another writer has made the next version first."""


def _place(key: Column) -> Column:
    """Where a key is in a bitmap, from 0."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(BITMAP_BITS))


class StoredTable:
    """A table in versions.

    ``keys`` are the columns by which rows are looked for in a rewrite. With ``month_column``, rows are
    laid out in folders by the month of the column ``moment``, and sorted by it.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: T.StructType,
        keys: tuple[str, ...] = ("id",),
        month_column: str | None = None,
        moment: str | None = None,
    ):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.columns, self.month_column, self.moment = schema, month_column, moment
        months = [T.StructField(month_column, T.DateType())] if month_column else []
        self.schema = T.StructType([*schema.fields, *months])

    # --- the log of versions ------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("versions").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def latest(self) -> int:
        """The number of the last version; 0 if there is none."""
        files, path = self._files(), self._path("versions")
        if not files.exists(path):
            return 0
        return max((int(f.getPath().getName()) for f in files.listStatus(path)), default=0)

    def _list_of(self, version: int) -> str:
        opened = self._files().open(self._path(f"versions/{version:012d}"))
        try:
            return bytes(opened.readAllBytes()).decode()
        finally:
            opened.close()

    def files(self, version: int | None = None) -> DataFrame | None:
        """The data files of a version: file, rows, and per key column low, high and bits."""
        version = self.latest() if version is None else version
        return self.spark.read.parquet(f"{self.folder}/files/{self._list_of(version)}") if version else None

    def _commit(self, files: DataFrame, after: int) -> int:
        name = uuid.uuid4().hex
        files.coalesce(1).write.parquet(f"{self.folder}/files/{name}")
        made, version = self._files(), self._path(f"versions/{after + 1:012d}")
        try:
            out = made.create(version, False)
        except Exception as failed:
            if made.exists(version):
                raise VersionTaken(f"{self.folder}: version {after + 1}") from failed
            raise
        out.write(bytearray(name.encode()))
        out.close()
        return after + 1

    # --- rows -------------------------------------------------------------------------------------

    def _read(self, files: list[str]) -> DataFrame:
        """Rows of data files; their load and month come from the names of their folders."""
        with_load = T.StructType([*self.schema.fields, T.StructField(LOAD, T.StringType())])
        if not files:
            return self.spark.createDataFrame([], with_load)
        return self.spark.read.schema(with_load).option("basePath", f"{self.folder}/data").parquet(*files)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        files = self.files(version)
        names = [r["file"] for r in files.select("file").collect()] if files is not None else []
        return self._read(names).select(*self.schema.names)

    def _write(self, rows: DataFrame, lie_well: bool = False) -> DataFrame:
        """Write rows as a load of their own; gives its part of a file list.

        Rows that ``lie_well``, in tasks of enough rows of few months, are not dealt anew.
        """
        load = f"{LOAD}={uuid.uuid4().hex}"
        given = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.columns.fields])
        if self.month_column:
            month = F.trunc(F.to_date(self.moment), "MM")
            dated = given.withColumn(self.month_column, month)
            dealt = dated if lie_well else dated.hint("rebalance", F.col(self.month_column))
            ordered = dealt.sortWithinPartitions(self.month_column, self.moment)
            writer = ordered.write.partitionBy(self.month_column)
        else:
            writer = (given if lie_well else given.hint("rebalance")).write
        writer.option("compression", "zstd").parquet(f"{self.folder}/data/{load}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{load}")
        summaries = []
        for key in self.keys:
            text = F.col(key).cast("string")
            summaries += [
                F.min(text).alias(f"low_{key}"),
                F.max(text).alias(f"high_{key}"),
                F.bitmap_construct_agg(_place(F.col(key))).alias(f"bits_{key}"),
            ]
        # Least and greatest strings alone would be aggregated by a sort of all rows, which spills; beside
        # a list, here one of no value, Spark keeps a hash table of the few files that a task reads.
        no_value = F.size(F.collect_list(F.lit(None).cast("int")))
        return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            (F.count(F.lit(1)) + no_value).alias("rows"), *summaries
        )

    def append(self, rows: DataFrame) -> int:
        """A new version with these rows added; gives its number."""
        last = self.latest()
        added = self._write(rows)
        return self._commit(added if not last else self.files(last).unionByName(added), last)

    # --- partial rewrites ---------------------------------------------------------------------

    def _may_hold(self, keys: DataFrame, key: str) -> Column:
        """A condition on the file list, from the least, the greatest and the hashes of the keys."""
        text = F.col(key).cast("string")
        asked = keys.agg(
            F.min(text).alias("low"),
            F.max(text).alias("high"),
            F.bitmap_count(F.bitmap_construct_agg(_place(F.col(key)))).alias("n"),
        ).first()
        if asked["low"] is None:
            return F.lit(False)
        condition = (F.col(f"high_{key}") >= asked["low"]) & (F.col(f"low_{key}") <= asked["high"])
        if asked["n"] > MOST_BITS_ASKED:
            return condition
        places = [r["p"] for r in keys.where(F.col(key).isNotNull()).select(_place(F.col(key)).alias("p")).distinct().collect()]
        bits = F.col(f"bits_{key}")

        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
            return F.pmod(F.floor(byte.cast("int") / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1

        return condition & F.exists(F.lit(places), is_set)

    def holding(self, keys: DataFrame, key: str, version: int | None = None) -> list[str]:
        """The data files with a row whose ``key`` is among ``keys`` (a column of that name)."""
        files = self.files(version)
        if files is None:
            return []
        wanted = measured_side(keys.select(key).where(F.col(key).isNotNull()).distinct())
        near = [r["file"] for r in files.where(self._may_hold(wanted, key)).select("file").collect()]
        if not near:
            return []
        # select the metadata first: a join would hide it
        seen = self._read(near).select(key, F.col("_metadata.file_path").alias("file"))
        found = seen.join(wanted, key, "left_semi").select("file").distinct()
        return [r["file"] for r in found.collect()]

    def rewrite(
        self,
        keys: DataFrame,
        key: str,
        change: Callable[[DataFrame], DataFrame],
        in_place: bool = False,
    ) -> tuple[int, list[str]]:
        """A new version in which the files that hold one of the keys are written anew.

        ``change`` gets all rows of those files and returns what takes their place. Gives the number
        of the version and the files replaced; without any, the version stays. With ``in_place``,
        ``change`` moves no rows between tasks; of large files they then stay in the tasks that read them.
        """
        last = self.latest()
        touched = self.holding(keys, key, last)
        if not touched:
            return last, []
        old = self._read(touched).select(*self.columns.names)
        cores = self.spark.sparkContext.defaultParallelism
        new = self._write(change(old), in_place and input_bytes(old) >= cores * LEAST_READ)
        gone = self.spark.createDataFrame([(f,) for f in touched], "file string")
        kept = self.files(last).join(gone, "file", "left_anti")
        return self._commit(kept.unionByName(new), last), touched
