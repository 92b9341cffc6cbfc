"""What the operators of this package share: tables, written steps, words and their hashes.

A word is a run of characters other than the six ASCII white-space characters, so words can
be cut out of the UTF-8 bytes. Hashes of words and of word sequences are 64 bits wide.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.session import SETTINGS

# Python turns the texts of one slice into words at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
# Rows that cross from the JVM to Python in one message.
ROWS_PER_MESSAGE = "256"
# Distinct words a task remembers before it starts afresh.
MOST_REMEMBERED = 600_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the library and small messages to Python, on a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_MESSAGE)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, as in tests, may go
    without; it has no other machine to share with and takes a folder next to its warehouse.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir") + "/steps"
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: it outlives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def texts(docs: DataFrame) -> DataFrame:
    """The two columns the operators read; other columns may have any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each part stay below ``SLICE_BYTES``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
            stop = max(start + 1, stop)
            yield batch.slice(start, stop - start)
            start = stop


def split_words(text: str | None) -> list[bytes]:
    """Words of a text; ``bytes.split`` parts at exactly the six ASCII white-space bytes."""
    return text.encode().split() if text else []


class Remembered(dict):
    """A function of a key whose values are kept, up to ``MOST_REMEMBERED`` of them."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        value = self[key] = self.function(key)
        return value


def word_hashes() -> Remembered:
    return Remembered(xxhash.xxh3_64_intdigest)


def hashed(words: list[bytes], known: Remembered) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any spans of a word sequence from one pass over it."""

    def __init__(self, words: np.ndarray, multiplier: int = _MULTIPLIER):
        n = len(words)
        factors = np.full(n, multiplier, np.uint64)
        back = np.full(n, pow(multiplier, -1, 1 << 64), np.uint64)
        if n:
            factors[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(factors), out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        size = (stops - starts).astype(np.uint64)
        raw = (self.sums[stops] - self.sums[starts]) * self.back[starts]
        return mixed(raw ^ (size * np.uint64(0xD6E8FEB86659FD93)))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` words, crossing document ends too."""
        n = len(self.back) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _with_text(schema: T.StructType, kind: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, kind if f.name == "text" else f.dataType) for f in schema.fields]
    )


def with_text(batch: pa.RecordBatch, values: pa.Array) -> pa.RecordBatch:
    """The batch with another column in the place of its text."""
    at = batch.schema.get_field_index("text")
    columns = [values if i == at else c for i, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def packed(docs: DataFrame) -> DataFrame:
    """The same rows with the text as compressed bytes, for a text that has to be moved."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            blobs = [
                None if t is None else press.compress(t.encode())
                for t in part.column("text").to_pylist()
            ]
            yield with_text(part, pa.array(blobs, pa.binary()))

    return docs.mapInArrow(pack, _with_text(docs.schema, T.BinaryType()))


def unpacked(blob: bytes | None) -> bytes | None:
    return None if blob is None else zstandard.ZstdDecompressor().decompress(blob)
