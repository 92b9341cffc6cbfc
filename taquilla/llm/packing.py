"""Documents cut into pieces of token ids and packed into as few fixed-length sequences as it can.

Hierarchical best fit over residuals:

* Each task tokenizes its documents where they lie. Only lengths and checksums go on; a piece
  of the full length is a sequence of its own and needs no packing.
* The pieces are dealt evenly to as many tasks as there are groups of up to ``GROUP`` pieces, so
  that every group has its share of short and long ones whatever the order of the rows.
* Round 0 packs each group by best fit, longest first. Any bin that fits below another would have
  been put there, so at most one bin of a group is no more than half full, and putting whole bins
  together can save at most one sequence per group. What other dealings of the pieces could save
  is the difference between samples of ``GROUP`` pieces and all of them.
* Nearly full bins are emitted. That one bin and the ``HOSTS`` emptiest others, which could take
  it in, go up the tree; all others are emitted too. In the next round bins of ``FAN_IN`` groups
  are items for best fit again, until one group is left.

A bin's rows travel with it: at most one per token of a sequence. Every round is written to the
shared folder before its sequence numbers are used, and no task holds more than a group.

Defined results. NULL text: no ids but the closing one. NULL or repeated ids: each row is packed
as a document of its own. No documents: no rows.
"""

from __future__ import annotations

import zlib
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taquilla.llm.common import slices, texts, written
from taquilla.llm.word_bpe import WordBpe

LIMIT = 4096
CLOSING_ID = 1
GROUP = 100_000
FAN_IN = 64
HOSTS = 64
# A bin counts as nearly full when less than this part of it is free.
NEARLY = 256

_PIECE = pa.struct(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
_FIELDS = [f.name for f in _PIECE]
_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = pa.struct([*_PIECE, ("offset", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """Every document's pieces: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    closing = CLOSING_ID.to_bytes(4, "little")

    def cut(batches):
        bpe = WordBpe(vocabulary)
        for part in slices(batches):
            columns = [[] for _ in _FIELDS]
            for doc_id, text in zip(
                part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True
            ):
                ids = bpe.ids(text or "") + closing
                for number, at in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[at : at + 4 * limit]
                    row = (doc_id, number, at // 4, len(own) // 4, zlib.crc32(own))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], names=_FIELDS
            )

    return texts(docs).mapInArrow(cut, _PIECE_SQL)


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r is set if some bin has r places left
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[bin_].append(item)
            room -= size
        else:
            bin_ = len(bins)
            bins.append([item])
            room = limit - size
        by_room[room].append(bin_)
        rooms |= 1 << room
    return bins


def _merged(group: list, limit: int, round_: int, last: bool, hosts: int):
    """Best fit over a group of bins; a row per bin: closed or not, number, size, members."""
    number = (round_ << 56) | (TaskContext.get().partitionId() << 32)
    group.sort(key=lambda b: [(m[f] is None, m[f]) for m in b[1] for f in _FIELDS])
    packs = []
    for found in best_fit([size for size, _ in group], limit):
        members, offset = [], 0
        for member in (m for i in found for m in group[i][1]):
            members.append(member | {"offset": offset})
            offset += member["length"]
        packs.append((offset, members))
    packs.sort(key=lambda p: p[0])
    rows = []
    for rank, (size, members) in enumerate(packs):
        closed = last or rank > hosts or (limit - size) * NEARLY < limit
        rows.append({"closed": closed, "sequence_id": number, "size": size, "members": members})
        number += 1
    yield pa.RecordBatch.from_pylist(rows, schema=_BIN)


_BIN = pa.schema(
    [
        ("closed", pa.bool_()),
        ("sequence_id", pa.int64()),
        ("size", pa.int64()),
        ("members", pa.list_(_PLACED)),
    ]
)
_BIN_SQL = (
    "closed boolean, sequence_id long, size long, members array<struct<doc_id:long,piece:int,"
    "start:long,length:long,ids_crc32:long,offset:long>>"
)


def pack(
    docs: DataFrame,
    vocabulary: str,
    limit: int = LIMIT,
    group: int = GROUP,
    fan_in: int = FAN_IN,
    hosts: int = HOSTS,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, the place inside the sequence.

    A first task holds ``group`` pieces, a later one ``fan_in`` times ``hosts + 1`` bins of up to
    ``limit`` pieces each.
    """
    cut = written(pieces(docs, vocabulary, limit))
    full = cut.where(F.col("length") == limit).select(
        *_FIELDS,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    def first(batches):
        held = [(row["length"], [row]) for batch in batches for row in batch.to_pylist()]
        if held:
            yield from _merged(held, limit, 0, False, hosts)

    short = cut.where(F.col("length") < limit)
    groups = max(1, -(-short.count() // group))
    # evenly, not by a key: rows that are alike go to all groups
    rounds = [written(short.repartition(groups).mapInArrow(first, _BIN_SQL))]
    while True:
        carried = rounds[-1].where(~F.col("closed"))
        tasks = -(-carried.count() // (fan_in * (hosts + 1)))
        if not tasks:
            break
        rounds.append(written(_next_round(carried, limit, len(rounds), tasks, hosts)))

    bins = reduce(DataFrame.unionByName, [r.where("closed") for r in rounds])
    placed = bins.select("sequence_id", F.explode("members").alias("m"))
    return full.unionByName(placed.select("m.*", "sequence_id"))


def _next_round(
    carried: DataFrame, limit: int, round_: int, tasks: int, hosts: int
) -> DataFrame:
    def again(batches):
        held = [
            (row["size"], row["members"]) for batch in batches for row in batch.to_pylist()
        ]
        if held:
            yield from _merged(held, limit, round_, tasks == 1, hosts)

    return (
        carried.select("size", "members").repartition(tasks).mapInArrow(again, _BIN_SQL)
    )
