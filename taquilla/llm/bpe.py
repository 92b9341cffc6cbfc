"""BPE encoding and decoding that encodes a chunk shared by several documents once.

1. A rolling hash over the bytes cuts every text into chunks whose ends follow from the content,
   so a passage gives the same chunks wherever it stands. Only the chunks' digests are moved.
   Rows with one and the same text count as one text from here on.
2. A chunk of two or more texts has one owner, the text with the least digest.
3. One text per digest is moved, once, and joined to what it owns and borrows. A text without
   shared chunks is encoded and finished there. An owner also encodes its shared chunks one by
   one and hands them out; a borrower leaves gaps for them.
4. Borrowed chunks are joined by digest and put in place. Encoding a text in parts differs from
   encoding it whole only around the cuts: each cut is repaired by encoding again what lies
   between the nearest places on either side where the vocabulary's pattern parts any text. If
   there is no such place before the end of a chunk, the repair takes in the whole chunk.

Ids travel as 16-bit numbers, compressed. Shared chunks move by digest through joins whose large
partitions Spark splits, and a text's parts are bounded by the text.

Defined results. NULL text: as an empty one, no ids. NULL or repeated ids: every row gets the ids
of its own text. A special token's string is its id, as in the library's plain call.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taquilla.llm.byte_bpe import SAFE, ByteBpe, wide
from taquilla.llm.common import Spans, slices, texts, unpacked, written

ROLLING = 32  # bytes under the rolling hash
MEAN_CHUNK = 1024
LEAST_CHUNK = 256
MOST_CHUNK = 16 * 1024


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes, each between two characters."""
    if len(data) <= LEAST_CHUNK:
        return [len(data)] if data else []
    raw = np.frombuffer(data, np.uint8)
    rolling = Spans(raw.astype(np.uint64) + np.uint64(1)).windows(ROLLING)
    candidates = np.flatnonzero(rolling % np.uint64(MEAN_CHUNK) == 0) + ROLLING
    ends, last = [], 0
    for end in [*candidates.tolist(), len(data)]:
        while end - last > MOST_CHUNK:
            last = _character(raw, last + MOST_CHUNK)
            ends.append(last)
        if end == len(data) or end - last >= LEAST_CHUNK:
            last = _character(raw, end)
            if not ends or last > ends[-1]:
                ends.append(last)
    return ends


def _character(raw: np.ndarray, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(data: bytes) -> list[bytes]:
    return [data[a:b] for a, b in itertools.pairwise([0, *cuts(data)])]


def joined(bpe: ByteBpe, left: bytes, right: bytes) -> bytes:
    """Ids of two neighbouring texts taken as one, from the ids of each."""
    if not left or not right:
        return left + right
    tail = head = 32
    while True:
        before = bpe.decode(left[-tail:])
        places = [m.start() for m in SAFE.finditer(before)]
        if places or tail >= len(left):
            break
        tail *= 2
    while True:
        after = bpe.decode(right[:head])
        place = SAFE.search(after)
        if place or head >= len(right):
            break
        head *= 2
    start = places[-1] if places else 0
    stop = place.start() if place else len(after)
    keep_left = left[: len(left) - _ids_for(bpe, left[-tail:], start, from_end=True)]
    drop_right = _ids_for(bpe, right[:head], stop, from_end=False)
    again = bpe.encode((before[start:] + after[:stop]).decode())
    return keep_left + again + right[drop_right:]


def _ids_for(bpe: ByteBpe, ids: bytes, place: int, from_end: bool) -> int:
    """Bytes of ``ids`` that stand for the text from ``place`` on, or up to it."""
    at, size = 0, 0
    for number in memoryview(ids).cast("H"):
        if at >= place:
            break
        at += len(bpe.bytes_of[number])
        size += 2
    assert at == place, "the pattern parts here, so an id ends here"
    return len(ids) - size if from_end else size


def encode_in_parts(bpe: ByteBpe, parts: list[bytes]) -> bytes:
    """Ids of the whole text from the ids of its parts."""
    done: list[bytes] = []
    last = b""
    for part in parts:
        both = joined(bpe, last, part)
        # what is far from the next cut is settled; a repair looks back a bounded way first
        if len(both) > 1 << 16:
            done.append(both[: -(1 << 15)])
            both = both[-(1 << 15) :]
            if not SAFE.search(bpe.decode(both)):
                both = done.pop() + both
        last = both
    return b"".join([*done, last])


_PART_SQL = (
    "text_key binary, chunk binary, at int, ids binary, "
    "n_tokens long, ids_sha256 string, decoded_sha256 string"
)
_PART = pa.schema(
    [
        ("text_key", pa.binary()),
        ("chunk", pa.binary()),
        ("at", pa.int32()),
        ("ids", pa.binary()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
    ]
)


def _cut_rows(batches):
    for part in slices(batches):
        datas = [(t or "").encode() for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([digest(d) for d in datas], pa.binary()),
                pa.array(
                    [[digest(c) for c in chunks(d)] for d in datas], pa.list_(pa.binary())
                ),
            ],
            names=["doc_id", "text_key", "chunks"],
        )


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_tokens`` and digests of ids and decoded text."""
    docs = texts(docs)
    rows = written(docs.mapInArrow(_cut_rows, "doc_id long, text_key binary, chunks array<binary>"))
    own = written(
        rows.groupBy("text_key").agg(
            F.min(_id_or_zero()).alias("doc_id"), F.first("chunks").alias("chunks")
        )
    )
    places = own.select("text_key", F.posexplode("chunks").alias("at", "chunk"))
    shared = written(
        places.groupBy("chunk")
        .agg(F.min("text_key").alias("owner"), F.max("text_key").alias("other"))
        .where("owner <> other")
        .select("chunk", "owner")
    )
    uses = written(
        places.join(shared, "chunk").select(
            "text_key", "at", "chunk", (F.col("owner") == F.col("text_key")).alias("owned")
        )
    )
    plans = uses.groupBy("text_key").agg(
        F.collect_list(F.when(F.col("owned"), F.col("at"))).alias("lent"),
        F.collect_list(F.when(~F.col("owned"), F.col("at"))).alias("borrowed"),
    )
    # The texts are dealt by their rows' ids: many copies of one don't meet in one task.
    wanted = own.select("doc_id", "text_key").join(plans, "text_key", "left")
    moved = docs.mapInArrow(_keyed_rows, "doc_id long, text_key binary, text binary")
    first = written(_encoded(moved.join(wanted, ["doc_id", "text_key"]), vocabulary))

    filled = (
        uses.where("not owned")
        .select("text_key", "at", "chunk")
        .join(first.where("chunk is not null").select("chunk", "ids"), "chunk")
        .select("text_key", "at", "ids")
    )
    kept = first.where("at is not null").select("text_key", "at", "ids")
    parts = filled.unionByName(kept).groupBy("text_key")
    put_together = _assembled(
        parts.agg(F.collect_list(F.struct("at", "ids")).alias("parts")), vocabulary
    )
    results = ["text_key", "n_tokens", "ids_sha256", "decoded_sha256"]
    finished = written(
        first.where("n_tokens is not null")
        .select(results)
        .unionByName(put_together)
        .dropDuplicates(["text_key"])  # rows that agree in id and text are encoded more than once
    )
    return rows.select("doc_id", "text_key").join(finished, "text_key").drop("text_key")


def _id_or_zero() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(0))


def _keyed_rows(batches):
    press = zstandard.ZstdCompressor(level=3)
    for part in slices(batches):
        datas = [(t or "").encode() for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pc.fill_null(part.column("doc_id"), 0),
                pa.array([digest(d) for d in datas], pa.binary()),
                pa.array([press.compress(d) for d in datas], pa.binary()),
            ],
            names=["doc_id", "text_key", "text"],
        )


def _encoded(moved: DataFrame, vocabulary: str) -> DataFrame:
    """Finished texts (``n_tokens`` set), lent chunks (``chunk``) and parts around gaps (``at``)."""

    def run(batches):
        bpe = ByteBpe(vocabulary)
        press = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            out = []
            for row in part.to_pylist():
                data, key = unpacked(row["text"]), row["text_key"]
                lent, borrowed = set(row["lent"] or ()), set(row["borrowed"] or ())
                if not lent and not borrowed:
                    out.append(_finished(bpe, key, bpe.encode(data.decode())))
                    continue
                parts, given = _parts(bpe, data, lent, borrowed)
                out += [{"chunk": c, "ids": press.compress(i)} for c, i in given.items()]
                if borrowed:
                    out += [
                        {"text_key": key, "at": at, "ids": press.compress(ids)}
                        for at, ids in parts
                    ]
                else:
                    out.append(_finished(bpe, key, encode_in_parts(bpe, [i for _, i in parts])))
            yield pa.RecordBatch.from_pylist(out, schema=_PART)

    return moved.select("text_key", "text", "lent", "borrowed").mapInArrow(run, _PART_SQL)


def _parts(bpe: ByteBpe, data: bytes, lent: set[int], borrowed: set[int]):
    """Ids of all but the borrowed chunks, by the first chunk they cover, and of the lent ones.

    Neighbouring chunks that are neither lent nor borrowed are encoded as one.
    """
    parts: list[tuple[int, bytes]] = []
    given: dict[bytes, bytes] = {}
    alone: list[bytes] = []
    since = 0

    def close():
        if alone:
            parts.append((since, bpe.encode(b"".join(alone).decode())))
            alone.clear()

    for at, chunk in enumerate(chunks(data)):
        if at not in lent and at not in borrowed:
            since = since if alone else at
            alone.append(chunk)
            continue
        close()
        if at in lent:
            key = digest(chunk)
            if key not in given:
                given[key] = bpe.encode(chunk.decode())
            parts.append((at, given[key]))
    close()
    return parts, given


def _finished(bpe: ByteBpe, key: bytes, ids: bytes) -> dict:
    return {
        "text_key": key,
        "n_tokens": len(ids) // 2,
        "ids_sha256": hashlib.sha256(wide(ids)).hexdigest(),
        "decoded_sha256": hashlib.sha256(bpe.decode(ids)).hexdigest(),
    }


def _assembled(parts: DataFrame, vocabulary: str) -> DataFrame:
    fields = ["text_key", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = pa.schema([_PART.field(f) for f in fields])

    def run(batches):
        bpe = ByteBpe(vocabulary)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                by_place = {p["at"]: unpacked(p["ids"]) for p in row["parts"]}
                ids = encode_in_parts(bpe, [by_place[at] for at in sorted(by_place)])
                out.append(_finished(bpe, row["text_key"], ids))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return parts.mapInArrow(
        run, "text_key binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
