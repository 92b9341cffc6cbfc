"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus.

A word's score is the count of its n-gram over the count of the n-gram's context; if the n-gram
does not occur, ``ALPHA`` times the score with a shorter context; in the end its share of all words.
A document's own n-grams are taken off every count, so it is not scored by itself.

As rows, one per word and order, the exploded n-grams would take many times the input's size to
move. So they are joined in sorted runs: documents are gathered in units of bounded size; a unit
holds each of its n-grams once, as a hash with its count. Runs of hashes are dealt out by the
leading bits of the hash, counted over all units, and the counts go back to the unit in the order
of its hashes; there they meet the documents' n-grams and are summed per document. Every n-gram is
in one run of each unit that has it, so no word or document makes a hot key.

N-grams are told apart by ``BITS`` bits: among a million million different ones, about one in
70,000 shares its count with another. Words are ``[^\\x20\\x09-\\x0D]+``, case as it is.

Defined results. NULL or empty text: no words, a sum of 0 and a NULL mean. NULL or repeated ids:
each row is a document of its own. A word seen in no other document counts as half an occurrence.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taquilla.llm.common import Spans, hashed, slices, split_words, texts, word_hashes, written

ORDER = 3
ALPHA = 0.4
BITS = 56
UNIT_BYTES = 12 << 20  # text of a unit; a longer document is a unit of its own
AT_ONCE = 1 << 18  # words worked on at a time, where that needs helper arrays

# Words joined by line ends hold no empty line, so two line ends part texts, empty ones too.
_BETWEEN = b"\n\n"
_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        *[(f"n_order_{n}", pa.int64()) for n in range(ORDER, 0, -1)],
        ("n_unseen", pa.int64()),
        ("log_score", pa.float64()),
    ]
)


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    )


def _expanded(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _units(docs: DataFrame) -> DataFrame:
    """Documents gathered: ``unit``, their ids and their texts as one compressed list."""
    schema = pa.schema(
        [
            ("unit", pa.int64()),
            ("ids", pa.list_(pa.int64())),
            ("texts", pa.binary()),
            ("n_words", pa.int64()),
        ]
    )

    def gather(batches):
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[bytes] = []

        def unit():
            data = zstandard.ZstdCompressor(level=3).compress(_BETWEEN.join(held))
            return pa.RecordBatch.from_pylist(
                [{"unit": number, "ids": ids, "texts": data, "n_words": words}], schema=schema
            )

        size = words = 0
        for part in slices(batches):
            for doc_id, text in zip(
                part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True
            ):
                own = split_words(text)
                data = b"\n".join(own)
                if held and size + len(data) > UNIT_BYTES:
                    yield unit()
                    number, ids, held, size, words = number + 1, [], [], 0, 0
                ids.append(doc_id)
                held.append(data)
                size += len(data)
                words += len(own)
        if held:
            yield unit()

    return docs.mapInArrow(gather, "unit long, ids array<long>, texts binary, n_words long")


def _hashed_words(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a unit's ``n`` texts, and their number in each; a text at a time."""
    known, parts, sizes = word_hashes(), [np.empty(0, np.uint64)], np.zeros(n, np.int64)
    texts_ = zstandard.ZstdDecompressor().decompress(data).split(_BETWEEN)
    assert len(texts_) == n
    for i, text in enumerate(texts_):
        if text:
            parts.append(hashed(text.split(b"\n"), known))
            sizes[i] = len(parts[-1])
    return np.concatenate(parts), sizes


class Grams:
    """N-grams of a unit's documents, by order: hash and document of each."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.spans, self.sizes = Spans(words), sizes
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.at = np.arange(len(words), dtype=np.int32)
        self.at -= np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)

    def of(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of an order, and the place of each one's last word."""
        last = np.flatnonzero(self.at >= order - 1).astype(np.int32)
        hashes = np.empty(len(last), np.uint64)
        for at in range(0, len(last), AT_ONCE):
            some = last[at : at + AT_ONCE]
            hashes[at : at + AT_ONCE] = self.spans.of(some - order + 1, some + 1)
        hashes >>= np.uint64(64 - BITS)
        return hashes, last

    def elsewhere(self, order: int, totals: np.ndarray) -> np.ndarray:
        """At each word, occurrences in other documents of the n-gram that ends there.

        ``totals`` has the corpus counts of the n-grams in the order of their hashes.
        """
        found = np.zeros(len(self.at))
        hashes, last = self.of(order)
        if not len(last):
            return found
        by_hash = np.argsort(hashes, kind="stable")  # those of one document stay side by side
        hashes, last = hashes[by_hash], last[by_hash]
        del by_hash
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        del hashes
        left = np.repeat(totals, _lengths(new))
        doc = self.doc[last]
        new[1:] |= doc[1:] != doc[:-1]
        own = _lengths(new)
        left -= np.repeat(own, own)
        found[last] = left
        return found


def _lengths(new: np.ndarray) -> np.ndarray:
    """Lengths of the runs that begin at the marks."""
    return np.diff(np.flatnonzero(new), append=len(new))


def _runs(units: DataFrame, bucket_bits: int) -> DataFrame:
    """Per unit, order and bucket of hashes: the sorted hashes and their counts."""
    schema = pa.schema(
        [
            ("unit", pa.int64()),
            ("gram", pa.int32()),
            ("bucket", pa.int32()),
            ("hashes", pa.binary()),
            ("counts", pa.binary()),
        ]
    )

    def run(batches):
        for unit, ids, data in _rows(batches):
            grams = Grams(*_hashed_words(data, len(ids)))
            for order in range(1, ORDER + 1):
                hashes, counts = np.unique(grams.of(order)[0], return_counts=True)
                buckets = hashes >> np.uint64(BITS - bucket_bits)
                ends = np.searchsorted(buckets, np.arange((1 << bucket_bits) + 1))
                for bucket, (a, b) in enumerate(itertools.pairwise(ends)):
                    if a == b:
                        continue
                    row = {
                        "unit": unit,
                        "gram": order,
                        "bucket": bucket,
                        "hashes": _squeezed(np.diff(hashes[a:b], prepend=np.uint64(0))),
                        "counts": _squeezed(counts[a:b]),
                    }
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return units.mapInArrow(
        run, "unit long, gram int, bucket int, hashes binary, counts binary"
    )


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(3))


def _counted(runs: pa.Table) -> pa.Table:
    """The corpus counts of a bucket's n-grams, for each unit in the order of its hashes."""
    hashes = [np.cumsum(_expanded(b)) for b in runs.column("hashes").to_pylist()]
    counts = [_expanded(b) for b in runs.column("counts").to_pylist()]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(place, np.concatenate(counts)).astype(np.uint64)
    ends = np.cumsum([len(h) for h in hashes])
    found = [_squeezed(totals[place[e - len(h) : e]]) for h, e in zip(hashes, ends, strict=True)]
    return pa.table(
        {
            "unit": runs.column("unit"),
            "gram": runs.column("gram"),
            "bucket": runs.column("bucket"),
            "totals": pa.array(found, pa.binary()),
        }
    )


def _unit_scores(
    grams: Grams, totals: Callable[[int], np.ndarray], n_words: int
) -> dict[str, np.ndarray]:
    """Columns of the result for a unit's documents; ``totals`` gives the corpus counts of an order.

    Orders go from short to long, and a longer n-gram that occurs takes the place of a shorter
    one, so that no more than two orders are held.
    """
    sizes, n_docs = grams.sizes, len(grams.sizes)
    context = (n_words - sizes)[grams.doc].astype(np.float64)  # all words elsewhere
    score = (np.minimum(ORDER, grams.at + 1) - 1) * np.log(ALPHA)
    score += np.log(0.5)
    score -= np.log(np.maximum(context, 1))
    level = np.zeros(len(score), np.int8)
    for order in range(1, ORDER + 1):
        here = grams.elsewhere(order, totals(order))
        for at in range(0, len(here), AT_ONCE):
            hit = np.flatnonzero(here[at : at + AT_ONCE] > 0) + at
            own = (np.minimum(ORDER, grams.at[hit] + 1) - order) * np.log(ALPHA)
            own += np.log(np.maximum(here[hit], 1))
            own -= np.log(np.maximum(context[hit if order == 1 else hit - 1], 1))
            score[hit], level[hit] = own, order
        context = here
    hits = {o: np.bincount(grams.doc[level == o], minlength=n_docs) for o in range(ORDER + 1)}
    return {
        "n_words": sizes,
        **{f"n_order_{o}": hits[o] for o in range(ORDER, 0, -1)},
        "n_unseen": hits[0],
        "log_score": np.bincount(grams.doc, score, n_docs).astype(np.float64),
    }


def _scored_unit(unit: pa.Table, counts: pa.Table, n_words: int) -> pa.Table:
    """The scores of a unit's documents; the counts of one order are expanded at a time."""
    ids = unit.column("ids").combine_chunks().flatten()
    places: dict[int, list] = {o: [] for o in range(1, ORDER + 1)}
    keys = zip(*(counts.column(c).to_pylist() for c in ("gram", "bucket")), strict=True)
    for i, (order, bucket) in enumerate(keys):
        places[order].append((bucket, i))
    packed = counts.column("totals")

    def totals(order: int) -> np.ndarray:
        parts = [_expanded(packed[i].as_py()) for _, i in sorted(places[order])]
        return np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)

    grams = Grams(*_hashed_words(unit.column("texts")[0].as_py(), len(ids)))
    found = _unit_scores(grams, totals, n_words)
    return pa.table({"doc_id": ids, **found}).cast(_SCORES)


def score(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: words, words scored at each order, sum and mean of log scores."""
    units = written(_units(texts(docs)))
    n_units, n_words = units.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    bucket_bits = max(0, (n_units - 1).bit_length())
    runs = _runs(units, bucket_bits)
    totals = runs.groupBy("gram", "bucket").applyInArrow(
        _counted, "unit long, gram int, bucket int, totals binary"
    )

    def run(key, unit: pa.Table, counts: pa.Table) -> pa.Table:
        return _scored_unit(unit, counts, n_words)

    orders = ", ".join(f"n_order_{n} long" for n in range(ORDER, 0, -1))
    scored = (
        units.groupBy("unit")
        .cogroup(totals.groupBy("unit"))
        .applyInArrow(run, f"doc_id long, n_words long, {orders}, n_unseen long, log_score double")
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.withColumn("mean_log_score", mean)

