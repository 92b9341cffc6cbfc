"""Exact top-k search: BM25 over inverted shards with block-max pruning, merged by global statistics.

The documents are dealt to shards of bounded text, by their language where the table names it and
inside it by a hash of their row. Each shard is indexed once and kept in the shared folder: postings of
every term, and its terms with their document counts. Document frequencies, the number of documents and their mean length are
summed over all shards, so a score does not depend on the shard.

Inside a shard the queries of a block are scored together, in single precision: the common terms of
some hundred queries by one product of matrices with those of all documents, the rarer ones by their
postings. What reaches the threshold, less what rounding can take away, is scored in full.

A query that comes almost alone is answered as block-max WAND does, with all documents of a step at once.
Postings of the rarer terms are read in full. The documents that lead by them are scored by all terms,
and the k-th best of them, or of shards the task had before, is the first threshold. Each common term
has a bound, its weight times its greatest contribution, for every block of ``BLOCK`` documents of
like length. Common terms are added with the greatest bound first, and a document is skipped, from the
first term on, as soon as its score so far and the bounds of its block for the terms left add up to less
than the threshold, which every step raises. What remains is scored in full, pair by pair.

Queries are documents: every word of the whole text, in lower case, counts as often as it occurs.
A document is no result of its own query. Scores are added up in the order of the terms' hashes and
rounded to nine places; ties go to the smaller id.

Queries are broadcast in blocks of bounded bytes, and the index is read once per block; nothing but the
``k`` best per shard and query is shuffled after indexing. The work still grows with the product of
queries and shards.

Defined results. NULL or empty text: neither found nor a query with results. NULL id: no result
and no query. Rows with one id: documents of their own, each may be found under that id, and one
query of all their words. Empty tables: no rows. A text may be of any length; one above
``SHARD_BYTES`` makes its shard as large, one with more terms than ``ASKED_BYTES`` its block. Other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taquilla.llm.common import (
    hashed,
    packed,
    shared_folder,
    signed,
    slices,
    texts,
    unpacked,
    word_hashes,
    written,
)

K1, B = 1.2, 0.75
TOP = 10
BLOCK = 64
SHARD_BYTES = 24 << 20  # of text before it is compressed
ASKED_BYTES = 16 << 20  # of terms and weights of the queries in a block
# Shards a task takes one after the other at most, with the thresholds of those before.
SHARDS_PER_TASK = 16
# Documents of one language share shards; languages are told apart by so many hashes.
KINDS = 64
_ROWS_PER_MESSAGE = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TERM_BYTES = 20
# A term is common if one document of so many has it; common terms have a cell per document, up to
# so many cells in a shard (20 MB), the most frequent first.
COMMON = 16
MOST_CELLS = 5 << 20
# Queries whose common terms are multiplied with those of all documents at once, and of whose rarer
# terms the postings are added at once; so many scores (16 MB) and postings at most. Fewer queries than
# ``FEW`` are answered one by one.
TOGETHER, OPENED_TOGETHER, FEW = 256, 8, 4
SCORED_CELLS, MOST_OPENED = 4 << 20, 1 << 18
# Documents scored in full for the first threshold, and common terms added in the first step.
SEEDS, FIRST_TERMS = 32, 8
# A sum of bounds may fall short of a rounded score by less than this.
_SLACK = 1e-6

# Arrays of an index, a row each as compressed bytes.
_ARRAYS = {
    "doc_id": np.int64,
    "length": np.int64,
    "term": np.uint64,
    "df": np.int64,
    "doc": np.int32,
    "tf": np.int32,
}
_INDEX = (
    "shard long, n_docs long, n_words long, terms array<long>, dfs array<long>, "
    + ", ".join(f"{n} binary" for n in _ARRAYS)
)


def indexed(ids: np.ndarray, words: Iterable[list[bytes]]) -> dict[str, np.ndarray]:
    """The index of some documents as plain arrays, documents of like length side by side."""
    known = word_hashes()
    found, counts, length = [], [], []
    for w in words:  # the words of one document at a time
        terms, tf = np.unique(hashed(w, known), return_counts=True)
        found.append(terms)
        counts.append(tf.astype(np.int32))
        length.append(len(w))
    length = np.array(length, np.int64)
    order = np.argsort(length, kind="stable")
    found, counts = [found[i] for i in order], [counts[i] for i in order]
    doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
    found = np.concatenate([np.empty(0, np.uint64), *found])
    by_term = np.argsort(found, kind="stable")
    found = found[by_term]
    starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else by_term
    return {
        "doc_id": np.asarray(ids, np.int64)[order],
        "length": length[order],
        "term": found[starts],
        "df": np.diff(np.r_[starts, len(found)]),
        "doc": doc[by_term],  # documents of the first term, the second, ...
        "tf": np.concatenate([np.empty(0, np.int32), *counts])[by_term],
    }


class _Asked(NamedTuple):
    """Queries of a block: the terms of each lie between two ``ends``, by their number among all terms."""

    ends: np.ndarray
    terms: np.ndarray
    number: np.ndarray
    weights: np.ndarray


class Shard:
    """An index ready for queries."""

    def __init__(self, index: dict[str, np.ndarray], mean_length: float):
        self.ids, self.terms, self.df, self.doc = (index[n] for n in ("doc_id", "term", "df", "doc"))
        n_docs = len(self.ids)
        self.pairs = np.bincount(self.doc, minlength=n_docs)
        self.doc_end = np.cumsum(self.pairs)
        self.term_end = np.cumsum(self.df)
        # the same pairs by document, sorted in steps of 16 bits where that is enough
        by_doc = np.argsort(self.doc.astype(np.uint16 if n_docs <= 1 << 16 else np.int32), kind="stable")
        self.of_doc = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.df)[by_doc]
        norm = K1 * (1 - B + B * index["length"] / mean_length)
        part = norm[self.doc]
        part += index["tf"]
        np.divide(index["tf"] * (K1 + 1), part, out=part)
        self.part, self.doc_part = part.astype(np.float32), part[by_doc]
        del part, by_doc
        common = np.flatnonzero(self.df * COMMON >= n_docs)
        common = common[np.argsort(-self.df[common], kind="stable")][: MOST_CELLS // max(1, n_docs)]
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.block = np.arange(n_docs) // BLOCK
        self.wide = np.zeros((len(common), n_docs), np.float32)
        for row, term in enumerate(common.tolist()):
            own = slice(self.term_end[term] - self.df[term], self.term_end[term])
            self.wide[row, self.doc[own]] = self.part[own]
        self.weight = np.zeros(len(self.terms))

    @cached_property
    def most(self) -> np.ndarray:
        """The greatest contribution of every common term in every block."""
        starts = np.arange(0, len(self.ids), BLOCK)
        return np.maximum.reduceat(self.wide, starts, axis=1) if len(starts) else self.wide

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms are in this shard, -1 if they are not."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[place] == terms, place, -1)

    def top(self, own: int, place: np.ndarray, weights: np.ndarray, k: int, floor: float = 0.0):
        """(-score, id) of the best ``k`` that reach ``floor``, best first."""
        known = place >= 0
        place, weights = place[known], weights[known]
        if not len(place):
            return []
        row = self.row[place]
        so_far = self._opened(place[row < 0], weights[row < 0])
        so_far[self.ids == own] = -np.inf
        row, weight = row[row >= 0], weights[row >= 0]
        bound = weight[:, None] * self.most[row]  # of every term in every block
        order = np.argsort(-bound.max(1), kind="stable") if len(row) else row
        row, weight = row[order], weight[order]
        # what the terms from here on can add in a block
        rest = np.zeros((len(row) + 1, bound.shape[1]))
        rest[:-1] = np.cumsum(bound[order][::-1], axis=0)[::-1]
        least = floor
        if not floor and len(so_far) > max(k, SEEDS):
            n_seeds = max(k, SEEDS)
            seeds = np.argpartition(so_far, -n_seeds)[-n_seeds:]
            seen = so_far[seeds] + self._common(row, weight, seeds)
            least = max(least, _below(_kth(seen, k), len(place)))
        docs = np.flatnonzero(so_far + rest[0][self.block] >= least)
        score, at, step = so_far[docs], 0, FIRST_TERMS
        while at < len(row) and len(docs):
            stop = min(len(row), at + step)
            score += self._common(row[at:stop], weight[at:stop], docs)
            least = max(least, _below(_kth(score, k), len(place)))
            reach = score + rest[stop][self.block[docs]] >= least
            docs, score = docs[reach], score[reach]
            at, step = stop, step * 2
        docs = docs[(score > 0) & (score >= max(least, _below(_kth(score, k), len(place))))]
        return self._best(place, weights, docs, k)

    def tops(
        self, own: np.ndarray, asked: _Asked, k: int, floors: np.ndarray
    ) -> Iterator[tuple[int, list]]:
        """The same for many queries at once: (number, best) of each that finds a document."""
        place = self.places(asked.terms)
        row = np.full(len(place), -1)
        row[place >= 0] = self.row[place[place >= 0]]
        sizes = np.diff(asked.ends)
        counted = np.r_[0, np.cumsum((row >= 0)[asked.number], dtype=np.int32)]
        common = np.diff(counted[asked.ends]) / np.maximum(sizes, 1)
        # queries with few of the common terms side by side, as those of another language
        order = np.argsort(common, kind="stable")
        together = max(1, min(TOGETHER, SCORED_CELLS // max(1, len(self.ids))))
        for at in range(0, len(order), together):
            some = order[at : at + together]
            terms = _ranges(asked.ends[some], asked.ends[some + 1])
            query = np.repeat(np.arange(len(some)), sizes[some])
            number = asked.number[terms]
            scores = self._all_scores(query, place[number], row[number], asked.weights[terms], len(some))
            for i, score in zip(some.tolist(), scores, strict=True):
                score[self.ids == own[i]] = 0
                docs = np.flatnonzero((score > 0) & (score >= _below(floors[i], sizes[i])))
                if len(docs) > k:
                    found = score[docs]
                    docs = docs[found >= _below(_kth(found, k), sizes[i])]
                if len(docs):
                    of = slice(asked.ends[i], asked.ends[i + 1])
                    own_place = place[asked.number[of]]
                    known = own_place >= 0
                    yield i, self._best(own_place[known], asked.weights[of][known], docs, k)

    def each_top(
        self, own: np.ndarray, asked: _Asked, k: int, floors: np.ndarray
    ) -> Iterator[tuple[int, list]]:
        """What ``tops`` gives, query by query."""
        place = self.places(asked.terms)
        for i, (start, stop) in enumerate(zip(asked.ends, asked.ends[1:], strict=False)):
            of = slice(start, stop)
            found = self.top(int(own[i]), place[asked.number[of]], asked.weights[of], k, floors[i])
            if found:
                yield i, found

    def _all_scores(self, query, place, row, weights, n: int) -> np.ndarray:
        """Scores of all documents by ``n`` queries, a row each, in single precision; terms by query."""
        wide = row >= 0
        asked = np.zeros((n, len(self.wide)), np.float32)
        asked[query[wide], row[wide]] = weights[wide]
        used = np.flatnonzero(asked.any(0))
        scores = asked[:, used] @ self.wide[used] if len(used) < len(self.wide) else asked @ self.wide
        rarer = (place >= 0) & ~wide
        query, place, weights = query[rarer], place[rarer], weights[rarer]
        df, n_docs = self.df[place], max(1, len(self.ids))
        ends = np.searchsorted(query, np.arange(n + 1))
        postings_to = np.r_[0, np.cumsum(df)][ends]
        most, at = max(1, min(OPENED_TOGETHER, SCORED_CELLS // (8 * n_docs))), 0
        while at < n:
            within = int(np.searchsorted(postings_to, postings_to[at] + MOST_OPENED, side="right")) - 1
            stop = max(at + 1, min(at + most, within, n))
            of, some = slice(ends[at], ends[stop]), scores[at:stop]
            own_df, last = df[of], self.term_end[place[of]]
            postings = _ranges(last - own_df, last)
            cell = np.repeat((query[of] - at) * n_docs, own_df) + self.doc[postings]
            scored = np.repeat(weights[of], own_df) * self.part[postings]
            some += np.bincount(cell, scored, some.size).reshape(some.shape)
            at = stop
        return scores

    def _best(self, place: np.ndarray, weights: np.ndarray, docs: np.ndarray, k: int):
        full = np.round(self._full(place, weights, docs), 9)
        return sorted(zip((-full).tolist(), self.ids[docs].tolist(), strict=True))[:k]

    def _opened(self, place: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of all documents by the postings of some terms."""
        ends, df = self.term_end[place], self.df[place]
        postings = _ranges(ends - df, ends)
        scored = np.repeat(weights, df) * self.part[postings]
        sums = np.bincount(self.doc[postings], scored, len(self.ids))
        return sums.astype(np.float64, copy=False)  # whole numbers if there are no postings

    def _common(self, row: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """What common terms add to the scores of some documents."""
        return (weight[:, None] * self.wide[row[:, None], docs]).sum(0)

    def _full(self, place: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of some documents, terms added in the order of their hashes."""
        size, ends = self.pairs[docs], self.doc_end[docs]
        pairs = _ranges(ends - size, ends)
        self.weight[place] = weights
        scored = self.weight[self.of_doc[pairs]] * self.doc_part[pairs]
        self.weight[place] = 0.0
        return np.bincount(np.repeat(np.arange(len(docs)), size), scored, len(docs))


def _below(score: float, n_terms: int) -> float:
    """What a sum of ``n_terms`` contributions in single precision reaches if the exact sum reaches
    another such sum of ``score``: nothing is negative, so each step is off by a part of the sum only."""
    return score * (1 - (n_terms + 8) * 2.0**-22) - _SLACK


def _kth(scores: np.ndarray, k: int) -> float:
    """The k-th best score, 0 if there are fewer."""
    return max(0.0, float(np.partition(scores, -k)[-k])) if len(scores) >= k else 0.0


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    size = stops - starts
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(starts - before, size)


def _dealt(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """Rows dealt to parts by a hash of ``row``, so that rows of one id are spread too."""
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(parts).cast("long")))


def _kind(docs: DataFrame) -> Column:
    """A number of the language of a document, where the table has one column that names it."""
    named = [c for c in docs.columns if c.lower() == "lang"]
    if len(named) != 1:
        return F.lit(0).cast("long")
    return F.pmod(F.xxhash64(F.col(named[0]).cast("string")), F.lit(KINDS).cast("long"))


def _shard(sizes: dict[int, int], shards: int) -> Column:
    """The shard of a row: kinds take stretches of the shards by their bytes, rows places in them by hash."""
    whole = max(1, sum(sizes.values()))
    width = [sizes.get(kind, 0) * shards / whole for kind in range(KINDS)]
    start = [sum(width[:kind]) for kind in range(KINDS)]
    parts = 1 << 30
    at = F.pmod(F.xxhash64("row"), F.lit(parts).cast("long")) / parts
    place = [F.get(F.array(*map(F.lit, x)), F.col("kind").cast("int")) for x in (start, width)]
    return F.least(F.floor(place[0] + at * place[1]), F.lit(shards - 1).cast("long"))


# --- index --------------------------------------------------------------------------------------


def index_of(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard of ``docs`` (``doc_id``, ``text``, ``kind``), written to the shared folder."""
    sized = docs.withColumn("size", F.octet_length("text"))
    held = written(packed(sized).withColumn("row", F.monotonically_increasing_id()))
    sizes = dict(held.groupBy("kind").agg(F.sum("size")).collect())  # at most ``KINDS``

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        words = (unpacked(b.as_py()).lower().split() for b in rows.column("text"))
        index = indexed(rows.column("doc_id").to_numpy(), words)
        press = zstandard.ZstdCompressor(level=1)
        cells = {
            "shard": key[0].as_py(),
            "n_docs": rows.num_rows,
            "n_words": int(index["length"].sum()),
        }
        columns = {n: pa.array([v], pa.int64()) for n, v in cells.items()}
        columns["terms"] = pa.array([signed(index["term"])], pa.list_(pa.int64()))
        columns["dfs"] = pa.array([index["df"]], pa.list_(pa.int64()))
        for n, kind in _ARRAYS.items():
            blob = press.compress(np.ascontiguousarray(index[n], kind).tobytes())
            columns[n] = pa.array([blob], pa.binary())
        return pa.table(columns)

    dealt = held.withColumn("shard", _shard(sizes, max(1, -(-sum(sizes.values()) // shard_bytes))))
    return written(
        dealt.select("shard", "doc_id", "text").groupBy("shard").applyInArrow(run, _INDEX)
    )


def _shards(batches: Iterable[pa.RecordBatch], mean_length: float) -> Iterator[Shard]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            # nothing but the shard is held while it is used
            yield Shard(
                {
                    n: np.frombuffer(press.decompress(batch.column(n)[i].as_py()), kind)
                    for n, kind in _ARRAYS.items()
                },
                mean_length,
            )


# --- queries ------------------------------------------------------------------------------------


def _terms(docs: DataFrame) -> DataFrame:
    """Distinct terms of every document: ``doc_id``, ``terms``, ``counts``."""

    def run(batches):
        known = word_hashes()
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(
                part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True
            ):
                found, counts = np.unique(
                    hashed(text.encode().lower().split(), known), return_counts=True
                )
                rows.append((doc_id, signed(found), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "terms", "counts"],
            )

    return docs.mapInArrow(run, "doc_id long, terms array<long>, counts array<long>")


def _weighted(asked: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, terms, row) of every query, its terms in the order of their hashes; written."""
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (
        _terms(asked)
        .select("doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        .select("doc_id", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
        .groupBy("doc_id", "term")
        .agg(F.sum("n").alias("n"))
        .join(frequencies, "term")
        .groupBy("doc_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("term", (F.col("n") * idf).alias("weight")))
            ).alias("terms")
        )
    )
    return written(weighted.withColumn("row", F.monotonically_increasing_id()))


def _sent(spark: SparkSession, block: DataFrame) -> Broadcast:
    """The queries of one block: ids, where their terms end, all terms, number and weight of each."""
    rows = block.select("doc_id", "terms.term", "terms.weight").toArrow()
    ends = np.cumsum([0] + [len(t) for t in rows.column("term")])
    term = rows.column("term").combine_chunks().flatten().to_numpy().view(np.uint64)
    weight = rows.column("weight").combine_chunks().flatten().to_numpy()
    terms, number = np.unique(term, return_inverse=True)
    ids = rows.column("doc_id").to_numpy()
    return spark.sparkContext.broadcast((ids, ends, terms, number.astype(np.int32), weight))


def _found(index: DataFrame, sent: Broadcast, mean_length: float, top: int) -> DataFrame:
    """The best of each shard that can be among the best of all."""
    kinds = {"query_id": pa.int64(), "doc_id": pa.int64(), "score": pa.float64()}

    def run(batches):
        ids, ends, terms, number, weight = sent.value
        asked = _Asked(ends, terms, number, weight)
        kept: dict[int, list] = {}
        floors = np.zeros(len(ids))
        for shard in _shards(batches, mean_length):
            tops = shard.tops if len(ids) >= FEW else shard.each_top
            for i, found in tops(ids, asked, top, floors):
                best = kept[i] = sorted(kept.get(i, []) + found)[:top]
                if len(best) == top:
                    floors[i] = max(0.0, -best[-1][0] - _SLACK)
            del shard, tops  # before the next one is made
        rows = [(int(ids[i]), doc_id, -score) for i, best in kept.items() for score, doc_id in best]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)],
                names=list(kinds),
            )

    return index.select(*_ARRAYS).mapInArrow(run, "query_id long, doc_id long, score double")


def search(
    docs: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    shard_bytes: int = SHARD_BYTES,
    asked_bytes: int = ASKED_BYTES,
) -> DataFrame:
    """The best ``top`` of ``docs`` per row of ``queries`` (``doc_id``, ``text``)."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _kind(docs).alias("kind"))
    index = index_of(given.where("doc_id is not null and text is not null"), shard_bytes)
    counted = index.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)),
        F.coalesce(F.sum("n_words"), F.lit(0)),
        F.count("*"),
    )
    n_docs, n_words, shards = counted.first()
    mean_length = max(1.0, n_words / max(1, n_docs))
    frequencies = written(
        index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
        .groupBy(F.col("t.terms").alias("term"))
        .agg(F.sum("t.dfs").alias("df"))
    )
    asked = _weighted(
        texts(queries).where("doc_id is not null and text is not null"), frequencies, n_docs
    )
    n_terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_terms * _TERM_BYTES // asked_bytes))
    asked = _dealt(asked, blocks, "block")
    folder = shared_folder(spark)
    cores = spark.sparkContext.defaultParallelism
    held = index.coalesce(cores * max(1, -(-shards // (cores * SHARDS_PER_TASK))))
    for block in range(blocks):
        sent = _sent(spark, asked.where(F.col("block") == block))
        found = _found(held, sent, mean_length, top)
        rows = spark.conf.get(_ROWS_PER_MESSAGE)
        spark.conf.set(_ROWS_PER_MESSAGE, "1")  # a shard is one row
        try:
            found.write.mode("append").parquet(folder)
        finally:
            spark.conf.set(_ROWS_PER_MESSAGE, rows)
        sent.unpersist()
    per_shard = spark.read.schema("query_id long, doc_id long, score double").parquet(folder)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return per_shard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
