"""Removal of long passages that a document with a smaller id holds too.

The graph: every ``window`` consecutive words of a document are an edge, the words two such
edges share are the node between them. A document is a walk. Walks are not stored edge by edge:

1. The least hash of the ``anchor``-word runs inside an edge is the edge's anchor. Neighbouring
   edges of a walk with one anchor form a *piece*. Anchor and extent follow from the words alone,
   so equal passages give equal pieces; a piece is known by its anchor and a hash of its words.
2. An anchor seen in one document only belongs to edges that cannot repeat. Those pieces go.
3. A join brings together the pieces of an anchor. Where all are one and the same, the path is
   nonbranching and compact: one row stands for all its edges, and its source is the smallest
   document that holds it. Where they differ the path branches; the first copy of each differing
   piece is opened into its edges, and the smallest document of each edge is found one by one.
   Later copies of a piece need no opening, since their source holds every edge they have.
4. The repeated pieces and edges return to their documents. There each is found again at its
   coordinates by hashing the document's own words, and the covered words are removed.

Pieces and edges are told apart by 128 bits (anchor and content). Only documents that hold a
branching or repeated piece are hashed again, and texts travel compressed.

Defined results. NULL text: no words. NULL id: neither smaller nor larger than any other, so the
row stays whole and is no source. Rows with one id: each is judged by its own words, against
smaller ids only. Repeats inside one document stay. Fewer words than a window: kept whole.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.llm.common import (
    Spans,
    hashed,
    packed,
    signed,
    slices,
    split_words,
    texts,
    unpacked,
    unused,
    with_text,
    word_hashes,
    written,
)

WINDOW = 50
ANCHOR = 8


class Walks:
    """The edges and pieces of several word sequences that stand one after the other."""

    def __init__(self, sequences: list[list[bytes]], known, window: int, anchor: int):
        self.window = window
        sizes = np.array([len(s) for s in sequences], np.int64)
        words = hashed(list(itertools.chain.from_iterable(sequences)), known)
        self.spans = Spans(words)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        edges = np.maximum(sizes - window + 1, 0)
        self.walk = np.repeat(np.arange(len(sizes)), edges)
        before = np.cumsum(edges) - edges
        self.at = np.arange(edges.sum()) - before[self.walk] + self.starts[self.walk]
        least = self._least(self.spans.windows(anchor), window - anchor + 1)
        self.anchor = least[self.at] if len(self.at) else np.empty(0, np.uint64)
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.walk[1:] != self.walk[:-1])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(self.at)))

    @staticmethod
    def _least(values: np.ndarray, width: int) -> np.ndarray:
        """The least of every ``width`` values in a row, by doubling."""
        have = 1
        while have * 2 <= width and len(values) > have:
            values = np.minimum(values[:-have], values[have:])
            have *= 2
        rest = width - have
        return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Walk, anchor and content hash of every piece."""
        at = self.at[self.first]
        return (
            self.walk[self.first],
            self.anchor[self.first],
            self.spans.of(at, at + self.size - 1 + self.window),
        )

    def edge_hashes(self, edges: np.ndarray) -> np.ndarray:
        at = self.at[edges]
        return self.spans.of(at, at + self.window)

    def edges_of(self, pieces: np.ndarray) -> np.ndarray:
        """The edges of the pieces marked in ``pieces``."""
        return np.flatnonzero(np.repeat(pieces, self.size))


def _arrow(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _pieces(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def cut(batches):
        known = word_hashes()
        for part in slices(batches):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            walks = Walks(
                [split_words(t) for t in part.column("text").to_pylist()], known, window, anchor
            )
            walk, anchors, contents = walks.pieces()
            yield _arrow(
                signed(anchors),
                signed(contents),
                ids[walk],
                names=["anchor", "content", "doc_id"],
            )

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(
        cut, "anchor long, content long, doc_id long"
    )


def repeated_parts(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Pieces and edges to remove: ``doc_id``, ``pieces``, ``edges`` (arrays of hashes)."""
    docs = texts(docs)
    pieces = written(_pieces(docs, window, anchor))
    # written: the pieces of a hot anchor can be split over tasks beside a plain exchange only
    shared = written(
        pieces.groupBy("anchor")
        .agg(
            F.min("doc_id").alias("lo"),
            F.max("doc_id").alias("hi"),
            F.min("content").alias("one"),
            F.max("content").alias("other"),
        )
        .where("lo < hi")
        .select("anchor", (F.col("one") != F.col("other")).alias("branching"))
    )
    pieces = written(pieces.join(shared, "anchor"))
    sources = written(
        pieces.groupBy("anchor", "content", "branching").agg(
            F.min("doc_id").alias("source"), F.max("doc_id").alias("last")
        )
    )
    compact = (
        pieces.join(
            sources.where("source < last").select("anchor", "content", "source"),
            ["anchor", "content"],
        )
        .where("source < doc_id")
        .select("doc_id", F.col("content").alias("piece"), F.lit(None).cast("long").alias("edge"))
    )

    opened = (
        sources.where("branching")
        .groupBy(F.col("source").alias("doc_id"))
        .agg(F.collect_set("content").alias("contents"))
    )
    edges = written(_opened_edges(packed(docs).join(opened, "doc_id"), window, anchor))
    again = written(
        edges.groupBy("anchor", "edge")
        .agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
        .where("source < last")
        .select("anchor", "edge", "source")
    )
    single = (
        edges.join(again, ["anchor", "edge"])
        .where("source < doc_id")
        .select("doc_id", F.lit(None).cast("long").alias("piece"), "edge")
    )
    return (
        compact.unionByName(single)
        .groupBy("doc_id")
        .agg(F.collect_set("piece").alias("pieces"), F.collect_set("edge").alias("edges"))
    )


def _opened_edges(held: DataFrame, window: int, anchor: int) -> DataFrame:
    """The edges of the listed pieces, found again in the words of their documents."""

    def cut(batches):
        known = word_hashes()
        for batch in batches:
            for part in slices([batch]):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                sequences = [(unpacked(b) or b"").split() for b in part.column("text").to_pylist()]
                walks = Walks(sequences, known, window, anchor)
                walk, anchors, contents = walks.pieces()
                wanted = part.column("contents")
                listed = np.zeros(len(walk), bool)
                bounds = np.searchsorted(walk, np.arange(len(ids) + 1))
                for i in range(len(ids)):
                    own = slice(bounds[i], bounds[i + 1])
                    listed[own] = np.isin(signed(contents[own]), np.array(wanted[i].as_py()))
                edges = walks.edges_of(listed)
                yield _arrow(
                    signed(walks.anchor[edges]),
                    signed(walks.edge_hashes(edges)),
                    ids[walks.walk[edges]],
                    names=["anchor", "edge", "doc_id"],
                )

    return held.mapInArrow(cut, "anchor long, edge long, doc_id long")


def removed_words(
    words: list[bytes], pieces, edges, known, window: int = WINDOW, anchor: int = ANCHOR
) -> np.ndarray:
    """Which words of a document the listed pieces and edges cover."""
    walks = Walks([words], known, window, anchor)
    covered = np.zeros(len(words) + 1, np.int64)
    if pieces:
        _, _, contents = walks.pieces()
        hit = np.isin(signed(contents), np.array(pieces, np.int64))
        at = walks.at[walks.first[hit]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + walks.size[hit] - 1 + window, -1)
    if edges:
        all_edges = np.arange(len(walks.at))
        hit = np.isin(signed(walks.edge_hashes(all_edges)), np.array(edges, np.int64))
        np.add.at(covered, walks.at[hit], 1)
        np.add.at(covered, walks.at[hit] + window, -1)
    return np.cumsum(covered[:-1]) > 0


def marked(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All rows and columns of ``docs``, the text compressed, then what is to be removed.

    The two columns more, pieces and edges, are the last, under names that ``docs`` does not use.
    """
    own_id, pieces, edges = (unused(name, docs.columns) for name in ("own_id", "pieces", "edges"))
    parts = repeated_parts(docs, window, anchor).select(
        F.col("doc_id").alias(own_id), F.col("pieces").alias(pieces), F.col("edges").alias(edges)
    )
    own = packed(docs)
    return own.join(parts, own["doc_id"].cast("long") == parts[own_id], "left").drop(own_id)


def removed_rows(batches, window: int, anchor: int):
    """For each slice: the batch, and per row its text, words and removed words (or None)."""
    known = word_hashes()
    for part in slices(batches):
        listed = zip(
            part.column("text").to_pylist(),
            part.columns[-2].to_pylist(),
            part.columns[-1].to_pylist(),
            strict=True,
        )
        rows = []
        for blob, pieces, edges in listed:
            text = unpacked(blob)
            words = text.split() if text else []
            gone = (
                removed_words(words, pieces, edges, known, window, anchor)
                if pieces or edges
                else None
            )
            rows.append((text, words, gone))
        yield part, rows


def removed_spans(gone: np.ndarray) -> list[tuple[int, int]]:
    """First word and number of words of every removed span."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(turns[::2], turns[1::2], strict=True)]


def cut_text(text: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The text without the removed words; white space after each removed word goes with it."""
    starts, at = [], 0
    for word in words:
        at = text.index(word, at)
        starts.append(at)
        at += len(word)
    starts.append(len(text))
    kept, done = [], 0
    for first, size in removed_spans(gone):
        kept.append(text[done : starts[first]])
        done = starts[first + size]
    kept.append(text[done:])
    return b"".join(kept)


def repeat_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row of ``docs``: words, removed spans and the kept words as bytes."""

    def find(batches):
        for part, rows in removed_rows(batches, window, anchor):
            spans = [[] if g is None else removed_spans(g) for _, _, g in rows]
            kept = [
                words if gone is None else list(itertools.compress(words, ~gone))
                for _, words, gone in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(w) for _, w, _ in rows], pa.int64()),
                    pa.array(
                        [[{"start": a, "words": b} for a, b in s] for s in spans],
                        pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])),
                    ),
                    pa.array([b" ".join(k) for k in kept], pa.binary()),
                ],
                names=["doc_id", "n_words", "spans", "kept"],
            )

    return marked(texts(docs), window, anchor).mapInArrow(
        find, "doc_id long, n_words long, spans array<struct<start:long,words:long>>, kept binary"
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text; a text may end up empty."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    names = docs.columns

    def cut(batches):
        for part, rows in removed_rows(batches, window, anchor):
            values = [
                None
                if text is None
                else (text if gone is None else cut_text(text, words, gone)).decode()
                for text, words, gone in rows
            ]
            yield with_text(part, pa.array(values, pa.string())).select(names)

    return marked(docs, window, anchor).mapInArrow(cut, schema)
