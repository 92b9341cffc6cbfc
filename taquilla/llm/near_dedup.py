"""Near-duplicate components: MinHash signatures under a multi-index Hamming join.

A ``Rule`` says how many words a shingle has, which similarity links, and how signatures are cut.

1. A document's set is its distinct runs of ``shingle`` words in lower case. Documents with one and
   the same set are one node, named by the smallest id; copies go no further.
2. A node's signature has ``symbols`` minima of 16 bits. Two nodes whose similarity is at the
   threshold differ in more than ``distance`` symbols with the chance ``Rule.missed``: 6.3e-7 by
   the default rule.
3. Signatures are split into ``chunks`` chunks. By the pigeonhole principle two that differ in at
   most ``distance = 2 * chunks - 1`` symbols have a chunk with at most one difference. Every chunk
   is looked up with each one of its symbols left out, so all such pairs share a key, for certain.
4. Nodes under one key are candidates. All pairs of a key are not formed: first every node meets
   the key's least node, and links that hold on the full sets join components; then those still
   apart from a node picked by hash meet that one. Only pairs of one key in different components
   after that, of sizes that allow the similarity, and not tried before, are formed and tried.
   Pairs inside a component need no trial, so no link between components is lost.
5. Components come from alternating star contractions over links in the shared folder.

Links are confirmed on the whole texts, which travel compressed and only for nodes that share a
key. Joins on hot nodes and sets have plain exchanges on both sides, so Spark splits their skew.

Defined results. No words or NULL text: the empty set, linked with nothing, kept. Fewer words than
a shingle: the whole sequence is the one shingle. Rows with one id are one document: a link of one
row is a link of the id. NULL id: linked with nothing, component NULL, kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taquilla.llm.common import (
    Remembered,
    Spans,
    hashed,
    mixed,
    packed,
    signed,
    slices,
    texts,
    unpacked,
    unused,
    word_hashes,
    written,
)

SHINGLE = 3
PERCENT = 85  # of the union that the intersection must reach
SYMBOLS = 64
CHUNKS = 13
DISTANCE = 2 * CHUNKS - 1
DIRECT = 16  # members of a key whose pairs are formed without a look at their shingles
_COLUMNS = 1 << 16  # shingles of a document hashed at a time


@dataclass(frozen=True)
class Rule:
    """Which documents are linked, and the signatures by which they are found."""

    shingle: int = SHINGLE
    percent: int = PERCENT
    symbols: int = SYMBOLS
    chunks: int = CHUNKS

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1

    @property
    def missed(self) -> float:
        """Chance that a pair right at the threshold shares no key."""
        p, n = 1 - self.percent / 100, self.symbols
        return sum(
            math.comb(n, d) * p**d * (1 - p) ** (n - d) for d in range(self.distance + 1, n + 1)
        )

    def similar(self, both, union):
        return 100 * both >= self.percent * union


DEFAULT = Rule()


def _random(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and flips of the hash functions behind the symbols."""
    random = np.random.default_rng(20)
    times = random.integers(0, 1 << 63, symbols, np.uint64) * np.uint64(2) + np.uint64(1)
    return times, random.integers(0, 1 << 63, symbols, np.uint64)


def shingle_hashes(data: bytes, known: Remembered, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = hashed(data.lower().split(), known)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(size, n)
    starts = np.arange(n - size + 1)
    return np.unique(Spans(words).of(starts, starts + size))


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    times, flips = functions
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _COLUMNS):
        part = (shingles[at : at + _COLUMNS][None, :] ^ flips[:, None]) * times[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def index_keys(signatures: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """One key per chunk and left-out symbol: as many keys as symbols per signature."""
    symbols = signatures.shape[1]
    wide = mixed(
        signatures.astype(np.uint64) + (np.arange(symbols, dtype=np.uint64) << np.uint64(32))
    )
    keys = np.empty(wide.shape, np.uint64)
    for places in np.array_split(np.arange(symbols), chunks):
        together = wide[:, places].sum(axis=1, dtype=np.uint64)
        for place in places:
            left_out = np.uint64((0x9E3779B97F4A7C15 * (int(place) + 1)) % (1 << 64))
            keys[:, place] = mixed((together - wide[:, place]) ^ left_out)
    return keys


def _sets(docs: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """Size, identity and signature of every document's set."""

    def run(batches):
        known, functions = word_hashes(), _random(rule.symbols)
        for part in slices(batches):
            sizes, names, signatures = [], [], []
            for text in part.column("text").to_pylist():
                found = shingle_hashes((text or "").encode(), known, rule.shingle)
                sizes.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found, functions).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "name", "signature"],
            )

    return docs.mapInArrow(
        run, "doc_id long, n_shingles long, name binary, signature binary"
    )


def _keys(nodes: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(batch.column("signature").to_pylist())
            signatures = np.frombuffer(raw, np.uint16).reshape(-1, rule.symbols)
            keys = index_keys(signatures, rule.chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(keys.ravel())),
                    pa.array(np.repeat(batch.column("node").to_numpy(), rule.symbols)),
                    pa.array(np.repeat(batch.column("n_shingles").to_numpy(), rule.symbols)),
                ],
                names=["key", "node", "n_shingles"],
            )

    return nodes.select("node", "n_shingles", "signature").mapInArrow(
        run, "key long, node long, n_shingles long"
    )


def _linked(pairs: DataFrame, held: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches):
        known = word_hashes()
        last, last_set = None, None
        for batch in batches:
            for part in slices([batch], "text_a"):
                rows = part.to_pydict()
                a, b = [], []
                for left, right, one, other in zip(
                    rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True
                ):
                    if last != other:
                        last = other
                        last_set = shingle_hashes(unpacked(other), known, rule.shingle)
                    first = shingle_hashes(unpacked(one), known, rule.shingle)
                    both = len(np.intersect1d(first, last_set, assume_unique=True))
                    if rule.similar(both, len(first) + len(last_set) - both):
                        a.append(left)
                        b.append(right)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
                )

    def side(name: str) -> DataFrame:
        return held.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node it reaches, for all nodes of the links.

    Large-star and small-star contractions in turn, until nothing changes.
    """

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both if large else both.where("b < a")
        # written: the links of a hub can be split over tasks beside a plain exchange only
        least = around.groupBy("a").agg(F.min("b").alias("m"))
        least = written(least.select("a", F.least("a", "m").alias("m")))
        joined = around.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.where("a <> b").distinct()

    edges = written(links.where("a <> b").select("a", "b").distinct())
    before = _mark(edges)
    while before[0]:
        edges = written(stars(stars(edges, True), False))
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    return (
        rows.where(F.col(one) != F.col(other))
        .select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
        .distinct()
    )


def _links(nodes: DataFrame, docs: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """Links that join the nodes into their components."""
    keys = _keys(nodes, rule)
    several = written(
        keys.groupBy("key")
        .agg(F.min("node").alias("least"), F.max("node").alias("most"))
        .where("least < most")
        .select("key", "least")
    )
    members = written(keys.join(several, "key"))
    involved = members.select(F.col("node").alias("doc_id")).distinct()
    held = written(
        packed(docs.where("doc_id is not null and text is not null")).join(
            involved, "doc_id", "left_semi"
        )
    )

    tried = written(_pairs(members, "node", "least"))
    links = written(_linked(tried, held, rule))
    for last in (False, True):
        joined = written(components(links))
        apart = _apart(members, joined)
        pairs = _across(apart, held, rule) if last else _with_picked(apart)
        fresh = written(pairs.join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            if not last:
                continue
            break
        links = written(links.unionByName(_linked(fresh, held, rule)))
        tried = written(tried.unionByName(fresh))
    return links


def _apart(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of the keys that several components share, with their component."""
    placed = members.join(joined, "node", "left").select(
        "key", "node", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    mixed_keys = written(
        placed.groupBy("key")
        .agg(F.min("component").alias("one"), F.max("component").alias("other"))
        .where("one < other")
        .select("key")
    )
    return written(placed.join(mixed_keys, "key"))


def _with_picked(apart: DataFrame) -> DataFrame:
    """Each member and one picked by hash from its key, if that lies in another component."""
    order = F.xxhash64("node", F.lit(1))
    picked = apart.groupBy("key").agg(F.min(order).alias("order"))
    picked = apart.withColumn("order", order).join(picked, ["key", "order"])
    picked = picked.select("key", F.col("node").alias("other"), F.col("component").alias("there"))
    return _pairs(apart.join(picked, "key").where("component <> there"), "node", "other")


def _across(apart: DataFrame, held: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """Pairs of one key that lie in different components and may be similar."""
    counted = apart.groupBy("key").agg((F.count("*") > DIRECT).alias("large"))
    sized = apart.join(written(counted), "key")
    large = sized.where("large").select("node", "n_shingles", "component").distinct()
    by_shingle = _pairs_by_shingle(written(large), held, rule)
    return _pairs_by_key(sized.where("not large"), rule).unionByName(by_shingle).distinct()


def _pairs_by_key(apart: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """All pairs of one key in different components, of sizes that allow the similarity."""
    other = apart.select(
        "key",
        F.col("node").alias("other"),
        F.col("component").alias("there"),
        F.col("n_shingles").alias("n_other"),
    )
    possible = (
        (F.col("node") < F.col("other"))
        & (F.col("component") != F.col("there"))
        & rule.similar(F.least("n_shingles", "n_other"), F.greatest("n_shingles", "n_other"))
    )
    return _pairs(apart.join(other, "key").where(possible), "node", "other")


def _shingles(nodes: DataFrame, held: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """A row per node and shingle."""
    kept = nodes.columns

    def run(batches):
        known = word_hashes()
        for part in slices(batches):
            for one in range(part.num_rows):
                row = part.slice(one, 1)
                data = unpacked(row.column("text")[0].as_py())
                found = shingle_hashes(data, known, rule.shingle)
                for at in range(0, len(found), _COLUMNS):
                    some = found[at : at + _COLUMNS]
                    same = np.zeros(len(some), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [row.column(c).take(pa.array(same)) for c in kept]
                        + [pa.array(signed(some))],
                        names=[*kept, "shingle"],
                    )

    texts_of = held.select(F.col("doc_id").alias("node"), "text")
    return nodes.join(texts_of, "node").select(*kept, "text").mapInArrow(
        run, "node long, n_shingles long, component long, shingle long"
    )


def _pairs_by_shingle(nodes: DataFrame, held: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """Pairs in different components that share a shingle early enough in the order by rarity.

    ``at`` is a shingle's place in its node's order. Shingles that one node alone has come first
    there; they pair nothing, so only their number is needed. A pair at the threshold has its
    first common shingle within the first ``n - ceil(n * percent / 100) + 1`` of both, and from it on each
    has as many shingles as the two must share.
    """
    spread = written(_shingles(nodes, held, rule))
    often = spread.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    common = spread.join(written(often), "shingle")
    mine = Window.partitionBy("node")
    place = F.row_number().over(mine.orderBy("often", "shingle")) - 1
    alone = F.col("n_shingles") - F.count("*").over(mine)
    early = written(
        common.select("node", "n_shingles", "component", "shingle", (alone + place).alias("at"))
        .where(rule.similar(F.col("n_shingles") - F.col("at"), F.col("n_shingles")))
    )
    # pairs inside the component that most nodes of a shingle belong to are not even looked at
    main = (
        early.groupBy("shingle", "component")
        .agg(F.count("*").alias("nodes"))
        .groupBy("shingle")
        .agg(F.max(F.struct("nodes", "component")).alias("main"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("shingle", F.col("main.component").alias("main"))
    )
    placed = written(early.join(written(main), "shingle"))
    other = placed.select(
        "shingle",
        F.col("node").alias("other"),
        F.col("component").alias("there"),
        F.col("n_shingles").alias("n_other"),
        F.col("at").alias("at_other"),
    )
    enough = F.least(F.col("n_shingles") - F.col("at"), F.col("n_other") - F.col("at_other"))
    possible = (
        (F.col("component") != F.col("there"))
        & ((F.col("there") == F.col("main")) | (F.col("node") < F.col("other")))
        & rule.similar(enough, F.col("n_shingles") + F.col("n_other") - enough)
    )
    outside = placed.where("component <> main")
    return _pairs(outside.join(other, "shingle").where(possible), "node", "other")


def near_duplicates(docs: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` per row of ``docs``."""
    docs = texts(docs)
    sets = written(_sets(docs, rule))
    named = sets.where("doc_id is not null and name is not null")
    nodes = written(
        named.groupBy("name").agg(
            F.min("doc_id").alias("node"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
    )
    same = named.select("doc_id", "name").join(nodes.select("name", "node"), "name")
    links = _links(nodes, docs, rule)
    # an id's own copies, and the sets of other rows with that id, are links as well
    copies = same.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    by_id = written(components(links.unionByName(copies)))
    found = sets.join(by_id.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_copies(docs: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """One document of each component: the rows whose id is the component's least."""
    own = unused("gone_id", docs.columns)
    gone = near_duplicates(docs, rule).where("not kept").select(F.col("doc_id").alias(own))
    return docs.join(gone.distinct(), docs["doc_id"].cast("long") == F.col(own), "left_anti")
