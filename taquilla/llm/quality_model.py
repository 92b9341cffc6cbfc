"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its words, hashed to ``BUCKETS`` places and weighted by the square root
of their share, a few numbers about its structure, and its stated length. The score is

    sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j),

whose pairwise part costs time linear in the features, because it equals half the sum over the
factors of (sum v_if x_i)^2 - sum (v_if x_i)^2.

Fitting reads a bounded sample: the ``SAMPLE`` labelled documents outside the held-out fold whose
hashed ids come first. One task fits the machine on them and hands back arrays of a fixed size,
which are broadcast; every document is scored where it lies, over its whole text. Language, source,
id and labels are no features.

Defined results. NULL or empty text: scored by structure alone. NULL id: never held out nor
labelled. Rows with one id share its label. An id with several labels is good if all say so. No
labels to learn from: every score is the share of good ones seen, or one half if none were.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taquilla.llm.common import Remembered, hashed, slices, unused, word_hashes

SAMPLE = 12_000
BUCKETS = 1 << 14
FACTORS = 8
FOLDS = 5
THRESHOLD = 0.3
EPOCHS = 4
LEAST_STEPS = 400  # of small samples more epochs are run
BATCH = 128
RATE = 0.05
PULL = 1e-4  # weight decay
STRUCTURE = (
    "symbols",
    "shouts",
    "capitals",
    "digits",
    "pipes",
    "stops",
    "word_length",
    "distinct_words",
    "repeats_in_a_row",
    "distinct_lines",
    "line_words",
    "words",
    "stated_length",
)
SIZE = BUCKETS + len(STRUCTURE)
_SYMBOLS, _DIGITS = b"#*$%&|<>", b"0123456789"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass
class Machine:
    bias: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, FACTORS), np.float32))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(STRUCTURE)))
    spread: np.ndarray = field(default_factory=lambda: np.ones(len(STRUCTURE)))


@dataclass
class Features:
    """Rows of sparse features: row ``r`` has places ``ends[r-1]`` to ``ends[r]``."""

    places: np.ndarray
    values: np.ndarray
    sizes: np.ndarray
    structure: np.ndarray


def held_out(doc_id: Column) -> Column:
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def _structure(data: bytes, words: list[bytes], stated: int | None) -> list[float]:
    size, n = max(1, len(data)), max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]

    def count(characters: bytes) -> int:
        return len(data) - len(data.translate(None, characters))

    return [
        count(_SYMBOLS) / size,
        data.count(b"!") / size,
        count(_CAPITALS) / size,
        count(_DIGITS) / size,
        data.count(b"|") / n,
        data.count(b".") / n,
        size / n,
        0.0,  # distinct words, from the hashed places
        0.0,  # repeats in a row, from the hashes
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        float(np.log1p(len(words))),
        float(np.log1p(max(0, stated or 0))),
    ]


def features(texts: list[str | None], stated: list[int | None], known: Remembered) -> Features:
    datas = [(t or "").encode() for t in texts]
    words = [d.split() for d in datas]
    sizes = np.array([len(w) for w in words], np.int64)
    hashes = hashed([w for row in words for w in row], known)
    row = np.repeat(np.arange(len(words)), sizes)
    key = row * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    held, counts = np.unique(key, return_counts=True)
    rows, places = held // BUCKETS, held % BUCKETS
    structure = np.array(
        [_structure(d, w, s) for d, w, s in zip(datas, words, stated, strict=True)], np.float64
    ).reshape(len(words), len(STRUCTURE))
    distinct = np.bincount(rows, minlength=len(words))
    same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]) if len(hashes) else np.empty(0, bool)
    in_a_row = np.bincount(row[1:][same], minlength=len(words)) if len(hashes) else distinct
    total = np.maximum(1, sizes)
    structure[:, STRUCTURE.index("distinct_words")] = distinct / total
    structure[:, STRUCTURE.index("repeats_in_a_row")] = in_a_row / total
    values = np.sqrt(counts / total[rows]) if len(rows) else np.empty(0)
    return Features(places, values.astype(np.float32), distinct, structure)


def _with_structure(f: Features, machine: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and row of all features, the structure's scaled by the sample's spread."""
    n = len(f.sizes)
    scaled = np.clip((f.structure - machine.mean) / machine.spread, -4, 4) / 2
    row = np.concatenate(
        [np.repeat(np.arange(n), f.sizes), np.repeat(np.arange(n), len(STRUCTURE))]
    )
    places = np.concatenate([f.places, np.tile(np.arange(BUCKETS, SIZE), n)])
    values = np.concatenate([f.values, scaled.ravel().astype(np.float32)])
    return places, values, row


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(row, values, n)
    return np.stack([np.bincount(row, values[:, k], n) for k in range(values.shape[1])], axis=1)


def margins(f: Features, machine: Machine) -> np.ndarray:
    places, values, row = _with_structure(f, machine)
    n = len(f.sizes)
    weighted = machine.factors[places] * values[:, None]
    sums, squares = _sums(row, weighted, n), _sums(row, (weighted * weighted).sum(axis=1), n)
    linear = _sums(row, machine.linear[places] * values, n)
    return machine.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)


def scores(f: Features, machine: Machine) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins(f, machine), -30, 30)))


def fit(f: Features, good: np.ndarray) -> Machine:
    """Logistic loss by steps over small batches, each weight with its own step size."""
    machine = Machine()
    n = len(good)
    share = float(good.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        machine.bias = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -6, 6))
        return machine
    random = np.random.default_rng(7)
    machine.bias = float(np.log(share / (1 - share)))
    machine.mean = f.structure.mean(axis=0)
    machine.spread = f.structure.std(axis=0) + 1e-6
    machine.factors = random.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)
    seen_linear = np.full(SIZE, 1e-3, np.float32)
    seen_factors = np.full((SIZE, FACTORS), 1e-3, np.float32)
    ends = np.cumsum(f.sizes)
    starts = ends - f.sizes
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // n))):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            picked = np.concatenate([np.arange(starts[i], ends[i]) for i in own])
            part = Features(f.places[picked], f.values[picked], f.sizes[own], f.structure[own])
            places, values, row = _with_structure(part, machine)
            weighted = machine.factors[places] * values[:, None]
            sums = _sums(row, weighted, len(own))
            error = (scores(part, machine) - good[own])[row] / len(own)
            used, inverse = np.unique(places, return_inverse=True)
            slope = _sums(inverse, error * values, len(used)) + PULL * machine.linear[used]
            pair = (error * values)[:, None] * (sums[row] - weighted)
            slopes = _sums(inverse, pair, len(used)) + PULL * machine.factors[used]
            seen_linear[used] += slope**2
            seen_factors[used] += slopes**2
            machine.linear[used] -= RATE * slope / np.sqrt(seen_linear[used])
            machine.factors[used] -= RATE * slopes / np.sqrt(seen_factors[used])
            machine.bias -= RATE * float(error.sum() / max(1, len(places) / len(own)))
    return machine


def _stated_size(docs: DataFrame) -> Column:
    """``n_chars`` as a whole number; NULL where there is none, or a text that is no number."""
    if "n_chars" not in docs.columns:
        return F.lit(None).cast("long")
    stated = F.col("n_chars")
    is_text = isinstance(docs.schema["n_chars"].dataType, T.StringType)
    return stated.try_cast("long") if is_text else stated.cast("long")


def _columns(docs: DataFrame) -> list[Column]:
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        _stated_size(docs).alias("n_chars"),
    ]


def _part_features(part: pa.RecordBatch, known: Remembered) -> Features:
    stated = part.column("n_chars").to_pylist()
    return features(part.column("text").to_pylist(), stated, known)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine fitted on at most ``sample`` labelled documents outside the held-out fold."""
    labelled = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~held_out(F.col("doc_id").cast("long")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    own = labelled.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def extract(batches):
        known = word_hashes()
        for part in slices(batches):
            f = _part_features(part, known)
            ends = np.cumsum(f.sizes)
            rows = [
                pickle.dumps((f.places[e - s : e].astype(np.int32), f.values[e - s : e], f.structure[i]))
                for i, (s, e) in enumerate(zip(f.sizes, ends, strict=True))
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("quality"), pa.array(rows, pa.binary())],
                names=["doc_id", "quality", "features"],
            )

    # ``sample`` rows of two numbers bound this broadcast
    chosen = docs.select(*_columns(docs)).join(F.broadcast(picked), "doc_id")
    rows = chosen.mapInArrow(extract, "doc_id long, quality int, features binary")

    def learn(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            held = sorted(zip(*[table.column(c).to_pylist() for c in table.column_names], strict=True))
            found = [pickle.loads(row) for _, _, row in held]
            f = Features(
                np.concatenate([p for p, _, _ in found]).astype(np.int64),
                np.concatenate([v for _, v, _ in found]),
                np.array([len(p) for p, _, _ in found]),
                np.stack([s for _, _, s in found]),
            )
            machine = fit(f, np.array([q for _, q, _ in held], np.float64))
        else:
            machine = Machine()
        yield pa.RecordBatch.from_pylist([{"machine": pickle.dumps(machine)}])

    # one task; an id that occurs in several rows counts once, with its least features
    one = rows.groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("row"))
    one = one.select("doc_id", "row.quality", "row.features")
    once = one.coalesce(1).mapInArrow(learn, "machine binary")
    found = once.collect()
    return pickle.loads(found[0]["machine"]) if found else Machine()


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        known = word_hashes()
        for part in slices(batches):
            found = scores(_part_features(part, known), shared.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found)], names=["doc_id", "score"]
            )

    scored = docs.select(*_columns(docs)).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_rejected(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that the machine takes for good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    size = unused("stated_size", docs.columns)
    names = docs.columns

    def run(batches):
        known = word_hashes()
        for part in slices(batches):
            texts, lengths = part.column("text").to_pylist(), part.column(size).to_pylist()
            found = scores(features(texts, lengths, known), shared.value)
            yield part.filter(pa.array(found >= THRESHOLD)).select(names)

    return docs.withColumn(size, _stated_size(docs)).mapInArrow(run, docs.schema)
