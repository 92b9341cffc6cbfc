"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary is an acceptor A. With the transducer T that copies its input but for exactly one
inserted, deleted or replaced code point, the composition A o T o A accepts the pairs of words that
are near. Its states are (p, edits used, q) with p and q states of the two acceptors. It is never
built whole: words are dealt to partitions by an initial state, and each partition composes the
acceptors of its own words from there.

An initial state is what a pair agrees on. Take pairs whose shorter word has m code points. With
k = m // 2, two near words share the first k code points, or else the last m - k; so (m, first k)
and (m, last m - k) reach every pair, and a pair that shares the former is left to it. A word is in
the partitions of m = its length and m = its length - 1. A partition of more than ``most`` words is
split by the same rule applied to what lies between the agreed ends, again and again if need be;
when one code point is left between them, a partition has no more words than there are letters
plus their pairs. So no partition grows with the corpus, however many words begin or end alike.

Inside a partition, the acceptors of the words of length m and of both lengths are minimal and share
their states. A state pair is composed once, whatever the number of paths that lead to it, and gives
places of words in the sorted list, not strings.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that
count is at least ``ratio`` times its own; counts at least double along forms, so they end, and the
last is the root, found by joins that double the distance covered.

Defined results. NULL or empty text: no words. NULL id: the id's text is empty in the checksum.
Repeated rows: each counts. Empty table: no rows. Very long words: like any other. Other columns may
have any name.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taquilla.llm.common import slices, texts, written

# --- fixed values: what a word is -------------------------------------------------------------
RUN = re.compile("[a-zÀ-ÿ]+")
DAMAGED = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
# ----------------------------------------------------------------------------------------------
# Words that one partition composes at once.
MOST_COMPOSED = 20_000
# Distinct words a counting task gathers before it hands them on.
MOST_GATHERED = 300_000
_NO_BOUND = 1 << 30


def read_runs(doc_id: int | None, text: str) -> Counter[str]:
    """The runs of a text, lower-cased from A to Z, some with one code point left out."""
    found: Counter[str] = Counter()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        checksum = zlib.crc32(run.encode(), prefix)
        if checksum % DAMAGED == 0:
            at = checksum % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told():
        words = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())],
            names=["word", "n"],
        )

    counts: Counter[str] = Counter()
    for part in slices(batches):
        for doc_id, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
            for word, n in read_runs(doc_id, text or "").items():
                if len(word) >= LEAST_LENGTH:
                    counts[word] += n
            if len(counts) >= MOST_GATHERED:
                yield told()
                counts.clear()
    if counts:
        yield told()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words long and frequent enough, with their occurrences in all texts."""
    counted = texts(docs).mapInArrow(_gathered, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptors:
    """Minimal acceptors of sorted lists of different words, with states in common.

    A state knows whether it accepts, how many words it accepts, and per code point the next state
    and how many of its words come before those of that arc.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.accepts: list[bool] = []
        self.sizes: list[int] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self._shared: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._near: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _state(self, accepts: bool, nexts: tuple[tuple[str, int], ...]) -> int:
        found = self.known.get((accepts, nexts))
        if found is None:
            found = self.known[accepts, nexts] = len(self.arcs)
            size, arcs = int(accepts), {}
            for symbol, state in nexts:
                arcs[symbol] = (state, size)
                size += self.sizes[state]
            self.accepts.append(accepts)
            self.sizes.append(size)
            self.arcs.append(arcs)
        return found

    def of(self, words: list[str], low: int = 0, high: int | None = None, depth: int = 0) -> int:
        """The initial state for ``words[low:high]`` without their first ``depth`` symbols."""
        high = len(words) if high is None else high
        if high - low == 1:
            state = self._state(True, ())
            for symbol in reversed(words[low][depth:]):
                state = self._state(False, ((symbol, state),))
            return state
        accepts = low < high and len(words[low]) == depth
        at, nexts = low + accepts, []
        while at < high:
            symbol, end = words[at][depth], at + 1
            while end < high and words[end][depth] == symbol:
                end += 1
            nexts.append((symbol, self.of(words, at, end, depth + 1)))
            at = end
        return self._state(accepts, tuple(nexts))

    def shared(self, p: int, q: int) -> list[tuple[int, int]]:
        """From state (p, one edit, q): places of the words that both accept."""
        if p == q:
            return [(i, i) for i in range(self.sizes[p])]
        found = self._shared.get((p, q))
        if found is None:
            found = [(0, 0)] if self.accepts[p] and self.accepts[q] else []
            found += self._after(p, q, None)
            self._shared[p, q] = found
        return found

    def _after(self, p: int, q: int, but: str | None) -> list[tuple[int, int]]:
        """As ``shared`` for words that are not empty and do not begin with ``but``."""
        found, others = [], self.arcs[q]
        for symbol, (p_next, p_skip) in self.arcs[p].items():
            if symbol != but and symbol in others:
                q_next, q_skip = others[symbol]
                found += [(i + p_skip, j + q_skip) for i, j in self.shared(p_next, q_next)]
        return found

    def near(self, p: int, q: int) -> list[tuple[int, int]]:
        """From state (p, no edit, q): places of words of p and q that are one edit apart.

        Of two words with different symbols here, the one with the smaller is taken from p; an
        insertion into the word of p is placed last in a run of one symbol. So each pair of words
        is found on one path only.
        """
        found = self._near.get((p, q))
        if found is not None:
            return found
        found = []
        for inserted, (q_next, q_skip) in self.arcs[q].items():
            same = [(0, 0)] if self.accepts[p] and self.accepts[q_next] else []
            found += [(i, j + q_skip) for i, j in same + self._after(p, q_next, inserted)]
            for replaced, (p_next, p_skip) in self.arcs[p].items():
                if replaced < inserted:
                    pairs = self.shared(p_next, q_next)
                elif replaced == inserted:
                    pairs = self.near(p_next, q_next)
                else:
                    continue
                found += [(i + p_skip, j + q_skip) for i, j in pairs]
        self._near[p, q] = found
        return found


def near_pairs(words: list[str], m: int, head: int, tail: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart whose shorter word has ``m`` code points.

    The words have m or m + 1 code points, and the first ``head`` and last ``tail`` in common.
    """
    middles = {w[head : len(w) - tail]: w for w in words}
    both = sorted(middles)
    short = [x for x in both if len(x) == m - head - tail]
    if not short or len(both) < 2:
        return
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * m + 1000))
    machines = Acceptors()
    for i, j in machines.near(machines.of(short), machines.of(both)):
        yield middles[short[i]], middles[both[j]]


_PARTITION = ["key", "m", "head", "tail", "below"]


def _split(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, head, tail, below) dealt to the two partitions each one belongs to.

    A pair belongs to a partition only if it does not share its first ``below`` code points.
    """
    middle = F.col("m") - F.col("head") - F.col("tail")
    half = F.floor(middle / 2).cast("int")
    reach = F.col("head") + half

    def part(head: Column, tail: Column, below: Column) -> Column:
        ends = F.left(F.col("word"), head), F.right(F.col("word"), tail)
        key = F.concat_ws("/", F.col("m"), head, tail, below, *ends)
        return F.struct(
            key.alias("key"), F.col("m"), head.alias("head"), tail.alias("tail"), below.alias("below")
        )

    parts = F.array(
        part(reach, F.col("tail"), F.col("below")),
        part(F.col("head"), F.col("tail") + middle - half, F.least(F.col("below"), reach)),
    )
    return rows.select("word", "n", F.explode(parts).alias("part")).select("word", "n", "part.*")


def _dealt(words: DataFrame, most: int) -> DataFrame:
    """Words in partitions of at most ``most``, or as small as they can be made."""
    size = F.length("word")
    shorter = F.filter(F.array(size, size - 1), lambda m: m >= LEAST_LENGTH)
    nothing = F.lit(0)
    rows = words.select(
        "word", "n", F.explode(shorter).alias("m"),
        nothing.alias("head"), nothing.alias("tail"), F.lit(_NO_BOUND).alias("below"),
    )
    done = []
    while True:
        rows = written(_split(rows))
        divisible = F.col("m") - F.col("head") - F.col("tail") > 1
        large = written(
            rows.where(divisible).groupBy("key").agg(F.count(F.lit(1)).alias("words"))
            .where(F.col("words") > most).select("key")
        )
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = rows.join(large, "key", "left_semi").drop("key")
    dealt = done[0]
    for more in done[1:]:
        dealt = dealt.unionByName(more)
    return dealt


_PAIR = "word string, n long, other string, other_n long"


def _composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each partition; the rows come sorted by key."""

    def pairs(group: list[tuple]) -> list[tuple]:
        _, m, head, tail, below = group[0][:5]
        counts = {word: n for *_, word, n in group}
        return [
            (a, counts[a], b, counts[b])
            for a, b in near_pairs(list(counts), m, head, tail)
            if a[:below] != b[:below]
        ]

    def told(found: list[tuple]) -> pa.RecordBatch:
        kinds = pa.string(), pa.int64(), pa.string(), pa.int64()
        columns = zip(*found, strict=True) if found else [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["word", "n", "other", "other_n"],
        )

    group: list[tuple] = []
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in (*_PARTITION, "word", "n")]
        for row in zip(*columns, strict=True):
            if group and group[0][0] != row[0]:
                if len(group) > 1:
                    found += pairs(group)
                group = []
            group.append(row)
        if found:
            yield told(found)
    if len(group) > 1:
        yield told(pairs(group))


def near_words(words: DataFrame, most: int = MOST_COMPOSED) -> DataFrame:
    """All pairs of near words, each once, with their counts."""
    dealt = _dealt(words, most).select(*_PARTITION, "word", "n")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_composed, _PAIR)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): every round of joins doubles the steps covered."""
    reached = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        reached = written(
            reached.select("word", "root")
            .join(on, "root", "left")
            .select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        )
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")


def variants(docs: DataFrame, most: int = MOST_COMPOSED, ratio: int = RATIO) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs))
    pairs = near_words(words, most)
    sides = F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    judged = (
        pairs.select(F.explode(sides).alias("side"))
        .select("side.*")
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("other_n")).alias("order"), "other")).alias("best"),
        )
    )
    told = words.join(judged, "word", "left").withColumn(
        "has_form", F.coalesce(-F.col("best.order") >= ratio * F.col("n"), F.lit(False))
    )
    told = written(
        told.select(
            "word",
            F.when(F.col("has_form"), F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("has_form"), -F.col("best.order")).alias("form_n"),
        )
    )
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
