"""Phrase collocations: Apriori-safe candidates counted by broadcast double-array tries.

A text is cut into pieces at punctuation and line ends, a piece into words; a phrase lies within a
piece, and everything is counted per language. Three steps:

1. Candidates, length by length. Each occurrence of a phrase adds to the sum of its 64-bit hash,
   folded per task and summed by Spark. A sum below ``least`` proves that the phrase is too rare, and so
   is every longer phrase that holds it, which is not summed at all. The hashes that are left are
   put into a bit map of fixed size, which is broadcast; the phrases whose bits are set in it are
   the candidates. Shared hashes and bits only add candidates, never lose one. They are named by a
   part of the texts and, if that part does not have them, by the others, so that not every task
   names every one of its candidates.
2. Counts. The candidates, their parts and their words are dealt by hash into sets of bounded bytes. Each
   set becomes one double-array trie per language, is broadcast, and the texts are read once for it:
   all positions of a slice of text advance one word at a time together, and the accepting states they
   reach are counted. The counts of a task leave it in blocks of phrases, which are added up per block.
3. Scores, joined and compared relationally in exact decimals.

Bound of the broadcasts: ``BITS`` bits for each length, and ``SET_BYTES`` for a set, however large
the corpus. The number of sets, and with it of readings of the texts, follows the bytes of the
candidates: that is the price of broadcasting them.

Defined results. NULL or empty text: no words. NULL language: ``und``, together with rows that say so.
NULL ids, repeated ids and rows: every row counts. Empty table: no rows. A word or a text may be of
any length. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taquilla.llm.common import Spans, mixed, signed, slices, written

# --- fixed values: what a phrase is ---------------------------------------------------------
NO_LANGUAGE = "und"
MOST_WORDS = 3
LEAST = 10
SCALE = 1_000_000
INSIDE_PERCENT = 50
TOP = 2000
# Between words: a space or a tab. Between pieces: these, which become one byte no text holds.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = b"\xff"
_CUT = bytes.maketrans(_PIECE_ENDS + b"\t", _END * len(_PIECE_ENDS) + b" ")
# --------------------------------------------------------------------------------------------
# Bits of the map of frequent hashes of one length: 32 MB.
BITS = 28
# Bytes of candidates, with what a trie needs beside them, in one set.
SET_BYTES = 96 << 20
# Hashes a task gathers before it folds them, and phrases it remembers to have named.
MOST_GATHERED = 4 << 20
MOST_NAMED = 1_000_000
ROWS_PER_BATCH = 1 << 16
# Bytes of text whose words are hashed at once.
HASHED_BYTES = 1 << 16
# Phrases whose counts leave a task as one row.
COUNTED_TOGETHER = 1 << 14
# One of so many texts names its candidates first; the others name those that none of these has. The
# bits of a sum that count occurrences.
NAMING_SHARE = 4
NAMED_BIT = 40
# Tries: words have two digits of this radix; states that draw their places in one round, and
# that are too few to draw.
RADIX_BITS = 9
RADIX = 1 << RADIX_BITS
MOST_DRAWN = 50_000
FEW_LEFT = 200

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(texts: Iterable[str]) -> list[bytes]:
    """Words of the texts in order, with an end mark between pieces and between texts."""
    return _cut(texts).replace(_END, b" " + _END + b" ").split()


def _cut(texts: Iterable[str]) -> bytes:
    return "\n".join(texts).encode().lower().translate(_CUT)


class Tokens:
    """The same tokens as places in the bytes of the texts, and their hashes, without a Python object each."""

    def __init__(self, texts: Iterable[str]):
        self.data = _cut(texts)
        given = np.frombuffer(self.data, np.uint8)
        is_end, is_word = given == _END[0], given != ord(" ")
        parts = ~is_word | is_end
        self.starts = np.flatnonzero(is_word & (is_end | np.r_[True, parts[:-1]][: len(given)]))
        self.stops = np.flatnonzero(is_word & (is_end | np.r_[parts[1:], True][: len(given)])) + 1
        self.is_word = ~is_end[self.starts]
        self.hashes = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            first = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.stops, first + HASHED_BYTES, side="right")))
            own = slice(at, stop)
            spans = Spans(given[first : self.stops[stop - 1]].astype(np.uint64))
            self.hashes[own] = spans.of(self.starts[own] - first, self.stops[own] - first)
            at = stop

    def __len__(self) -> int:
        return len(self.starts)

    def phrase(self, at: int, size: int) -> bytes:
        return b" ".join(self.data[self.starts[at] : self.stops[at + size - 1]].split())


def _grouped(batches: Iterable[pa.RecordBatch], of: Callable, made: Callable) -> Iterator[tuple]:
    """What is ``made`` of the texts of a slice, by what ``of`` gives for language and text."""
    for part in slices(batches):
        found: dict = {}
        for lang, text in zip(*(part.column(c).to_pylist() for c in ("lang", "text")), strict=True):
            if text:
                found.setdefault(of(lang, text), []).append(text)
        for key, texts in found.items():
            yield key, made(texts)


def _per_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    return _grouped(batches, lambda lang, text: lang, tokens_of)


def _per_language_and_side(
    batches: Iterable[pa.RecordBatch],
) -> Iterator[tuple[tuple[str, bool], Tokens]]:
    """The same, texts that name phrases first (one of ``NAMING_SHARE``, by a hash of the text) apart."""
    return _grouped(
        batches,
        lambda lang, text: (lang, xxhash.xxh3_64_intdigest(text, seed=2) % NAMING_SHARE == 0),
        Tokens,
    )


# --- candidates ---------------------------------------------------------------------------------


class Windows:
    """Hashes of the phrases of a token sequence, and which of them may be frequent."""

    def __init__(self, lang: str, tokens: Tokens, maps: dict[int, np.ndarray]):
        self.words = tokens.hashes
        self.maps = maps
        # a seed of its own: a language may be called like a word
        self.hashes = mixed(self.words + np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=1)))
        self.open = tokens.is_word
        self.size = 1

    def longer(self) -> None:
        """Go on to phrases of one more word, whose both parts may be frequent."""
        hashes = mixed(self.hashes[:-1] * _FACTOR + self.words[self.size :])
        parts = self.frequent()
        self.open = parts[:-1] & parts[1:]
        self.hashes = hashes
        self.size += 1

    def frequent(self) -> np.ndarray:
        found = self.maps.get(self.size)
        return self.open if found is None else self.open & self.in_map(found)

    def in_map(self, found: np.ndarray) -> np.ndarray:
        bit = self.hashes >> np.uint64(64 - _bits(found))
        set_ = found[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)
        return (set_ & np.uint8(1)).astype(bool)


def _bits(bit_map: np.ndarray) -> int:
    return (len(bit_map) * 8).bit_length() - 1


def _maps(sent: dict[int, Broadcast]) -> dict[int, np.ndarray]:
    return {size: np.frombuffer(b.value, np.uint8) for size, b in sent.items()}


def _hash_sums(rows: DataFrame, size: int, sent: dict[int, Broadcast]) -> DataFrame:
    """(hash, n) of the phrases of ``size`` words that may be frequent, folded per task.

    Above ``NAMED_BIT`` bits ``n`` counts the folds that had the phrase from a text that names first.
    """

    def folded(pending):
        # the last bit, given up by the hash, tells whether it is of a text that names first
        tagged, counts = np.unique(np.concatenate(pending), return_counts=True)
        hashes, named = tagged & ~np.uint64(1), (tagged & np.uint64(1)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else []
        hashes = hashes[starts]
        if len(hashes):
            counts = np.add.reduceat(counts, starts) + (np.maximum.reduceat(named, starts) << NAMED_BIT)
        for at in range(0, len(hashes), ROWS_PER_BATCH):
            columns = signed(hashes[at : at + ROWS_PER_BATCH]), counts[at : at + ROWS_PER_BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["hash", "n"])

    def run(batches):
        maps, pending, gathered = _maps(sent), [], 0
        for (lang, names_first), tokens in _per_language_and_side(batches):
            if len(tokens) < size:
                continue
            windows = Windows(lang, tokens, maps)
            while windows.size < size:
                windows.longer()
            own = windows.hashes[windows.open] & ~np.uint64(1)
            pending.append(own | np.uint64(names_first))
            gathered += len(pending[-1])
            if gathered >= MOST_GATHERED:
                yield from folded(pending)
                pending, gathered = [], 0
        if pending:
            yield from folded(pending)

    return rows.mapInArrow(run, "hash long, n long")


def _bit_maps(sums: DataFrame, least: int, bits: int) -> tuple[Broadcast, Broadcast]:
    """One bit for the leading ``bits`` bits of every hash that occurs ``least`` times; and one for the
    leading ``bits - 3`` of those that no text has that names first, which are few."""
    spark = sums.sparkSession
    bits = max(bits, 6)  # whole bytes of both maps
    bit = F.shiftrightunsigned("hash", 64 - bits) + 1
    mask = (1 << NAMED_BIT) - 1
    frequent = (
        sums.groupBy("hash").agg(F.sum("n").alias("n"))
        .select(bit.alias("bit"), F.col("n").bitwiseAND(mask).alias("n"), (F.col("n") > mask).alias("is_named"))
        .where(F.col("n") >= least)
    )
    bitmap = "bitmap_construct_agg(bitmap_bit_position(bit))"
    blocks = frequent.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(
        F.expr(bitmap).alias("bits"), F.expr(f"{bitmap} FILTER (WHERE NOT is_named)").alias("unnamed")
    )
    whole, unnamed = (np.zeros((1 << bits) // 8, np.uint8) for _ in range(2))
    for row in written(blocks).collect():  # at most two such maps
        for to, name in ((whole, "bits"), (unnamed, "unnamed")):
            own = np.frombuffer(row[name], np.uint8)
            start = (row["block"] - 1) * len(own)
            to[start : start + len(own)] |= own[: len(to) - start]
    few = np.packbits(unnamed != 0, bitorder="little")
    return tuple(spark.sparkContext.broadcast(m.tobytes()) for m in (whole, few))


def candidates(rows: DataFrame, most_words: int, least: int, bits: int) -> DataFrame:
    """Distinct (lang, phrase) of every phrase that may be frequent, and of the words in them."""
    sent: dict[int, Broadcast] = {}
    unnamed: dict[int, Broadcast] = {}
    for size in range(2, most_words + 1):
        sent[size], unnamed[size] = _bit_maps(_hash_sums(rows, size, sent), least, bits)

    def named(batches):
        maps, few, seen = _maps(sent), _maps(unnamed), set()
        for (lang, names_first), tokens in _per_language_and_side(batches):
            found = []
            windows = Windows(lang, tokens, maps)
            while windows.size < min(most_words, len(tokens)):
                windows.longer()
                found_here = windows.frequent()
                if not names_first:
                    found_here &= windows.in_map(few[windows.size])
                places = np.flatnonzero(found_here)
                hashes, first = np.unique(windows.hashes[places], return_index=True)
                for h, at in zip(hashes.tolist(), places[first].tolist(), strict=True):
                    if h not in seen:
                        seen.add(h)
                        found.append(tokens.phrase(at, windows.size))
            if len(seen) >= MOST_NAMED:
                seen.clear()
            if found:
                texts = pa.array(found, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), texts], names=["lang", "phrase"]
                )

    phrases = written(rows.mapInArrow(named, "lang string, phrase string").distinct())
    words = phrases.select("lang", F.explode(F.split("phrase", " ")).alias("phrase"))
    return written(phrases.unionByName(words).distinct())


# --- counts -------------------------------------------------------------------------------------


def digits(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two symbols of every word number; of 0, which no word has, the symbol of no arc."""
    known = numbers > 0
    return known * ((numbers >> RADIX_BITS) + 1), known * ((numbers & (RADIX - 1)) + 1)


class Trie:
    """A double-array trie: ``check[base[state] + symbol] == state`` for every arc.

    Words are numbered, the most used first, and a word is two symbols, the digits of its number.
    So a state has few arcs, close together. States are places in the arrays, the first the start.
    """

    def __init__(self, phrases: list[bytes]):
        self.phrases = phrases
        split = [p.split(b" ") for p in phrases]
        ranked = Counter(w for words in split for w in words).most_common()
        self.number = {word: i for i, (word, _) in enumerate(ranked, 1)}
        self._fill(split)

    def _fill(self, split: list[list[bytes]]) -> None:
        n, deepest = len(split), max(map(len, split), default=0)
        sizes = np.fromiter(map(len, split), np.int64, n)
        ids = np.zeros((n, deepest), np.int64)
        for i, words in enumerate(split):
            ids[i, : len(words)] = [self.number[w] for w in words]
        self.first = max(RADIX, (len(self.number) >> RADIX_BITS) + 1) + 1  # no arc ends before
        self.lowest, self.chance = self.first, np.random.default_rng(0)
        self.used = np.zeros(4 * self.first, bool)
        self.base, self.check = np.zeros(4 * self.first, np.int64), np.full(4 * self.first, -1, np.int64)
        self.used[: self.first] = True
        at = np.zeros(n, np.int64)  # the state each phrase has come to
        reached = []
        for depth in range(deepest):
            on = np.flatnonzero(sizes > depth)
            for symbols in digits(ids[on, depth]):
                arcs, back = np.unique(at[on] * self.first + symbols, return_inverse=True)
                at[on] = self._placed(arcs // self.first, arcs % self.first)[back]
            whole = on[sizes[on] == depth + 1]
            reached.append((whole, at[whole]))
        length = int(np.flatnonzero(self.used)[-1]) + self.first + 1
        self._grown(length)
        self.base, self.check = (x[:length].astype(np.int32) for x in (self.base, self.check))
        self.accept = np.full(length, -1, np.int32)
        for whole, states in reached:
            self.accept[states] = whole
        del self.used

    def _grown(self, length: int) -> None:
        more = length - len(self.used)
        if more > 0:
            more = max(more, len(self.used) // 2)
            self.used = np.concatenate([self.used, np.zeros(more, bool)])
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _placed(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Places for arcs sorted by parent; the parents with most arcs choose first."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        sizes = np.diff(np.r_[starts, len(parents)])
        places = np.empty(len(parents), np.int64)
        for size in np.unique(sizes)[::-1].tolist():
            rows = starts[sizes == size][:, None] + np.arange(size)
            if size >= 32:
                for row in rows:
                    places[row] = self._fit(symbols[row]) + symbols[row]
                    self.used[places[row]] = True
            else:
                places[rows] = self._fitted(symbols[rows])
        self.base[parents] = places - symbols
        self.check[places] = parents
        return places

    def _fit(self, symbols: np.ndarray) -> int:
        """A base for one state with many arcs; a stretch without any is not tried again."""
        while True:
            self._grown(self.lowest + 2 * self.first)
            bases = np.flatnonzero(~self.used[self.lowest : self.lowest + 64]) + self.lowest - symbols[0]
            if len(bases):
                bases = bases[~self.used[bases[:, None] + symbols].any(1)]
            if len(bases):
                return int(bases[0])
            self.lowest += 64

    def _fitted(self, symbols: np.ndarray) -> np.ndarray:
        """Places for states with equally many arcs, a row each, in rounds of drawn bases.

        A state whose draw is taken, or claimed by a later row of the same round, draws again; the
        last few look for a base one by one.
        """
        places = np.empty_like(symbols)
        left = np.arange(len(symbols))
        claimed_by = np.empty(0, np.int64)
        while len(left) > FEW_LEFT:
            free = np.flatnonzero(~self.used[: len(self.used) - self.first])
            if len(free) < 2 * symbols.shape[1] * len(left):
                self._grown(len(self.used) + 2 * symbols.shape[1] * len(left))
                continue
            tried = left[:MOST_DRAWN]
            drawn = self.chance.choice(free, len(tried), replace=False)
            own = (drawn - symbols[tried, 0])[:, None] + symbols[tried]
            if len(claimed_by) < len(self.used):
                claimed_by = np.empty(len(self.used), np.int64)
            open_ = ~self.used[own].any(1)
            claimed_by[own[open_]] = tried[open_][:, None]
            open_ &= (claimed_by[own] == tried[:, None]).all(1)
            places[tried[open_]] = own[open_]
            self.used[own[open_]] = True
            if open_.sum() < len(tried) // 16:
                self._grown(len(self.used) + len(self.used) // 4)
            left = np.r_[tried[~open_], left[MOST_DRAWN:]]
        for row in left:
            places[row] = self._fit(symbols[row]) + symbols[row]
            self.used[places[row]] = True
        return places

    def counted(self, tokens: list[bytes], counts: np.ndarray) -> None:
        """Add the occurrences of every phrase to ``counts``."""
        ids = np.fromiter(map(self.number.get, tokens, repeat(0)), np.int64, len(tokens))
        both = digits(ids)
        place = np.flatnonzero(ids)
        state = np.zeros(len(place), np.int64)
        while len(place):
            for symbols in both:
                following = self.base[state] + symbols[place]
                on = self.check[following] == state
                place, state = place[on], following[on]
            hits = self.accept[state]
            counts += np.bincount(hits[hits >= 0], minlength=len(counts))
            place = place + 1
            inside = place < len(ids)
            place, state = place[inside], state[inside]

    def packed(self) -> bytes:
        words = sorted(self.number, key=self.number.__getitem__)
        parts = [
            _END.join(self.phrases), _END.join(words), self.base.tobytes(), self.check.tobytes(), self.accept.tobytes()
        ]
        sizes = np.array([len(p) for p in parts], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))

    @classmethod
    def unpacked(cls, blob: bytes) -> Trie:
        data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
        ends = 40 + np.cumsum(np.frombuffer(data[:40], np.int64))
        parts = [data[a:b] for a, b in zip([40, *ends], ends, strict=False)]
        self = cls.__new__(cls)
        self.phrases = bytes(parts[0]).split(_END)
        self.number = {word: i for i, word in enumerate(bytes(parts[1]).split(_END), 1)}
        self.base, self.check, self.accept = (np.frombuffer(p, np.int32) for p in parts[2:])
        return self


def _built(batches: Iterable[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """One packed trie per set and language, with a NULL block, and its phrases in blocks; the rows come
    sorted by both."""

    def told(key, phrases):
        yield _row(part=key[0], lang=key[1], trie=Trie(phrases).packed())
        press = zstandard.ZstdCompressor(level=3)
        for block, at in enumerate(range(0, len(phrases), together)):
            listed = press.compress(_END.join(phrases[at : at + together]))
            yield _row(part=key[0], lang=key[1], block=block, phrases=listed)

    key, phrases = None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", "lang", "phrase"))
        for part, lang, phrase in zip(*columns, strict=True):
            if key != (part, lang):
                if phrases:
                    yield from told(key, phrases)
                key, phrases = (part, lang), []
            phrases.append(phrase.encode())
    if phrases:
        yield from told(key, phrases)


def _row(**cells) -> pa.RecordBatch:
    kinds = [("part", pa.int64()), ("lang", pa.string()), ("trie", pa.binary()), ("block", pa.int64()), ("phrases", pa.binary())]
    return pa.RecordBatch.from_pylist([cells], schema=pa.schema(kinds))


def _tries(phrases: DataFrame, set_bytes: int) -> tuple[DataFrame, int]:
    """(part, lang, trie, block, phrases), written, and the number of sets."""
    size = F.sum(F.octet_length("phrase") + 40)
    sets = max(1, math.ceil((phrases.agg(size.alias("size")).first()["size"] or 0) / set_bytes))
    together = COUNTED_TOGETHER
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("lang", "phrase"), F.lit(sets)))
    return written(
        dealt.repartition("part", "lang")
        .sortWithinPartitions("part", "lang", "phrase")
        .mapInArrow(lambda batches: _built(batches, together), "part long, lang string, trie binary, block long, phrases binary")
    ), sets


def _trie_counts(rows: DataFrame, tries: DataFrame, part: int) -> DataFrame:
    """(part, lang, block, counts) of one set per task: how often each phrase of a block occurs, compressed;
    in the first set also the number of all words, with a NULL block."""
    own = tries.where((F.col("part") == part) & F.col("trie").isNotNull()).select("lang", "trie").collect()  # one set
    together = COUNTED_TOGETHER
    sent = rows.sparkSession.sparkContext.broadcast({r["lang"]: bytes(r["trie"]) for r in own})

    def run(batches):
        loaded: dict[str, Trie | None] = {}
        counts: dict[str, np.ndarray] = {}
        words: Counter[str] = Counter()
        for lang, tokens in _per_language(batches):
            words[lang] += len(tokens) - tokens.count(_END)
            if lang not in loaded:
                blob = sent.value.get(lang)
                loaded[lang] = blob and Trie.unpacked(blob)
                if blob:
                    counts[lang] = np.zeros(len(loaded[lang].phrases), np.int64)
            if loaded[lang]:
                loaded[lang].counted(tokens, counts[lang])
        press = zstandard.ZstdCompressor(level=1)
        cells = [
            (lang, block, press.compress(found[at : at + together].tobytes()))
            for lang, found in counts.items()
            for block, at in enumerate(range(0, len(found), together))
            if found[at : at + together].any()
        ]
        if part == 0:
            cells += [(lang, None, press.compress(np.int64(n).tobytes())) for lang, n in words.items()]
        for lang, block, blob in cells:
            columns = [pa.array([part]), pa.array([lang]), pa.array([block], pa.int64()), pa.array([blob])]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "lang", "block", "counts"])

    return rows.mapInArrow(run, "part long, lang string, block long, counts binary")


def _summed(counts: DataFrame, tries: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases that occur ``least`` times, and of all words as phrase NULL."""

    def told(key, total, listed):
        lang, block = key[1:]
        total = np.broadcast_to(total, 1 if block is None else len(listed))
        places = np.flatnonzero(total >= (0 if block is None else least))
        texts = pa.array([listed and listed[i] for i in places], pa.binary()).cast(pa.string())
        columns = [pa.array([lang] * len(places), pa.string()), texts, pa.array(total[places], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])

    def run(batches):
        press, last, total, listed = zstandard.ZstdDecompressor(), None, np.int64(0), None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "block")), strict=True)
            for i, key in enumerate(keys):
                if key != last:
                    if last:
                        yield told(last, total, listed)
                    last, total, listed = key, np.int64(0), None
                if batch.column("phrases")[i].is_valid:
                    listed = press.decompress(batch.column("phrases")[i].as_py()).split(_END)
                else:
                    total = total + np.frombuffer(press.decompress(batch.column("counts")[i].as_py()), np.int64)
        if last:
            yield told(last, total, listed)

    named = tries.where(F.col("block").isNotNull()).select(
        "part", "lang", "block", F.lit(None).cast("binary").alias("counts"), "phrases"
    )
    key = ["part", "lang", "block"]
    return (
        counts.withColumn("phrases", F.lit(None).cast("binary")).unionByName(named)
        .repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(run, "lang string, phrase string, n long")
    )


def frequencies(
    docs: DataFrame,
    most_words: int = MOST_WORDS,
    least: int = LEAST,
    bits: int = BITS,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """(lang, phrase, n), written: phrases of one word up that occur ``least`` times.

    Words come only if they are in such a phrase. The row with phrase NULL counts all words.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    rows = docs.select(lang.alias("lang"), F.col("text"))
    tries, sets = _tries(candidates(rows, most_words, least, bits), set_bytes)
    found = _trie_counts(rows, tries, 0)
    for part in range(1, sets):
        found = found.unionByName(_trie_counts(rows, tries, part))
    return written(_summed(found, tries, least))


# --- scores -------------------------------------------------------------------------------------


def _joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _cuts(phrases: DataFrame) -> DataFrame:
    """A row per place at which a phrase can be cut in two."""
    words, size = F.col("words"), F.size("words")
    return phrases.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*",
        _joined(words, F.lit(1), F.col("k")).alias("left_part"),
        _joined(words, F.col("k") + 1, size - F.col("k")).alias("right_part"),
    )


def _inside(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase, longest): the greatest count among longer candidates a phrase lies in."""
    size = F.size("words")
    longer = phrases.where(size > 2).select(
        "lang", "words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("part_size")
    )
    parts = longer.select(
        "lang", "words", "a", "part_size",
        F.explode(F.sequence(F.lit(1), size - F.col("part_size") + 1)).alias("start"),
    )
    return (
        parts.groupBy("lang", _joined(F.col("words"), F.col("start"), F.col("part_size")).alias("phrase"))
        .agg(F.max("a").alias("longest"))
        .withColumn("bound", 100 * F.col("longest"))
    )


def collocations(
    docs: DataFrame,
    most_words: int = MOST_WORDS,
    least: int = LEAST,
    inside_percent: int = INSIDE_PERCENT,
    top: int = TOP,
    bits: int = BITS,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counted = frequencies(docs, most_words, least, bits, set_bytes)
    phrases = written(
        counted.where(F.instr("phrase", " ") > 0).select(
            "lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words")
        )
    )
    parts = counted.where("phrase IS NOT NULL")
    cuts = written(_cuts(phrases).select("lang", "phrase", "a", "k", "left_part", "right_part"))
    for side, name in (("left_part", "l"), ("right_part", "r")):
        cuts = cuts.join(
            parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side]
        )
    wide = {c: F.col(c).cast("decimal(20,0)") for c in "alr"}
    exact = cuts.select("lang", "phrase", "k", "a", "l", "r", *[v.alias(f"wide_{c}") for c, v in wide.items()])
    scored = exact.withColumn("score", F.expr(f"({SCALE}BD * wide_a * wide_a) div (wide_l * wide_r)"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = written(_inside(phrases, inside_percent))
    kept = (
        worst.join(inside, ["lang", "phrase"], "left")
        .where(F.col("bound").isNull() | (F.col("bound") < inside_percent * F.col("a")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    sizes = counted.where("phrase IS NULL").select("lang", "n")
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
