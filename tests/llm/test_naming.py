"""Candidates are named once by the texts that name first, or else by the others; none is lost."""

from __future__ import annotations

import collections
import random

import xxhash

from taquilla.llm import collocations


def test_no_candidate_is_lost_or_named_by_all_tasks(spark):
    rng = random.Random(3)
    share = collocations.NAMING_SHARE
    first = lambda t: xxhash.xxh3_64_intdigest(t, seed=2) % share == 0
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(40)) for _ in range(200)]
    # phrases that only texts of one side have
    texts += [t for t in (f"only others {i}" for i in range(200)) if not first(t)][:20]
    texts += [t for t in (f"just named {i}" for i in range(400)) if first(t)][:20]
    rows = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(8)
    counts = collections.Counter()
    for t in texts:
        w = t.split()
        counts.update(" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1))
    frequent = {p for p, n in counts.items() if n >= 10}
    assert {"only others", "just named"} <= frequent
    for bits in (28, 12):
        found = {r["phrase"] for r in collocations.candidates(rows, 3, 10, bits).collect()}
        assert frequent <= found
    sums = collocations._hash_sums(rows, 2, {}).groupBy("hash").sum("n").collect()
    low = (1 << collocations.NAMED_BIT) - 1
    assert sorted(r[1] & low for r in sums) == sorted(n for p, n in counts.items() if p.count(" ") == 1)
    assert any(r[1] <= low for r in sums)


def test_counts_leave_a_task_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "COUNTED_TOGETHER", 8)
    rng = random.Random(4)
    texts = [(lang, " ".join(f"w{rng.randrange(9)}" for _ in range(50))) for lang in ("en", None) for _ in range(60)]
    rows = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    expected = collections.Counter()
    for lang, t in texts:
        w, key = t.split(), lang or "und"
        expected[key, None] += len(w)
        expected.update((key, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    expected = {k: n for k, n in expected.items() if n >= 10}
    for set_bytes in (96 << 20, 20_000):
        found = collocations.frequencies(rows, bits=20, set_bytes=set_bytes).collect()
        assert {(r["lang"], r["phrase"]): r["n"] for r in found} == expected and len(found) == len(expected)
    sent = collocations.candidates(rows.fillna("und"), 3, 10, 20)
    tries, _ = collocations._tries(sent, 96 << 20)
    # blocks of eight phrases and the number of words, for each of five tasks and two languages
    blocks = -(-sent.count() // 8) + 2
    assert collocations._trie_counts(rows.fillna("und"), tries, 0).count() <= 5 * (blocks + 2)
