"""Spelling variants against plain Python: every pair compared, forms followed one by one."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taquilla.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, root int"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def invented():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(25)]
    stems += ["prefix" + "".join(rng.choice("ab") for _ in range(3)) for _ in range(12)]
    stems += ["".join(rng.choice("ab") for _ in range(3)) + "suffix" for _ in range(12)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "aaabaa", "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499]
    rows = [(i, None, "w", "n", 1) for i in range(2)] + [(2, "", "w", "n", 1), (None, " ".join(stems), "w", "n", 1)]
    for i in range(400):
        rows.append((3 + i, "×".join(rng.choices(stems, k=3)) + " 12 " + rng.choice(stems).upper() + "-É-" + rng.choice(stems), "w", "n", 1))
    rows += [rows[-1]] * 3
    rows.append((5000, " ".join(rng.choices(stems, k=20_000)), "w", "n", 1))
    return rows


def expected(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {(w, forms[w], root(w), words[w], len(near[w]), words.get(forms[w])) for w in words}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))
    return spark.createDataFrame(invented(), SCHEMA).repartition(3)


@pytest.mark.parametrize("most", [2, 5, spelling.MOST_COMPOSED])
def test_variants_equal_plain_python(docs, most):
    """Small partitions are split over and over and still give each pair once."""
    found = spelling.variants(docs, most).collect()
    wanted = expected(invented())
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    assert any(r[1] for r in wanted) and max(r[4] for r in wanted) > 2


def test_empty_table(spark, docs):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, "", "", 1)], SCHEMA)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=4, max_size=5), max_size=40))
def test_composition_gives_each_pair_once(words):
    found = list(spelling.near_pairs(sorted(words), 4, 0, 0))
    pairs = {frozenset(p) for p in found}
    assert len(pairs) == len(found)
    assert pairs == {
        frozenset((a, b)) for a in words for b in words if one_edit(a, b) and min(len(a), len(b)) == 4
    }


@given(st.sets(st.text("ab", max_size=6), min_size=1, max_size=30))
def test_acceptors_are_minimal_and_number_their_words(words):
    machine = spelling.Acceptors()
    ordered = sorted(words)
    state = machine.of(ordered)

    def accepted(s):
        own = [""] if machine.accepts[s] else []
        return own + [c + x for c, (t, _) in machine.arcs[s].items() for x in accepted(t)]

    assert accepted(state) == ordered and machine.sizes[state] == len(ordered)
    languages = [tuple(accepted(s)) for s in range(len(machine.arcs))]
    assert len(set(languages)) == len(languages)
