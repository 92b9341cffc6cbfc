"""Phrase collocations against plain Python, and the tries against a plain scan."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taquilla.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, words string, score int"


def invented():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["Ärger", "É", "x\x1cy", "\x00", "ÿ"]
    texts = [None, "", " \t. ", "one", "New York City. new york city! NEW YORK" * 12, "a a a a a a a a a a a a a a a b"]
    texts += [" ".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; "]) for _ in range(300)) for _ in range(30)]
    texts += ["of the state of the union is " * 300, "long" * 20_000 + " tail " + "long" * 20_000 + " tail"] * 5
    langs = ["w1", None, "und", "w2", ""]  # called like words
    rows = [(i, t, langs[i % 5], "p", 1, "w", 2) for i, t in enumerate(texts)]
    return rows + rows[10:14] + [(None, "new york city " * 3, "en", "p", 1, "w", 2)]


def counts_of(rows, most_words):
    found, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for size in range(1, most_words + 1):
                for i in range(len(words) - size + 1):
                    found["und" if lang is None else lang, " ".join(words[i : i + size])] += 1
    return found, total


def expected(rows, most_words=3, top=2000):
    f, total = counts_of(rows, most_words)
    chosen = {k: a for k, a in f.items() if a >= 10 and " " in k[1]}
    scored = collections.defaultdict(list)
    for (lang, phrase), a in chosen.items():
        words = phrase.split(" ")
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        longer = [
            b for (other, p), b in chosen.items()
            if other == lang and p != phrase and f" {phrase} " in f" {p} "
        ]
        if not any(100 * b >= 50 * a for b in longer):
            scored[lang].append((-score, -a, phrase.encode(), left, right))
    found = set()
    for lang, rows_ in scored.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            found.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return found


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))
    return spark.createDataFrame(invented(), SCHEMA).repartition(3)


@pytest.mark.parametrize(
    "options",
    [{}, {"bits": 15, "set_bytes": 4000}, {"top": 3}, {"most_words": 4, "bits": 20}],
    ids=["plain", "full map, many sets", "few", "four words"],
)
def test_collocations_equal_plain_python(docs, options):
    found = collocations.collocations(docs, **{"bits": 20, **options}).collect()
    wanted = expected(invented(), options.get("most_words", 3), options.get("top", 2000))
    assert len(found) == len(wanted) > 5 and {tuple(r) for r in found} == wanted


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none, bits=16).collect() == []
    odd = spark.createDataFrame([(1, None, None, "", 1, "", 1), (2, "a b", "en", "", 1, "", 1)], SCHEMA)
    assert collocations.collocations(odd, bits=16).collect() == []


def test_products_beyond_64_bits_stay_exact(spark, docs):
    big = 3_000_000_000_000
    row = spark.sql(
        f"SELECT ({collocations.SCALE}BD * a * a) div (l * r) AS score FROM "
        f"(SELECT cast({big} AS decimal(20,0)) a, cast({big + 7} AS decimal(20,0)) l, cast({big + 1} AS decimal(20,0)) r)"
    ).first()
    assert row["score"] == 1_000_000 * big * big // ((big + 7) * (big + 1))


@settings(max_examples=60, deadline=None)
@given(
    st.sets(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=3).map(" ".join), min_size=1, max_size=60),
    st.lists(st.sampled_from([*"abcdefghxy", "."]), max_size=200),
)
def test_tries_count_like_a_plain_scan(phrases, words):
    listed = sorted(p.encode() for p in phrases)
    trie = collocations.Trie.unpacked(collocations.Trie(listed).packed())
    counts = np.zeros(len(listed), np.int64)
    trie.counted(collocations.tokens_of([" ".join(words)]), counts)
    plain = [
        sum(words[i : i + p.count(b" ") + 1] == p.decode().split(" ") for i in range(len(words))) for p in listed
    ]
    assert counts.tolist() == plain
