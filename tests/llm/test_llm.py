"""The operators on training data against brute force, on small tables with odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taquilla.llm import (
    bpe,
    chat,
    licenses,
    lm_score,
    near_dedup,
    packing,
    quality_model,
    quality_rules,
    search,
    substring_dedup,
)
from taquilla.llm.byte_bpe import ByteBpe, wide
from taquilla.llm.word_bpe import WordBpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = "Don't  stop\t12345 ß ÀÉ x\x1cy 漢字 🎉!! <|endoftext|>a\n\n \r\nend "


def invented() -> list[tuple]:
    """Prose with copies, near copies, shared passages, odd rows and a very long text."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, base = prose(70), prose(220)
    texts: list[str | None] = [None, "", " \n ", "one", "two words", ODD, "same " * 400]
    texts += [" ".join(prose(60) + passage + prose(rng.randrange(60))) for _ in range(6)]
    texts += [" ".join(base)] * 3
    for edits in (1, 2, 3, 20):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts.append("\n".join(" ".join(prose(9)) for _ in range(900)))
    rows = [(i, t, "en" if i % 2 else None, "s", None, "x") for i, t in enumerate(texts)]
    return rows + [(7, " ".join(base), "en", "s", 1, "x"), (None, " ".join(base), "en", "s", 1, "x")]


@pytest.fixture(scope="module")
def rows():
    return invented()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return text.encode().split() if text else []


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_substring_dedup(docs, rows, empty):
    first = {}
    for doc_id, text, *_ in rows:
        w = words_of(text)
        for i in range(len(w) - 49) if doc_id is not None else ():
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, doc_id), doc_id)
    expected = collections.Counter()
    for doc_id, text, *_ in rows:
        w, gone = words_of(text), set()
        for i in range(len(w) - 49) if doc_id is not None else ():
            if first[tuple(w[i : i + 50])] < doc_id:
                gone |= set(range(i, i + 50))
        expected[doc_id, len(w), b" ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    found = substring_dedup.repeat_spans(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, bytes(r.kept)) for r in found) == expected
    cleaned = substring_dedup.without_repeats(docs)
    assert cleaned.columns == docs.columns
    got = collections.Counter(
        (r.doc_id, b" ".join(words_of(r.text))) for r in cleaned.collect()
    )
    assert got == collections.Counter({(d, k): n for (d, _, k), n in expected.items()})
    assert substring_dedup.repeat_spans(empty).count() == 0


def test_packing(docs, rows, empty):
    limit = 256
    library = Tokenizer.from_file(WORD_BPE)
    expected = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for number, at in enumerate(range(0, len(ids), limit)):
            own = np.array(ids[at : at + limit], "<u4").tobytes()
            expected[doc_id, number, at, len(own) // 4, zlib.crc32(own)] += 1
    found = packing.pack(docs, WORD_BPE, limit)
    assert counted(found, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    by_sequence = collections.defaultdict(list)
    for r in found.collect():
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= limit
    sizes = [k[3] for k in expected.elements()]
    assert len(by_sequence) <= len(packing.best_fit(sizes, limit)) + 1
    assert packing.pack(empty, WORD_BPE).count() == 0


def shingles(text):
    w = text.encode().lower().split() if text else []
    size = min(3, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def check_near_dedup(docs, rows):
    least = {d: d for d, *_ in rows}

    def find(x):
        return x if least[x] == x else find(least[x])

    known = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y) and find(a) != find(b):
                a_, b_ = sorted((find(a), find(b)))
                least[b_] = a_
    expected = collections.Counter()
    for d, t, *_ in rows:
        component = None if d is None else find(d)
        expected[d, len(shingles(t)), component, component == d] += 1
    found = near_dedup.near_duplicates(docs)
    assert counted(found, "doc_id", "n_shingles", "component_id", "kept") == expected
    kept = near_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for k, n in expected.items() if k[3])


def test_near_dedup(docs, rows, empty):
    check_near_dedup(docs, rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_of_many_variants_around_the_threshold(spark, docs):
    rng = random.Random(9)
    base = [f"v{rng.randrange(400)}" for _ in range(130)]
    rows = []
    for i in range(150):
        words = base[: rng.randrange(115, 131)]
        for n in range(rng.randrange(2, 12)):
            words[rng.randrange(len(words))] = f"own{i}" if n % 2 else f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words), "en", "s", 1, "x"))
    check_near_dedup(spark.createDataFrame(rows, docs.schema).repartition(3), rows)


def test_pairs_by_shingle_find_every_pair(spark, docs):
    """Alone, without the links that the steps before find."""
    rng = random.Random(10)
    base = [f"v{rng.randrange(400)}" for _ in range(60)]
    texts = []
    for i in range(60):
        words = base[: rng.randrange(45, 61)]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    expected = {
        (a, b)
        for b, y in enumerate(sets)
        for a, x in enumerate(sets[:b])
        if 100 * len(x & y) >= 85 * len(x | y) and a % 7 != b % 7
    }
    nodes = [(i, len(s), i % 7) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(nodes, "node long, n_shingles long, component long")
    held = near_dedup.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {tuple(r) for r in near_dedup._pairs_by_shingle(nodes, held).collect()}
    assert expected and expected <= found
    assert all(a % 7 != b % 7 for a, b in found)


def test_index_finds_every_pair_within_the_distance():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 16, (200, near_dedup.SYMBOLS)).astype(np.uint16)
    other = one.copy()
    for row in other:
        row[rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)] ^= 1
    both = near_dedup.index_keys(one), near_dedup.index_keys(other)
    assert all(np.intersect1d(a, b).size for a, b in zip(*both, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.sampled_from(["user", "assistant", "a\\[INST]</s>"]))
def test_chat_round_trip(text, role):
    text = text + "</s>[INST] ok [/INST]\\"
    turns = [(role, text), ("assistant", text[::-1]), ("user", "")]
    made = list(chat.examples(turns))
    assert chat.read_back(made[-1]["formatted"]) == turns
    trained = [e for e in made if e["target"] is not None]
    for e in trained:
        masked = e["formatted"][e["mask_start"] : e["mask_end"]]
        assert chat.unescaped(masked) == turns[e["target"]][1]
        assert chat.read_back(e["formatted"]) == turns[: e["target"] + 1]


def test_chat_odd_rows(spark, docs):
    given_ = [(1, 0, "user", None), (1, 1, "assistant", "a"), (2, 0, None, "x"), (3, 0, "assistant", "")]
    made = spark.createDataFrame(given_, "conv_id long, turn int, role string, text string")
    found = chat.digests(chat.prefix_target_examples(made))
    assert counted(found, "conv_id", "n_turns", "loss_chars") == {(1, 2, 1): 1, (2, 1, 0): 1, (3, 1, 0): 1}
    assert chat.digests(chat.prefix_target_examples(made.limit(0))).count() == 0


def test_search(docs, rows, empty):
    terms = [(d, collections.Counter(t.encode().lower().split())) for d, t, *_ in rows if t is not None and d is not None]
    df = collections.Counter(w for _, c in terms for w in c)
    n, mean = len(terms), sum(c.total() for _, c in terms) / len(terms)
    expected = set()
    for q, asked in terms:
        if q % 4:
            continue
        scores = []
        for d, c in terms:
            s = sum(
                m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2
                / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean))
                for w, m in asked.items() if w in c
            )
            if s > 0 and d != q:
                scores.append((-round(s, 6), d))
        expected |= {(q, i + 1, round(-s, 6)) for i, (s, _) in enumerate(sorted(scores)[:5])}
    found = search.search(docs, docs.where("doc_id % 4 = 0"), 5)
    assert {(r.query_id, r.rank, round(r.score, 6)) for r in found.collect()} == expected
    assert search.search(empty, empty).count() == 0


def every_score(index, own, terms, weights, k):
    """The best of all documents, each scored by itself."""
    weight_of = dict(zip(terms.tolist(), weights.tolist(), strict=True))
    found, start = [], 0
    for doc_id, pairs in zip(index.ids.tolist(), index.pairs.tolist(), strict=True):
        score = 0.0
        for pair in range(start, start + pairs):
            score += weight_of.get(int(index.terms[index.of_doc[pair]]), 0.0) * index.doc_part[pair]
        start += pairs
        if score > 0 and doc_id != own:
            found.append((-round(score, 9), doc_id))
    return sorted(found)[:k]


@pytest.mark.parametrize("cells", [0, 20_000, search.MOST_CELLS])
def test_blocks_are_skipped_without_loss(monkeypatch, cells):
    monkeypatch.setattr(search, "MOST_CELLS", cells)
    rng = np.random.default_rng(2)
    words = [[b"t%d" % x for x in rng.zipf(1.4, 40) % 500] for _ in range(1500)]
    words += words[:30] + [[], [b"t1"]]
    index = search.Shard(search.indexed(np.arange(len(words)), words), 40.0)
    for n, own in ((12, -1), (1, 7), (60, 3)):
        terms = np.sort(rng.choice(index.terms, n, replace=False))
        weights = rng.random(n)
        every = every_score(index, own, terms, weights, 10)
        assert index.top(own, index.places(terms), weights, 10) == every
        floor = -every[4][0] - 1e-6
        above = [x for x in every if -x[0] >= floor]
        assert index.top(own, index.places(terms), weights, 10, floor)[: len(above)] == above


def test_most_documents_are_never_scored_by_all_terms(monkeypatch):
    rng = np.random.default_rng(3)
    words = [[b"t%d" % x for x in rng.zipf(1.2, 60) % 3000] for _ in range(4000)]
    index = search.Shard(search.indexed(np.arange(len(words)), words), 60.0)
    terms, counts = np.unique(index.terms[index.of_doc[:60]], return_counts=True)
    weights = counts * np.log(1 + 4000 / (1 + index.df[np.searchsorted(index.terms, terms)]))
    seen, common = [], search.Shard._common

    def counted(self, row, weight, docs):
        seen.append(len(row) * len(docs))
        return common(self, row, weight, docs)

    monkeypatch.setattr(search.Shard, "_common", counted)
    found = index.top(-1, index.places(terms), weights, 10)
    asked = (index.row[np.searchsorted(index.terms, terms)] >= 0).sum()
    assert found == every_score(index, -1, terms, weights, 10)
    assert asked and sum(seen) < asked * 4000


def test_classifier_learns_and_odd_rows_have_scores(spark, docs, empty):
    rng = random.Random(3)
    made, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = [rng.choice("the cat sat on a mat and saw dogs run".split()) for _ in range(60)]
        text = " ".join(words) if good else " ".join(w + "###" for w in words)
        made.append((i, text, None, None, len(text), ""))
        labels.append((i, int(good)))
    table = spark.createDataFrame(made, SCHEMA)
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    machine = quality_model.train(table, marked)
    scored = quality_model.score(table, machine).join(marked, "doc_id").where("held_out")
    assert scored.where("predicted <> quality").count() == 0 and scored.count() > 60
    odd = quality_model.score(docs, machine)
    assert odd.count() == docs.count() and odd.where("score between 0 and 1").count() == docs.count()
    assert quality_model.without_rejected(docs, machine).columns == docs.columns
    untrained = quality_model.train(empty, marked.limit(0))
    assert quality_model.score(empty, untrained).count() == 0


def test_pairwise_identity():
    rng = np.random.default_rng(5)
    machine = quality_model.Machine(0.3)
    machine.linear = rng.normal(size=quality_model.SIZE)
    machine.factors = rng.normal(size=(quality_model.SIZE, quality_model.FACTORS))
    f = quality_model.features(["a b c d e"], [9], quality_model.word_hashes())
    places, values, _ = quality_model._with_structure(f, machine)
    pairs = sum(
        machine.factors[places[i]] @ machine.factors[places[j]] * values[i] * values[j]
        for i in range(len(places)) for j in range(i)
    )
    whole = 0.3 + machine.linear[places] @ values + pairs
    assert quality_model.margins(f, machine)[0] == pytest.approx(whole)


def test_quality_rules(spark, docs, rows, empty):
    labels = spark.createDataFrame([(9, 1)], "doc_id long, quality int")
    expected = collections.Counter()
    for d, t, *_ in rows:
        w = words_of(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = collections.Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        chars = sum(len(x.decode()) for x in w)
        expected[d, len(w), chars, len(lines) - len(set(lines)), len(covered), failed, not failed] += 1
    columns = ["doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert counted(quality_rules.judge(docs, labels), *columns) == expected
    kept = quality_rules.without_rejected(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for k, n in expected.items() if k[-1])
    assert quality_rules.judge(empty, labels).count() == 0


def test_binomial_bound_is_exact(spark):
    rows = [(n, x) for n in (10, 500, 5000) for x in (0, 1, 7)]
    frame = spark.createDataFrame(rows, "n long, x long")
    level = 0.01
    found = frame.withColumn("ok", quality_rules.harmless(F.col("n"), F.col("x"), 0.01, F.lit(level)))
    for r in found.collect():
        tail = sum(math.comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(r.x + 1))
        assert r.ok == (tail <= level)


def test_lm_scores(docs, rows, empty):
    total, texts = collections.Counter(), [(d, words_of(t)) for d, t, *_ in rows]
    grams = lambda w: [tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    for _, w in texts:
        total.update(grams(w))
    size = sum(len(w) for _, w in texts)
    expected = collections.Counter()
    for d, w in texts:
        own, score = collections.Counter(grams(w)), 0.0
        for i in range(len(w)):
            top = min(3, i + 1)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if total[g] > own[g]:
                    context = total[g[:-1]] - own[g[:-1]] if n > 1 else size - len(w)
                    score += (top - n) * math.log(0.4) + math.log((total[g] - own[g]) / context)
                    break
            else:
                score += (top - 1) * math.log(0.4) + math.log(0.5 / (size - len(w)))
        expected[d, len(w), round(score, 5)] += 1
    found = collections.Counter(
        (r.doc_id, r.n_words, round(r.log_score, 5)) for r in lm_score.score(docs).collect()
    )
    assert found == expected
    assert lm_score.score(empty).count() == 0


def test_bpe(docs, rows, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    expected = collections.Counter()
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        expected[d, len(ids), raw, hashlib.sha256(text.encode()).hexdigest()] += 1
    found = bpe.encode(docs, BYTE_BPE)
    assert counted(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    assert bpe.encode(empty, BYTE_BPE).count() == 0


@pytest.fixture(scope="module")
def byte_bpe():
    return ByteBpe(BYTE_BPE)


@pytest.fixture(scope="module")
def word_bpe():
    return WordBpe(WORD_BPE)


_TEXT = st.text(st.sampled_from("aB1 .,'\n\té漢<|>endoftext\x1c ") | st.characters(exclude_categories=["Cs"]), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(_TEXT, max_size=5))
def test_parts_are_repaired_to_the_whole(byte_bpe, texts):
    ids = bpe.encode_in_parts(byte_bpe, [byte_bpe.encode(t) for t in texts])
    whole = byte_bpe.library.encode("".join(texts), add_special_tokens=False).ids
    assert wide(ids) == np.array(whole, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(_TEXT)
def test_word_ids_equal_the_library(word_bpe, text):
    whole = word_bpe.library.encode(text, add_special_tokens=False).ids
    assert word_bpe.ids(text) == np.array(whole, "<u4").tobytes()


def test_chunks_join_to_the_text_and_follow_content():
    rng = random.Random(8)
    data = "".join(rng.choice("abc é漢 ") for _ in range(40_000)).encode()
    cut = bpe.chunks(data)
    assert b"".join(cut) == data and all(c.decode() for c in cut)
    moved = bpe.chunks(b"something else in front " + data)
    assert len(set(cut) & set(moved)) > 0.8 * len(cut)


def test_licenses(spark, docs, empty):
    text = re.sub(r"\blicense\b", "LICENCE", licenses.KNOWN[1][1].lower())
    made = [
        (1, f"Copyright 2020 Somebody\n{text}"),
        (2, "prose\nreleased under the MIT licence!\nmore"),
        (3, "Released under the MIT License. Or not."),
        (4, None),
        (5, ""),
        (None, "All rights reserved"),
    ]
    found = licenses.scan(
        spark.createDataFrame(made, "doc_id long, text string"), licenses.known_texts(spark)
    )
    assert counted(found, "doc_id", "whole_license", "n_notices", "licenses") == {
        (1, "Apache-2.0", 0, "Apache-2.0"): 1,
        (2, None, 1, "MIT"): 1,
        (3, None, 0, ""): 1,
        (4, None, 0, ""): 1,
        (5, None, 0, ""): 1,
        (None, "LicenseRef-All-Rights-Reserved", 1, "LicenseRef-All-Rights-Reserved"): 1,
    }
    assert licenses.scan(empty, licenses.known_texts(spark)).count() == 0
