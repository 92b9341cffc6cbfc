"""The stages of the corpus pipeline against plain Python, on small tables."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from taquilla.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def steps(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))


def five_word_runs(text):
    w = text.encode().lower().split() if text else []
    size = min(5, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def least_of_components(rows):
    """Ids that brute force keeps: the least of each component at 0.8 of five-word runs."""
    parent = {d: d for d, *_ in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    sets = [(d, five_word_runs(t)) for d, t, *_ in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d for d in parent if find(d) == d}


def edited(seed=11):
    """Texts with blocks added, cut or replaced, on both sides of the stage's threshold."""
    rng = random.Random(seed)

    def prose(n):
        return [f"v{rng.randrange(3000)}" for _ in range(n)]

    base = prose(200)
    texts = [base, base + prose(40), base[30:], base[:90] + prose(10) + base[100:]]
    for size in range(20, 70, 5):  # 200 / 250 is the threshold
        other = prose(200)
        texts += [other, other + prose(size), other[size:], other[:80] + prose(size) + other[80:]]
    texts += [[], ["one"], ["one"]]
    return [(i, " ".join(t) or None, "en", "s", None) for i, t in enumerate(texts)]


def test_near_copies_by_five_words_and_a_similarity_of_four_fifths(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    found = {r.doc_id for r in kept.collect()}
    assert not found & {1, 2}
    assert found == least_of_components(rows)


def test_signatures_of_the_stage_miss_less_than_one_pair_in_a_million():
    assert corpus_pipeline.NEAR_COPY.missed < 1e-6
    rule = corpus_pipeline.NEAR_COPY
    assert (rule.shingle, rule.percent) == (5, 80)
    assert near_dedup.DEFAULT == near_dedup.Rule(3, 85)


def test_default_signatures_miss_less_than_one_pair_in_a_million():
    assert near_dedup.DEFAULT.missed < 1e-6


def test_run_is_its_stages_in_order(spark, tmp_path):
    """Against plain Python but for the classifier, whose scores come from the trained machine."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [base, base + [rng.choice(vocabulary) for _ in range(40)], ["too", "short"]]
    texts += [[rng.choice(vocabulary) for _ in range(80)] + passage for _ in range(3)]
    rows = [(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(0, 1), (3, 1), (99, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    judged = {r.doc_id for r in corpus_pipeline.classified(spark, docs, str(tmp_path)).collect()}
    ruled = [r for r in rows if r[0] in judged and len(r[1].split()) >= 50]
    left = least_of_components(ruled)
    first, expected = {}, {}
    for d, text, *_ in sorted(r for r in ruled if r[0] in left):
        w, gone = text.split(), set()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone |= set(range(i, i + 50))
        expected[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    assert {0, 3, 4, 5} == set(expected) and len(expected[4].split()) == 80
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in expected.items()}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in found} == sizes and len(found) == len(sizes)
