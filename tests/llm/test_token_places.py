"""Words hashed in place are the words of a plain split, without a Python object for each."""

from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taquilla.llm import collocations

LETTERS = [*"abAÉÿ\x00\x1c", " ", "  ", "\t", ".", ",\n", "\r", "\x0b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LETTERS), max_size=30).map("".join), max_size=4), st.sampled_from([1, 7, 1 << 16]))
def test_places_and_hashes_are_those_of_the_words(texts, together):
    before, collocations.HASHED_BYTES = collocations.HASHED_BYTES, together
    try:
        found = collocations.Tokens(texts)
    finally:
        collocations.HASHED_BYTES = before
    words = collocations.tokens_of(texts)
    assert [found.data[a:b] for a, b in zip(found.starts, found.stops, strict=True)] == words
    assert found.is_word.tolist() == [w != collocations._END for w in words]
    hashes = dict(zip(words, found.hashes.tolist(), strict=True))
    assert found.hashes.tolist() == [hashes[w] for w in words] and len(set(hashes.values())) == len(hashes)
    for at in range(len(words) - 1):
        if collocations._END not in words[at : at + 2]:
            assert found.phrase(at, 2) == b" ".join(words[at : at + 2])


def test_no_word_is_looked_up_to_be_hashed(monkeypatch):
    batch = pa.record_batch({"lang": ["en", None, "en"], "text": ["one two. two", None, "ONE two\tthree"]})

    def refused(texts):
        raise AssertionError("cut into Python objects")

    monkeypatch.setattr(collocations, "tokens_of", refused)
    found = [*collocations._per_language_and_side([batch])]
    assert sum(int(tokens.is_word.sum()) for _, tokens in found) == 6
    windows = [collocations.Windows(lang, tokens, {}) for (lang, _), tokens in found]
    for w in windows:
        w.longer()
    pairs = [h for w in windows for h in w.hashes[w.open].tolist()]
    assert len(pairs) == 3 and len(set(pairs)) == 2


@pytest.mark.parametrize("texts", [[], [""], ["", ""], [" "], ["."]])
def test_texts_without_words(texts):
    found = collocations.Tokens(texts)
    assert len(found) == len(collocations.tokens_of(texts)) and not found.is_word.any()
