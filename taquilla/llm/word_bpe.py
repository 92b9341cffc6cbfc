"""Ids of the lower-case BPE vocabulary with word ends, one white-space run at a time.

The tokenizer drops white space and never joins what white space parts, so a text's ids are the
ids of its white-space runs one after the other. Runs are looked up in a bounded memory; new ones
of plain Latin letters go through the merge table directly, all others through the library. A text
with a special token's string, or a control character of doubtful class, goes to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array

import regex
import tiktoken
from tokenizers import Tokenizer

from taquilla.llm.common import Remembered

# The vocabulary's own pre-tokenizer pattern (fixed value).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Letters up to here, but for the dotted capital I, have one form under NFC and lower-case one by
# one; later ones may not.
_LAST_PLAIN = "\u024f"
_UNSIGNED = "I"  # 32 bits on every platform Spark runs on, little-endian there too
_WORD_END = b"\xff"  # never a byte of UTF-8


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class WordBpe:
    """``ids(text)``: little-endian 32-bit ids as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        self.special = [t["content"] for t in content["added_tokens"]]
        # Python takes four control characters for white space that the library does not.
        self.whole = [*self.special, "\x1c", "\x1d", "\x1e", "\x1f"]
        letters = byte_letters()
        end = content["model"]["end_of_word_suffix"]
        ranks = {}
        for token, number in content["model"]["vocab"].items():
            if token in self.special:
                continue
            stem, tail = (token[: -len(end)], _WORD_END) if token.endswith(end) else (token, b"")
            ranks[bytes(letters[c] for c in stem) + tail] = number
        self.merges = tiktoken.Encoding(
            "word_bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}
        )
        self.encode = self.merges._core_bpe.encode_single_piece
        self.words = Remembered(self._word)
        self.known = Remembered(self._run)

    def _word(self, word: str) -> bytes:
        """Ids of one piece in lower case."""
        return array(_UNSIGNED, self.encode(word.encode() + _WORD_END)).tobytes()

    def _run(self, run: str) -> bytes:
        if not run.isascii() and (max(run) > _LAST_PLAIN or "İ" in run):
            found = self.library.encode(run, add_special_tokens=False).ids
            return array(_UNSIGNED, found).tobytes()
        lower = run.lower()
        if lower.isalpha():
            return self.words[lower]
        if lower[:-1].isalpha():  # a word and one other character: two pieces
            return self.words[lower[:-1]] + self.words[lower[-1]]
        return b"".join(map(self.words.__getitem__, _PIECES.findall(lower)))

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.whole):
            found = self.library.encode(text, add_special_tokens=False).ids
            return array(_UNSIGNED, found).tobytes()
        return b"".join(map(self.known.__getitem__, text.split()))
