"""Ids of the byte-level BPE vocabulary, and their bytes.

A text is parted where the vocabulary's pattern parts it whatever stands further off: before a
space with a printable ASCII character on either side. What lies between such places is encoded
on its own and remembered up to a bound. Plain Latin runs go through the merge table directly, all
others through the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from taquilla.llm.common import Remembered
from taquilla.llm.word_bpe import byte_letters

# Before such a space the pattern always parts.
SAFE = re.compile(rb"(?<=[!-~]) (?=[!-~])")
# Letters, digits and signs up to Latin Extended-B; their classes are long settled.
_C = "!-~\u00a1-\u024f"
_SAFE_TEXT = re.compile(f"(?<=[{_C}]) (?=[{_C}])")
# Runs of such characters, parted by single spaces and line ends.
_PLAIN = re.compile(f"[{_C}]+(?:[ \n][{_C}]+)*")
_PIECES = regex.compile(public_tokenizers.PATTERN)
_SHORT = "H"  # 16 bits hold every id


class ByteBpe:
    """``encode(text)``: ids as bytes, 16 bits each; ``decode(ids)``: the text's bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.special = list(special)
        letters = byte_letters()
        ranks = {
            bytes(letters[c] for c in token): number
            for token, number in content["model"]["vocab"].items()
            if token not in special
        }
        merges = tiktoken.Encoding(
            "byte_bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}
        )
        self.piece = merges._core_bpe.encode_single_piece
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.bytes_of |= {i: s.encode() for s, i in special.items()}
        assert max(self.bytes_of) < 1 << 16
        self.pieces = Remembered(lambda piece: array(_SHORT, self.piece(piece.encode())).tobytes())
        self.known = Remembered(self._run)

    def _by_library(self, text: str) -> bytes:
        return array(_SHORT, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of a plain run after a space, or of one after the line end it begins with."""
        if run[0] == "\n":
            return self.pieces["\n"] + self._word(run[1:])
        return self._word(" " + run)

    def _word(self, word: str) -> bytes:
        """Ids of a plain run, with the space before it if there is one."""
        bare = word[1:] if word[0] == " " else word
        if bare.isalpha():
            return self.pieces[word]
        if bare[:-1].isalpha():  # a word and one other character: two pieces
            return self.pieces[word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word)))

    def _plain(self, text: str) -> bytes:
        runs = text.replace("\n", " \n").split(" ")
        return self._word(runs[0]) + b"".join(map(self.known.__getitem__, runs[1:]))

    def encode(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self._plain(text)
        found = []
        for number, part in enumerate(_SAFE_TEXT.split(text) if text else []):
            if not _PLAIN.fullmatch(part) or any(s in part for s in self.special):
                found.append(self._by_library(" " + part if number else part))
            elif number:  # without spaces, but maybe with line ends
                found += map(self.known.__getitem__, part.replace("\n", " \n").split(" "))
            else:
                found.append(self._plain(part))
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast(_SHORT)))


def wide(ids: bytes) -> bytes:
    """The same ids at 32 bits each."""
    return array("I", memoryview(ids).cast(_SHORT)).tobytes()
