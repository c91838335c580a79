"""Ids of a word-level BPE tokenizer, word by word and remembered.

The tokenizer drops white space and never merges across it, so a text's ids are those of its words in
order. Words seen before come from a bounded cache as packed little-endian unsigned 32-bit ids: when it is full, words
that were not met since the last time are dropped.
"""

from __future__ import annotations

import json
import os
import string
from array import array

import regex

from clauseframe.llm import textcore as tc

CACHED, LONG = 120_000, 64
LAST_PLAIN = "\u024f"


class _Recent(dict):
    """What `make` gives for a key. At `most` keys a new turn begins, to which only what is asked for again is carried over; long keys are not kept."""

    def __init__(self, make, most: int):
        self.make, self.most, self.last = make, most, {}

    def __missing__(self, key):
        out = self.last.get(key)
        if out is None:
            out = self.make(key)
        if len(key) > LONG:
            return out
        if len(self) >= self.most:
            self.last = dict(self)
            self.clear()
        self[key] = out
        return out


class WordIds:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.known = self.tokenizer.model, _Recent(self._word, CACHED)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # their states alone: the file has the whole vocabulary besides
        normalizer, splitter = (json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        kinds, steps = [x["type"] for x in normalizer.get("normalizers", [])], splitter.get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            raise ValueError("a tokenizer that lower-cases and drops white space is needed")
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        # the usual printable stand-ins of bytes in byte-level vocabularies
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.stand_in = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.stand_in)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        # up to U+024F there is nothing to compose, so the normaliser is lower-casing alone
        if not (word.isprintable() and (word.isascii() or max(word) <= LAST_PLAIN)) or "<" in word and any(s in word for s in self.special):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        # letters and then marks are two parts by the pattern
        core = low.rstrip(string.punctuation)
        parts = [core, low[len(core) :]] if core.isalpha() else self.split.findall(low)
        # a part by itself is a word, and remembered as one
        return b"".join([self._part(x) if x == word else self.known[x] for x in parts if x])

    def ids(self, text: str) -> bytes:
        """The ids of a text, packed; a special string in it gives its id, as the library has it."""
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


def word_ids(path: str) -> WordIds:
    return tc.held(f"word ids {path}", lambda: WordIds(path))
