"""Ids of whole texts by the byte-level BPE vocabulary of the tokenizers library.

The vocabulary's splitting pattern always cuts before a space that a non-space follows, whatever stands further off. So a text falls into
chunks at its spaces, each is encoded once per worker, and later ones are looked up. Texts with other runs of spaces are cut by a pattern that allows them.
A text that holds one of the vocabulary's added tokens (such as `<|endoftext|>`) is left to the library as a whole, which gives such a token its own id.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

from .common import worker_cache

#: Chunks kept per worker; beyond it the later (rarer) half goes.
MEMO = 700_000
CUT = re.compile(r" (?=\S)")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: visible Latin-1 letters stand for themselves, other bytes follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RunOfSpaces(Exception):
    """A chunk that touches further white space: the plain cut does not hold there."""


class Chunks(dict):
    """' ' + chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoder: BpeEncoder, strict: bool, prefix: str):
        self.encoder, self.strict, self.prefix = encoder, strict, prefix

    def __missing__(self, chunk: str) -> bytes:
        if self.strict and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
            raise RunOfSpaces
        if len(self) >= MEMO:
            kept = list(islice(self.items(), MEMO // 2))
            self.clear()
            self.update(kept)
        found = self.encoder.ids(self.prefix + chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found


class BpeEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.split, self.letters = regex.compile(public_tokenizers.PATTERN).findall, byte_letters()
        self.words: dict[str, bytes] = {}
        self.heads, self.plain, self.any = Chunks(self, False, ""), Chunks(self, True, " "), Chunks(self, False, " ")

    def ids(self, text: str) -> bytes:
        """Of a chunk: the vocabulary's pattern gives words, the library's model their ids."""
        out = []
        words = self.split(text)
        several = len(words) > 1
        for word in words:
            found = self.words.get(word)
            if found is None and several and word[0] == " ":
                found = self.plain.get(word[1:])
            if found is None:
                found = np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()
                if len(self.words) >= MEMO:
                    kept = list(islice(self.words.items(), MEMO // 2))
                    self.words = dict(kept)
                if several and len(word) <= 64:
                    self.words[word] = found
            out.append(found)
        return out[0] if len(out) == 1 else b"".join(out)

    def __call__(self, text: str | None) -> bytes:
        """Ids of a whole text; null is empty."""
        if not text:
            return b""
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = text.split(" ")
        try:
            if chunks[0] and chunks[0][-1].isspace():
                raise RunOfSpaces
            return self.heads[chunks[0]] + b"".join(map(self.plain.__getitem__, chunks[1:]))
        except RunOfSpaces:
            chunks = CUT.split(text)
            return self.heads[chunks[0]] + b"".join(map(self.any.__getitem__, chunks[1:]))


def encoder(path: str) -> BpeEncoder:
    """The worker's encoder for a vocabulary file."""
    return worker_cache(("bpe", path), lambda: BpeEncoder(path))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
