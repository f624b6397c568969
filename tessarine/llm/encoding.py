"""Byte-level BPE ids of whole texts by the tokenizers library, with caches for repeated words."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array

import numpy as np

# Fixed value: the pre-token rule of byte-level BPE vocabularies of this kind,
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# written for the characters below, whose classes every Unicode version agrees on.
KNOWN = [chr(c) for c in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x250))]
LETTERS = "".join(c for c in KNOWN if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(c for c in KNOWN if unicodedata.category(c)[0] == "N")
SPACES = r"\t-\r \xa0"
PRE_TOKEN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
    rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
UNKNOWN = r"[^\t-\r -~\xa0-ɏ]"
#: Where cutting a text before each space would cut a run of spaces apart, beside two spaces in a row.
RUN_OF_SPACES = r"[\t-\r\xa0] (?:[\t-\r\xa0]|\Z)"
CACHED = 400_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Cache(dict):
    """A dictionary that computes what it lacks. When full it becomes the older one, whose used entries come back."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute
        self.older = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= CACHED:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers, equal to Tokenizer.encode(...).ids.

    A text is cut before its spaces and then by the pre-token rule, and each distinct pre-token goes
    through the library's BPE model once. Texts with characters, or added tokens, beyond what the
    rule above covers go through the library whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        about = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.space = self.letters[0x20]
        self.pre_tokens = re.compile(PRE_TOKEN).findall
        plain = about.get("pre_tokenizer") == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
        }
        plain = plain and about.get("normalizer") is None and about.get("post_processor") is None
        # Searched one by one: a pattern of all of them would try each at every character.
        self.added = [t["content"] for t in about.get("added_tokens", [])]
        self.unknown = re.compile(UNKNOWN if plain else "").search
        self.runs = re.compile(RUN_OF_SPACES).search
        self.by_token = _Cache(self._token)
        self.by_chunk = _Cache(self._spaced)

    def _token(self, token: str) -> bytes:
        if token.isascii() and token[1:].isalpha():
            shown = self.space + token[1:] if token[0] == " " else token
        else:
            shown = token.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _spaced(self, chunk: str) -> bytes:
        if chunk.isalpha():  # letters alone are one pre-token with their space
            return self.by_token[" " + chunk]
        return self._chunk(" " + chunk)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.by_token.__getitem__, self.pre_tokens(chunk)))

    def encode(self, text: str) -> bytes:
        if self.unknown(text) or any(token in text for token in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if "  " in text or self.runs(text):
            return self._chunk(text)
        first, *others = text.split(" ")
        return self._chunk(first) + b"".join(map(self.by_chunk.__getitem__, others))


def fingerprint_of(vocabulary: str) -> str:
    return hashlib.sha256(vocabulary.encode()).hexdigest()
