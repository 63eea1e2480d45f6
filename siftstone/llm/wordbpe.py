"""Token ids and counts of public BPE files for distinct words.

The merge loop of tiktoken is several times faster than that of tokenizers on single words, and both give the
same ids where one token has one way to be merged; the tests hold the two against each other. Whatever is not
a plain Latin word goes to tokenizers itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,!?;:|]*)")
#: A word's end, as a byte that UTF-8 never has.
_END = b"\xff"


def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts under a lower-casing BPE file with word ends, word by word.

    White space always parts words there and is dropped, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str, cache: int = 600_000):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.library, self.cache = _library(path), _Ids(self.word, cache)
        letters = _byte_alphabet()

        def raw(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(letters[c] for c in body) + (_END if body != token else b"")

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(255):  # the end joins the last byte before anything else
            ranks[bytes([b]) + _END] = len(ranks)
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        special = {t["content"] for t in spec["added_tokens"]}
        known = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.raw = [struct.pack("<i", known.get(k, -1)) for k in sorted(ranks, key=ranks.get)]  # by rank
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.mark = {bytes([c]): self._merged(bytes([c])) for c in b".,!?;:|"}

    def _merged(self, part: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, self.merge(part + _END)))

    def word(self, word: bytes) -> bytes:
        """The word's ids as little-endian 32-bit bytes."""
        if word.isalpha():  # ASCII letters
            return self._merged(word.lower())
        if (mark := self.mark.get(word[-1:])) and word[:-1].isalpha():
            return self._merged(word[:-1].lower()) + mark
        text = word.decode("utf-8", "replace")
        if m := _PLAIN.fullmatch(text):
            return b"".join(self._merged(part.lower().encode()) for part in m.groups() if part)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of the words as bytes, joined: no id is a Python object on its way."""
        return np.frombuffer(b"".join(map(self.cache.__getitem__, text.encode("utf-8", "replace").split())), dtype="<u4")


class _Ids(dict):
    """The ids of words as bytes. Words are kept until size of them are, so frequent ones are; it starts anew when too much passes it by."""

    def __init__(self, word: Callable[[bytes], bytes], size: int):
        super().__init__()
        self.word, self.size, self.missed = word, size, 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self.word(word)
        if len(self) < self.size and len(word) <= 64:
            self[word] = ids
        else:
            self.missed += 1
            if self.missed > 4 * self.size:
                self.clear()
                self.missed = 0
        return ids


class PieceCounter:
    """Pre-tokens under a byte-level BPE file, and their numbers of tokens."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = _library(path)
        self.pieces = regex.compile(pattern).findall
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special, self.at_special = set(special), regex.compile("(" + "|".join(map(regex.escape, special)) + ")")

    def cut(self, part: str) -> list[str]:
        """The pre-tokens of a part of a text that is cut on both sides: special strings, and what the pattern gives between them.

        Up to U+024F all engines class characters alike; from there on the library's own pre-tokenizer has its say.
        """
        if max(part, default="") < "ɐ" and "<|" not in part:
            return self.pieces(part)
        out = []
        for between in filter(None, self.at_special.split(part)):
            if between in self.special:
                out.append(between)
            else:
                out += [between[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(between)]
        return out

    def count(self, piece: str) -> int:
        if max(piece, default="") < "ɐ" and "<|" not in piece:
            return len(self.fast(piece))
        return len(self.library.encode(piece, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def piece_counter(path: str, ranks_path: str, pattern: str) -> PieceCounter:
    return PieceCounter(path, ranks_path, pattern)
