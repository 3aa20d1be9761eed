"""Byte-level BPE ids of texts, with the encodings of repeated words kept."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Encodings of words that a worker keeps: those that it met first. Others last for one call.
KEPT_WORDS = 300_000

# A space after white space belongs to a run, and is not where a word starts.
_RUN = re.compile(r"\s ")


class _Words(dict):
    """Number of each word; a new word is encoded when it is first asked for."""

    def __init__(self, owner: "ByteBpe", before: str):
        super().__init__()
        self.owner, self.before = owner, before

    def __missing__(self, word: str) -> int:
        number = self[word] = self.owner.add(self.owner.ranks.encode_ordinary(self.before + word))
        return number


class ByteBpe:
    """Encodes as the tokenizers library does with the same vocabulary.

    The pre-tokenizer never joins a word with what stands before its leading space, so texts
    are cut at spaces, and every distinct word is encoded once. Texts with runs of white space
    are encoded whole. Texts that contain a special token go to the library itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
        )
        self.first, self.later = _Words(self, ""), _Words(self, " ")
        self.ids, self.starts = array("i"), array("q", [0])
        self.kept: tuple[int, int, int] | None = None  # words and numbers to go back to, once full

    @cached_property
    def library(self) -> Tokenizer:
        tokenizer = Tokenizer.from_file(self.vocabulary)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return tokenizer

    def _forget(self) -> None:
        """Drop what has come since the table was full."""
        if self.kept is None:
            if len(self.starts) > KEPT_WORDS:
                self.kept = len(self.first), len(self.later), len(self.starts)
            return
        for words, most in zip((self.first, self.later), self.kept):
            while len(words) > most:
                words.popitem()
        del self.starts[self.kept[2] :]
        del self.ids[self.starts[-1] :]

    def add(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        return len(self.starts) - 2

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text as int32. Null is encoded as the empty text."""
        self._forget()
        numbers: list[np.ndarray] = []
        for text in texts:
            text = text or ""
            if any(token in text for token in self.special):
                one = [self.add(self.library.encode(text, add_special_tokens=False).ids)]
            elif _RUN.search(text):
                one = [self.add(self.ranks.encode_ordinary(text))]
            else:
                words = text.split(" ")
                one = np.empty(len(words), dtype=np.int64)
                one[0] = self.first[words[0]]
                one[1:] = np.fromiter(
                    map(self.later.__getitem__, words[1:]), dtype=np.int64, count=len(words) - 1
                )
            numbers.append(np.asarray(one, dtype=np.int64))
        ids, starts = np.frombuffer(self.ids, dtype=np.int32), np.frombuffer(self.starts, dtype=np.int64)
        for one in numbers:
            sizes = starts[one + 1] - starts[one]
            ends = np.cumsum(sizes)
            total = int(ends[-1])
            yield ids[np.repeat(starts[one] - ends + sizes, sizes) + np.arange(total)]


_encoders: dict[tuple[str, str], ByteBpe] = {}


def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> ByteBpe:
    """The worker's encoder of a vocabulary."""
    key = (vocabulary, ranks)
    if key not in _encoders:
        _encoders[key] = ByteBpe(*key)
    return _encoders[key]


def release() -> None:
    """Forget the worker's encoders: a worker serves other operators after this one."""
    _encoders.clear()
