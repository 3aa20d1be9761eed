"""BPE encoding and decoding of texts, with words of a batch encoded together in a trie."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType
from tokenizers import Tokenizer

from reposift.llm.common import CHUNK_CHARS, ready

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

# Words and pieces of text whose encodings a worker keeps; beyond, those that it met first.
KEPT = 1_200_000
KEPT_FIRST = 600_000
KEPT_PAIRS = 500_000

# Characters that lower-casing, composition and letter classes treat as the library does, each of
# them tested; texts with others are left to the library.
_PLAIN = re.compile("[\x00-\u0130\u0132-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u21ff]*")

_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"\p{White_Space}+")
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordBpe:
    """Encodes and decodes as the tokenizers library does with a vocabulary of word-end BPE.

    The last token of a prefix's encoding follows from the last tokens of shorter prefixes: it is
    the one suffix in the vocabulary that cannot merge with what stands before it. So a
    depth-first walk over the trie of all new words computes each shared prefix once.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        self.vocabulary, self._library = vocabulary, None
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)
        bpe = model["model"]
        self.end = bpe["end_of_word_suffix"]
        self.vocab: dict[str, int] = bpe["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_of = regex.compile(pattern).findall
        self.letters = byte_letters()
        self._merge_tables(bpe["merges"])
        plain = [t.removesuffix(self.end) for t in self.vocab]
        # The beginnings of tokens, with the token where one ends there.
        self.begins = {b: self.vocab.get(b) for t in plain for b in (t[:i] for i in range(1, len(t) + 1))}
        self.table = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.ends = {
            t.removesuffix(self.end): i for t, i in self.vocab.items() if t.endswith(self.end)
        }
        self.pairs: dict[int, bool] = {}
        self._clear()

    def library(self) -> Tokenizer:
        """The library's encoder, loaded when a text needs it."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.vocabulary)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _merge_tables(self, merges: list) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        formed: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = self.vocab[a], self.vocab[b]
            if self.rank.setdefault((left, right), rank) == rank:
                formed.setdefault(self.vocab[a + b], (rank, left, right))
        # The tokens that stand at the edge of a token while it forms, and until which merge.
        self.right_edge, self.left_edge = {}, {}
        for token in self.vocab.values():
            for edges, side in ((self.right_edge, 2), (self.left_edge, 1)):
                chain, at, until = [], token, _NEVER
                while True:
                    chain.append((at, until))
                    if at not in formed:
                        break
                    until, at = formed[at][0], formed[at][side]
                edges[token] = chain

    def _forget(self) -> None:
        """Keep the pieces and words that were met first, which are the frequent ones."""
        self.pieces = {piece: n for piece, n in self.pieces.items() if n < KEPT_FIRST}
        self.words = {word: n for word, n in self.words.items() if n < KEPT_FIRST}
        del self.ids[self.starts[KEPT_FIRST] :], self.starts[KEPT_FIRST + 1 :]

    def _clear(self) -> None:
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.ids, self.starts = array("i"), array("q", [0])

    def _stays(self, before: int, after: int) -> bool:
        """Whether two tokens side by side are never merged across their border."""
        rank = self.rank
        left = self.left_edge[after]
        for x, until_x in self.right_edge[before]:
            for y, until_y in left:
                merged = rank.get((x, y))
                if merged is not None and merged < until_x and merged <= until_y:
                    return False
        return True

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, given in byte letters."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        found: dict[str, list[int]] = {}
        ends, begins, pairs = self.ends, self.begins, self.pairs
        # The branch of the trie that the word before stands on. By number of letters: the last
        # token of the prefix, where it starts, and the starts from which it can still grow.
        last, starts, alive_at = [-1], [0], [()]
        before = ""
        # In order, the words are the leaves of the trie as a depth-first walk meets them.
        for word in sorted(words):
            size = len(word)
            depth, shared = 0, min(len(last), size) - 1
            while depth < shared and before[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :], starts[depth + 1 :], alive_at[depth + 1 :]
            alive = alive_at[depth]
            while depth < size - 1:
                ahead, token = [], None
                depth += 1
                for at in (*alive, depth - 1):
                    part = word[at:depth]
                    if part not in begins:
                        continue
                    ahead.append(at)
                    if token is None:
                        token = begins[part]
                        if token is not None and at:
                            pair = last[at] << 20 | token
                            stays = pairs.get(pair)
                            if stays is None:
                                stays = pairs[pair] = self._stays(last[at], token)
                            if not stays:
                                token = None
                        if token is not None:
                            last.append(token)
                            starts.append(at)
                alive = ahead
                alive_at.append(ahead)
            # The last letter of a word differs from the same letter within one.
            for at in (*alive, size - 1):
                token = ends.get(word[at:])
                if token is not None:
                    if not at:
                        break
                    pair = last[at] << 20 | token
                    stays = pairs.get(pair)
                    if stays is None:
                        stays = pairs[pair] = self._stays(last[at], token)
                    if stays:
                        break
            ids = [token]
            while at:
                ids.append(last[at])
                at = starts[at]
            ids.reverse()
            found[word] = ids
            before = word
        return found

    def _words_of(self, piece: str) -> list[str]:
        """Words of a piece of text, in byte letters."""
        if piece.isalpha():
            words = [piece]
        elif piece[:-1].isalpha() and piece[-1] in ".,;:!?":
            words = [piece[:-1], piece[-1]]
        else:
            words = self.words_of(piece)
        if piece.isascii() and piece.isprintable():
            return words
        letters = self.letters
        return ["".join([letters[b] for b in word.encode()]) for word in words]

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces of text (without white space) that are new.

        ASCII is spelt alike, so the number of such a word is kept with the pieces.
        """
        own, others, all_ids, starts = self.pieces, self.words, self.ids, self.starts
        spelt = [(piece, self._words_of(piece)) for piece in pieces]
        new = {w for _, words in spelt for w in words if w not in (own if w.isascii() else others)}
        for word, ids in self.encode_words(new).items():
            (own if word.isascii() else others)[word] = len(starts) - 1
            all_ids.fromlist(ids)
            starts.append(len(all_ids))
        for piece, words in spelt:
            if len(words) == 1:
                word = words[0]
                if word is not piece:
                    own[piece] = (own if word.isascii() else others)[word]
                continue
            joined = array("i")
            for word in words:
                number = (own if word.isascii() else others)[word]
                joined += all_ids[starts[number] : starts[number + 1]]
            own[piece] = len(starts) - 1
            all_ids += joined
            starts.append(len(all_ids))

    def _pieces_of(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [p for p in _WHITE.split(text) if p] if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text as int32. Null is encoded as the empty text."""
        if len(self.pieces) + len(self.words) > KEPT:
            self._forget()
        flat: list[str] = []
        parts: list[list[tuple[int, int] | list[int]]] = []  # ranges of the flat list, or ids
        for text in texts:
            text = text or ""
            split = [text]
            if self.split_special and any(name in text for name in self.special):
                split = self.split_special.split(text)
            parts.append([])
            for part in split:
                if len(split) > 1 and part in self.special:
                    parts[-1].append([self.special[part]])
                elif not part.isascii() and not _PLAIN.fullmatch(part):
                    parts[-1].append(self.library().encode(part, add_special_tokens=False).ids)
                else:
                    before = len(flat)
                    flat += self._pieces_of(part)
                    parts[-1].append((before, len(flat)))
        numbers = list(map(self.pieces.get, flat))
        if None in numbers:
            missing = [i for i, number in enumerate(numbers) if number is None]
            self._learn({flat[i] for i in missing})
            for i in missing:
                numbers[i] = self.pieces[flat[i]]
        at = np.array(numbers, dtype=np.int64)
        ids, starts = np.frombuffer(self.ids, dtype=np.int32), np.frombuffer(self.starts, dtype=np.int64)
        sizes = starts[at + 1] - starts[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        all_ids = ids[np.repeat(starts[at] - ends[:-1], sizes) + np.arange(int(ends[-1]))]
        for text in parts:
            out = [
                np.array(part, dtype=np.int32)
                if isinstance(part, list)
                else all_ids[ends[part[0]] : ends[part[1]]]
                for part in text
            ]
            yield out[0] if len(out) == 1 else np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens, joined with spaces; special tokens are kept, unknown ids left out."""
        table = self.table
        if len(ids) and (ids.min() < 0 or ids.max() >= len(table)):
            ids = ids[(ids >= 0) & (ids < len(table))]
        return " ".join(map(table.__getitem__, ids.tolist()))


_known: dict[str, WordBpe] = {}


def bpe(vocabulary: str = VOCABULARY) -> WordBpe:
    """The worker's encoder of a vocabulary."""
    if vocabulary not in _known:
        _known[vocabulary] = WordBpe(vocabulary)
    return _known[vocabulary]


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size > CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of whole texts as little-endian 32-bit words, in a binary column."""

    @F.pandas_udf(BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        model = bpe(vocabulary)
        return pd.Series(
            [ids.tobytes() for group in _groups(texts.tolist()) for ids in model.encode(group)], dtype=object
        )

    return run(text)


def decoded(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """Texts of ids as :func:`encoded` gives them. Null stays null."""

    @F.pandas_udf(StringType())
    def run(rows: pd.Series) -> pd.Series:
        model = bpe(vocabulary)
        return pd.Series(
            [None if r is None else model.decode(np.frombuffer(r, dtype=np.int32)) for r in rows], dtype=object
        )

    return run(ids)


def with_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``ids`` (binary) and ``decoded`` (the text that they decode to).

    A null text is encoded as the empty one: no ids, and decoded to the empty text. Columns of
    these names are replaced, all others and all rows are kept.
    """
    ready(docs.sparkSession)
    return docs.withColumn("ids", encoded(F.col(text_col), vocabulary)).withColumn(
        "decoded", decoded(F.col("ids"), vocabulary)
    )
