"""Runs of repeated words: maximal stretches with a period, by maximal pairs of equal substrings.

Two places i < j that are followed by the same l words, but not by l + 1, and preceded by different
words, are a maximal pair. If l is at least their distance q, the words from i to j + l repeat with
period q and cannot be extended: they are a run, and every run is found so, once for each multiple
of its period that fits; the least distance is the period. The pairs of a text come from its
LCP-interval tree, bottom up: an interval joins the places of its children, kept apart by the word
to their left, and only places of different children with different left words, at most l apart,
are looked up.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import chunks, mixed, ready, unused, window_hashes

# Fixed value: words of the shortest run.
LEAST_LENGTH = 12

# Fixed value: how often a run repeats its period at least.
LEAST_EXPONENT = 2

RUNS = "array<struct<start: long, length: long, period: long>>"

Run = tuple[int, int, int]


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    names: tuple[str, str, str] = ("runs", "collapsed", "n_words"),
    least_length: int = LEAST_LENGTH,
) -> DataFrame:
    """Add the runs of each text, the text without their repetitions, and its number of words.

    Words are split at the white space of ASCII and compared as they are. A run (start, length,
    period, in words) is at least ``least_length`` words and two periods long. ``collapsed`` are the
    words, joined by one space, without those that some run holds after its first period. Runs are
    in order of their start, then period.

    Null and empty texts have no words and no runs, and their ``collapsed`` is empty. Repeated rows
    each get their runs; columns of the names asked for are replaced, all others stay, whatever
    their names. An empty table gives an empty result. A text is the work of one task, in memory in
    proportion to its words; in texts without repeated passages only those are counted and hashed.
    """
    ready(docs.sparkSession)
    runs, collapsed, n_words = names
    kept = [c for c in docs.columns if c not in names]
    given, found = unused(docs, "given"), unused(docs, "found")
    schema = f"`{found}` struct<runs: {RUNS}, collapsed: string, n_words: long>"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias(given))

    @F.pandas_udf(schema.split(" ", 1)[1])
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frames = [
                pd.DataFrame(_found(piece["text"].tolist(), least_length), columns=["runs", "collapsed", "n_words"])
                for piece in chunks(iter([batch.to_frame("text")]))
            ]
            yield pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(
                {"runs": [], "collapsed": [], "n_words": []}
            )

    out = packed.withColumn(found, find(given))
    return out.select(
        "row.*",
        F.col(f"{found}.runs").alias(runs),
        F.col(f"{found}.collapsed").alias(collapsed),
        F.col(f"{found}.n_words").alias(n_words),
    )


def _found(texts: list[str | None], least_length: int) -> list[tuple[list[dict], str, int]]:
    """Runs, collapsed text and number of words of each text."""
    words = [[] if t is None else t.encode().split() for t in texts]
    of_text = runs_of_texts(words, least_length)
    rows = []
    for own, runs in zip(words, of_text):
        kept = own
        if runs:
            change = np.zeros(len(own) + 1, dtype=np.int64)
            for start, length, period in runs:
                change[start + period] += 1
                change[start + length] -= 1
            kept = compress(own, np.cumsum(change[:-1]) == 0)
        shown = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        rows.append((shown, b" ".join(kept).decode(), len(own)))
    return rows


def runs_of_texts(texts: list[list], least_length: int = LEAST_LENGTH) -> list[list[Run]]:
    """The runs of each list of words, in order of start and period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    known: dict = {}
    ids = np.fromiter(
        (known.setdefault(word, len(known)) for t in texts for word in t), dtype=np.int64, count=int(sizes.sum())
    )
    runs: list[list[Run]] = [[] for _ in texts]
    if not len(ids):
        return runs
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    # A run's pair shares so many words at least, so only texts that repeat a passage of them count.
    shared = max(1, (least_length + 1) // 2)
    dense = _repeating(ids, owner, shared)
    for i in np.unique(owner[dense]):
        own = ids[first[i] : first[i] + sizes[i]]
        runs[i] = _runs(own, shared, least_length)
    return runs


def _repeating(ids: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Places whose text has the ``width`` words that start there more than once.

    Words are told by hashes here, so a place may be named that repeats nothing, and is not harmed.
    """
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    keys = window_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), width)
    keys = mixed(keys + owner[:n].astype(np.uint64))
    keys = keys[owner[:n] == owner[width - 1 :]]
    places = np.flatnonzero(owner[:n] == owner[width - 1 :])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    return places[order[1:][same]]


def _runs(ids: np.ndarray, shared: int, least_length: int) -> list[Run]:
    """The runs of one text, from the maximal pairs that its LCP-interval tree gives."""
    places, lcps = _suffixes(ids, shared)
    best: dict[tuple[int, int], int] = {}
    for i, j, common in _maximal_pairs(places.tolist(), lcps.tolist(), ids.tolist(), shared):
        period = j - i
        length = period + common
        if common >= (LEAST_EXPONENT - 1) * period and length >= least_length:
            known = best.get((i, length))
            if known is None or period < known:
                best[i, length] = period
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda run: (run[0], run[2]))


def _suffixes(ids: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share ``shared`` words with a neighbour, sorted, and what each shares with the last.

    Ranks of the first 1, 2, 4 … words, until all differ; the suffix array and the lengths of common
    prefixes are read off them.
    """
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while ranks[-1].max() < n - 1:
        rank = ranks[-1]
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        ranks.append(np.unique(rank * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1])
    left, right = order[:-1].copy(), order[1:].copy()
    lcps = np.zeros(n, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank, step = ranks[level], 1 << level
        inside = (left < n - step + 1) & (right < n - step + 1)
        # A rank of a shorter suffix stands for itself alone, so equal ranks share all the words.
        equal = np.zeros(n - 1, dtype=bool)
        equal[inside] = rank[left[inside]] == rank[right[inside]]
        lcps[1:][equal] += step
        left[equal] += step
        right[equal] += step
    with_last = lcps >= shared
    with_next = np.append(with_last[1:], False)
    part = with_last | with_next
    return order[part], np.where(with_last, lcps, 0)[part]


class _Places:
    """Places of one interval, in order, together and by the word to their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int):
        self.all = [place]
        self.by_left = {left: [place]}


def _maximal_pairs(
    places: list[int], lcps: list[int], ids: list[int], least: int
) -> list[tuple[int, int, int]]:
    """Maximal pairs (i, j, l) of sorted suffixes with l at least ``least`` and j - i at most l.

    ``lcps[k]`` is what suffix k shares with the one before. The stack holds the open intervals, each
    deeper than the one below, with the places of its children so far.
    """
    pairs: list[tuple[int, int, int]] = []
    stack: list[tuple[int, _Places]] = []
    done = None  # the subtree that ends with the suffix before
    for place, depth in zip([*places, None], [*lcps, 0]):
        if done is not None:
            while stack and stack[-1][0] > depth:
                at, children = stack.pop()
                done = _joined(children, done, at, pairs)
            if depth >= least:
                if stack and stack[-1][0] == depth:
                    done = _joined(stack.pop()[1], done, depth, pairs)
                stack.append((depth, done))
        if place is not None:
            done = _Places(place, ids[place - 1] if place else -1)
    return pairs


def _joined(large: _Places, small: _Places, depth: int, pairs: list[tuple[int, int, int]]) -> _Places:
    """The places of two children of an interval of ``depth``; their maximal pairs go to ``pairs``.

    Those of the smaller child are looked up in the larger one, in the window of ``depth`` words:
    among all places there, or word by word to the left, whichever are fewer. So neither a passage
    after many words nor one that overlaps itself many times costs the square of its places.
    """
    if len(small.all) > len(large.all):
        small, large = large, small
    for left, some in small.by_left.items():
        same = large.by_left.get(left, ())
        for place in some:
            low = bisect_left(large.all, place - depth)
            high = bisect_right(large.all, place + depth, low)
            if low == high or high - low == _within(same, place, depth):
                continue
            if high - low <= len(large.by_left):
                others = set(large.all[low:high])
                others.difference_update(same[bisect_left(same, place - depth) : bisect_right(same, place + depth)])
            else:
                others = [
                    other
                    for other_left, there in large.by_left.items()
                    if other_left != left
                    for other in there[bisect_left(there, place - depth) : bisect_right(there, place + depth)]
                ]
            pairs += [(min(place, other), max(place, other), depth) for other in others]
    _add(large.all, small.all)
    for left, some in small.by_left.items():
        _add(large.by_left.setdefault(left, []), some)
    return large


def _within(places, place: int, depth: int) -> int:
    return bisect_right(places, place + depth) - bisect_left(places, place - depth)


def _add(large: list[int], small: list[int]) -> None:
    if len(small) < 8:
        for place in small:
            insort(large, place)
    else:
        large.extend(small)
        large.sort()


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids its words with a repeating end (the rule of the query).

    With h the crc32 of the decimal id and g a tenth of it, rounded down: if h is divisible by ten,
    each word from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    Words are joined by one space then. A null id changes nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")

        def word(i: Column) -> Column:
            return F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))

        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    # Bound to a variable, so that the words are split once and not for each of them.
    bound = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return F.when((h % 10 == 0) & (F.size(words) > 0), bound).otherwise(text)
