"""Packing of token sequences by bounded-space best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.byte_bpe import RANKS, VOCABULARY, encoder, release
from reposift.llm.common import chunks, cut, ready

LENGTH = 1024
OPEN = 64  # open windows of a task
LEAST_CUT = 8  # tokens; a smaller gap is padded rather than filled with a cut piece
FAN_IN = 32  # tasks whose leftovers one task merges
END = 0  # id after each document
FRAME_ROWS = 1_000  # pieces that a task hands over at once

_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long"
_PLACED = f"{_PIECE}, sequence_id long, offset long, closed boolean, part long"


class Packer:
    """Windows of ``length`` tokens, at most ``open_windows`` of them open.

    A piece goes to the open window that it fits best. If none fits and no more may be opened,
    the fullest is filled with the head of the piece, if both parts are worth it, and emitted.
    """

    def __init__(self, length: int, open_windows: int, least_cut: int):
        self.length, self.most, self.least = length, open_windows, least_cut
        self.gaps: list[tuple[int, int]] = []  # free tokens and number of the open windows
        self.windows: dict[int, list] = {}
        self.numbers = 0

    def add(self, piece: tuple) -> Iterator[tuple[int, list]]:
        """Place (doc_id, start, ids, doc_tokens); yields the windows that this closes."""
        doc_id, start, ids, total = piece
        while len(ids) >= self.length:
            yield self._number(), [(doc_id, start, ids[: self.length], total)]
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return
        at = bisect_left(self.gaps, (len(ids), -1))
        if at == len(self.gaps) and len(self.gaps) == self.most:
            gap, number = self.gaps.pop(0)
            window = self.windows.pop(number)
            if gap >= self.least and len(ids) - gap >= self.least:
                window.append((doc_id, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            yield number, window
            at = bisect_left(self.gaps, (len(ids), -1))
        if at < len(self.gaps):
            gap, number = self.gaps.pop(at)
        else:
            gap, number = self.length, self._number()
            self.windows[number] = []
        self.windows[number].append((doc_id, start, ids, total))
        if gap == len(ids):
            yield number, self.windows.pop(number)
        else:
            insort(self.gaps, (gap - len(ids), number))

    def _number(self) -> int:
        self.numbers += 1
        return self.numbers - 1

    def rest(self, merge: bool) -> Iterator[tuple[int, list]]:
        """The open windows; with ``merge``, their pieces cut so that one is partly filled at most."""
        if not merge:
            yield from ((number, self.windows[number]) for _, number in self.gaps)
            return
        window, free = [], self.length
        for _, number in self.gaps:
            for doc_id, start, ids, total in self.windows[number]:
                while len(ids):
                    window.append((doc_id, start, ids[:free], total))
                    start, ids, free = start + free, ids[free:], free - min(free, len(ids))
                    if not free:
                        yield self._number(), window
                        window, free = [], self.length
        if window:
            yield self._number(), window


def _rows(windows, first: int, closed: bool) -> Iterator[tuple]:
    for number, window in windows:
        offset = 0
        for doc_id, start, ids, total in window:
            yield doc_id, start, len(ids), ids.tobytes(), total, first + number, offset, closed
            offset += len(ids)


def _frames(rows: Iterator[tuple], part: int) -> Iterator[pd.DataFrame]:
    names = "doc_id start length ids doc_tokens sequence_id offset closed".split()
    held: list[tuple] = []

    def frame():
        return pd.DataFrame(held, columns=names).assign(part=part).astype({"doc_id": "Int64"})

    for row in rows:
        held.append(row)
        if len(held) == FRAME_ROWS:
            yield frame()
            held = []
    if held:
        yield frame()


def _pack(pieces, packer: Packer, turn: int, last: bool) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    first = (turn << 56) + (part << 28)

    def rows():
        for piece in pieces:
            yield from _rows(packer.add(piece), first, True)
        yield from _rows(packer.rest(last), first, last)

    return _frames(rows(), part)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    open_windows: int = OPEN,
    least_cut: int = LEAST_CUT,
    vocabulary: str = VOCABULARY,
    ranks: str = RANKS,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens, one row per piece:
    ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian 32-bit words; a document is its ids and then id 0. Null texts
    count as empty, so they are that id alone. Whole windows of long documents are sequences of
    their own. Each task packs its documents with ``open_windows`` open windows; what is still
    open at its end is merged, first by groups of tasks and at last by one, whose share is
    bounded by the open windows of the tasks before it. Only the very last sequence is cut off
    by the end of the data. Null and repeated ids are packed like others; an empty table gives
    no rows. Other columns are not read.
    """
    ready(docs.sparkSession)

    def packer():
        return Packer(length, open_windows, least_cut)

    def texts(batches):
        bpe = encoder(vocabulary, ranks)
        for batch in chunks(batches):
            for doc_id, ids in zip(batch["doc_id"], bpe.encode(batch["text"].tolist())):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                yield doc_id, 0, np.append(ids, np.int32(END)), len(ids) + 1
        release()

    def leftovers(batches):
        for batch in batches:
            for doc_id, start, ids, total in zip(
                batch["doc_id"], batch["start"], batch["ids"], batch["doc_tokens"]
            ):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                yield doc_id, start, np.frombuffer(bytes(ids), dtype=np.int32), total

    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = cut(table.mapInPandas(lambda b: _pack(texts(b), packer(), 0, False), _PLACED), "packed")
    done = placed.filter("closed")
    parts = (placed.agg(F.max("part")).first()[0] or 0) + 1
    turn = 1
    while True:
        parts, last = -(-parts // FAN_IN), parts <= FAN_IN
        opened = placed.filter("not closed").drop("closed", "sequence_id", "offset", "length")
        group = F.floor(F.col("part") / FAN_IN)
        dealt = opened.repartition(1) if last else opened.repartition(parts, group)
        dealt = dealt.sortWithinPartitions(F.desc(F.length("ids")), "doc_id", "start")
        merged = dealt.mapInPandas(
            lambda b, turn=turn, last=last: _pack(leftovers(b), packer(), turn, last), _PLACED
        )
        placed = cut(merged, "merged")
        done = done.unionByName(placed.filter("closed"))
        if last:
            return done.drop("closed", "part")
        parts = placed.agg(F.max("part")).first()[0] or 0
        parts, turn = parts + 1, turn + 1
