"""Exact deduplication with a cuckoo-filter index of live digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import cut, only, ready, sent, unused

SLOTS = 4
MAX_KICKS = 128


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints whose slots point at the stored keys.

    A fingerprint that matches is only a hint: the stored digest decides. A key that finds no
    slot after :data:`MAX_KICKS` evictions doubles the buckets, which are filled again from the
    stored keys, so nothing is ever lost or refused.
    """

    def __init__(self, buckets: int = 1024):
        self.digests: list[bytes | None] = []
        self.free: list[int] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.entries = [-1] * (buckets * SLOTS)

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & self.mask

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & self.mask)

    def _slot(self, digest: bytes) -> int:
        fingerprint, bucket = self._print(digest), self._first(digest)
        for at in (bucket, self._other(bucket, fingerprint)):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if self.prints[slot] == fingerprint and self.digests[self.entries[slot]] == digest:
                    return slot
        return -1

    def find(self, digest: bytes) -> int:
        """Entry of a live digest, -1 if there is none."""
        slot = self._slot(digest)
        return self.entries[slot] if slot >= 0 else -1

    def insert(self, digest: bytes) -> int:
        """Entry of the digest, which is live from now on."""
        entry = self.find(digest)
        if entry >= 0:
            return entry
        if self.free:
            entry = self.free.pop()
            self.digests[entry] = digest
        else:
            entry = len(self.digests)
            self.digests.append(digest)
        if not self._place(entry):
            self._grow()
        return entry

    def delete(self, digest: bytes) -> int:
        """Entry that the digest had, -1 if it was not live. The entry may be given away again."""
        slot = self._slot(digest)
        if slot < 0:
            return -1
        entry = self.entries[slot]
        self.prints[slot], self.entries[slot] = 0, -1
        self.digests[entry] = None
        self.free.append(entry)
        return entry

    def _place(self, entry: int) -> bool:
        digest = self.digests[entry]
        fingerprint, bucket = self._print(digest), self._first(digest)
        for at in (bucket, self._other(bucket, fingerprint)):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = fingerprint, entry
                    return True
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick * 7 + fingerprint) % SLOTS
            self.prints[slot], fingerprint = fingerprint, self.prints[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket = self._other(bucket, fingerprint)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = fingerprint, entry
                    return True
        return False

    def _grow(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(i) for i, digest in enumerate(self.digests) if digest is not None):
                return


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Live digests of a partition, each with its largest id, rows, and rows of that id.

    A row with a larger id takes the place of the live one: its entry is deleted, the new one
    inserted.
    """
    index = CuckooIndex()
    keep: list[int | None] = []
    sizes: list[int] = []
    ties: list[int] = []
    for batch in batches:
        for digest, new, size, tied in zip(
            batch["digest"], batch["keep_id"].tolist(), batch["size"].tolist(), batch["ties"].tolist()
        ):
            digest, new = bytes(digest), None if pd.isna(new) else int(new)
            entry = index.find(digest)
            if entry < 0:
                entry = index.insert(digest)
                if entry == len(keep):
                    keep.append(None), sizes.append(0), ties.append(0)
                keep[entry], sizes[entry], ties[entry] = new, size, tied
            elif new is not None and (keep[entry] is None or new > keep[entry]):
                before = sizes[index.delete(digest)]
                entry = index.insert(digest)
                keep[entry], sizes[entry], ties[entry] = new, before + size, tied
            else:
                sizes[entry] += size
                ties[entry] += tied * (new == keep[entry])
    for start in range(0, len(keep), 10_000):
        part = slice(start, start + 10_000)
        yield pd.DataFrame(
            {
                "digest": index.digests[part],
                "keep_id": pd.array(keep[part], dtype="Int64"),
                "size": np.array(sizes[part], dtype=np.int64),
                "ties": np.array(ties[part], dtype=np.int64),
            }
        )


_LIVE = "digest binary, keep_id long, size long, ties long"


def live_digests(rows: DataFrame) -> DataFrame:
    """``rows`` (digest binary, keep_id, size, ties) with one row for each digest.

    Each task indexes its own part first, so a digest reaches the shuffle once per task at
    most, however many copies it has; the tasks that own a range of hashes index what is left.
    """
    ready(rows.sparkSession)
    return rows.mapInPandas(_index, _LIVE).repartition("digest").mapInPandas(_index, _LIVE)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, ties, row``.

    Texts are equal when all their characters are; null counts as empty. The largest id of a
    group stays. Rows without an id never stay if another row has one; if none has, all are
    kept and ``keep_id`` is null. Rows that repeat both id and text are one row told several
    times: each is marked as kept, and ``ties`` counts them. ``row`` is a hash of id and text. Other columns are not read, and an
    empty table gives an empty result.
    """
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
            _row(id_col, text_col).alias("row"),
        ),
        "digests",
    )
    one = F.lit(1).cast("long")
    live = live_digests(
        rows.select("digest", F.col("doc_id").alias("keep_id"), one.alias("size"), one.alias("ties"))
    )
    return rows.join(live, "digest").select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "ties",
        "row",
    )


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    row = unused(docs, "row")
    decided = exact_duplicates(docs, id_col, text_col).select("kept", "ties", F.col("row").alias(row))
    decided = cut(decided.filter("not kept or ties > 1").distinct(), "decided", docs.count())
    gone, again = decided.select(row), decided.filter("kept").select(row)
    known = docs.withColumn(row, _row(id_col, text_col))
    once = known.join(sent(gone), row, "left_anti")
    return once.unionByName(only(known, again).dropDuplicates([row])).select(*docs.columns)
