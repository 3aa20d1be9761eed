"""Repeated passages by sparse suffix arrays over word positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reposift.llm.common import (
    as_signed,
    chunks,
    cut,
    mixed,
    only,
    ready,
    sent,
    unused,
    window_hashes,
    word_hashes,
    words_of_texts,
)

PASSAGE = 50  # words that a repeated passage has at least
PREFIX = 20  # words by which suffixes are sorted
SPAN = PASSAGE - PREFIX + 1  # prefixes in a passage; the smallest of them is retained

# Texts that are hashed at once, in characters: their arrays take some forty times as many bytes.
HASHED_CHARS = 250_000


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over all runs of ``width`` values, in a logarithmic number of passes."""
    reach = 1
    while reach * 2 <= width:
        x = op(x[: len(x) - reach], x[reach:])
        reach *= 2
    return op(x[: len(x) - (width - reach)], x[width - reach :])


def minimisers(prefixes: np.ndarray, span: int) -> np.ndarray:
    """Positions whose value is the smallest of some ``span`` neighbouring ones."""
    if len(prefixes) < span:
        return np.empty(0, dtype=np.int64)
    least = _sliding(prefixes, span, np.minimum)
    edge = np.zeros(span - 1, dtype=np.uint64)
    highest = _sliding(np.concatenate((edge, least, edge)), span, np.maximum)
    return np.flatnonzero(highest == prefixes)


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of texts with a passage at least: words, digest, and the sort keys of retained suffixes."""
    for part in chunks(batches, chars=HASHED_CHARS):
        found = []
        for row, doc_id, words in zip(part["row"], part["doc_id"], words_of_texts(part["text"].tolist())):
            if len(words) < PASSAGE:
                continue
            whole = [window_hashes(x, len(x)) for x in (words, mixed(words))]
            digests = as_signed(np.concatenate(whole))
            prefixes = window_hashes(words, PREFIX)
            keys = as_signed(prefixes[minimisers(prefixes, SPAN)])
            found.append((row, doc_id, len(words), digests[0], digests[1], keys))
        yield pd.DataFrame(found, columns=["row", "doc_id", "words", "digest", "other", "keys"])


def _extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages that hold a shared suffix, left and right of its start: position and hash."""
    for part in chunks(batches, chars=HASHED_CHARS):
        found = []
        for row, doc_id, keys, words in zip(
            part["row"], part["doc_id"], part["keys"], words_of_texts(part["text"].tolist())
        ):
            last = len(words) - PASSAGE
            prefixes = window_hashes(words, PREFIX)
            at = np.flatnonzero(np.isin(prefixes, np.asarray(keys, dtype=np.int64).view(np.uint64)))
            edges = np.zeros(len(words) + 2, dtype=np.int64)
            np.add.at(edges, np.maximum(at - SPAN + 1, 0), 1)
            np.add.at(edges, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(edges)[: last + 1])
            hashes = as_signed(window_hashes(words, PASSAGE)[starts])
            found.append((row, doc_id, starts.astype(np.int32), hashes))
        yield pd.DataFrame(found, columns=["row", "doc_id", "starts", "hashes"])


def _runs(mask: np.ndarray) -> zip:
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return zip(edges[0::2], edges[1::2])


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of repeated words: those that have come before, and first occurrences."""
    for batch in batches:
        found = []
        for row, doc_id, n, copied, *passages in batch.itertuples(index=False):
            start, first, own = (
                np.asarray([] if p is None else p, dtype=np.int64) for p in passages
            )
            order = np.argsort(start, kind="stable")
            start, first, own = start[order], first[order], own[order]
            here = first == doc_id
            new = np.zeros(len(start), dtype=bool)
            new[np.flatnonzero(here)[np.unique(own[here], return_index=True)[1]]] = True

            def covered(some):
                edges = np.zeros(n + PASSAGE + 1, dtype=np.int64)
                np.add.at(edges, start[some], 1)
                np.add.at(edges, start[some] + PASSAGE, -1)
                return np.cumsum(edges)[:n] > 0

            again = covered(~new)
            kept = (covered(new) | bool(copied)) & ~again
            for mask, stays in ((again, False), (kept, True)):
                for a, b in _runs(mask):
                    source = doc_id
                    if not stays:
                        touching = ~new & (start < b) & (start + PASSAGE > a)
                        source = first[touching].min()
                    found.append((row, doc_id, a, b, stays, source))
        yield pd.DataFrame(
            found, columns=["row", "doc_id", "start_word", "end_word", "kept", "first_doc_id"]
        )


_SPAN = "row long, doc_id long, start_word long, end_word long, kept boolean, first_doc_id long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("binary")
    return docs.select(F.xxhash64(doc_id, text).alias("row"), doc_id.alias("doc_id"), text.alias("text"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of repeated words: ``row, doc_id, start_word, end_word, kept, first_doc_id``.

    A passage is a run of 50 words (between white space of ASCII, A-Z in lower case) that
    occurs more than once, within a document or in several. Its first occurrence, by smallest
    id and then position, is kept; ``kept`` runs are those that no later occurrence covers.
    Runs that are not kept name the smallest document in which one of their passages occurs
    first. ``row`` is a hash of id and text. Of equal word sequences the smallest id enters the
    search; the others are repeated from end to end.

    Suffixes are retained where a 20-word prefix is the smallest of 31 neighbours, so every
    passage holds one. Nothing is sorted: equal prefixes are found by grouping their hashes, all
    windows of 50 words around them are listed, and these are matched by hash instead of pair
    by pair, so a passage in a third of all documents costs no more than its occurrences.

    Texts of fewer words, null texts and rows without an id are never reported. Rows that
    repeat id and text are one document. Other columns are not read; an empty table gives no
    rows.
    """
    ready(docs.sparkSession)
    texts = _texts(docs, id_col, text_col).filter("doc_id is not null")
    suffixes = cut(
        texts.mapInPandas(
            _suffixes, "row long, doc_id long, words long, digest long, other long, keys array<long>"
        ),
        "suffixes",
    )
    told_again = not suffixes.groupBy("row").count().filter("count > 1").isEmpty()

    def once(table: DataFrame) -> DataFrame:
        return table.dropDuplicates(["row"]) if told_again else table

    suffixes = once(suffixes)
    equal = ["words", "digest", "other"]
    classes = cut(
        suffixes.groupBy(*equal).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")),
        "sequences",
    )
    known = suffixes.join(classes, equal)
    copies = known.filter("doc_id <> first").select(
        "row",
        "doc_id",
        F.lit(0).cast("long").alias("start_word"),
        F.col("words").alias("end_word"),
        F.lit(False).alias("kept"),
        F.col("first").alias("first_doc_id"),
    )
    firsts = known.filter("doc_id = first")
    keys = firsts.select("row", F.explode("keys").alias("key"))
    neighbours = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    seeds = keys.join(cut(neighbours, "neighbours"), "key").groupBy("row").agg(
        F.collect_set("key").alias("keys")
    )
    seeds = cut(seeds, "seeds")
    found = (
        only(texts, seeds.select("row"))
        .join(seeds, "row")
        .select("row", "doc_id", "text", "keys")
        .mapInPandas(_extended, "row long, doc_id long, starts array<int>, hashes array<long>")
    )
    extended = cut(once(found), "passages")
    passages = extended.select(
        "row", "doc_id", F.explode(F.arrays_zip("starts", "hashes")).alias("p")
    ).select("row", "doc_id", F.col("p.starts").alias("start"), F.col("p.hashes").alias("hash"))
    repeated = (
        passages.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id"))
        .filter("n > 1")
        .select("hash", "first_doc_id")
    )
    # Written first, so that both sides of the join are shuffled alone and a frequent passage is split.
    repeated = cut(repeated, "repeated")
    own = F.when(F.col("first_doc_id") == F.col("doc_id"), F.col("hash")).otherwise(0).alias("own")
    matched = (
        passages.join(repeated, "hash")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", F.col("first_doc_id").alias("first"), own)).alias("p"))
        .select("row", "p.start", "p.first", "p.own")
    )
    whole = firsts.select("row", "doc_id", "words", (F.col("n") > 1).alias("copied"))
    spans = (
        whole.join(matched, "row", "left")
        .filter("copied or start is not null")
        .mapInPandas(_spans, _SPAN)
    )
    return spans.unionByName(copies)


@F.pandas_udf(StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without their spans of words, each cut up to the next word that stays."""
    left = []
    for text, cuts in zip(texts, spans):
        if text is None or cuts is None or not len(cuts):
            left.append(text)
            continue
        data = text.encode()
        bounds = np.append(word_hashes(data)[1], len(data))
        pieces, at = [], 0
        for span in sorted(cuts, key=lambda s: s["start_word"]):
            pieces.append(data[at : bounds[span["start_word"]]])
            at = bounds[span["end_word"]]
        left.append(b"".join([*pieces, data[at:]]).decode())
    return pd.Series(left)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the runs that have come before, with all their columns.

    Documents of which no word is left go. ``n_chars``, if there is such a column, is counted
    again where the text changes.
    """
    gone = repeated_passages(docs, id_col, text_col).filter("not kept")
    row, cuts = unused(docs, "row"), unused(docs, "cuts")
    spans = gone.distinct().groupBy(F.col("row").alias(row)).agg(
        F.collect_list(F.struct("start_word", "end_word")).alias(cuts)
    )
    spans = cut(spans, "cuts", docs.count())
    ids = spans.select(row)
    known = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("binary")))
    whole = known.join(sent(ids), row, "left_anti").select(*docs.columns)
    changed = only(known, ids).join(spans, row).withColumn(text_col, _without(F.col(text_col), cuts))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    changed = changed.filter(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
    return whole.unionByName(changed)
