"""Ranked search for terms, by MaxScore with bounds of single terms and of pairs of terms.

Documents are indexed in blocks: for every term that some item asks for, the documents of the block
that hold it and what it adds to their scores, its impact; and for pairs of an item's terms, the list
of documents that hold both, with the greatest impact that the two have together. An item's terms
are taken in pairs from the greatest bound down. A pair adds to no score more than its joint maximum
or that of one of its terms, which is often less than the two maxima together; so the bounds of the
pairs that are left tell earlier that a document cannot reach the best ones. Once they cannot lift a
new document up, only documents that have a score already are looked up in the lists, and those that
cannot get there any more are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import cut, ready

# Documents whose scores a task computes at once, and distinct terms of the items of one pass.
BLOCK_DOCS = 16_384
PASS_TERMS = 200_000

# Documents that give the first bound of each item's best scores.
SEED_DOCS = 16_384

_SPLIT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text: stretches of ASCII letters and digits and all other characters, A-Z lowered."""
    return [] if text is None else text.encode().translate(_SPLIT).split()


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, pass_terms: int = PASS_TERMS
) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each item (item_id, text).

    Returns item_id, rank from 1, doc_id and score. The score sums, over the item's distinct terms,
    w * (1000000000 tf div (1000 tf + 20 m)), where w = floor(1000 ln((2N + 2) / (2 df + 1))) and
    m = 50 + 50 n N div L: tf is the term's count in the document, n the document's number of terms, df the
    number of documents with the term, N that of documents with terms, L that of all their terms.
    Scores above 0 count; equal scores go by the smaller doc_id.

    Null and empty texts have no terms: such documents do not count, such items get nothing. Repeated
    rows of a document are ranked each. Documents without an id count in N, L and df and are not
    ranked, items without one get nothing. Rows of one item_id are one item, with the terms of all.
    Empty tables give an empty result; other columns are ignored.

    Items are dealt to passes of about ``pass_terms`` distinct terms by a hash of their id, so that
    the terms of a pass fit in a worker; each pass reads the documents once, and the index
    that it writes, of the terms asked for only, twice.
    """
    spark = ready(docs.sparkSession)
    asked = items.filter("item_id is not null and text is not null").select("item_id", "text")
    asked = cut(asked.mapInPandas(_asked, "item_id long, term string").distinct(), "asked")
    passes = max(1, -(-asked.count() // pass_terms))
    schema = "item_id long, rank int, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    for number in range(passes):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        found = found.unionByName(_one_pass(docs, own, k))
    return found


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            [(i, t.decode()) for i, text in zip(batch["item_id"], batch["text"]) for t in set(terms_of(text))],
            columns=["item_id", "term"],
        )


class Item(NamedTuple):
    item_id: int
    terms: np.ndarray


def _one_pass(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    number: dict[str, int] = {}
    of_item: dict[int, list[int]] = {}
    for item_id, term in sorted(map(tuple, asked.collect())):
        of_item.setdefault(item_id, []).append(number.setdefault(term, len(number)))
    items = [Item(i, np.array(terms)) for i, terms in of_item.items()]
    vocabulary = spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()})

    # The part of the index that the items ask for: the counts of their terms in each document.
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = terms_of(text)
                if words:
                    held = [(known[t], n) for t, n in Counter(words).items() if t in known]
                    rows.append((doc_id, len(words), [t for t, _ in held], [n for _, n in held]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"])

    counted = "doc_id long, n long, terms array<int>, tfs array<int>"
    with_text = docs.filter("text is not null").select("doc_id", "text")
    stored = cut(with_text.mapInPandas(index, counted), "index")

    sizes = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(sizes[0]), int(sizes[1])
    df = np.zeros(len(number), dtype=np.int64)
    for term, held in stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = held
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    sent = spark.sparkContext.broadcast((items, weights, n_docs, max(n_terms, 1), k))
    ranked = "item_id long, doc_id long, score long"
    named = stored.filter("doc_id is not null")

    def best_of(least: dict[int, int]):
        bounds = spark.sparkContext.broadcast(least)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            items, weights, n_docs, n_terms, k = sent.value
            best = Best(items, k, bounds.value)
            for block in _blocks(batches):
                best.add(Block(block, items, weights, n_docs, n_terms))
            yield from best.frames()

        return search

    # The k-th best score among some documents bounds that among all from below.
    share = min(1.0, SEED_DOCS / max(n_docs, 1))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    seeds = named.filter(drawn).mapInPandas(best_of({}), ranked)
    place = "row_number() over (partition by item_id order by score desc, doc_id)"
    kth = seeds.withColumn("rank", F.expr(place)).filter(F.col("rank") <= k).filter(F.col("rank") == k)
    least = {row["item_id"]: row["score"] for row in kth.collect()}
    found = named.mapInPandas(best_of(least), ranked).withColumn("rank", F.expr(place))
    return found.filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BLOCK_DOCS:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if rows:
        yield pd.concat(held, ignore_index=True)


class Block:
    """Inverted lists of some documents, and the joint maxima of the pairs of terms that items have.

    The list of a pair is the intersection of two lists that the block has anyway, so only its
    maximum is kept; pairs that several items have are intersected once.
    """

    def __init__(
        self, rows: pd.DataFrame, items: list[Item], weights: np.ndarray, n_docs: int, n_terms: int
    ):
        self.doc_ids = rows["doc_id"].to_numpy(dtype=np.int64)
        held = rows["terms"].map(len).to_numpy()
        doc = np.repeat(np.arange(len(rows), dtype=np.int64), held)
        term = np.concatenate([*rows["terms"], np.empty(0)]).astype(np.int64)
        tf = np.concatenate([*rows["tfs"], np.empty(0)]).astype(np.int64)
        m = 50 + 50 * rows["n"].to_numpy(dtype=np.int64) * n_docs // n_terms
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.docs, self.impacts = doc[order], impact[order]
        self.ends = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.pairs: dict[tuple[int, int], int] = {}
        self.scratch = np.zeros(len(rows), dtype=np.int64)
        self.looked_up = 0
        most = np.zeros(len(weights), dtype=np.int64)
        np.maximum.at(most, term, impact)
        self.most = most
        self.groups = [self.bounds(item.terms) for item in items]

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ends[term], self.ends[term + 1])
        return self.docs[own], self.impacts[own]

    def joint(self, a: int, b: int) -> int:
        """The greatest impact of two terms together among the documents that hold both, 0 if none."""
        pair = (a, b) if a < b else (b, a)
        if pair not in self.pairs:
            (docs_a, impacts_a), (docs_b, impacts_b) = self.list(pair[0]), self.list(pair[1])
            self.scratch[docs_a] = impacts_a
            held = self.scratch[docs_b]
            self.scratch[docs_a] = 0
            both = held > 0
            self.pairs[pair] = int((held[both] + impacts_b[both]).max()) if both.any() else 0
        return self.pairs[pair]

    def bounds(self, terms: np.ndarray) -> list[tuple[list[int], int]]:
        """The terms in pairs, from the greatest impact down, with the bound of each pair."""
        own = sorted((int(t) for t in terms if self.most[t]), key=lambda t: (-self.most[t], t))
        groups = []
        for a, b in zip(own[0::2], [*own[1::2], *[None] * (len(own) % 2)]):
            alone = int(self.most[a])
            groups.append(([a], alone) if b is None else ([a, b], max(alone, self.joint(a, b))))
        return groups

    def scores(self, item: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents whose score for the item of this number is above 0 and at least ``least``."""
        groups = self.groups[item]
        rest = np.cumsum([bound for _, bound in groups][::-1])[::-1] if groups else np.empty(0)
        total = np.zeros(len(self.doc_ids), dtype=np.int64)
        alive = None
        for (group, _), left in zip(groups, rest):
            if alive is None and left < least:
                # A document without a score so far cannot get to ``least`` any more.
                alive = np.flatnonzero(total)
            if alive is not None:
                alive = alive[total[alive] + left >= least]
                if not len(alive):
                    break
            for term in group:
                docs, impacts = self.list(term)
                if alive is None or 8 * len(alive) > len(docs):
                    self.looked_up += len(docs)
                    total[docs] += impacts
                else:
                    self.looked_up += len(alive)
                    at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
                    hit = docs[at] == alive
                    total[alive[hit]] += impacts[at[hit]]
        alive = np.flatnonzero(total) if alive is None else alive
        alive = alive[total[alive] >= max(least, 1)]
        return alive, total[alive]


class Best:
    """The best documents of every item among the blocks so far, none below a bound known before."""

    def __init__(self, items: list[Item], k: int, least: dict[int, int]):
        self.items, self.k = items, k
        self.least = [least.get(item.item_id, 0) for item in items]
        empty = np.empty(0, dtype=np.int64)
        self.found = [(empty, empty)] * len(items)

    def add(self, block: Block) -> None:
        for i in range(len(self.items)):
            rows, scores = block.scores(i, self.least[i])
            if not len(rows):
                continue
            ids = np.concatenate((self.found[i][0], block.doc_ids[rows]))
            scores = np.concatenate((self.found[i][1], scores))
            order = np.lexsort((ids, -scores))[: self.k]
            self.found[i] = ids[order], scores[order]
            if len(order) == self.k:
                self.least[i] = max(self.least[i], int(scores[order[-1]]))

    def frames(self) -> Iterator[pd.DataFrame]:
        for item, (ids, scores) in zip(self.items, self.found):
            if len(ids):
                yield pd.DataFrame({"item_id": item.item_id, "doc_id": ids, "score": scores})
