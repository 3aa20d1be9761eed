"""Ranked search against scores computed term by term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from reposift.llm import lexical_search
from reposift.llm.lexical_search import Block, Item, rank_documents, terms_of
from tests.conftest import rows
from tests.llm.texts import corpus, table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return TERM.findall(lowered)


def brute(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def documents():
    draw = random.Random(2)
    common = [f"c{i}" for i in range(8)]
    docs = corpus() + [(7_000 + i, " ".join(draw.choices(common, k=draw.randint(1, 40))) + f" r{i % 5}.R{i % 3}") for i in range(200)]
    return docs + [(None, "c1 c2 r1"), (7_000, "c1 c1 r0"), (7_500, "È-é, c3_c4"), (7_501, "è é")]


def benchmark():
    return [(1, "c1 C2 c3"), (2, "r1 R1 r4 c5 c6 c7 c0"), (3, None), (4, ""), (5, "nowhere at all"), (None, "c1"),
            (6, "È é c3"), (1, "r2"), (8, " ".join(f"c{i} r{i}" for i in range(8)))]


def frame(spark, items):
    return spark.createDataFrame([Row(item_id=i, text=t, score=1, rank="x") for i, t in items], "item_id long, text string, score int, rank string")


@pytest.mark.parametrize("passes", [10**6, 3])
@pytest.mark.parametrize("block", [16_384, 32])
def test_against_brute_force(spark, monkeypatch, block, passes):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "SEED_DOCS", 50)
    found = rank_documents(table(spark, documents()), frame(spark, benchmark()), k=5, pass_terms=passes)
    assert rows(found) == sorted(brute(documents(), benchmark(), 5), key=repr)


def test_empty_tables(spark):
    docs, items = table(spark, documents()), frame(spark, benchmark())
    assert rank_documents(docs.limit(0), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0
    assert rank_documents(docs.filter("text is null"), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms():
    for text in ("A-b_c 1É\x7fÈé{x}", "", None, "a\x00b c", "日本 語😀z"):
        assert [t.decode() for t in terms_of(text)] == plain_terms(text)


def test_bounds_of_pairs_skip_more_than_those_of_terms(monkeypatch):
    """Two terms that never meet bound a score by one of them."""
    draw = np.random.default_rng(1)
    n = 4_000
    terms = [[0] if i < 40 else [1 + 2 * (i % 5) + int(draw.random() < 0.5)] for i in range(n)]
    docs = pd.DataFrame({"doc_id": range(n), "n": 20, "terms": terms, "tfs": [[30] if i < 40 else [2] for i in range(n)]})
    weights = np.array([1000] + [100] * 10)
    items = [Item(0, np.arange(11))]
    looked_up = []
    for alone in (False, True):
        if alone:
            monkeypatch.setattr(Block, "joint", lambda self, a, b: int(self.most[a] + self.most[b]))
        block = Block(docs, items, weights, n, 20 * n)
        docs_found, scores = block.scores(0, 300_000_000)
        looked_up.append(block.looked_up)
        assert docs_found.tolist() == list(range(40)) and scores.min() >= 300_000_000
    assert looked_up[0] < looked_up[1]
