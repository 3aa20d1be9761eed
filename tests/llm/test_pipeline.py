"""The pipeline against the same stages done one by one over a few texts."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reposift.llm.byte_bpe import VOCABULARY
from reposift.llm.common import cut
from tests.llm.test_dedup import connected, shingles
from tests.llm.texts import ascii_words, corpus, table


def without_later_passages(texts):
    """Texts by id, cut at word starts where a passage of 50 words has come before."""
    first, count = {}, Counter()
    words = {i: ascii_words(t) for i, t in texts.items()}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            passage = tuple(words[i][p : p + 50])
            count[passage] += 1
            first.setdefault(passage, (i, p))
    left = {}
    for i, text in texts.items():
        gone = set()
        for p in range(len(words[i]) - 49):
            passage = tuple(words[i][p : p + 50])
            if count[passage] > 1 and first[passage] != (i, p):
                gone.update(range(p, p + 50))
        pieces = re.findall("[^\x20\x09-\x0d]+[\x20\x09-\x0d]*", text)
        lead = text[: len(text) - len("".join(pieces))]
        kept = lead + "".join(x for p, x in enumerate(pieces) if p not in gone)
        if not gone or kept.strip("\x20\x09\x0a\x0b\x0c\x0d"):
            left[i] = kept
    return left


@pytest.mark.parametrize("lang", [None, "en"])
def test_pipeline_against_brute_force(spark, lang):
    rows = corpus()
    docs = table(spark, rows).withColumnRenamed("row", "found").withColumn("lang", F.lit(lang))
    texts = {i: t for i, t in rows if t is not None and any(c.isalpha() for c in t)}
    keep = {}
    for i in sorted(texts):
        keep[texts[i]] = i
    texts = {i: t for t, i in keep.items()}
    component = connected({i: shingles(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if component[i] == i}
    want = without_later_passages(texts)

    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, ""), name.replace(" ", "_"))
        assert docs.columns == columns
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {
        i: np.frombuffer(b"".join(own.sort_values("start")["ids"]), dtype="<u4").tolist()
        for i, own in pieces.groupby("doc_id")
    }
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in want.items()}


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""), name.replace(" ", "_"))
    assert docs.collect() == []


def test_stages_are_four_or_five_and_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact dedup", "near dedup", "passage dedup", "packing"]
