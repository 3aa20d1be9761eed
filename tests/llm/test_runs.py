"""Runs of repeated words against a search of every period, and the registered query."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from reposift.llm.periodic_runs import periodic_runs, planted, runs_of_texts
from reposift.llm.queries import QUERIES
from tests.llm.texts import corpus, table


def brute(words, least=12):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                best[i, length] = min(q, best.get((i, length), q))
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [] if text is None else text.encode().split()


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("least", [12, 4, 5])
def test_random_words(least):
    draw = random.Random(least)
    for _ in range(400):
        n, kinds = draw.randint(0, 60), draw.choice([1, 2, 2, 3, 30])
        words = [draw.randrange(kinds) for _ in range(n)]
        if n > 4 and draw.random() < 0.6:
            a = draw.randrange(n)
            p = draw.randint(1, max(1, (n - a) // 2))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert runs_of_texts([words, words], least) == [brute(words, least)] * 2


@pytest.mark.parametrize(
    "words, runs",
    [
        (["a"] * 30_000, 1),
        (["a", "b"] * 15_000, 1),
        ([w for k in range(4_000) for w in (f"w{k}", *"abcdefg")], 0),
        ([w for k in range(100) for w in (*["a"] * 200, f"s{k}")], 100),
    ],
)
def test_long_texts_that_repeat(words, runs):
    """Overlapping passages, and passages after many words, cost no square of their places."""
    assert len(runs_of_texts([words])[0]) == runs


def test_texts_of_a_table(spark):
    rows = corpus() + [(9_001, "x y z " * 9), (9_002, "a " * 12), (9_003, "a " * 11), (9_001, "x y z " * 9)]
    docs = table(spark, rows).withColumn("runs", F.lit("taken")).withColumn("given", F.lit(1))
    found = periodic_runs(docs)
    assert set(found.columns) == {*docs.columns, "collapsed", "n_words"}
    got = sorted((r.doc_id, r.text or "", [tuple(x) for x in r.runs], r.collapsed, r.n_words, r.given) for r in found.collect())
    want = []
    for i, text in rows:
        words = split(text)
        runs = brute(words) if len(words) < 2_000 else []
        want.append((i, text or "", runs, collapsed(words, runs).decode(), len(words), 1))
    assert got == sorted(want)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_planted_texts(spark):
    rows = [(i, f"  A{i} b\tc {i} " * (i % 9)) for i in range(60)] + [(None, "a b"), (70, None), (71, "")]
    docs = table(spark, rows).select("doc_id", "text", planted(F.col("doc_id"), F.col("text")).alias("new"))
    for doc_id, text, new in docs.collect():
        want = split(text) if doc_id is None else rewritten(doc_id, split(text))
        assert split(new) == want


def test_the_query(spark, tmp_path):
    """The registered query on a small table of its own, digest by digest."""
    rows = [(i, t) for i, t in corpus() if t is None or len(t) < 20_000]
    rows += [(i, f"w{i} " + " ".join(f"v{i}-{k % 50}" for k in range(i % 90))) for i in range(5_000, 5_150)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    some = 0
    for doc_id, text in rows:
        words = rewritten(doc_id, split(text))
        runs, row = brute(words), got[doc_id]
        some += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs)).hexdigest()
    assert some > 10
