import random
import zlib
from collections import Counter

import numpy as np
import pytest

from reposift.llm import top_k
from reposift.llm.sharding import kd_shards
from reposift.llm.top_k import KdTree, exact_top_k, integer_vectors
from reposift.llm.url_filter import Rule, bloom_filter, judge_urls
from tests.llm.texts import corpus, table

RULES = (Rule("allow", "org", "/"), Rule("block", "bad.org", "/x/"), Rule("block", "com", "/de/"))


def test_urls(spark):
    urls = {
        1: "http://a.bad.org/x/1?q", 2: "https://BAD.ORG/y", 3: "http://notbad.org/x/", 4: "http://m.s.com/de/1",
        5: "http://s.com/page.html#t", 6: "https://www.s.com/page/", 7: "s.com/page", 8: None, 9: "http://s.com/other",
        10: "http://s.net?x/y", 11: "x://y://z", 12: "http://", 13: "http://org/", 14: "http://\n.com/de/\n?",
    }
    rows = [(i, u, "h", "v", "b") for i, u in urls.items()] + [(5, urls[5], "h", "v", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, block string")
    listed = spark.createDataFrame([("s.com/page",), ("elsewhere/x",)], "url string")
    got = sorted(tuple(r) for r in judge_urls(pages, listed, RULES).collect())
    assert got == sorted(
        [
            (1, "a.bad.org", "/x/1", "bad.org/x/", "block"),
            (2, "bad.org", "/y", "org/", "allow"),
            (3, "notbad.org", "/x/", "org/", "allow"),
            (4, "m.s.com", "/de/1", "com/de/", "block"),
            *[(5, "s.com", "/page.html", None, "block")] * 2,
            (6, "www.s.com", "/page/", None, "block"),
            (7, "", "", None, "allow"),
            (8, "", "", None, "allow"),
            (9, "s.com", "/other", None, "allow"),
            (10, "s.net", "", None, "allow"),
            (11, "y:", "//z", None, "allow"),
            (12, "", "", None, "allow"),
            (13, "org", "/", "org/", "allow"),
            (14, "\n.com", "/de/\n", "com/de/", "block"),
        ],
        key=lambda r: r,
    )
    none = judge_urls(pages, listed.filter("false"), ())
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert judge_urls(pages.filter("false"), listed, RULES).collect() == []


def test_bloom_filter_has_every_listed_url_and_few_others(spark):
    listed = spark.range(3_000).selectExpr("concat('u', id) as url")
    others = spark.range(20_000).selectExpr("id as page_id", "concat('http://v', id, '/') as url")
    filter_ = bloom_filter(listed, 256)
    assert filter_.count() <= 256
    plan = judge_urls(others, listed, ())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("FileScan") == 0
    assert judge_urls(others, listed, ()).filter("verdict = 'block'").count() == 0


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 60)
    monkeypatch.setattr(top_k, "BLOCK", 7)
    monkeypatch.setattr(top_k, "LEAF", 8)


def brute(vectors, queries, k):
    want = []
    for query_id, q in queries.items():
        scored = [(-sum(a * b for a, b in zip(q, x)), i) for i, x in vectors if i != query_id and len(x) == len(q)]
        want += [(query_id, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(want)


@pytest.mark.parametrize("scale", [1, 3_000_000])
def test_top_k_against_brute_force(spark, small_shards, scale):
    rng = random.Random(scale)
    data = [(i, [rng.randint(-3, 3) * scale for _ in range(6)]) for i in range(300)]
    data += [(i, data[5][1]) for i in range(300, 340)]  # a common vector
    data += [(400, [1 * scale] * 3), (450, [2 * scale] * 3), (500, [])]
    table_ = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in data], "vec_id long, x array<double>")
    got = sorted(tuple(r) for r in exact_top_k(table_, table_.filter("vec_id % 50 = 0")).collect())
    assert got == brute(data, {i: x for i, x in data if i % 50 == 0}, 5)


def test_tree_boxes_bound_their_points():
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(size=(900, 8)) * 50)
    tree = KdTree(np.arange(900), vectors)
    queries = np.floor(rng.normal(size=(5, 8)) * 50)
    bounds = tree.bounds(queries)
    rows = [r for r in tree.rows if r is not None]
    assert sorted(np.concatenate(rows)) == list(range(900))
    for node, own in enumerate(tree.rows):
        if own is not None:
            assert ((vectors[own] @ queries.T).max(axis=0) <= bounds[:, node]).all()


def test_vectors_that_take_no_part(spark, small_shards):
    rows = [
        (0, [0.5, -0.001]), (50, [1.0, 1.0]), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]),
        (5, None), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]),
    ]
    source = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, x int")
    vectors = integer_vectors(source)
    assert sorted((r["vec_id"], r["x"]) for r in vectors.collect())[0] == (0, [128.0, -1.0])
    got = sorted(tuple(r) for r in exact_top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect())
    assert got == [
        (0, 1, 6, 32512), (0, 2, 6, 32512), (0, 3, 50, 32512), (50, 1, 6, 131072), (50, 2, 6, 131072), (50, 3, 0, 32512),
    ]
    assert exact_top_k(vectors.filter("false"), vectors.filter("false")).collect() == []


def test_shards(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 60)) for i in range(3_000)] + corpus()[:60]
    rows += [(10_000 + i, "the same text in a third of all rows, so it has to be divided") for i in range(1_500)]
    rows += [(None, "x"), (7, "twice"), (7, "twice"), (8_000, None)]
    docs = table(spark, rows)
    got = kd_shards(docs, shards=8).toPandas()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    ids = [None if np.isnan(i) else int(i) for i in got["doc_id"].astype(float)]
    assert Counter(zip(ids, got["size"], got["text_crc32"])) == want
    sums = got.groupby("shard")["size"].sum()
    assert sorted(sums.index) == list(range(8))
    assert sums.max() < 1.06 * sums.mean() and sums.min() > 0.94 * sums.mean()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    groups = got.groupby(["size", "text_crc32"])["shard"].agg(["nunique", "size"])
    assert groups[groups["size"] < 32]["nunique"].max() == 1
    assert kd_shards(docs, target_bytes=20_000).select("shard").distinct().count() > 8
    assert kd_shards(docs.drop("source", "lang"), shards=1).select("shard").distinct().count() == 1
    assert kd_shards(docs.filter("false"), shards=8).collect() == []


def test_rows_that_repeat_an_id_are_candidates_of_each_other(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (7, [0.5, 0.5, 1.0])]
    points = spark.createDataFrame(rows, "vec_id long, x array<double>")
    got = sorted(tuple(r) for r in exact_top_k(points, points.filter("vec_id = 50")).collect())
    want = []
    asked = [(i, q) for i, q in enumerate(rows) if q[0] == 50]
    for i, (query_id, q) in asked:
        others = [x for j, x in enumerate(rows) if j != i and len(x[1]) == len(q)]
        scored = sorted((-sum(a * b for a, b in zip(q, x)), vec_id) for vec_id, x in others)
        want += [(query_id, rank, vec_id, -score) for rank, (score, vec_id) in enumerate(scored, 1)]
    assert got == sorted(want) and len(got) == 9
