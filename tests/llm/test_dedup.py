import hashlib
import random
from collections import Counter, defaultdict

import pytest

from reposift.llm import near_dedup
from reposift.llm.components import components, joined
from reposift.llm.exact_dedup import CuckooIndex, drop_exact_duplicates, exact_duplicates
from reposift.llm.near_dedup import drop_near_duplicates, near_duplicates
from reposift.llm.suffix_dedup import drop_repeated_passages, repeated_passages
from tests.llm.texts import ascii_words, corpus, table


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows += [rows[3], rows[25], (None, "no id"), (None, rows[21][1])]  # told twice, and without id
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)


# --- exact ----------------------------------------------------------------------------


def test_cuckoo_index_against_a_set():
    rng = random.Random(3)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(6_000)]
    index, live = CuckooIndex(buckets=4), {}
    for _ in range(20_000):
        key = rng.choice(keys)
        if rng.random() < 0.7:
            entry = index.insert(key)
            assert live.setdefault(key, entry) == entry
        else:
            assert index.delete(key) == live.pop(key, -1)
    assert all(index.find(key) == live.get(key, -1) for key in keys)
    assert len(set(live.values())) == len(live)


def test_fingerprints_that_agree_are_told_apart_by_their_digests():
    index = CuckooIndex(buckets=4)
    keys = [b"\0" * 10 + bytes([i]) * 22 for i in range(5)]
    assert len({index.insert(key) for key in keys}) == 5
    assert index.delete(keys[2]) >= 0 and index.find(keys[2]) == -1
    assert all(index.find(key) >= 0 for key in keys if key != keys[2])


def test_exact_duplicates_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text].append(doc_id)
    want = []
    for doc_id, text in rows:
        known = [i for i in groups[text] if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        want.append((doc_id, keep, len(groups[text]), doc_id == keep, digest))
    got = [tuple(r)[:5] for r in exact_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted((keep for keep, _ in {(w[1], w[4]) for w in want}), key=repr)


# --- near -----------------------------------------------------------------------------


def shingles(text):
    w = ascii_words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def connected(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates_against_all_pairs(docs):
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    want = connected(sets)
    rows = near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    for r in rows:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert r["n_shingles"] == len(sets[r["doc_id"]])
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert max(Counter(want.values()).values()) > 20
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert set(ids(left)) == {i for i in want if want[i] == i} | {None}


def test_long_lists_and_frequent_shingles_lose_no_link(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(140):
        rate = rng.choice((0.01, 0.02, 0.03, 0.05, 0.08))
        rows.append((i, " ".join(f"x{rng.random()}" if rng.random() < rate else w for w in base)))
    for i in range(140, 220):  # a common passage in texts that are otherwise different
        own = [f"y{rng.random()}" for _ in range(rng.randint(30, 120))]
        rows.append((i, " ".join(own + base[:60])))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, rows)).collect()}
    assert got == connected({i: shingles(t) for i, t in rows})


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(40, 70)] + [(5, 3), (3, 9), (9, 5), (7, 7), (5, 3), (100, 2)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 40 for i in range(40, 71)}, 3: 3, 5: 3, 9: 3, 100: 2, 2: 2}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- passages -------------------------------------------------------------------------


def test_repeated_passages_against_brute_force(docs):
    texts = {}
    for r in docs.collect():
        if r["doc_id"] is not None:
            texts[r["doc_id"]] = ascii_words(r["text"])
    first, count = {}, Counter()
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            passage = tuple(texts[i][p : p + 50])
            count[passage] += 1
            first.setdefault(passage, (i, p))
    want = {}
    for i, w in texts.items():
        gone, kept = set(), set()
        for p in range(len(w) - 49):
            passage = tuple(w[p : p + 50])
            if count[passage] > 1:
                (kept if first[passage] == (i, p) else gone).update(range(p, p + 50))
        if gone or kept:
            want[i] = (gone, kept - gone)
    got = defaultdict(lambda: (set(), set()))
    for r in repeated_passages(docs).collect():
        got[r["doc_id"]][r["kept"]].update(range(r["start_word"], r["end_word"]))
        assert r["first_doc_id"] <= r["doc_id"]
    assert dict(got) == want
    cleaned = drop_repeated_passages(docs)
    assert cleaned.columns == docs.columns
    left = {r["doc_id"]: ascii_words(r["text"]) for r in cleaned.collect() if r["doc_id"] is not None}
    for i, w in texts.items():
        gone = want.get(i, (set(), set()))[0]
        rest = [x for p, x in enumerate(w) if p not in gone]
        assert left.get(i, []) == rest
        assert (i in left) == bool(rest or not gone)


def test_empty_tables(empty):
    assert exact_duplicates(empty).collect() == drop_exact_duplicates(empty).collect() == []
    assert near_duplicates(empty).collect() == drop_near_duplicates(empty).collect() == []
    assert repeated_passages(empty).collect() == drop_repeated_passages(empty).collect() == []


def test_more_links_join_known_components(spark):
    rng = random.Random(3)
    for extra in ([], [(1, 2), (30, 31), (31, 2)], [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]):
        links = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
        frames = [spark.createDataFrame(x, "a long, b long") for x in (links, extra, links + extra)]
        got = {tuple(r) for r in joined(components(frames[0]), frames[1]).collect()}
        assert got == {tuple(r) for r in components(frames[2]).collect()}


def test_common_passage_makes_no_pairs_of_texts_that_cannot_link(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(i, passage + "".join(f" o{i}_{j}" for j in range(8))) for i in range(300)]
    rows += [(300 + i, passage + f" o{i}_0 o{i}_1") for i in range(3)]
    left = []
    outside = near_dedup._outside
    monkeypatch.setattr(near_dedup, "_outside", lambda r: left.append(r.count()) or outside(r))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, rows)).collect()}
    assert got == connected({i: shingles(t) for i, t in rows})
    assert sum(left) <= len(rows)
