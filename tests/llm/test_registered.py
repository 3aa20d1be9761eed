"""The registered queries without SQL, and the pipeline, against brute force over small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline
from reposift.llm.byte_bpe import VOCABULARY as BYTE_VOCABULARY
from reposift.llm.queries import ORACLES, QUERIES
from reposift.llm.word_bpe import VOCABULARY as WORD_VOCABULARY
from tests.llm.test_dedup import connected, shingles
from tests.llm.test_pipeline import without_later_passages
from tests.llm.texts import corpus, table

LANGUAGES = {"en": "the of and to in is that", "fr": "le la les des et un une", "de": "der die das und ist ein"}


def documents():
    rows = [(i, t) for i, t in corpus() if t is None or len(t) < 20_000]
    for i in range(240):
        words = list(LANGUAGES.values())[i % 3].split()
        toxic = " vile scum hate" if i % 4 == 0 else ""
        rows.append((20_000 + i, " ".join(random.Random(i).choices(words, k=30)) + f" w{i}" + toxic))
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    names = list(LANGUAGES)
    lang = {i: names[(i - 20_000) % 3] for i, _ in documents() if i >= 20_000}
    docs = table(spark, documents()).drop("lang").join(
        spark.createDataFrame([Row(doc_id=i, lang=x) for i, x in lang.items()]), "doc_id", "left"
    )
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [Row(doc_id=i, quality=1, toxic=int((i - 20_000) % 4 == 0)) for i in lang if i % 5 < 3]
    spark.createDataFrame(labels).write.parquet(f"{folder}/labels.parquet")
    return folder


def run(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def ids_of(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding(), tokenizer.no_truncation()
    return tokenizer, {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in documents()}


def test_every_query_without_sql_is_here():
    here = {name for name in globals() if name.startswith("test_op")}
    elsewhere = {"op6_suffix_array_dedup", "op12_html_extraction", "op13_periodic_runs"}
    assert {f"test_{name}" for name in set(QUERIES) - set(ORACLES) - elsewhere - {"pipeline"}} == here


def test_op1_packing(spark, sf_dir):
    _, ids = ids_of(BYTE_VOCABULARY)
    pieces, sequences = {}, {}
    for row in run(spark, sf_dir, "op1_packing"):
        pieces.setdefault(row["doc_id"], []).append(row)
        sequences.setdefault(row["sequence_id"], []).append(row)
    assert pieces.keys() == ids.keys()
    for doc_id, rows in pieces.items():
        whole, at = [*ids[doc_id], 0], 0
        for row in sorted(rows, key=lambda r: r["start"]):
            assert row["start"] == at and row["doc_tokens"] == len(whole) and row["length"] > 0
            own = np.array(whole[at : at + row["length"]], dtype="<u4").tobytes()
            assert row["ids_crc32"] == zlib.crc32(own)
            at += row["length"]
        assert at == len(whole)
    for rows in sequences.values():
        at = 0
        for row in sorted(rows, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= 1024


def test_op3_sharding(spark, sf_dir):
    rows = {r["doc_id"]: r for r in run(spark, sf_dir, "op3_sharding")}
    slots, sizes = {}, [0] * 8
    for doc_id, text in documents():
        data = (text or "").encode()
        row = rows.pop(doc_id)
        assert row["size"] == len(data) + 1 and row["text_crc32"] == zlib.crc32(data) and row["law"] == "bytes"
        slots.setdefault(row["shard"], []).append(row["slot"])
        sizes[row["shard"]] += row["size"]
    assert not rows
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert max(sizes) < 1.3 * sum(sizes) / 8


def test_op4_language_id(spark, sf_dir):
    docs = dict(documents())
    rows = run(spark, sf_dir, "op4_language_id")
    assert {r["doc_id"] for r in rows} == docs.keys() and len(rows) == len(docs)
    right = held = 0
    for row in rows:
        text = docs[row["doc_id"]]
        assert row["held_out"] == (remainder(row["doc_id"], 3) == 1) and 0 <= row["score"] <= 1
        assert (row["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
        if row["held_out"] and row["doc_id"] >= 20_000:
            held += 1
            right += row["lang_pred"] == list(LANGUAGES)[(row["doc_id"] - 20_000) % 3]
    assert held > 30 and right >= 0.95 * held


def test_op5_minhash_near_dedup(spark, sf_dir):
    sets = {i: shingles(t) for i, t in documents()}
    component = connected(sets)
    rows = run(spark, sf_dir, "op5_minhash_near_dedup")
    assert len(rows) == len(sets)
    for row in rows:
        i = row["doc_id"]
        assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(sets[i]), component[i], component[i] == i)


def test_op7_bpe(spark, sf_dir):
    tokenizer, ids = ids_of(WORD_VOCABULARY)
    rows = run(spark, sf_dir, "op7_bpe")
    assert len(rows) == len(ids)
    for row in rows:
        own = ids[row["doc_id"]]
        text = tokenizer.decode(own, skip_special_tokens=False)
        assert row["n_tokens"] == len(own)
        assert row["ids_sha256"] == hashlib.sha256(np.array(own, dtype="<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op9_toxicity(spark, sf_dir):
    rows = run(spark, sf_dir, "op9_toxicity")
    assert len(rows) == len(documents())
    right = held = 0
    for row in rows:
        assert row["held_out"] == (remainder(row["doc_id"], 5) == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
        if row["held_out"] and row["doc_id"] >= 20_000:
            held += 1
            right += row["predicted"] == int((row["doc_id"] - 20_000) % 4 == 0)
    assert held > 20 and right >= 0.9 * held


def test_pipeline(spark, sf_dir):
    """``corpus_pipeline.run`` gives the pieces of what the stages leave, done one by one."""
    texts = {i: t for i, t in documents() if t is not None and re.search(r"[^\W\d_]", t)}
    last = {}
    for i in sorted(texts):
        last[texts[i]] = i
    texts = {i: t for t, i in last.items()}
    component = connected({i: shingles(t) for i, t in texts.items()})
    want = without_later_passages({i: t for i, t in texts.items() if component[i] == i})
    tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    ids = {
        i: np.frombuffer(b"".join(own.sort_values("start")["ids"]), dtype="<u4").tolist()
        for i, own in got.groupby("doc_id")
    }
    assert ids == {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in want.items()}
