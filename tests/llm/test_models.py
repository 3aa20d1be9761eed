import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reposift.llm.language import LanguageModel, fit_language_model, held_out, with_language
from reposift.llm.toxicity import fit_nnpu, fit_toxicity, with_toxicity
from tests.llm.texts import corpus, table

SOUNDS = {
    "en": "th he an ing er ou ly".split(),
    "de": "sch ei ung en ie ver ß".split(),
    "es": "ción os ll ar qu do ñ".split(),
    "fr": "eau ou aux elle é ai ç".split(),
    "xx": "zk vy gr ub ot".split(),
}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, spoken(rng, lang, rng.randint(5, 60)), lang if i % 4 else None, lang))
    rows += [(1000, None, "en", None), (1001, "123 !? \n", "fr", None), (1002, "", None, None), (None, "the", "en", None)]
    schema = "doc_id long, text string, lang string, truth string, score string"
    return spark.createDataFrame([(*r, "taken") for r in rows], schema).cache()


def test_language_of_held_out_documents(spark, docs):
    train = docs.filter(~held_out(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull())
    model = fit_language_model(train)
    assert sorted(map(sorted, model.languages)) == [["de", "en"], ["es", "fr"], ["xx"]]
    rows = with_language(docs, model).collect()
    assert len(rows) == docs.count()
    known = [r for r in rows if r["truth"] is not None]
    assert np.mean([r["lang_pred"] == r["truth"] for r in known]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1000, 1001, 1002)} == {"und"}
    again = with_language(docs.drop("lang", "truth").withColumn("doc_id", F.lit(0)), model).collect()
    assert [(r["text"], r["lang_pred"], r["score"]) for r in again] == [(r["text"], r["lang_pred"], r["score"]) for r in rows]


def test_language_without_anything_to_learn(spark, docs):
    model = fit_language_model(docs.filter("false"))
    assert {r["lang_pred"] for r in with_language(docs, model).collect()} == {"und"}
    one = LanguageModel.fit([b"aa bb", b"cc"], ["en", "en"])
    assert one.predict([b"aa", b"zz"])[0] == ["en", "en"]
    assert with_language(table(spark, []), one).collect() == []
    assert with_language(table(spark, corpus()), one).count() == len(corpus())


def test_nnpu_finds_the_positives_among_unlabelled_rows():
    rng = np.random.default_rng(1)
    signal = np.eye(6)[rng.integers(0, 6, 900)]
    noise = (rng.random((900, 4)) < 0.3).astype(float)
    unlabelled = np.hstack([signal * (np.arange(900) < 150)[:, None], noise])
    positive = np.hstack([np.eye(6)[rng.integers(0, 6, 200)], (rng.random((200, 4)) < 0.3).astype(float)])
    w, b = fit_nnpu(positive, unlabelled, 150 / 900)
    found = unlabelled @ w + b > 0
    assert found[:150].mean() > 0.95 and found[150:].mean() < 0.02


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1_200):
        words = spoken(rng, "en", rng.randint(5, 80)).split()
        toxic = rng.random() < 0.2
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice("ABC") + "ugly")
        rows.append((i, " ".join(words) + "."))
        if i % 2:
            labels += [(i, 1, int(toxic))] * (1 + i % 3 % 2)
    truth = {i: "ugly" in t for i, t in rows}
    rows += [(5000, None), (5001, ""), (None, "x")]
    docs = table(spark, rows).withColumn("score", F.lit("taken"))
    labels = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(
        docs.filter(~held_out(F.col("doc_id"), 5, 0)), labels.filter(~held_out(F.col("doc_id"), 5, 0))
    )
    got = with_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    judged = {r["doc_id"]: r["predicted"] for r in got}
    hits = [judged[i] for i, toxic in truth.items() if toxic]
    misses = [judged[i] for i, toxic in truth.items() if not toxic]
    assert np.mean(hits) > 0.95 and np.mean(misses) < 0.03
    assert judged[5000] == judged[5001] == judged[None] == 0


def test_toxicity_without_examples(spark):
    docs, labels = table(spark, corpus()), spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    assert {r["predicted"] for r in with_toxicity(docs, model).collect()} == {0}
    assert with_toxicity(table(spark, []), model).collect() == []


def test_toxicity_by_words_that_few_drawn_documents_hold(spark):
    """Each of 12 words marks a twelfth of the toxic documents; a draw of 20 holds one or two of these."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(6_000):
        words = spoken(rng, "en", rng.randint(20, 40)).split()
        if i % 20 == 0:
            words.append("ugly" + "abcdefghijkl"[rng.randrange(12)])
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(i % 20 == 0)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id < 5000")
    model = fit_toxicity(table(spark, rows[:5_000]), labels, positives=20, unlabelled=400)
    judged = {r["doc_id"]: r["predicted"] for r in with_toxicity(table(spark, rows[5_000:]), model).collect()}
    assert np.mean([judged[i] for i in judged if i % 20 == 0]) > 0.9
    assert np.mean([judged[i] for i in judged if i % 20]) < 0.03


@pytest.mark.parametrize("clean", [0, None])
def test_toxicity_where_every_document_has_a_label_row(spark, clean):
    rng = random.Random(12)
    rows = [(i, spoken(rng, "en", 30) + (" ugly" if i % 5 == 0 else "")) for i in range(500)]
    told = [(i, clean if i % 2 and clean is None else int(i % 5 == 0)) for i, _ in rows]
    labels = spark.createDataFrame(told, "doc_id long, toxic int")
    model = fit_toxicity(table(spark, rows), labels)
    judged = {r["doc_id"]: r["predicted"] for r in with_toxicity(table(spark, rows), model).collect()}
    assert judged == {i: int(i % 5 == 0) for i, _ in rows}
