"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from reposift.llm.common import CHUNK_CHARS, ready, unused

BUCKETS = 8192  # hashed byte trigrams
SAMPLE = 2000  # labelled documents that the model is fitted on, over all languages
ROUNDS = 80
DECAY = 1e-4
UNKNOWN = "und"

# Families of common language codes. Any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "es fr it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn mr gu pa ne si",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_CLASS = np.zeros(256, dtype=np.uint32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def profiles(texts: list[bytes | None]) -> np.ndarray:
    """One row per text: square roots of the shares of its hashed byte trigrams."""
    sizes = np.array([0 if t is None else len(t) for t in texts], dtype=np.int64) + 2
    data = b"".join(b" " + (t or b"") + b" " for t in texts)
    classes = _CLASS[np.frombuffer(data, dtype=np.uint8)]
    grams = (classes[:-2] * np.uint32(24_971) + classes[1:-1]) * np.uint32(24_971) + classes[2:]
    hashed = (grams * np.uint32(2_654_435_761)) >> np.uint32(19)
    owner = np.repeat(np.arange(len(texts)), sizes)[:-2]
    blank = (classes[:-2] == 0) & (classes[1:-1] == 0) & (classes[2:] == 0)
    cells = (owner * BUCKETS + hashed)[~blank]
    counts = np.bincount(cells, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    shares = counts.astype(np.float32)
    shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1)
    return np.sqrt(shares, out=shares)


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of the texts with few enough rows and bytes for one dense table."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > CHUNK_CHARS or len(held) == 256:
            yield held
            held, size = [], 0
    if held:
        yield held


def _curvature(x: np.ndarray) -> float:
    """Largest eigenvalue of the rows' inner products, by power iteration."""
    v = np.random.default_rng(0).normal(size=len(x)).astype(np.float32)
    v /= np.linalg.norm(v) or 1
    size = 0.0
    for _ in range(30):
        v = x @ (x.T @ v)
        size = float(np.linalg.norm(v))
        if not size:
            break
        v /= size
    return size


def linear_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of linear SVMs with squared hinge loss, one per column of ``y``.

    ``y`` holds 1, -1, or 0 where a row takes no part. Both sides of a column weigh the same.
    ``x`` is centred in place.
    """
    mean = x.mean(axis=0)
    x -= mean
    share = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(axis=0), 1), 0) + np.where(
        y < 0, 0.5 / np.maximum((y < 0).sum(axis=0), 1), 0
    )
    share, y = share.astype(np.float32), y.astype(np.float32)
    step = 1 / (2 * float(share.max()) * (1.1 * _curvature(x) + len(x)) + DECAY)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(ROUNDS):
        slack = share * y * np.maximum(0, 1 - y * (x @ ahead_w + ahead_b))
        new_w = ahead_w + step * (2 * x.T @ slack - DECAY * ahead_w)
        new_b = ahead_b + step * 2 * slack.sum(axis=0)
        after = (1 + sqrt(1 + 4 * t * t)) / 2
        ahead_w = new_w + (t - 1) / after * (new_w - w)
        ahead_b = new_b + (t - 1) / after * (new_b - b)
        w, b, t = new_w, new_b, after
    return w, b - mean @ w


@dataclass
class LanguageModel:
    """Families, the languages of each, and their classifiers, side by side in one matrix."""

    families: list[str] = field(default_factory=list)
    languages: list[list[str]] = field(default_factory=list)
    pairs: list[tuple[int, int, int]] = field(default_factory=list)  # family and two of its languages
    weights: np.ndarray | None = None
    biases: np.ndarray | None = None

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str]) -> "LanguageModel":
        model = cls()
        if not texts:
            return model
        by_family: dict[str, list[str]] = {}
        for label in sorted(set(labels)):
            by_family.setdefault(_FAMILY.get(label, label), []).append(label)
        model.families, model.languages = list(by_family), list(by_family.values())
        model.pairs = [
            (f, i, j)
            for f, names in enumerate(model.languages)
            for i in range(len(names))
            for j in range(i + 1, len(names))
        ]
        labels_ = np.array(labels)
        family = np.array([_FAMILY.get(label, label) for label in labels])
        targets = [np.where(family == name, 1, -1) for name in model.families]
        for f, i, j in model.pairs:
            one, other = model.languages[f][i], model.languages[f][j]
            targets.append((labels_ == one).astype(int) - (labels_ == other).astype(int))
        x = np.empty((len(texts), BUCKETS), dtype=np.float32)
        at = 0
        for block in _blocks(texts):
            x[at : at + len(block)] = profiles(block)
            at += len(block)
        model.weights, model.biases = linear_svm(x, np.array(targets).T)
        return model

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and confidence (0 to 1) of each text."""
        blocks = [profiles(block) @ self.weights for block in _blocks(texts)]
        margins = np.concatenate([*blocks, np.empty((0, len(self.biases)), np.float32)]) + self.biases
        n = len(self.families)
        family = margins[:, :n].argmax(axis=1)
        ranked = np.sort(margins[:, :n], axis=1)
        sure = _sigmoid(4 * (ranked[:, -1] - ranked[:, -2])) if n > 1 else np.ones(len(texts))
        found = np.empty(len(texts), dtype=object)
        for f, names in enumerate(self.languages):
            rows = np.flatnonzero(family == f)
            wins = np.zeros((len(rows), len(names)))
            nearest = np.full((len(rows), len(names)), np.inf)
            for column, (of, i, j) in enumerate(self.pairs, start=n):
                if of == f:
                    margin = margins[rows, column]
                    for k, own in ((i, margin), (j, -margin)):
                        # Votes decide; margins only order languages with as many.
                        wins[:, k] += (own > 0) + 1e-3 * np.tanh(own)
                        nearest[:, k] = np.minimum(nearest[:, k], own)
            best = wins.argmax(axis=1)
            found[rows] = np.array(names, dtype=object)[best]
            if len(names) > 1:
                sure[rows] *= _sigmoid(4 * nearest[np.arange(len(rows)), best])
        return found.tolist(), sure


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold``; false for rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_language_model(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE
) -> LanguageModel:
    """Fit on about ``sample`` labelled documents, shared equally among the languages.

    The share of a language is drawn by a hash of id and text, so the sample is the same in
    every run, and the driver holds ``2 * sample`` texts at most.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    labelled = labelled.select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).cast("binary").alias("text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"),
    )
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not counts:
        return LanguageModel()
    share = sample / len(counts)
    odds = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, share / n))))
    drawn = labelled.filter(F.pmod("draw", F.lit(1 << 30)) < odds[F.col("lang")] * (1 << 30))
    rows = drawn.select("lang", "text", "draw").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"]))
    return LanguageModel.fit([bytes(r["text"]) for r in rows], [r["lang"] for r in rows])


_RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def with_language(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted language of each whole text and the confidence in it.

    A text that is null or has no letter, and any text if nothing could be learned, is
    ``und`` with score 0. Columns of these names are replaced; all others are kept.
    """
    ready(docs.sparkSession)

    @F.pandas_udf(_RESULT)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch))
            known = np.flatnonzero(batch.notna())
            if len(known):
                langs[known], scores[known] = model.predict([batch.iloc[i] for i in known])
            yield pd.DataFrame({"lang": langs, "score": scores})

    text = F.col(text_col)
    spoken = F.when(text.rlike(r"\p{L}"), text.cast("binary")) if model.families else F.lit(None).cast("binary")
    temporary = unused(docs, "language")
    known = docs.withColumn(temporary, predicted(spoken))
    lang, score = names
    return known.withColumns(
        {lang: F.col(temporary)["lang"], score: F.col(temporary)["score"]}
    ).drop(temporary)
