"""Toxicity by non-negative positive-unlabelled learning on the presence of words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from reposift.llm.common import cut, ready, sent

POSITIVES = 3000  # confirmed toxic documents that the weights are fitted on, about, at most
UNLABELLED = 6000  # documents drawn from all without regard to labels, about, at most
CHANCE = 1e-4  # that a word enters the vocabulary without a link with toxicity, at most
LEAST_DRAWN = 5  # drawn documents of one side that hold a word with a weight of its own
HELD_WORDS = 200_000  # words that a task counts before it hands them on
ROUNDS = 500
RATE = 0.05
DECAY = 1e-5

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> set[bytes]:
    """Distinct words: runs of ASCII letters, apostrophes and bytes beyond ASCII, A-Z lowered."""
    return set((text or b"").translate(_LETTERS).split())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk estimator.

    The risk of negatives is that of the unlabelled, as if all were negative, less the part
    that positives have in it by the class prior. It counts as zero where it falls below, so
    that only the risk of positives is lowered there. Logistic loss, full batches, Adam.
    """
    w = np.zeros(positive.shape[1] + 1, dtype=np.float64)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        on_p, on_u = positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1]

        def gradient(x, slope):
            return np.append(slope @ x, slope.sum()) / x.shape[0]

        step = -prior * gradient(positive, _sigmoid(-on_p))
        if np.logaddexp(0, on_u).mean() >= prior * np.logaddexp(0, on_p).mean():
            step += gradient(unlabelled, _sigmoid(on_u)) - prior * gradient(positive, _sigmoid(on_p))
        step[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step**2
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


class _Presence:
    """A matrix of 0 and 1 by the rows and columns of the ones."""

    __array_ufunc__ = None  # products with arrays are ours

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.shape = row, column, shape

    @classmethod
    def of(cls, found: list[bytes], width: int) -> _Presence:
        row = np.repeat(np.arange(len(found)), [len(x) // 4 for x in found])
        return cls(row, np.frombuffer(b"".join(found), dtype="<i4"), (len(found), width))

    def counts(self) -> np.ndarray:
        return np.bincount(self.column, minlength=self.shape[1])

    def only(self, columns: np.ndarray) -> _Presence:
        stays = columns[self.column]
        return _Presence(self.row[stays], self.column[stays], self.shape)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.shape[0])

    def __rmatmul__(self, slope: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=slope[self.row], minlength=self.shape[1])


@dataclass
class ToxicityModel:
    words: dict[bytes, float]
    bias: float


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents and confirmed positives that hold a word, added up within a task."""
    every, toxic = Counter(), Counter()

    def counted():
        words = list(every)
        rows = {"word": words, "p": [toxic[w] for w in words], "d": [every[w] for w in words]}
        every.clear()
        toxic.clear()
        return pd.DataFrame(rows)

    for batch in batches:
        for text, positive in zip(batch["text"], batch["positive"]):
            words = words_of(text)
            every.update(words)
            if positive:
                toxic.update(words)
            if len(every) > HELD_WORDS:
                yield counted()
    yield counted()


def _surprise(n_p: int, n: int):
    """Column: -log of a bound on the chance that ``p`` of the ``d`` documents with a word are positive.

    Hoeffding's bound for draws without replacement from ``n`` documents, ``n_p`` of them
    positive. It holds for rare words too, where counted deviations mislead.
    """
    p, d = F.col("p").cast("double"), F.col("d").cast("double")
    inside = F.when(p > 0, p * F.log(p * float(n) / (d * float(n_p)))).otherwise(0.0)
    outside = F.when(p < d, (d - p) * F.log((d - p) * float(n) / (d * float(max(1, n - n_p))))).otherwise(0.0)
    return inside + outside


def _by_counts(p: np.ndarray, d: np.ndarray, n_p: int, n: int, prior: float, bias: float) -> np.ndarray:
    """Weights of words from their counts alone.

    A word that makes a text toxic rather than not lifts the score of a text without other words of the
    vocabulary to its own odds, others move it by the change of odds. The share of negatives
    with a word is raised by its deviation.
    """
    a, b = (p + 0.5) / (n_p + 1), (d + 0.5) / (n + 1)
    odds = np.log(prior * a / (np.maximum(b - prior * a, 0) + np.sqrt(b / n + prior**2 * a / n_p)))
    base = math.log(prior / (1 - prior))
    return odds - np.where(odds > 0, min(bias, base), base)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> ToxicityModel:
    """Words by counts over all documents, weights by a fit on a sample of them.

    ``labels`` (doc_id, toxic) are the rows to learn from; an id counts as toxic if one of its
    rows says so. The class prior is the share of toxic ids among the labelled ones. Without a
    toxic document nothing is learned: every score is then the smallest one.

    Every document, whatever its label or without one, serves as unlabelled text: so the class prior
    is the share of toxic texts in it even if few or no documents lack a label, and rows whose ``toxic``
    is null or 0 count. Words are counted over all of them and all confirmed positives. The
    vocabulary is every word whose link with the positives is significant (:data:`CHANCE`);
    driver and workers hold it.

    Weights are fitted on about ``positives`` and ``unlabelled`` documents at most, drawn by a
    hash of id and text. Words that fewer than :data:`LEAST_DRAWN` drawn documents of a side hold
    get their weights from the counts over all documents.
    """
    ready(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    known = cut(known, "toxic_labels")
    prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return ToxicityModel({}, -20.0)
    prior = min(float(prior), 0.95)
    toxic = cut(known.filter("toxic = 1"), "toxic_ids")
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(
        sent(toxic), "doc_id", "left"
    )
    told = told.select(
        "doc_id",
        "text",
        F.col("toxic").isNotNull().alias("positive"),
    )
    n_p, n = told.agg(F.count_if("positive"), F.count(F.lit(1))).first()
    if not n_p:
        return ToxicityModel({}, -20.0)
    rows = told.select("text", "positive").mapInPandas(_word_rows, "word binary, p long, d long")
    rows = rows.groupBy("word").agg(F.sum("p").alias("p"), F.sum("d").alias("d"))
    clear = rows.filter(_surprise(n_p, n) >= -math.log(CHANCE)).collect()
    clear = sorted((bytes(r["word"]), r["p"], r["d"]) for r in clear)
    place = {word: i for i, (word, _, _) in enumerate(clear)}
    vocabulary = frozenset(place)

    def features(batches):
        for batch in batches:
            held = (sorted(place[w] for w in vocabulary & words_of(t)) for t in batch["text"])
            found = [np.array(x, dtype="<i4").tobytes() for x in held]
            yield batch[["draw", "as_positive", "as_any"]].assign(found=found)

    def drawn(side: str, most: int, count: int):
        hashed = F.xxhash64("doc_id", "text", F.lit(side))
        return F.pmod(hashed, F.lit(1 << 30)) < min(1.0, most / count) * (1 << 30)

    sample = told.select(
        F.xxhash64("doc_id", "text").alias("draw"),
        "text",
        (F.col("positive") & drawn("positive", positives, n_p)).alias("as_positive"),
        drawn("any", unlabelled, n).alias("as_any"),
    ).filter("as_positive or as_any")
    # Rows that repeat an id and a text are drawn once, so that copies do not exceed the bounds.
    found = (
        sample.mapInPandas(features, "draw long, as_positive boolean, as_any boolean, found binary")
        .dropDuplicates(["draw"])
        .collect()
    )
    sides = [
        _Presence.of(sorted(bytes(r["found"]) for r in found if r[side]), len(clear))
        for side in ("as_positive", "as_any")
    ]
    if not all(side.shape[0] for side in sides):
        return ToxicityModel({}, -20.0)
    own = np.maximum(*(side.counts() for side in sides)) >= LEAST_DRAWN
    weights, bias = fit_nnpu(*(side.only(own) for side in sides), prior)
    p, d = (np.array([row[i] for row in clear], dtype=np.float64) for i in (1, 2))
    weights = np.where(own, weights, _by_counts(p, d, n_p, n, prior, bias))
    return ToxicityModel({word: float(w) for (word, _, _), w in zip(clear, weights)}, bias)


def toxicity_score(model: ToxicityModel, text):
    """Column: the probability that a whole text is toxic. Null is scored as the empty text."""
    weights, bias = model.words, model.bias
    known = frozenset(weights)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        sums = [bias + sum(weights[w] for w in sorted(known & words_of(t))) for t in texts]
        return pd.Series(_sigmoid(np.array(sums, dtype=np.float64)))

    return score(text.cast("binary"))


def with_toxicity(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """``docs`` with a score and 1 where it is 0.5 or more. Columns of these names are replaced."""
    ready(docs.sparkSession)
    score, predicted = names
    known = docs.withColumn(score, toxicity_score(model, F.col(text_col)))
    return known.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
