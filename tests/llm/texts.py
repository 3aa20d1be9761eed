"""Small corpora with the cases that every operator must survive."""

from __future__ import annotations

import random
import re

from pyspark.sql import Row

SYLLABLES = "ta ri mo lu ke sa no vi pe du ga hi zo fe bu wa".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def edited(rng: random.Random, source: list[str], rate: float) -> list[str]:
    return [words(rng, 1)[0] if rng.random() < rate else word for word in source]


def corpus(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Unique texts, exact and near copies, shared passages, empty, null, short and long texts."""
    rng = random.Random(seed)
    base, passage = words(rng, 150), words(rng, 60)
    texts: list[str | None] = [" ".join(words(rng, rng.randint(1, 200))) for _ in range(20)]
    texts += [" ".join(base)] * 5
    texts += [" ".join(edited(rng, base, rate)) for rate in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1) for _ in range(6)]
    texts += [" ".join(words(rng, 30) + passage + words(rng, 25)) for _ in range(12)]
    texts += [" ".join(passage) + "\n" + " ".join(passage)]
    texts += [None, None, "", " ", "\n\t ", "one", "One", "one two three", "a b c d e", "A b c d E", "a b c d e f"]
    texts += [" ".join(words(rng, 9_000)), "x" * 50_000, "é è  ü\n\n ñ", "end. <|endoftext|> more", "日本 語 😀"]
    return [(i * 3 + 1, text) for i, text in enumerate(texts)]


def table(spark, rows, **extra):
    """A documents table with columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, size int, node string, key long"
    full = [Row(i, t, None, None, None if t is None else len(t), True, "r", 1, "n", 5) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(4, "doc_id")


def ascii_words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
