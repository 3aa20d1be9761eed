"""What the operators share: paths of workers, tables cut from their lineage, words of a text."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.session import new_folder

ROOT = str(Path(__file__).resolve().parents[2])

# Most rows that a Python worker gets at once.
BATCH_ROWS = 1_000

# Texts that a task turns into arrays at once, in characters.
CHUNK_CHARS = 1_000_000


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and get few enough whole texts at once."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".strip(":")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Rows for which a small table of narrow rows gets one more file.
FILE_ROWS = 20_000


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, well compressed, and read it back.

    The lineage ends there, so lost executors cost a retry of one stage only, and what a task
    decided once is never decided again. Opening a file costs more than writing a thousand ids,
    so a table of about ``rows`` narrow rows is written in as many files as these fill, but by
    twice as many tasks as run at once at least; with fewer shuffle partitions nothing changes.
    """
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


# Ids that may be sent to every executor: 16 bytes each, about 32 MB.
SENT_IDS = 2_000_000


def sent(ids: DataFrame) -> DataFrame:
    """``ids``, a written table of distinct keys, marked to be sent to the rows if it is small.

    The keys are counted: beyond :data:`SENT_IDS` a join with them shuffles both sides.
    """
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is among ``ids`` (see :func:`sent`)."""
    return df.join(sent(ids), ids.columns[0], "left_semi")


def chunks(
    batches: Iterator[pd.DataFrame], text: str = "text", chars: int = CHUNK_CHARS
) -> Iterator[pd.DataFrame]:
    """Pieces of the batches of about ``chars`` characters, at least one row each."""
    for batch in batches:
        sizes = np.cumsum([0 if t is None else len(t) for t in batch[text]], dtype=np.int64)
        start = 0
        while start < len(batch):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + chars, "right")))
            yield batch.iloc[start:end]
            start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them well."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to ``n``."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, start and end bytes of the words between the white space of ASCII.

    A-Z count as lower case. Long texts are hashed block by block, cut at white space.
    """
    data = np.frombuffer(text.translate(_LOWER), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(~_WHITE[data], prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_CHARS, "right")))
        first, last = starts[at], ends[to - 1]
        power, inverse = _powers(last - first + 1)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[first:last]] * power[: last - first], out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        hashes[at:to] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return hashes, starts, ends


def words_of_texts(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text, hashed together. Null has no words."""
    sizes = np.array([0 if t is None else len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    hashes, starts, _ = word_hashes(b"".join(t + b"\n" for t in texts if t is not None))
    bounds = np.searchsorted(starts, np.concatenate(([0], ends)))
    for i in range(len(texts)):
        yield hashes[bounds[i] : bounds[i + 1]]


_PLACE = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, by prefix sums: the cost does not grow with it."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if width <= 8:
        return mixed(sum(words[i : i + n] * _PLACE[i] for i in range(width)))
    power, inverse = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * inverse[:n])


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
