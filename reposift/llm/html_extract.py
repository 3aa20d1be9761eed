"""Main texts of web pages, by wrappers that are inferred from all pages of their host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import cut, ready
from reposift.llm.page_wrappers import EMPTY, article_of, merged_runs
from reposift.llm.url_filter import host_and_path

# Hosts whose wrappers a task holds at once.
HELD_HOSTS = 2_000

# Tasks that share the wrappers of one host before the last.
SALTS = 16


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper for each host of the pages (url, html), as a written table (host, wrapper).

    Every task aligns the pages of each host that it reads; equal wrappers are then kept once, those of
    one host are aligned in :data:`SALTS` tasks, and theirs in one. What moves are wrappers, whose
    size goes with the kinds of elements that a host nests, not with its pages.
    """
    spark = ready(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    schema = "host string, wrapper string"

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"]):
                held[host] = held.get(host, EMPTY).with_page(page)
            if len(held) > HELD_HOSTS:
                yield _frame((h, w.text()) for h, w in held.items())
                held = {}
        yield _frame((h, w.text()) for h, w in held.items())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((h, w) for batch in batches for h, w in zip(batch["host"], batch["wrapper"]))
        for row in merged_runs(rows):
            yield _frame([row])

    found = pages.select(host.alias("host"), "html").mapInPandas(infer, schema).distinct()
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))
    for keys in (["host", salt], ["host"]):
        dealt = found.repartition(*keys).sortWithinPartitions("host", "wrapper")
        found = dealt.mapInPandas(merge, schema)
    return cut(found, "wrappers")


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["host", "wrapper"])


def extract_articles(
    pages: DataFrame, wrappers: DataFrame | None = None, names: tuple[str, str] = ("text", "n_chars")
) -> DataFrame:
    """Add the main text of each page (url, html) and its number of characters; ``html`` is dropped.

    The text is that of the article: not that of menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and reader comments. Character references are decoded, white space in a
    block becomes one space, and blocks are joined by two line ends. On pages without an article
    it is that of the main part, else what is not in the frame and not the same on all pages of the host.

    ``wrappers`` are those of :func:`infer_wrappers`, by default of the pages themselves. Pages
    meet the wrapper of their host in a join that Spark plans by size; if it shuffles, adaptive
    execution can split a host with many pages. Null and empty pages, and pages without text, give an empty text. A
    null url, or one without a host, counts as one host. Repeated rows each get their text; all other
    columns stay, whatever their names. An empty table gives an empty result.
    """
    ready(pages.sparkSession)
    wrappers = infer_wrappers(pages) if wrappers is None else wrappers
    text, n_chars = names
    kept = [c for c in pages.columns if c not in (*names, "html")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    host, _ = host_and_path(F.col("url"))

    @F.pandas_udf("string")
    def article(pages: pd.Series, wrappers: pd.Series) -> pd.Series:
        return pd.Series([article_of(page, wrapper) for page, wrapper in zip(pages, wrappers)], dtype=object)

    joined = pages.select(row, host.alias("host"), "html").join(wrappers, "host", "left")
    given = joined.select("row", article("html", F.coalesce("wrapper", F.lit(EMPTY.text()))).alias("found"))
    return given.select("row.*", F.col("found").alias(text), F.length("found").cast("long").alias(n_chars))
