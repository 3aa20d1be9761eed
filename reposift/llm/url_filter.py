"""URL filters: rules by host and path, and a list behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL = 16
WORDS = 4  # 64-bit words of a block; each listed URL sets two bits in every one
MAX_BLOCKS = 1 << 18  # bound of what is sent to the executors: 8 MB of bits

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null and without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.`` and path without page suffix and closing slashes.

    Scheme, query and fragment play no part. Null where there is no host.
    """
    plain = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), plain))


def _best_rule(rules: Sequence[Rule], host: Column, path: Column, give) -> Column:
    """``give`` of the longest rule that fits; of equally long ones, the one listed first."""
    found = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(give(rule))).otherwise(found)
    return found


def _bits(url: Column) -> list[Column]:
    """The bits of a URL in each word of its block."""
    bits = F.xxhash64(url, F.lit("bits"))
    places = [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(2 * WORDS)]
    one = F.lit(1).cast("long")
    return [
        F.call_function("shiftleft", one, places[2 * i]).bitwiseOR(F.call_function("shiftleft", one, places[2 * i + 1]))
        for i in range(WORDS)
    ]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w3`` of the distinct URLs in ``listed`` (url): at most ``blocks`` rows."""
    words = _bits(F.col("url"))
    rows = listed.select(
        F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words))
    )
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The longest rule that fits decides. Where none does, a page is blocked if its canonical URL
    is among ``listed`` (url, distinct canonical URLs), else allowed. URLs meet a blocked Bloom
    filter first, one block of 256 bits each; only possible hits are shuffled to the list, where
    a hash join removes the false ones. The filter is sized by the list, up to a fixed bound:
    beyond it more URLs reach the join, with the same result. Null URLs and those without a
    host match no rule and are allowed. Repeated rows are judged each; other columns are not
    read; empty tables give no rows, and an empty list blocks nothing.
    """
    url = F.col(url_col)
    host, path = host_and_path(url)
    named = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = named.select(
        "page_id",
        "host",
        "path",
        _best_rule(rules, host, path, lambda r: r.name).alias("rule"),
        _best_rule(rules, host, path, lambda r: r.verdict).alias("verdict"),
        canonical(host, path).alias("_url"),
    )
    known = listed.count()
    blocks = min(MAX_BLOCKS, 1 << ceil(log2(max(1, known * BITS_PER_URL / (64 * WORDS)))))
    filter_ = bloom_filter(listed, blocks)
    block = F.when(F.col("verdict").isNull(), F.pmod(F.xxhash64("_url"), F.lit(blocks)))
    # At most MAX_BLOCKS rows.
    probed = judged.withColumn("block", block).join(F.broadcast(filter_), "block", "left")
    hit = F.lit(True)
    for i, bits in enumerate(_bits(F.col("_url"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bits) == bits)
    hit = F.coalesce(hit, F.lit(False))
    result = ["page_id", "host", "path", "rule"]
    clear = probed.filter(~hit).select(*result, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    exact = listed.select(F.col("url").alias("_url"), F.lit("block").alias("_listed"))
    possible = probed.filter(hit).join(exact, "_url", "left")
    return clear.unionByName(possible.select(*result, F.coalesce("_listed", F.lit("allow")).alias("verdict")))
