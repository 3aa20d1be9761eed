"""Near-duplicates by bottom-k sketches from one hash function, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import as_signed, chunks, cut, mixed, only, ready, sent, unused, window_hashes, words_of_texts
from reposift.llm.components import components, joined

WIDTH = 5
KEPT = 64  # values of a sketch
FEW = 48  # sets of up to so many values can only link with sets whose sketch is complete
LEAST = 0.45  # estimate from which pairs are confirmed; five deviations below the threshold
NUMERATOR, DENOMINATOR = 75, 100
RUNS = 3  # runs that a larger set shares at least; linked sets share fewer with odds of 1e-6
SHORT = 8  # lists of so many classes at most are compared pair by pair
LIGHT = 32  # shingles of so many open classes at most pair them all


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence if it is shorter."""
    if len(words) == 0:
        return words
    if len(words) < WIDTH:
        return mixed(window_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(words, WIDTH))


def _digests(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Size and two order-free sums of each set; sets are equal when these are."""
    again = [mixed(x + np.uint64(0x9E3779B97F4A7C15)) for x in sets]
    return {
        "n": np.array([len(x) for x in sets], dtype=np.int64),
        "sum": as_signed(np.array([x.sum(dtype=np.uint64) for x in again], dtype=np.uint64)),
        "xor": as_signed(
            np.array([np.bitwise_xor.reduce(mixed(x)) if len(x) else 0 for x in again], dtype=np.uint64)
        ),
    }


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in chunks(batches):
        sets = [shingle_set(words) for words in words_of_texts(part["text"].tolist())]
        kept = [as_signed(x[:KEPT].copy()) for x in sets]
        yield pd.DataFrame({"doc_id": part["doc_id"], **_digests(sets), "sketch": kept})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in chunks(batches):
        sets = [shingle_set(words) for words in words_of_texts(part["text"].tolist())]
        yield pd.DataFrame({**_digests(sets), "shingles": [as_signed(x) for x in sets]})


def _runs(width: int):
    """Hashes of all runs of neighbours in a sketch."""
    sketch = F.col("sketch")
    return F.transform(
        F.sequence(F.lit(0), F.size(sketch) - width),
        lambda i: F.xxhash64(F.lit(width), *(sketch[i + j] for j in range(width))),
    )


def _keys():
    """Keys of the inverted lists: runs of neighbouring retained values.

    Two sets of similarity 3/4 differ in a quarter of their union, so in the order of the hash
    the differences cannot keep all neighbours apart: where the sketches hold the whole sets, a
    run of two is shared for certain. For larger sets, runs of three among the 64 smallest
    values of the union are missed with a probability of about 0.75 ** 64, or 1e-8, at the
    threshold, and much less above it. Texts that only share a passage share few such runs.
    """
    none = F.array().cast("array<bigint>")
    two = F.when(F.col("n").between(3, KEPT), _runs(2)).otherwise(none)
    three = F.when(F.col("n") > FEW, _runs(3)).otherwise(none)
    return F.concat(two, three)


def _estimate(a, b):
    """Share of the common values among the smallest ones of both sketches together."""
    smallest = F.slice(F.array_sort(F.transform(F.array_union(a, b), _unsigned)), 1, KEPT)
    common = F.transform(F.array_intersect(a, b), _unsigned)
    return F.size(F.array_intersect(smallest, common)) / F.size(smallest)


def _unsigned(value):
    """A signed word whose order is the unsigned order of the sketch."""
    return value.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with columns of both nodes."""
    for side in "ab":
        named = [F.col(c).alias(f"{c}_{side}") for c in columns]
        pairs = pairs.join(table.select(F.col("node").alias(side), *named), side)
    return pairs


def _similar(common, n_a="n_a", n_b="n_b"):
    return DENOMINATOR * common >= NUMERATOR * (F.col(n_a) + F.col(n_b) - common)


def _links(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """The ``pairs`` (a, b) that link: estimated on the sketches, then exact on whole sets."""
    likely = (
        _sides(pairs, sketches, "n", "sketch")
        .filter(_similar(F.least("n_a", "n_b")))
        .filter(_estimate(F.col("sketch_a"), F.col("sketch_b")) >= LEAST)
        .select("a", "b")
    )
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    linked = _sides(likely, sets, "n", "shingles").filter(_similar(common))
    return cut(linked.select("a", "b"), "links", rows)


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with the component that each has so far, itself if it has no link."""
    labels = labels.select(F.col("id").alias("node"), "component")
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _paired(rows: DataFrame, key: str, *conditions) -> DataFrame:
    """Pairs (a, b) of rows of one ``key`` in different components that meet the conditions."""
    left, right = (
        rows.select(key, *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != key))
        for side in "ab"
    )
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
    for condition in conditions:
        apart = apart & condition
    pairs = left.join(right, key).filter(apart)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _members(postings: DataFrame) -> DataFrame:
    """Rows (key, node, n, first, size) of the lists with more than one class.

    Classes that share too few runs with others to link are left out: in complete sketches of n
    values, linked sets have n / 2 - 1 neighbours in common for certain.
    """
    shared = postings.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    shared = cut(shared.filter("first < last").select("key"), "lists")
    members = cut(postings.join(shared, "key"), "postings")
    needed = F.when(F.col("n") <= FEW, F.ceil(F.col("n") / 2) - 1).otherwise(RUNS)
    enough = members.groupBy("node", "n").agg(F.count(F.lit(1)).alias("runs")).filter(F.col("runs") >= needed)
    members = members.join(enough.select("node"), "node")
    lists = members.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size"))
    return cut(members.join(lists.filter("size > 1"), "key"), "members")


def _rare_first(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each of the ``nodes``: the shingles that it must share one of to link with another.

    In the order of frequency among the nodes, linked sets share one of the first n / 4 + 1
    shingles of both. What no other node has is counted and left out; ``light`` are those of at
    most :data:`LIGHT` nodes. Two sets without a common light one have only frequent ones in
    common, of which ``heavy`` is the number, so they share one among ``first``, the first
    ``heavy - 3/4 n + 1`` of these.
    """
    entries = nodes.join(sets, "node").select("node", "n", F.explode("shingles").alias("shingle"))
    entries = entries.dropDuplicates(["node", "shingle"]) if _repeated(sets) else entries
    counts = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = entries.join(counts, "shingle").groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("known")
    )
    least = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)
    light = F.filter("known", lambda x: x["df"] <= LIGHT)
    known = known.filter(F.size("known") >= least).select(
        "node",
        "n",
        (F.size("known") - F.size(light)).alias("heavy"),
        F.filter(F.slice("known", 1, (F.size("known") - least + 1).cast("int")), lambda x: x["df"] <= LIGHT)[
            "shingle"
        ].alias("light"),
        F.filter("known", lambda x: x["df"] > LIGHT)["shingle"].alias("frequent"),
    )
    spare = F.greatest(F.col("heavy") - least + 1, F.lit(0)).cast("int")
    return cut(known.withColumn("first", F.slice("frequent", 1, spare)).drop("frequent"), "rare_first")


def _repeated(sets: DataFrame) -> bool:
    return not sets.groupBy("node").count().filter("count > 1").isEmpty()


def _within_reach(rows: DataFrame) -> DataFrame:
    """``rows`` (shingle, node, n, heavy, first, component) that a partner in their list may link with.

    With ``c`` values in common, sets of n and m values link when ``7 * c >= 3 * (n + m)``, and c
    is at most the smaller ``heavy``. So a row stays if its own reaches the smallest set of its list,
    and the largest of the list reaches it. Lists of one component go.
    """
    lists = rows.groupBy("shingle").agg(
        F.min("n").alias("_least"),
        F.max(7 * F.col("heavy") - 3 * F.col("n")).alias("_reach"),
        F.min("component").alias("_low"),
        F.max("component").alias("_high"),
    )
    lists = lists.filter("_low < _high").select("shingle", "_least", "_reach")
    near = (7 * F.col("heavy") >= 3 * (F.col("n") + F.col("_least"))) & (F.col("_reach") >= 3 * F.col("n"))
    return rows.join(lists, "shingle").filter(near).drop("_least", "_reach")


def _outside(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of one list in different components that may link, each pair once.

    The rows of a list's largest component are compared with the rows outside of it only, so a
    list that is one component but for a few rows makes so many times its length of pairs.
    """
    sizes = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("shingle").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("_parts")
    )
    rows = rows.join(main.filter("_parts > 1").drop("_parts"), "shingle")
    left, right = (
        rows.select("shingle", "main", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "heavy", "first", "component")))
        for side in "ab"
    )
    pairs = left.filter("component_a <> main").join(right.drop("main"), "shingle").filter(
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
        & _similar(F.least("heavy_a", "heavy_b"))
        & (F.array_min(F.array_intersect("first_a", "first_b")) == F.col("shingle"))
    )
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_links(
    members: DataFrame, sketches: DataFrame, sets: DataFrame, rows: int
) -> tuple[DataFrame, DataFrame]:
    """Links that give the same components as all links do, and these components.

    ``rows`` is about how many nodes and links there are (see :func:`cut`).
    """
    first = members.filter("node <> first").groupBy(F.col("first").alias("a"), F.col("node").alias("b"))
    first = first.agg(F.count(F.lit(1)).alias("runs")).filter(F.col("runs") >= RUNS).select("a", "b")
    links = _links(first, sketches, sets, rows)
    labels = components(links, rows)

    known = cut(_labelled(members.select("key", "size", "node", "n"), labels), "labelled")
    lists = known.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
    lists = lists.filter("_least < _most").select("key")
    open_ = cut(known.join(lists, "key", "left_semi"), "open_lists")
    near = _similar(F.least("n_a", "n_b"))
    short = _paired(open_.filter(F.col("size") <= SHORT).drop("size"), "key", near)
    nodes = open_.filter(F.col("size") > SHORT).select("node").distinct()
    rare = _rare_first(nodes, sets)

    def by_shingle(column: str, labels: DataFrame) -> DataFrame:
        return _labelled(rare.select("node", "n", "heavy", column), labels).withColumn(
            "shingle", F.explode(column)
        )

    light = _paired(
        by_shingle("light", labels),
        "shingle",
        near,
        F.array_min(F.array_intersect("light_a", "light_b")) == F.col("shingle"),
    )
    # A class with few shingles of its own is near all classes of a large group that can link.
    frequent = by_shingle("first", labels)
    hubs = frequent.groupBy("shingle").agg(
        F.max_by("node", F.col("heavy") / F.col("n")).alias("hub"), F.min("component").alias("_least"), F.max("component").alias("_most")
    )
    hubs = hubs.filter("_least < _most").select("shingle", "hub")
    around = frequent.join(hubs, "shingle").filter("node <> hub")
    around = around.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    more = _links(short.unionByName(light).unionByName(around).distinct(), sketches, sets, rows)
    labels = joined(labels, more, rows)

    rest = cut(_outside(_within_reach(by_shingle("first", labels))), "rest", rows)
    if rest.isEmpty():
        return links.unionByName(more), labels
    last = _links(rest, sketches, sets, rows)
    return links.unionByName(more).unionByName(last), joined(labels, last, rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents link when ``100 * common >= 75 * union`` holds for their sets of 5-word shingles;
    ``component_id`` is the smallest id that links reach. Documents with equal sets are one
    class and enter the search as one. In each inverted list every class is compared with the
    list's first one. Of lists that this leaves with several components, short ones are
    compared pair by pair, and the classes of long ones by shared rare shingles (see
    :func:`_rare_first`), which is exact; so a large group costs about as many comparisons as
    it has members, and no list is cut short.

    Texts that are null, empty or without words link with nothing. Rows without an id take no
    part: their ``component_id`` is null and they are kept. Rows that repeat an id and a text
    get equal rows; a repeated id with another text is judged by that text. Other columns are
    not read, and an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")
    )
    node = F.xxhash64("n", "sum", "xor")
    rows = cut(
        texts.mapInPandas(
            _sketches, "doc_id long, n long, sum long, xor long, sketch array<long>"
        ).withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), node)),
        "sketches",
    )
    count = rows.count()
    classes = cut(
        rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "classes", count
    )
    reps = rows.filter("n > 2").select("doc_id", "node", "n", "sketch").join(classes, ["node", "doc_id"])
    members = _members(reps.select("node", "n", F.explode(_keys()).alias("key")))
    nodes = cut(members.select("node").distinct().join(classes, "node"), "nodes", count)
    sketches = cut(only(reps, nodes.select("node")), "near_sketches")
    found = (
        only(texts, cut(nodes.select("doc_id").distinct(), "near_ids", count))
        .select("text")
        .mapInPandas(_sets, "n long, sum long, xor long, shingles array<long>")
        .select(node.alias("node"), "n", "shingles")
    )
    sets = cut(only(found, nodes.select("node")), "sets")
    _, labels = near_links(members, sketches, sets, count)

    linked = labels.select(F.col("id").alias("node"), "component").join(classes, "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = cut(linked.join(least, "component").select("node", "component_id"), "linked", count)
    named = classes.join(linked, "node", "left").select(
        "node", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n", "node").join(named, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each component and those without one, with all their columns."""
    decided = near_duplicates(docs, id_col, text_col)
    name = unused(docs, "gone")
    gone = cut(decided.filter("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone", docs.count())
    return docs.join(sent(gone), docs[id_col] == F.col(name), "left_anti")
