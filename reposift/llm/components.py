"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import cut


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``id, component`` for every id of ``links`` (a, b): the smallest id that links reach.

    Every round gives each id the smallest component of its neighbours and then follows one
    step of the pointers, so chains halve. Links inside one component are dropped between
    rounds. Self links and repeated links do no harm; without links the result is empty.
    ``rows`` is about how many links there are, if known (see :func:`cut`).
    """
    links = links.filter("a <> b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(
        both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")),
        "components",
        rows,
    )
    while True:
        a = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        open_ = cut(
            links.join(a, "a").join(b, "b").filter("ca <> cb").select("a", "b", "ca", "cb"), "open", rows
        )
        if open_.isEmpty():
            return labels
        links = open_.select("a", "b")
        # Components are hung below the smallest one that an open link leads to.
        hung = (
            open_.select(F.greatest("ca", "cb").alias("component"), F.least("ca", "cb").alias("_to"))
            .groupBy("component")
            .agg(F.min("_to").alias("_to"))
        )
        follow = hung.select(F.col("component").alias("_to"), F.col("_to").alias("_next"))
        hung = hung.join(follow, "_to", "left").select(
            "component", F.coalesce("_next", "_to").alias("_to")
        )
        labels = cut(
            labels.join(hung, "component", "left").select(
                "id", F.coalesce("_to", "component").alias("component")
            ),
            "components",
            rows,
        )


def joined(labels: DataFrame, links: DataFrame, rows: int | None = None) -> DataFrame:
    """``labels`` (id, component) with the components that more ``links`` (a, b) connect as one.

    Only links between different components enter the rounds, as links between these; where none
    is left, the labels are returned as they are. Ids without a label so far are their own.
    """
    for side in "ab":
        named = labels.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))
        links = links.join(named, side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    between = cut(links.filter("a <> b").distinct(), "between", rows)
    if between.isEmpty():
        return labels
    merged = components(between, rows).withColumnRenamed("component", "_to")
    new = merged.select("id", F.col("id").alias("component")).join(labels.select("id"), "id", "left_anti")
    merged = merged.withColumnRenamed("id", "component")
    return cut(
        labels.unionByName(new)
        .join(merged, "component", "left")
        .select("id", F.coalesce("_to", "component").alias("component")),
        "components",
        rows,
    )
