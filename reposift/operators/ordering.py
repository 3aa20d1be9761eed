"""Positions and limits under a total order, without a task that holds a whole hot group."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from reposift.session import written_table

# Most rows of a group that one task may sort.
GROUP_ROWS_PER_TASK = 1_000_000

# Most rows that the last task of a limit may get from the tasks before it.
MERGED = 1_000_000

# Rows that a round of the search for the n-th row draws, and keys that it counts rows below.
SAMPLE = 2_048
SPLITTERS = 32


class Nth(NamedTuple):
    """A row, and how many come before it in the order, without and with those that equal it."""

    row: tuple
    below: int
    upto: int


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_group: int = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Add ``position`` (1, 2, … within ``keys``) and ``group_rows`` (size of the group).

    The other columns settle ties of ``order``, so rows that still tie are equal. The largest group is counted first:
    if one task can sort it, a window does the work in one shuffle; if a single key holds
    more than ``max_group`` rows, the rows are range-partitioned instead, which splits that
    key over many tasks.
    """
    keys, order = list(keys), list(order)
    order += [c for c in df.columns if c not in [*keys, *order]]
    if keys and _largest_group(df, keys) <= max_group:
        group = Window.partitionBy(*keys)
        return df.withColumns(
            {
                "position": F.row_number().over(group.orderBy(*order)).cast("long"),
                "group_rows": F.count(F.lit(1)).over(group),
            }
        )
    return _number_by_range(df, keys, order)


def _largest_group(df: DataFrame, keys: list[str]) -> int:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _number_by_range(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    # Every partition is a contiguous piece of the order; pieces and seats within them are
    # pinned by writing the table, as a second evaluation could draw other range bounds.
    sorted_rows = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumns(
            {"_piece": F.spark_partition_id(), "_seat": F.monotonically_increasing_id()}
        )
    )
    rows = written_table(sorted_rows, "numbered")

    # One row per key and piece. A key has at most as many as there are partitions.
    pieces = rows.groupBy(*keys, "_piece").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seat").alias("_first_seat")
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *keys,
        "_piece",
        "_first_seat",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias("group_rows"),
    )
    same = F.col("row._piece") == F.col("part._piece")
    for key in keys:
        same = same & F.col(f"row.`{key}`").eqNullSafe(F.col(f"part.`{key}`"))
    position = F.col("_before") + F.col("_seat") - F.col("_first_seat") + 1
    return (
        rows.alias("row")
        .join(pieces.alias("part"), same)
        .select(
            *[F.col(f"row.`{c}`") for c in df.columns],
            position.alias("position"),
            "group_rows",
        )
    )


def nth_row(df: DataFrame, n: int, order: Sequence[str]) -> Nth | None:
    """The ``n``-th row of ``df`` by ``order``, counted from 1; None if there are fewer.

    No row is shuffled and no task keeps more than :data:`SAMPLE` of them: an interval of the
    order that holds the row is narrowed by the counts of rows between a few keys, which are
    drawn near the place of the row. Every round is two scans and leaves about a thirtieth of
    the rows; an interval that fits in a sample is read off it. ``df`` is scanned several
    times, so it should be a stored table or cheap to make. Columns of the order are texts,
    numbers or booleans.
    """
    key = F.struct(*order)
    inside, rank, below = df.select(*order), n, 0
    schema = inside.schema
    while True:
        seen = Observation()
        drawn = (
            inside.observe(seen, F.count(F.lit(1)).alias("rows"))
            .orderBy(F.xxhash64(*order, F.monotonically_increasing_id()))
            .limit(SAMPLE)
        )
        sample = sorted((tuple(row) for row in drawn.collect()), key=_nulls_first)
        # A task that runs again is observed again, so the observed rows only say where to look.
        if len(sample) < SAMPLE:
            if len(sample) < rank:
                return None
            found = sample[rank - 1]
            first, last = sample.index(found), len(sample) - sample[::-1].index(found)
            return Nth(found, below + first, below + last)
        splitters = _splitters(sample, min(1.0, rank / max(seen.get["rows"], SAMPLE)))
        keys = _literals(splitters, schema)
        place = F.expr(_place(0, len(splitters))).alias("place")
        counts = inside.select(key.alias("key"), keys.alias("keys")).groupBy(place).count().collect()
        rows = [0] * (2 * len(splitters) + 1)
        for place, count in counts:
            rows[place] = count
        if sum(rows) < rank:
            return None
        before = 0
        for place, count in enumerate(rows):
            if before + count >= rank:
                break
            before += count
        i = place // 2
        if place % 2:
            return Nth(splitters[i], below + before, below + before + rows[place])
        if i > 0:
            inside = inside.filter(key > F.get(_literals([splitters[i - 1]], schema), F.lit(0)))
        if i < len(splitters):
            inside = inside.filter(key < F.get(_literals([splitters[i]], schema), F.lit(0)))
        rank, below = rank - before, below + before


def _nulls_first(row: tuple) -> tuple:
    return tuple((value is not None, value) for value in row)


def _splitters(sample: list[tuple], share: float) -> list[tuple]:
    """Keys of the sorted sample around the place that holds ``share`` of the rows before it."""
    middle = share * len(sample)
    reach = 4 * math.sqrt(len(sample) * share * (1 - share)) + 2
    first = max(0, math.floor(middle - reach))
    last = min(len(sample) - 1, math.ceil(middle + reach))
    step = max(1, math.ceil((last - first) / (SPLITTERS - 1)))
    return list(dict.fromkeys(sample[i] for i in [*range(first, last, step), last]))


def _literals(rows: list[tuple], schema: StructType) -> Column:
    """The rows as an array of structs, which Spark folds to a constant."""
    text = json.dumps([dict(zip(schema.fieldNames(), row)) for row in rows])
    return F.from_json(F.lit(text), ArrayType(schema))


def _place(low: int, high: int) -> str:
    """SQL that looks ``key`` up in the sorted ``keys``: 2i+1 if it is the i-th, 2i if just below it."""
    if low == high:
        return f"if(key = get(keys, {low}), {2 * low + 1}, {2 * low})"
    middle = (low + high) // 2
    return f"if(key <= get(keys, {middle}), {_place(low, middle)}, {_place(middle + 1, high)})"


def _few(df: DataFrame, n: int) -> bool:
    """True if the first ``n`` rows of every task are few enough for one task."""
    return n <= MERGED and n * df.rdd.getNumPartitions() <= MERGED


def within_first(df: DataFrame, n: int, order: Sequence[str]) -> Column:
    """Condition on ``order`` that holds for the first ``n`` rows of ``df`` and none after them.

    Rows that tie with the last one pass as well. If the first ``n`` rows of all tasks may meet in
    one task (:data:`MERGED`), they do, in the plan of whoever uses the condition; else the last
    row is looked for at once (see :func:`nth_row`).
    """
    if n < 0:
        raise ValueError("the number of rows must not be negative")
    if n == 0:
        return F.lit(False)
    key, rows = F.struct(*order), df.select(*order)
    if _few(rows, n):
        last = rows.orderBy(*order).limit(n).agg(F.max(F.struct(*order))).scalar()
        return F.coalesce(key <= last, F.lit(False))
    found = nth_row(rows, n, order)
    if found is None:
        return F.lit(True)
    return key <= F.get(_literals([found.row], rows.schema), F.lit(0))


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by ``order``, in no order; rows that tie are settled by their other columns.

    Up to :data:`MERGED` rows are merged in one task, after every task has kept its first ``n``.
    Beyond, the ``n``-th row is looked for (see :func:`nth_row`), and one filter keeps the rows up
    to it. Of rows equal to it in every column, as many as are wanted are made again from it.
    """
    if n < 0:
        raise ValueError("the number of rows must not be negative")
    if n == 0:
        return df.filter(F.lit(False))
    order = [*order, *[c for c in df.columns if c not in order]]
    if _few(df, n):
        return df.orderBy(*order).limit(n)
    found = nth_row(df, n, order)
    if found is None:
        return df
    row = F.get(_literals([found.row], df.select(*order).schema), F.lit(0))
    if found.upto == n:
        return df.filter(F.struct(*order) <= row)
    copies = df.sparkSession.range(n - found.below).select(row.alias("row")).select("row.*")
    return df.filter(F.struct(*order) < row).unionByName(copies.select(*df.columns))
