"""The work queue on disk: ranges of the key, each with a log of changes, under numbered versions.

``<store>/queue/segment=<id>/range=<n>/`` holds rows, written by one writer into a folder of its
own; ``counts/segment=<id>/`` how they change the rows per status. A version,
``versions/<number>.json``, names for every range the segment that holds its base and those of
its log, oldest first. It is created once and never changed, and decides what readers see: of
two writers that want the same number one gets it, and the other makes its change again from the
version that came first. What a writer leaves behind without a version, nobody reads.

The log of a range holds the rows that changes touched, whole; the latest row of a key counts. A
range whose log has grown is written anew (:func:`compact_queue`), and split if it has grown too.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from reposift.functions.status import queue_status
from reposift.operators.report import details, report_of_counts
from reposift.schemas import QUEUE, QUEUE_KEY
from reposift.session import sized
from reposift.sources.folders import create_once, delete, exists, names, read_text

# A range is written anew when its log has as many segments, or so many rows for one of its base.
LOG_SEGMENTS = 16
LOG_ROWS = 4.0

# Counts that the driver gets; more are written by the tasks.
COLLECTED = 10_000

# A range with more rows is split when it is written anew.
RANGE_ROWS = 1_000_000

_WAS = "_was"
_RANGE = "_range"
_VALUES = [c for c in QUEUE.fieldNames() if c not in QUEUE_KEY]
_KEY_TYPE = StructType([QUEUE[c] for c in QUEUE_KEY])
# The values that a row had before, null if it is new, and the version that wrote it.
_SEGMENT = StructType([*QUEUE.fields]).add("was", StructType([QUEUE[c] for c in _VALUES]))
_SEGMENT = _SEGMENT.add("version", "long")
_COUNTS = (
    "range int, status string, details string, count long, rows long,"
    " low struct<owner: string, repo: string>"
)


@dataclass(frozen=True)
class Range:
    """A range of the key: from ``low``, or the least key for the first one, to that of the next."""

    number: int
    low: tuple[str | None, str | None]
    base: str
    rows: int
    pending: int
    log: tuple[str, ...] = ()
    log_rows: int = 0

    @property
    def segments(self) -> tuple[str, ...]:
        return (self.base, *self.log)


@dataclass(frozen=True)
class Version:
    """What a version consists of. ``ledger`` has the last batch of every source that feeds it."""

    number: int = 0
    ranges: tuple[Range, ...] = ()
    ledger: dict[str, int] = field(default_factory=dict)
    next_range: int = 0

    def pending(self) -> int:
        return sum(r.pending for r in self.ranges)

    def with_pending(self, rows: int | None) -> list[Range]:
        """The first ranges that hold ``rows`` pending rows, or all that hold any."""
        picked, left = [], rows
        for r in self.ranges:
            if left is not None and left <= 0:
                break
            if r.pending:
                picked.append(r)
                left = None if left is None else left - r.pending
        return picked

    def between(self, first: str, last: str) -> list[Range]:
        """The ranges that may hold keys of the owners from ``first`` to ``last``."""
        above = [*self.ranges[1:], None]
        return [
            r
            for i, (r, upper) in enumerate(zip(self.ranges, above))
            if (i == 0 or (r.low[0] or "") <= last)
            and (upper is None or (upper.low[0] or "") >= first)
        ]


class QueueMoved(RuntimeError):
    """Another writer has published a version since the queue was read."""


Change = Callable[[DataFrame], DataFrame]
Pick = Callable[[Version], list[Range]]


def _folder(store: str) -> str:
    return f"{store}/queue"


def _version_file(store: str, number: int) -> str:
    return f"{_folder(store)}/versions/{number:012d}.json"


def queue_versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the versions, ascending."""
    found = [re.fullmatch(r"(\d{12})\.json", name) for name in names(spark, f"{_folder(store)}/versions")]
    return [int(name[1]) for name in found if name]


_seen: dict[str, int] = {}


def latest_version(spark: SparkSession, store: str) -> int:
    """Number of the latest version, 0 if there is none.

    The folder is listed once; then the versions after the one seen last are looked for by name,
    as long as that one has not been removed.
    """
    number = _seen.get(store, 0)
    if not number or not exists(spark, _version_file(store, number)):
        number = max(queue_versions(spark, store), default=0)
    while number and exists(spark, _version_file(store, number + 1)):
        number += 1
    _seen[store] = number
    return number


def queue_version(spark: SparkSession, store: str, number: int | None = None) -> Version:
    """What a version consists of, by default the latest; an empty one if there is none."""
    number = latest_version(spark, store) if number is None else number
    if not number:
        return Version()
    stored = json.loads(read_text(spark, _version_file(store, number)))
    ranges = tuple(
        Range(**{**r, "low": tuple(r["low"]), "log": tuple(r["log"])}) for r in stored.pop("ranges")
    )
    return Version(**stored, ranges=ranges)


def _commit(spark: SparkSession, store: str, version: Version) -> bool:
    return create_once(spark, _version_file(store, version.number), json.dumps(asdict(version)))


# --- reading --------------------------------------------------------------------------


def _segments(spark: SparkSession, store: str, parts: Iterable[tuple[str, int]]) -> DataFrame:
    """Rows of the given (segment, range) folders."""
    paths = [f"{_folder(store)}/segment={segment}/range={number}" for segment, number in parts]
    schema = StructType([*_SEGMENT.fields]).add("segment", "string").add("range", "integer")
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", _folder(store)).parquet(*paths)


def _merged(spark: SparkSession, store: str, ranges: Sequence[Range]) -> DataFrame:
    """The queue's rows in the given ranges, with the number of their range.

    Ranges without a log are their base. In the others, the latest row of a key in the log stands
    for the one of the base. The log is aggregated and joined by the key; only the base of ranges
    that have a log is, and if the log has many rows, shuffled.
    """
    columns = [*QUEUE.fieldNames(), F.col("range").alias(_RANGE)]
    busy = [r for r in ranges if r.log]
    quiet = _segments(spark, store, [(r.base, r.number) for r in ranges if not r.log])
    quiet = quiet.select(*columns)
    if not busy:
        return quiet
    base = _segments(spark, store, [(r.base, r.number) for r in busy]).select(*columns)
    log = _segments(spark, store, [(s, r.number) for r in busy for s in r.log])
    row = F.struct(*_VALUES, F.col("range").alias(_RANGE))
    latest = log.groupBy(*QUEUE_KEY).agg(F.max_by(row, "version").alias("row"))
    latest = latest.select(*QUEUE_KEY, "row.*")
    changed = sized(latest.select(*[F.col(c).alias(f"_{c}") for c in QUEUE_KEY]), sum(r.log_rows for r in busy))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in QUEUE_KEY]
    rows = base.join(changed, same, "left_anti").unionByName(latest)
    return rows if len(busy) == len(ranges) else quiet.unionByName(rows)


def read_queue(
    spark: SparkSession, store: str, version: int | None = None, pick: Pick | None = None
) -> DataFrame:
    """The queue as of a version, by default the latest; an empty queue if there is none.

    ``pick`` chooses the ranges to read. Later changes do not reach the result.
    """
    state = queue_version(spark, store, version)
    ranges = state.ranges if pick is None else pick(state)
    return _merged(spark, store, ranges).drop(_RANGE)


def stored_report(spark: SparkSession, store: str, time: str) -> DataFrame:
    """The report of :func:`reposift.operators.report.queue_report` from the counts of the segments.

    It reads a few rows per segment and range, and no row of the queue.
    """
    return report_of_counts(_counts(spark, store, queue_version(spark, store).ranges), time)


def _counts(spark: SparkSession, store: str, ranges: Sequence[Range]) -> DataFrame:
    """Rows per status and details, summed over the segments."""
    folder = f"{_folder(store)}/counts"
    wanted = [(s, r.number) for r in ranges for s in r.segments]
    if not wanted:
        return spark.createDataFrame([], "status string, details string, count long")
    schema = StructType.fromDDL(_COUNTS).add("segment", "string")
    parts = spark.createDataFrame(wanted, "segment string, range int")
    paths = [f"{folder}/segment={segment}" for segment in dict(wanted)]
    counts = spark.read.schema(schema).option("basePath", folder).json(paths)
    summed = counts.join(parts, ["segment", "range"]).groupBy("status", "details")
    return summed.agg(F.sum("count").alias("count")).filter("count <> 0")


# --- writing --------------------------------------------------------------------------


def _write_segment(rows: DataFrame, store: str, lows: bool) -> tuple[str, dict[int, dict]]:
    """Write rows as a segment with its counts; its name, and figures of every range.

    The figures are sums of the counts: how many rows are ``new`` or more or less ``pending`` than
    before, the ``rows`` written, and the lowest key.
    """
    segment, spark = uuid.uuid4().hex, rows.sparkSession
    path, counts = f"{_folder(store)}/segment={segment}", f"{_folder(store)}/counts/segment={segment}"
    rows.write.partitionBy("range").option("compression", "zstd").parquet(path)
    written = StructType([*_SEGMENT.fields]).add("range", "integer")
    low = F.min(F.struct(*QUEUE_KEY)) if lows else F.lit(None).cast(_KEY_TYPE)
    values = ", ".join(_VALUES)
    both = f"explode(array(struct({values}, 1 as n), struct(was.*, if(was is null, 0, -1) as n))) as row"
    groups = (
        spark.read.schema(written)
        .parquet(path)
        .selectExpr("range", *QUEUE_KEY, both)
        .select("range", *QUEUE_KEY, "row.*")
        .filter("n <> 0")
        .groupBy("range", queue_status().alias("status"), details(queue_status()).alias("details"))
        .agg(F.sum("n").alias("count"), F.count_if(F.col("n") > 0).alias("rows"), low.alias("low"))
    )
    few = [row.asDict(recursive=True) for row in groups.limit(COLLECTED + 1).collect()]
    if len(few) <= COLLECTED:
        create_once(spark, f"{counts}/counts.json", "\n".join(map(json.dumps, few)))
        return segment, _figures(few)
    groups.write.json(counts)
    pending = F.sum(F.when(F.col("status") == "PENDING", F.col("count")).otherwise(0))
    sums = spark.read.schema(_COUNTS).json(counts).groupBy("range").agg(
        F.sum("count").alias("new"), F.sum("rows").alias("rows"), pending.alias("pending"), F.min("low").alias("low")
    )
    return segment, {row["range"]: row.asDict(recursive=True) for row in sums.collect()}


def _figures(counts: list[dict]) -> dict[int, dict]:
    """The figures of :func:`_write_segment` from its counts."""
    figures: dict[int, dict] = {}
    for c in counts:
        f = figures.setdefault(c["range"], {"new": 0, "rows": 0, "pending": 0, "low": c["low"]})
        f["new"] += c["count"]
        f["rows"] += c["rows"]
        f["pending"] += c["count"] if c["status"] == "PENDING" else 0
        if c["low"] is not None:
            f["low"] = min(f["low"], c["low"], key=lambda low: tuple((v is not None, v) for v in low.values()))
    return figures


def _plain(rows: DataFrame, version: int, *further: Column) -> DataFrame:
    """Rows of the queue as a segment has them, not changes of earlier ones."""
    was = F.lit(None).cast(_SEGMENT["was"].dataType).alias("was")
    return rows.select(*QUEUE.fieldNames(), was, F.lit(version).cast("long").alias("version"), *further)


def _write_base(rows: DataFrame, store: str, state: Version, piece: Column | None = None) -> list[Range]:
    """Write rows as the base of new ranges, numbered from ``state.next_range`` on.

    Rows are range-partitioned by their key; each partition, of ``piece`` if given, is a range.
    """
    number = (F.spark_partition_id() + state.next_range).alias("range")
    rows = _plain(rows, state.number + 1, *([] if piece is None else [piece.alias("_piece")]))
    keys = [*([] if piece is None else ["_piece"]), *QUEUE_KEY]
    dealt = rows.repartitionByRange(*keys).select(*_SEGMENT.fieldNames(), number)
    segment, figures = _write_segment(dealt.sortWithinPartitions("range", *QUEUE_KEY), store, True)
    return [
        Range(n, tuple(f["low"].values()), segment, f["rows"], f["pending"])
        for n, f in sorted(figures.items())
    ]


def publish_queue(queue: DataFrame, store: str, expected: int | None = None) -> DataFrame:
    """Replace the queue, as the next version, and read it back.

    With ``expected``, the version that it was made from, a later one makes it fail; without, the
    queue replaces whatever version is the latest in the end.
    """
    spark = queue.sparkSession
    while True:
        state = queue_version(spark, store)
        if expected is not None and state.number != expected:
            raise QueueMoved(f"the queue is at version {state.number}, not {expected}")
        ranges = _write_base(queue, store, state)
        if _commit(spark, store, _after(state, ranges)):
            return read_queue(spark, store, state.number + 1)
        _discard(spark, store, {r.base for r in ranges})
        if expected is not None:
            raise QueueMoved(f"another writer has published version {expected + 1}")


def _after(state: Version, ranges: Iterable[Range], batch: tuple[str, int] | None = None) -> Version:
    """The version that follows ``state`` with these ranges."""
    ranges = tuple(ranges)
    ledger = state.ledger if batch is None else {**state.ledger, batch[0]: batch[1]}
    top = max([state.next_range, *[r.number + 1 for r in ranges]])
    return replace(state, number=state.number + 1, ranges=ranges, ledger=ledger, next_range=top)


def _discard(spark: SparkSession, store: str, segments: Iterable[str]) -> None:
    for segment in segments:
        delete(spark, f"{_folder(store)}/segment={segment}")
        delete(spark, f"{_folder(store)}/counts/segment={segment}")


def change_queue(
    spark: SparkSession,
    store: str,
    change: Change,
    tries: int = 10,
    pick: Pick | None = None,
    batch: tuple[str, int] | None = None,
) -> DataFrame:
    """Apply a change to the latest version, write the rows that it touched, and read the queue.

    ``change`` takes the queue, or the ranges of it that ``pick`` chooses, and returns it changed:
    rows that differ from before, or that are new, are written to the logs of their ranges; a row
    that is left out stays. If another writer came first and has touched one of the ranges that
    were read, the change is made again; if not, it is published as it is. With ``batch``, a source
    and the number of its batch, a batch that the ledger knows is not applied again.
    """
    applied = apply_change(spark, store, change, tries, pick, batch)
    ranges = [r for r in applied.version.ranges if applied.read is None or r.number in applied.read]
    return _merged(spark, store, ranges).drop(_RANGE)


class Applied(NamedTuple):
    """A change that was published: its version, the numbers of the ranges that it read (None: all)
    and the segment that holds the rows it touched (None: there are none)."""

    version: Version
    read: set[int] | None = None
    segment: str | None = None


def apply_change(
    spark: SparkSession,
    store: str,
    change: Change,
    tries: int = 10,
    pick: Pick | None = None,
    batch: tuple[str, int] | None = None,
) -> Applied:
    """What :func:`change_queue` does, without reading the queue afterwards."""
    for left in reversed(range(tries)):
        state = queue_version(spark, store)
        if batch is not None and state.ledger.get(batch[0], -1) >= batch[1]:
            return Applied(state)
        try:
            if state.ranges:
                applied = _log_change(spark, store, state, change, pick, batch)
                compact_queue(spark, store)
                return applied
            return _first_rows(spark, store, state, change, batch)
        except QueueMoved:
            if not left:
                raise


def _first_rows(
    spark: SparkSession, store: str, state: Version, change: Change, batch: tuple[str, int] | None
) -> Applied:
    """Apply a change to a queue without rows: what it returns is the base of the first ranges."""
    ranges = _write_base(change(spark.createDataFrame([], QUEUE)), store, state)
    if not ranges and batch is None:
        return Applied(state)
    after = _after(state, ranges, batch)
    if _commit(spark, store, after):
        return Applied(after)
    _discard(spark, store, {r.base for r in ranges})
    raise QueueMoved(f"another writer has published version {after.number}")


def touched_rows(spark: SparkSession, store: str, segment: str | None) -> DataFrame:
    """The rows that a change has written; they stay as long as its version."""
    if segment is None:
        return spark.createDataFrame([], QUEUE)
    path = f"{_folder(store)}/segment={segment}"
    return spark.read.schema(_SEGMENT).parquet(path).select(*QUEUE.fieldNames())


def _log_change(
    spark: SparkSession,
    store: str,
    state: Version,
    change: Change,
    pick: Pick | None,
    batch: tuple[str, int] | None,
) -> Applied:
    """Write a change of ``state`` to the logs and publish it."""
    read = list(state.ranges) if pick is None else pick(state)
    rows = _touched(state, _merged(spark, store, read), change)
    segment, figures = _write_segment(rows, store, False)
    numbers = {r.number for r in read}
    if not figures:
        _discard(spark, store, [segment])
        if batch is None:
            return Applied(state, numbers)
    latest = state
    while True:
        ranges = []
        for r in latest.ranges:
            if f := figures.get(r.number):
                r = replace(
                    r,
                    log=(*r.log, segment),
                    log_rows=r.log_rows + f["rows"],
                    rows=r.rows + f["new"],
                    pending=r.pending + f["pending"],
                )
            ranges.append(r)
        after = _after(latest, ranges, batch)
        if _commit(spark, store, after):
            return Applied(after, numbers, segment if figures else None)
        latest = queue_version(spark, store)
        still = {r.number: r for r in latest.ranges}
        known = batch is not None and latest.ledger.get(batch[0], -1) >= batch[1]
        if known or any(still.get(r.number) != r for r in read) or not figures.keys() <= still.keys():
            _discard(spark, store, [segment])
            raise QueueMoved(f"another writer has published version {latest.number}")


def _touched(state: Version, queue: DataFrame, change: Change) -> DataFrame:
    """The rows that a change makes different or adds, as a segment has them."""
    given = queue.withColumn(_WAS, F.struct(*_VALUES))
    changed = change(given)
    if not {_WAS, _RANGE} <= set(changed.columns):
        before = given.select(*[F.col(c).alias(f"_{c}") for c in QUEUE_KEY], _WAS, _RANGE)
        before = sized(before, sum(r.rows for r in state.ranges))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in QUEUE_KEY]
        changed = changed.select(*QUEUE.fieldNames()).join(before, same, "left")
    values = ", ".join(_VALUES)
    changed = changed.filter(f"{_WAS} is null or not {_WAS} <=> struct({values})")
    lows = json.dumps([dict(zip(QUEUE_KEY, r.low)) for r in state.ranges[1:]])
    above = F.from_json(F.lit(lows), ArrayType(_KEY_TYPE)).alias("lows")
    numbers = ", ".join(str(r.number) for r in state.ranges)
    key = ", ".join(QUEUE_KEY)
    place = f"get(array({numbers}), size(filter(lows, low -> low <= struct({key}))))"
    rows = changed.select("*", above).selectExpr(
        *QUEUE.fieldNames(),
        f"{_WAS} as was",
        f"{state.number + 1}L as version",
        f"coalesce({_RANGE}, {place}) as range",
    )
    return rows.hint("rebalance", F.col("range"))


def compact_queue(spark: SparkSession, store: str, pick: Pick | None = None) -> int | None:
    """Write ranges anew without their logs; the number of the new version, None if nothing was done.

    By default these are the ranges whose log has grown (:data:`LOG_SEGMENTS`, :data:`LOG_ROWS`);
    ``pick`` chooses others. A range of more than :data:`RANGE_ROWS` rows becomes several. If
    another writer has touched one of the ranges meanwhile, the work is given up.
    """
    state = queue_version(spark, store)
    picked = [
        r
        for r in (state.ranges if pick is None else pick(state))
        if r.log and (pick is not None or len(r.log) >= LOG_SEGMENTS or r.log_rows >= LOG_ROWS * max(r.rows, 1))
    ]
    if not picked:
        return None
    rows = _merged(spark, store, picked)
    large = [r.number for r in picked if r.rows > RANGE_ROWS]
    small = [r for r in picked if r.number not in large]
    fresh = []
    if small:
        part = rows.filter(~F.col(_RANGE).isin(large)) if large else rows
        fresh += _write_same(part, store, state, small)
    top = max([state.next_range, *[r.number + 1 for r in fresh]])
    for r in picked:
        if r.number in large:
            own = rows.filter(F.col(_RANGE) == r.number)
            fresh += _write_base(own, store, replace(state, next_range=top))
            top = fresh[-1].number + 1
    latest = state
    while True:
        gone = {r.number for r in picked}
        still = {r.number: r for r in latest.ranges}
        moved = any(still.get(r.number) != r for r in picked) or latest.next_range != state.next_range
        ranges = [r for r in latest.ranges if r.number not in gone] + fresh
        ranges.sort(key=lambda r: tuple((value is not None, value) for value in r.low))
        if not moved and _commit(spark, store, _after(latest, ranges)):
            return latest.number + 1
        if moved:
            _discard(spark, store, {r.base for r in fresh})
            return None
        latest = queue_version(spark, store)


def _write_same(rows: DataFrame, store: str, state: Version, ranges: Sequence[Range]) -> list[Range]:
    """Write whole ranges as new ones, each under a number of its own."""
    old = F.array(*[F.lit(r.number) for r in ranges])
    number = (F.array_position(old, F.col(_RANGE)) - 1 + state.next_range).cast("int").alias("range")
    dealt = _plain(rows, state.number + 1, number).hint("rebalance", F.col("range"))
    segment, figures = _write_segment(dealt, store, True)
    return [
        Range(n, ranges[n - state.next_range].low, segment, f["rows"], f["pending"])
        for n, f in sorted(figures.items())
    ]


def claim_token(spark: SparkSession, store: str, token: int | str) -> None:
    """Take a token for a claim; fails if a claim has taken it before."""
    if not create_once(spark, f"{_folder(store)}/claims/{token}", ""):
        raise ValueError(f"the queue knows a claim {token}")


def vacuum_queue(spark: SparkSession, store: str, keep: int = 2) -> None:
    """Remove all versions but the latest ``keep``, and the segments that only they name.

    No reader of older ones may be at work. Segments that no version names yet stay: their writer
    may still be at work.
    """
    known = queue_versions(spark, store)
    old, kept = known[: -max(keep, 1)], known[-max(keep, 1) :]

    def named(numbers: list[int]) -> set[str]:
        states = [queue_version(spark, store, n) for n in numbers]
        return {s for state in states for r in state.ranges for s in r.segments}

    _discard(spark, store, named(old) - named(kept))
    for number in old:
        delete(spark, _version_file(store, number))


def scan_queue_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    predicates: Sequence[str],
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Read a queue table from a database; filters and limits are pushed to it.

    ``predicates`` are conditions that split the table; each is read by a task of its own.
    """
    if not predicates:
        raise ValueError("predicates must split the table")
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=properties or {})


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    connections: int,
    mode: str = "append",
    batch_rows: int = 1000,
    properties: dict[str, str] | None = None,
) -> None:
    """Write rows to a database in batches, with at most ``connections`` connections."""
    writer = df.write.format("jdbc").options(**(properties or {}))
    writer = writer.option("url", url).option("dbtable", table).option("batchsize", batch_rows)
    writer.option("numPartitions", connections).mode(mode).save()
