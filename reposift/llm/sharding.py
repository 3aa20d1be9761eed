"""Sharding by a k-d tree over metadata, with distributed weighted medians."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposift.llm.common import cut

LEVELS = 20  # bits of a coordinate
TIES = 24  # bits that order points of one coordinate
STEP = 11  # bits of a key that one pass over the points finds
TOLERANCE = 0.005  # of a leaf's bytes: lighter groups stay whole
FEW = 32  # rows; groups of fewer stay whole too, as a hash would divide them unevenly
PER_BUCKET = 20_000  # rows that one task numbers at once, about

_KEY_BITS = LEVELS + TIES


def _number_of(text: Column) -> Column:
    """The first six bytes of a text as a number that keeps their order; null comes first."""
    digits = F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(-1).cast("long")).cast("double")


def _groups(rows: DataFrame) -> DataFrame:
    """One point per group of equal texts: bytes, tie, and coordinates from 0 to 2^20 - 1."""
    plain = rows.groupBy("text_hash", "size", "text_crc32").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("d0"),
        _number_of(F.min("source")).alias("d1"),
        _number_of(F.min("lang")).alias("d2"),
        F.log2(F.first("size").cast("double")).alias("d3"),
    )
    plain = cut(plain, "groups")
    names = [f"d{i}" for i in range(4)]
    ends = plain.agg(*(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max))).first()

    def level(name: str) -> Column:
        low, high = ends[f"min_{name}"] or 0.0, ends[f"max_{name}"] or 0.0
        share = (F.col(name) - F.lit(low)) / F.lit((high - low) or 1.0)
        return F.floor(share * ((1 << LEVELS) - 1)).cast("long")

    return plain.select(
        "text_hash",
        "size",
        "text_crc32",
        (F.col("size") * F.col("n")).cast("double").alias("bytes"),
        F.col("n").cast("double").alias("n"),
        F.array(*map(level, names)).alias("at"),
        F.pmod(F.xxhash64("text_hash", F.lit("tie")), F.lit(1 << TIES)).alias("tie"),
        F.lit(0).alias("node"),
        F.lit(0.0).alias("low"),
        F.lit(1.0).alias("high"),
    )


def _small(points: DataFrame, rows: list[dict]) -> DataFrame:
    """A table of one row per open node, of which there are fewer than shards."""
    structs = [F.struct(*(F.lit(v).alias(k) for k, v in row.items())) for row in rows]
    return F.broadcast(points.sparkSession.range(1).select(F.inline(F.array(*structs))))


def _split(points: DataFrame, nodes: dict[int, int], tolerance: float) -> tuple[DataFrame, dict[int, int]]:
    """One level of the tree; ``nodes`` gives the leaves that are still to come below a node."""
    open_ = [node for node, leaves in nodes.items() if leaves > 1]
    dims = range(4)
    stats = points.filter(F.col("node").isin(open_)).groupBy("node").agg(
        F.sum("bytes").alias("bytes"),
        *((F.max(F.col("at")[i]) - F.min(F.col("at")[i])).alias(f"w{i}") for i in dims),
    )
    state = {}
    for row in stats.collect():
        widest = max(dims, key=lambda i: (row[f"w{i}"], -i))
        left = nodes[row["node"]] // 2
        state[row["node"]] = {
            "node": row["node"],
            "dim": widest,
            "goal": float(row["bytes"]) * left / nodes[row["node"]],
            "prefix": 0,
            "before": 0.0,
        }
    key = F.shiftleft(F.col("at")[F.col("dim")], TIES) + F.col("tie")
    shift = _KEY_BITS
    while shift and state:
        known, shift = shift, shift - STEP
        cuts = _small(points, list(state.values()))
        binned = (
            points.select("node", "bytes", "n", "at", "tie")
            .join(cuts, "node")
            .filter(F.shiftright(key, known) == F.col("prefix"))
            .groupBy("node", "goal", "before", F.shiftright(key, shift).alias("bin"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        )
        order = Window.partitionBy("node").orderBy("bin")
        sums = binned.withColumn("until", F.col("before") + F.sum("bytes").over(order))
        at = sums.filter(F.col("until") >= F.col("goal") - 0.5).groupBy("node").agg(
            F.min(F.struct("bin", "until", "bytes", "n")).alias("found")
        )
        for row in at.collect():
            one, found = state[row["node"]], row["found"]
            one["prefix"], one["before"] = found["bin"], found["until"] - found["bytes"]
            one["mass"], one["rows"] = found["bytes"], found["n"]
    cuts = []
    after = {node: leaves for node, leaves in nodes.items() if leaves == 1}
    for node, one in state.items():
        share = min(1.0, max(0.0, (one["goal"] - one["before"]) / one["mass"]))
        if one["mass"] <= tolerance or one["rows"] < FEW:
            share = float(round(share))
        cuts.append({"node": node, "dim": one["dim"], "cut": one["prefix"], "share": share})
        left = nodes[node] // 2
        after[2 * node + 1], after[2 * node + 2] = left, nodes[node] - left
    if not cuts:
        return points, {node: 1 for node in nodes}
    middle = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    sides = (
        (0, "low", middle, F.when(key < F.col("cut"), 1.0).when(key == F.col("cut"), F.col("share")).otherwise(0.0)),
        (1, middle, "high", F.when(key > F.col("cut"), 1.0).when(key == F.col("cut"), 1 - F.col("share")).otherwise(0.0)),
    )
    whole = key != F.col("cut")
    parts = F.array(
        *(
            F.struct(
                part.alias("part"),
                (2 * F.col("node") + 1 + side).cast("int").alias("node"),
                F.when(whole, F.col("low")).otherwise(F.col(low) if isinstance(low, str) else low).alias("low"),
                F.when(whole, F.col("high")).otherwise(F.col(high) if isinstance(high, str) else high).alias("high"),
            )
            for side, low, high, part in sides
        )
    )
    same = ["text_hash", "size", "text_crc32", "at", "tie"]
    moved = points.join(_small(points, cuts), "node").select(
        *same, "bytes", "n", F.explode(F.filter(parts, lambda p: p["part"] > 0)).alias("to")
    )
    moved = moved.select(
        "text_hash", "size", "text_crc32", (F.col("bytes") * F.col("to.part")).alias("bytes"),
        (F.col("n") * F.col("to.part")).alias("n"), "at", "tie",
        F.col("to.node").alias("node"), F.col("to.low").alias("low"), F.col("to.high").alias("high"),
    )
    closed = [node for node, leaves in nodes.items() if leaves == 1]
    return cut(moved.unionByName(points.filter(F.col("node").isin(closed))), "points"), after


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per document.

    Leaves are split at the weighted median of their widest dimension until they reach
    ``target_bytes`` (or the total's share of ``shards``); shards are the leaves from left to
    right. Dimensions are the id, source, language and size, of a group of equal texts the
    smallest of each, so groups stay whole; only a group at a median that outweighs half a
    percent of a leaf is divided there by a hash of the id, so one text may hold any share of
    the rows. The law is ``bytes``: sizes (bytes of the text and one) are near equal.

    Medians are found by histograms of 2048 bins per node, refined four times: what reaches the
    driver is one row per node. Slots number a shard's documents without gaps. Null texts count as
    empty, with size 1 and checksum 0; null metadata come first; repeated rows count each. ``source`` and
    ``lang`` may be missing. An empty table gives no rows.
    """
    text = F.col(text_col)
    metadata = [
        (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)
        for c in ("source", "lang")
    ]
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
            *metadata,
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = shards or max(1, ceil(total / target_bytes))
    points, nodes = cut(_groups(rows), "points"), {0: leaves}
    while max(nodes.values()) > 1:
        points, nodes = _split(points, nodes, TOLERANCE * total / leaves)

    shard = {node: i for i, node in enumerate(sorted(nodes, key=_place))}
    leaf = _small(points, [{"node": node, "shard": i} for node, i in shard.items()])
    same = ["text_hash", "size", "text_crc32"]
    draw = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 40)) / float(1 << 40)
    count = rows.count()
    buckets = max(1, count // PER_BUCKET)
    placed = cut(
        rows.withColumn("draw", draw)
        .join(points.join(leaf, "node").select(*same, "low", "high", "shard"), same)
        .filter((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")))
        .select(
            "doc_id",
            *same,
            "shard",
            F.pmod(F.xxhash64("doc_id", *same, F.lit("slot")), F.lit(buckets)).alias("bucket"),
        ),
        "placed",
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", *same)
    numbered = placed.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(counts, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _place(node: int) -> list[int]:
    """Way from the root to a node, by which leaves are ordered from left to right."""
    way = []
    while node:
        node, side = divmod(node - 1, 2)
        way.append(side)
    return way[::-1]
