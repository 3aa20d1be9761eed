"""Repository-shaped tables derived from the star-schema test tables, row by row.

Used by the registered queries, the tests and the benchmark. All of them grow with the
tables they are made from.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.operators.ordering import number_rows
from reposift.session import written_table


_written: dict[tuple[str, str, str], DataFrame] = {}


def _once(build):
    """Write the table at its first use in an application, so that queries measure the
    operators and not the making of their input."""

    @functools.wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, build.__name__, sf_dir)
        if key not in _written:
            _written[key] = written_table(build(spark, sf_dir), build.__name__)
        return _written[key]

    return read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(day: Column) -> Column:
    """Midnight of a date as epoch seconds, whatever the session's zone."""
    return F.unix_date(day.cast("date")).cast("long") * 86400


def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of one project per order, some of them bad."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "'cust' || o_custkey as owner",
        "'repo' || o_orderkey % 7 as repo",
        "case o_orderkey % 5 when 0 then 'JavaScript' when 1 then 'TypeScript'"
        " when 2 then 'CoffeeScript' when 3 then 'Python' else 'javascript' end as language",
        "case when o_orderkey % 97 = 3 then '2012-13-45 00:00:00'"
        " else cast(cast(o_orderdate as date) as string) || ' 00:00:00' end as created_at",
        "case when o_orderpriority = '1-URGENT' then cast(o_custkey as string)"
        " else chr(92) || 'N' end as forked_from",
        "case when o_orderkey % 97 = 2 then 'x' when o_orderstatus = 'F' then '1'"
        " else '0' end as deleted",
        "case when o_orderkey % 97 in (1, 2, 3, 4) then o_orderkey % 97 else 0 end as bad_kind",
    )


@_once
def project_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project list as CSV lines: bad urls, numbers, dates and quotes among them."""
    return project_fields(spark, sf_dir).selectExpr(
        "concat_ws(',', id,"
        " '\"https://api.github.com/repos/' || owner"
        "   || case when bad_kind = 1 then '' else '/' || repo end || '\"',"
        " id, '\"' || repo || '\"',"
        " case when bad_kind = 4 then '\"quoted\" text' else '\"says \"\"hi\"\", twice\"' end,"
        " '\"' || language || '\"', '\"' || created_at || '\"', forked_from, deleted,"
        " created_at) as value"
    )


# Errors of queue rows: one for each pattern of the report and of the reset, some for two.
QUEUE_TEXTS = (
    "https://host: 503 Service Unavailable",
    "Socket is closed",
    "File name too long: a",
    "unlisted failure text that runs well past the fifty character mark",
    "a: No such file or directory",
    "cannot open git-upload-pack",
    "git-upload-pack not permitted on x",
    "authentication not supported",
    "Duplicate stages not allowed: 1",
    "Nul character not allowed: b",
    "No space left on device",
    "SSL peer shut down incorrectly",
    "Shutdown in progress",
    "Read timed out after 120,000 ms",
    "Connection timed out (Connection timed out)",
    "cannot open git-upload-pack: 503 Service Unavailable",
    "File name too long: No such file or directory",
)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work queue in all states, one row per order."""
    texts = ", ".join(f"'{text}'" for text in QUEUE_TEXTS)
    return table(spark, sf_dir, "orders").selectExpr(
        "'cust' || o_custkey as owner",
        "'repo' || o_orderkey as repo",
        "case when o_orderstatus in ('F', 'P')"
        " then cast(1528559497000 + o_orderkey % 3 as string) end as checkout_id",
        f"get(array({texts}), cast(o_orderkey % 29 as int)) as result",
        "o_orderstatus = 'F' as completed",
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit log, one commit per order; many fall on the same second."""
    return table(spark, sf_dir, "orders").select(
        F.expr("'cust' || o_custkey").alias("owner"),
        F.expr("'repo' || o_orderkey % 7").alias("repo"),
        F.expr("md5(cast(o_orderkey as string))").alias("commit_id"),
        F.expr("md5('tree' || o_orderkey)").alias("tree_id"),
        _seconds(F.col("o_orderdate")).alias("commit_time_s"),
        F.expr("'u' || o_custkey || '@x.org'").alias("author"),
        F.col("o_orderpriority").alias("message"),
        F.col("o_orderkey").alias("seq"),
    )


def _supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return table(spark, sf_dir, "lineitem").select(
        F.lit("acme").alias("owner"),
        F.expr("'supp' || l_suppkey").alias("repo"),
        F.concat_ws("-", F.lit("c"), "l_suppkey", F.date_format(month, "yyyyMM")).alias("commit_id"),
        _seconds(month).alias("commit_time_s"),
        F.expr("case l_linenumber % 4 when 0 then '.js' when 1 then '.ts' when 2 then '.JS'"
               " else '' end").alias("extension"),
        "l_linenumber",
        "l_partkey",
    )


@_once
def snapshot_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per supplier and shipping month."""
    return (
        _supplier_months(spark, sf_dir)
        .select("owner", "repo", "commit_id", "commit_time_s")
        .distinct()
        .select(
            "*",
            F.concat(F.lit("t"), "commit_id").alias("tree_id"),
            F.lit("u@x.org").alias("author"),
            F.lit("ship").alias("message"),
        )
    )


@_once
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of those commits, one per line item; a file may be listed several times."""
    return _supplier_months(spark, sf_dir).select(
        "owner",
        "repo",
        "commit_id",
        F.concat(F.lit("src/f"), "l_linenumber", "extension").alias("path"),
        F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("hash_code"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diff entries of all kinds, one per line item."""
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("ADD", "MODIFY", "DELETE", "RENAME", "COPY")]),
        (F.col("l_orderkey") % 5 + 1).cast("int"),
    )
    path = F.concat(F.lit("src/f"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.lit("acme").alias("owner"),
        F.expr("'supp' || l_suppkey").alias("repo"),
        F.expr("'c' || l_orderkey").alias("commit_id"),
        F.expr("'t' || l_orderkey").alias("tree_id"),
        _seconds(F.col("l_shipdate")).alias("commit_time_s"),
        kind.alias("change_type"),
        F.when(kind != "ADD", F.concat(path, F.lit(".old"))).alias("old_path"),
        F.when(kind != "DELETE", F.concat(path, F.lit(".new"))).alias("new_path"),
        F.when(kind != "ADD", F.expr("'h' || l_partkey")).alias("old_hash"),
        F.when(kind != "DELETE", F.expr("'g' || l_partkey")).alias("new_hash"),
    )


@_once
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a user as attempts, numbered in their order."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "props")
    return number_rows(events, ["user_id"], ["ts", "event_id"]).select(
        "user_id",
        F.col("position").cast("int").alias("attempt"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


@_once
def queue_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of queue rows, one per line item in order of ``seq``; some are null."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.expr("'cust' || o_custkey").alias("owner"),
        F.expr("'repo' || o_orderkey").alias("repo"),
        F.when(F.col("l_linenumber") != 7, F.expr("repeat('part ' || l_partkey || ' ', 30)")).alias(
            "error"
        ),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"),
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and their contents: whole documents, some of them several times."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("hash_code"),
        F.col("text").alias("contents"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths: urls of pages without their query and fragment."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", "[?#].*", "").alias("path")
    )


def crawl_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that could not be read: those with an order of a very high price."""
    return table(spark, sf_dir, "orders").filter("o_totalprice > 480000").select(
        F.expr("'cust' || o_custkey").alias("owner"),
        F.expr("'repo' || o_orderkey % 7").alias("repo"),
        F.expr("'cannot open git-upload-pack ' || o_orderkey").alias("error"),
        F.col("o_orderkey").alias("seq"),
    )


def page_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and their contents: whole web pages."""
    return table(spark, sf_dir, "pages").select(
        F.md5(F.col("html").cast("binary")).alias("hash_code"), F.col("html").alias("contents")
    )


def labelled_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the documents that have a label."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return blobs(spark, sf_dir).join(labels, "doc_id", "left_semi").select("hash_code").distinct()
