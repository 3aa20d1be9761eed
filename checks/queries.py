"""Queries over the whole test tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift import samples
from reposift.functions import paths as path_functions
from reposift.functions import projects as fields
from reposift.functions import status
from reposift.operators import attempts as tries
from reposift.operators import contents as objects
from reposift.operators import history, projects, queue, report
from reposift.plans import contents as content_plans
from reposift.plans import crawl, project_load
from reposift.schemas import QUEUE_KEY
from reposift.session import new_folder, sized, written_table
from reposift.sources import error_log, files, queue_table, run_store
from reposift.streaming import ingest
from reposift.streaming.ingest import ingest_project_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKEN = 1700000000000


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _lines_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = new_folder(spark, "lines")
    samples.project_lines(spark, sf_dir).repartition("value").write.text(folder)
    return folder


# --- project list ---------------------------------------------------------------------


@query
def scan_project_lines(spark, sf_dir):
    return files.scan_project_lines(spark, _lines_folder(spark, sf_dir))


@query
def parse_projects(spark, sf_dir):
    return projects.parse_projects(samples.project_lines(spark, sf_dir))


@query
def parse_projects_of_language(spark, sf_dir):
    return projects.parse_projects(samples.project_lines(spark, sf_dir), ["TypeScript"])


@query
def rejected_lines(spark, sf_dir):
    rejected = projects.rejected_lines(samples.project_lines(spark, sf_dir))
    return rejected.select(
        F.substring_index("value", ",", 1).cast("long").alias("id"), "error"
    )


def _fields(spark, sf_dir):
    lines = samples.project_lines(spark, sf_dir)
    strict = lines.filter(F.col("value").rlike(fields.STRICT_RECORD))
    return projects.split_lines(strict).withColumn("id", F.col("id").cast("long"))


@query
def url_owner_repo(spark, sf_dir):
    url = F.col("url")
    return _fields(spark, sf_dir).select(
        "id", fields.url_owner(url).alias("owner"), fields.url_repo(url).alias("repo")
    )


@query
def language_id(spark, sf_dir):
    return _fields(spark, sf_dir).select(
        "id", fields.language_id(F.col("language")).alias("lang_id")
    )


@query
def deleted_flag(spark, sf_dir):
    return _fields(spark, sf_dir).select(
        "id", fields.deleted_flag(F.col("deleted")).alias("is_deleted")
    )


@query
def forked_flag(spark, sf_dir):
    return _fields(spark, sf_dir).select(
        "id", fields.forked_flag(F.col("forked_from")).alias("is_forked")
    )


@query
def created_ms(spark, sf_dir):
    return _fields(spark, sf_dir).select(
        "id", fields.created_ms(F.col("created_at")).alias("created_ms")
    )


@query
def filter_deleted(spark, sf_dir):
    return projects.filter_deleted(parse_projects(spark, sf_dir))


@query
def filter_forked(spark, sf_dir):
    return projects.filter_forked(parse_projects(spark, sf_dir))


@query
def filter_top_n(spark, sf_dir):
    return projects.filter_top_n(parse_projects(spark, sf_dir), 500)


@query
def filter_top_n_in_parallel(spark, sf_dir):
    return projects.filter_top_n(parse_projects(spark, sf_dir).repartition(32), 500)


@query
def apply_project_filters(spark, sf_dir):
    names = "filterTopx, filterTop300,filterForked,filterDeleted, filterTop5"
    return projects.apply_project_filters(parse_projects(spark, sf_dir), names)


@query
def top_n_before_distinct(spark, sf_dir):
    return project_load.pairs_of_lines(samples.project_lines(spark, sf_dir), "filterTop300")


@query
def project_pairs(spark, sf_dir):
    return projects.project_pairs(parse_projects(spark, sf_dir))


@query
def load_project_queue(spark, sf_dir):
    store = new_folder(spark, "store")
    return project_load.load_project_queue(spark, _lines_folder(spark, sf_dir), store)


@query
def load_project_queue_status(spark, sf_dir):
    return report.status_counts(load_project_queue(spark, sf_dir))


@query
def stream_project_lines(spark, sf_dir):
    store = new_folder(spark, "store")
    stream = ingest_project_lines(
        spark, _lines_folder(spark, sf_dir), store, new_folder(spark, "progress")
    )
    stream.awaitTermination()
    return queue_table.read_queue(spark, store)


# --- work queue -----------------------------------------------------------------------


@query
def scan_queue(spark, sf_dir):
    return queue_table.publish_queue(samples.queue(spark, sf_dir), new_folder(spark, "store"))


@query
def load_queue(spark, sf_dir):
    return queue.load_queue(samples.project_fields(spark, sf_dir))


@query
def load_queue_ignoring_case(spark, sf_dir):
    pairs = samples.project_fields(spark, sf_dir).select("owner", "repo")
    shouted = pairs.select(F.upper("owner").alias("owner"), F.upper("repo").alias("repo"))
    return queue.load_queue(pairs.union(shouted), ignore_case=True)


@query
def load_queue_merging(spark, sf_dir):
    pairs = samples.queue_errors(spark, sf_dir).select("owner", "repo")
    extra = samples.project_fields(spark, sf_dir).select("owner", "repo")
    return queue.load_queue(pairs.union(extra), samples.queue(spark, sf_dir))


@query
def queue_status(spark, sf_dir):
    return samples.queue(spark, sf_dir).select(
        "owner", "repo", status.queue_status().alias("status")
    )


@query
def error_bucket(spark, sf_dir):
    return samples.queue(spark, sf_dir).select(
        "owner", "repo", status.error_bucket(F.col("result")).alias("bucket")
    )


@query
def error_text(spark, sf_dir):
    return samples.queue_errors(spark, sf_dir).select(
        "owner", "repo", "seq", status.error_text(F.col("error")).alias("error")
    )


@query
def pending(spark, sf_dir):
    return samples.queue(spark, sf_dir).filter(status.is_pending())


@query
def in_progress(spark, sf_dir):
    return samples.queue(spark, sf_dir).filter(status.is_in_progress())


@query
def failed(spark, sf_dir):
    return samples.queue(spark, sf_dir).filter(status.is_failed())


@query
def like_any(spark, sf_dir):
    hit = status.like_any(F.col("result"), status.RESET_PATTERNS)
    return samples.queue(spark, sf_dir).filter(hit).select("owner", "repo", "result")


@query
def like_any_ignoring_case(spark, sf_dir):
    shouted = [pattern.swapcase() for pattern in status.RESET_PATTERNS]
    hit = status.like_any(F.col("result"), shouted, ignore_case=True)
    return samples.queue(spark, sf_dir).filter(hit).select("owner", "repo", "result")


@query
def status_counts(spark, sf_dir):
    return report.status_counts(samples.queue(spark, sf_dir))


@query
def progress_by_token(spark, sf_dir):
    return report.progress_by_token(samples.queue(spark, sf_dir))


@query
def error_counts(spark, sf_dir):
    return report.error_counts(samples.queue(spark, sf_dir))


@query
def queue_report(spark, sf_dir):
    full = report.queue_report(samples.queue(spark, sf_dir), "2018-06-09 15:51:37")
    return report.in_report_order(full)


@query
def claim(spark, sf_dir):
    return queue.claim(samples.queue(spark, sf_dir), TOKEN, 1000)


@query
def claim_in_parallel(spark, sf_dir):
    return queue.claim(samples.queue(spark, sf_dir).repartition(32), TOKEN, 1000)


@query
def claim_all(spark, sf_dir):
    return queue.claim(samples.queue(spark, sf_dir), TOKEN, None)


@query
def claimed_batch(spark, sf_dir):
    return queue.claimed(queue.claim(samples.queue(spark, sf_dir), TOKEN, 1000), TOKEN)


def _is_empty(rows):
    found = rows.filter(status.is_pending()).limit(1)
    return found.agg((F.count(F.lit(1)) == 0).alias("is_empty"))


@query
def batch_is_empty(spark, sf_dir):
    return _is_empty(samples.queue(spark, sf_dir))


@query
def batch_is_empty_when_done(spark, sf_dir):
    return _is_empty(queue.claim(samples.queue(spark, sf_dir), TOKEN, None))


@query
def mark_completed(spark, sf_dir):
    pairs = samples.queue_errors(spark, sf_dir).select("owner", "repo")
    return queue.mark_completed(samples.queue(spark, sf_dir), pairs, TOKEN)


@query
def mark_error(spark, sf_dir):
    errors = samples.queue_errors(spark, sf_dir)
    return queue.mark_error(samples.queue(spark, sf_dir), errors, "seq")


@query
def reset_errors(spark, sf_dir):
    return queue.reset_errors(samples.queue(spark, sf_dir))


@query
def release_incomplete(spark, sf_dir):
    return queue.release_incomplete(samples.queue(spark, sf_dir))


@query
def release_stale(spark, sf_dir):
    return queue.release_stale(samples.queue(spark, sf_dir), [1528559497001])


@query
def log_errors(spark, sf_dir):
    store = new_folder(spark, "store")
    error_log.log_errors(samples.queue_errors(spark, sf_dir), store, TOKEN)
    return error_log.read_error_log(spark, store)


def _changed_store(spark, sf_dir):
    """A stored queue after a claim, errors and marks, all in its logs."""
    store = new_folder(spark, "store")
    queue_table.publish_queue(samples.queue(spark, sf_dir), store)
    errors = samples.queue_errors(spark, sf_dir)
    some = errors.filter("error is null")
    for change in (
        lambda q: queue.claim(q, TOKEN, 1000),
        lambda q: queue.mark_error(q, some, "seq"),
        lambda q: queue.mark_completed(q, some, TOKEN),
        lambda q: queue.reset_errors(q, ["%Socket%closed%"]),
    ):
        queue_table.apply_change(spark, store, change)
    return store


@query
def changed_queue(spark, sf_dir):
    return queue_table.read_queue(spark, _changed_store(spark, sf_dir))


@query
def changed_queue_compacted(spark, sf_dir):
    """The logs are written into their ranges, and one more change is made after that."""
    store = _changed_store(spark, sf_dir)
    queue_table.compact_queue(spark, store, pick=lambda version: list(version.ranges))
    queue_table.apply_change(spark, store, lambda q: queue.release_stale(q, [TOKEN, 1528559497000]))
    return queue_table.read_queue(spark, store)


@query
def stored_report(spark, sf_dir):
    return queue_table.stored_report(spark, _changed_store(spark, sf_dir), "2018-06-09 15:51:37")


@query
def claims_of_two(spark, sf_dir):
    """While a claimer is at work another one claims and a batch of lines arrives: nothing is lost."""
    store = new_folder(spark, "store")
    lines = samples.project_lines(spark, sf_dir)
    queue_table.publish_queue(queue.load_queue(samples.queue(spark, sf_dir)), store)

    def slow(latest):
        if queue_table.latest_version(spark, store) == 1:
            queue_table.apply_change(spark, store, lambda q: queue.claim(q, TOKEN, 400))
            for _ in range(2):
                ingest.add_lines(lines, store, ("lines", 0))
        return queue.claim(latest, TOKEN + 1, 400)

    queue_table.apply_change(spark, store, slow)
    return queue_table.read_queue(spark, store)


# --- commits and files ----------------------------------------------------------------


@query
def scan_commits(spark, sf_dir):
    return history.scan_commits(samples.commits(spark, sf_dir))


@query
def scan_commits_in_log_order(spark, sf_dir):
    return history.scan_commits(samples.commits(spark, sf_dir), order=["commit_time_s", "seq"])


@query
def scan_commits_of_large_repos(spark, sf_dir):
    return history.scan_commits(samples.commits(spark, sf_dir), max_group=1)


def _with_errors(log, unreadable):
    return log.withColumn("error", F.when(unreadable, F.lit("missing object")))


@query
def messages_of_readable_commits(spark, sf_dir):
    log = samples.commits(spark, sf_dir)
    return history.commit_messages(_with_errors(log, F.col("message") == "5-LOW"))


@query
def file_history_with_unreadable_commits(spark, sf_dir):
    december = F.substring("commit_id", -2, 2) == "12"
    log = _with_errors(samples.snapshot_commits(spark, sf_dir), december)
    return history.file_history(log, samples.snapshots(spark, sf_dir))


@query
def commit_messages(spark, sf_dir):
    return history.commit_messages(samples.commits(spark, sf_dir))


@query
def change_records(spark, sf_dir):
    return history.change_records(samples.changes(spark, sf_dir))


@query
def file_extension(spark, sf_dir):
    return samples.paths(spark, sf_dir).withColumn(
        "extension", path_functions.file_extension(F.col("path"))
    )


@query
def checkout_owner_repo(spark, sf_dir):
    path = F.concat_ws("/", F.lit("/mnt/checkouts"), "owner", "repo")
    return samples.commits(spark, sf_dir).select(
        "commit_id",
        path_functions.checkout_owner(path).alias("owner"),
        path_functions.checkout_repo(path).alias("repo"),
    )


@query
def filter_extensions(spark, sf_dir):
    return history.filter_extensions(samples.snapshots(spark, sf_dir), "js, Coffee,ts")


@query
def filter_extensions_case_sensitive(spark, sf_dir):
    return history.filter_extensions(
        samples.snapshots(spark, sf_dir), "js,coffee,ts", case_sensitive=True
    )


@query
def snapshot_changes(spark, sf_dir):
    return history.snapshot_changes(
        samples.snapshot_commits(spark, sf_dir), samples.snapshots(spark, sf_dir)
    )


@query
def file_history(spark, sf_dir):
    return history.file_history(
        samples.snapshot_commits(spark, sf_dir), samples.snapshots(spark, sf_dir)
    )


@query
def file_history_of_large_repos(spark, sf_dir):
    return history.file_history(
        samples.snapshot_commits(spark, sf_dir),
        samples.snapshots(spark, sf_dir),
        per_group=4,
        max_group=1,
    )


@query
def file_history_of_extensions(spark, sf_dir):
    return history.file_history(
        samples.snapshot_commits(spark, sf_dir), samples.snapshots(spark, sf_dir), "js,ts"
    )


@query
def resolve_attempts(spark, sf_dir):
    return tries.resolve_attempts(samples.attempts(spark, sf_dir), ["user_id"])


@query
def failed_attempts(spark, sf_dir):
    return tries.failures(tries.resolve_attempts(samples.attempts(spark, sf_dir), ["user_id"], 1))


# --- run store ------------------------------------------------------------------------


def _contents_store(spark, sf_dir):
    """Two runs: documents, and documents once more with web pages."""
    store = new_folder(spark, "store")
    documents = samples.blobs(spark, sf_dir).drop("doc_id")
    both = documents.unionByName(samples.page_blobs(spark, sf_dir))
    run_store.store_records(documents, store, "CONTENTS", 1)
    run_store.store_records(both, store, "CONTENTS", 2)
    return store


def _messages_store(spark, sf_dir):
    """Two runs: all commits, and those of finished orders with another message."""
    store = new_folder(spark, "store")
    first = history.commit_messages(samples.commits(spark, sf_dir))
    finished = samples.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    ids = finished.select(F.expr("md5(cast(o_orderkey as string))").alias("commit_id"))
    second = first.join(ids, "commit_id", "left_semi").withColumn(
        "long_message", F.concat("long_message", F.lit(", amended"))
    )
    run_store.store_records(first, store, "COMMIT_MESSAGES", 1)
    run_store.store_records(second, store, "COMMIT_MESSAGES", 2)
    return store


@query
def store_records(spark, sf_dir):
    store = new_folder(spark, "store")
    records = history.change_records(samples.changes(spark, sf_dir))
    run_store.store_records(records, store, "FILE_METADATA", TOKEN)
    return run_store.read_runs(spark, store, "FILE_METADATA", all_columns=True)


@query
def all_runs(spark, sf_dir):
    return run_store.read_runs(spark, _contents_store(spark, sf_dir), "CONTENTS")


@query
def read_split(spark, sf_dir):
    return run_store.read_split(spark, _contents_store(spark, sf_dir), "CONTENTS")


@query
def read_split_of_changes(spark, sf_dir):
    store = new_folder(spark, "store")
    records = history.change_records(samples.changes(spark, sf_dir))
    run_store.store_records(records, store, "FILE_METADATA", 1)
    run_store.store_records(records, store, "FILE_METADATA", 2)
    return run_store.read_split(spark, store, "FILE_METADATA").drop("commit_time_s")


@query
def read_split_latest(spark, sf_dir):
    store = _messages_store(spark, sf_dir)
    return run_store.read_split(spark, store, "COMMIT_MESSAGES", latest=True)


@query
def existing_hashes(spark, sf_dir):
    store = new_folder(spark, "store")
    run_store.store_records(samples.labelled_hashes(spark, sf_dir), store, "INDEX", 1)
    run_store.store_records(samples.blobs(spark, sf_dir), store, "INDEX", 2)
    return run_store.existing_hashes(spark, store)


@query
def consolidate(spark, sf_dir):
    store = _contents_store(spark, sf_dir)
    run_store.consolidate(spark, store, ["CONTENTS", "INDEX"], run=3)
    return run_store.read_runs(spark, store, "CONTENTS")


@query
def consolidate_after_a_small_run(spark, sf_dir):
    """A consolidated store gets the labelled documents again and some pages; the large run stays."""
    store = new_folder(spark, "store")
    documents = samples.blobs(spark, sf_dir).drop("doc_id")
    run_store.store_records(documents, store, "CONTENTS", 1)
    run_store.consolidate(spark, store, ["CONTENTS"], run=2)
    labelled = documents.join(samples.labelled_hashes(spark, sf_dir), "hash_code", "left_semi")
    pages = samples.page_blobs(spark, sf_dir).filter("contents like '%/de/%'")
    run_store.store_records(labelled.unionByName(pages), store, "CONTENTS", 3)
    run_store.consolidate(spark, store, ["CONTENTS"], run=4, tier=1.0)
    return run_store.read_runs(spark, store, "CONTENTS").drop("run")


@query
def consolidate_latest(spark, sf_dir):
    store = _messages_store(spark, sf_dir)
    run_store.consolidate(spark, store, ["COMMIT_MESSAGES"], run=3, latest=True)
    return run_store.read_runs(spark, store, "COMMIT_MESSAGES", all_columns=True)


def _requests(spark, sf_dir):
    """Hashes of all documents and, unknown to them, of all conversation turns."""
    turns = samples.table(spark, sf_dir, "conversations").select(
        F.md5(F.col("text").cast("binary")).alias("hash_code")
    )
    return samples.blobs(spark, sf_dir).select("hash_code").union(turns)


def _unique_blobs(spark, sf_dir):
    return objects.dedup(samples.blobs(spark, sf_dir).drop("doc_id"), ["hash_code"])


@query
def lookup_contents(spark, sf_dir):
    return objects.lookup_contents(_requests(spark, sf_dir), _unique_blobs(spark, sf_dir))


@query
def found_contents(spark, sf_dir):
    return objects.found_contents(_requests(spark, sf_dir), _unique_blobs(spark, sf_dir))


@query
def missing_contents(spark, sf_dir):
    return objects.missing_contents(_requests(spark, sf_dir), _unique_blobs(spark, sf_dir))


@query
def new_hashes(spark, sf_dir):
    return objects.new_hashes(
        samples.blobs(spark, sf_dir), samples.labelled_hashes(spark, sf_dir)
    )


@query
def dedup_latest(spark, sf_dir):
    return objects.dedup_latest(samples.blobs(spark, sf_dir), ["hash_code"], "doc_id")




# --- pipelines ------------------------------------------------------------------------


def _crawl_store(spark, repos):
    store = new_folder(spark, "store")
    queue_table.publish_queue(queue.load_queue(repos), store)
    return store


def _crawl_messages(spark, sf_dir, limit):
    log = samples.commits(spark, sf_dir)
    store = _crawl_store(spark, log)
    failures = samples.crawl_failures(spark, sf_dir)
    crawl.crawl_commit_messages(spark, store, log, failures, limit=limit, token=TOKEN)
    return store


@query
def crawl_commit_messages(spark, sf_dir):
    store = _crawl_messages(spark, sf_dir, None)
    return run_store.read_runs(spark, store, "COMMIT_MESSAGES", all_columns=True)


@query
def crawl_commit_messages_in_batch(spark, sf_dir):
    store = _crawl_messages(spark, sf_dir, 2000)
    return run_store.read_runs(spark, store, "COMMIT_MESSAGES", all_columns=True)


@query
def crawl_commit_messages_marks(spark, sf_dir):
    return queue_table.read_queue(spark, _crawl_messages(spark, sf_dir, 2000))


@query
def crawl_file_history(spark, sf_dir):
    log = samples.snapshot_commits(spark, sf_dir)
    store = _crawl_store(spark, log)
    files = samples.snapshots(spark, sf_dir)
    crawl.crawl_file_history(spark, store, log, files, limit=None, token=TOKEN)
    return run_store.read_runs(spark, store, "FILE_METADATA", all_columns=True)


def _listed_files(spark, sf_dir, store):
    """A file history of documents, with extensions that the crawl wants and one that it does not."""
    extension = F.get(F.array(*map(F.lit, (".js", ".TS", ".coffee", ".md"))), (F.col("doc_id") % 4).cast("int"))
    listed = samples.blobs(spark, sf_dir).select(
        F.lit("acme").alias("repo_owner"),
        F.lit("docs").alias("repository"),
        F.lit("t").alias("tree_id"),
        F.concat(F.lit("doc"), "doc_id", extension).alias("git_path"),
        "hash_code",
        F.lit("c").alias("commit_id"),
        F.lit(0).cast("long").alias("commit_time_s"),
    )
    run_store.store_records(listed, store, "FILE_METADATA", 1)


@query
def crawl_file_contents(spark, sf_dir):
    store = new_folder(spark, "store")
    _listed_files(spark, sf_dir, store)
    run_store.store_records(samples.labelled_hashes(spark, sf_dir), store, "INDEX", 1)
    source = _unique_blobs(spark, sf_dir)
    content_plans.crawl_file_contents(spark, store, source, token=TOKEN)
    index = run_store.read_runs(spark, store, "INDEX", [TOKEN])
    return run_store.read_runs(spark, store, "CONTENTS").join(index, ["hash_code", "run"])


@query
def crawl_file_contents_misses(spark, sf_dir):
    """Only labelled documents have contents; the others are logged, and not wanted again."""
    store = new_folder(spark, "store")
    _listed_files(spark, sf_dir, store)
    source = _unique_blobs(spark, sf_dir).join(samples.labelled_hashes(spark, sf_dir), "hash_code", "left_semi")
    tokens = iter((TOKEN, TOKEN + 1))
    crawl.drain(lambda: content_plans.crawl_file_contents(spark, store, source, token=next(tokens)))
    return error_log.read_misses(spark, store)


def _failed_repositories(spark, sf_dir, store):
    """Repositories of the users whose first two attempts failed; the queue has each of the log once.

    Either side may have millions of rows in few bytes of files, so their rows decide on the join.
    """
    failed = tries.failures(tries.resolve_attempts(samples.attempts(spark, sf_dir), ["user_id"], 2))
    owner = F.concat(F.lit("cust"), "user_id").alias("owner")
    failed = sized(written_table(failed.select(owner, "error"), "failed"))
    rows = sum(r.rows for r in queue_table.queue_version(spark, store).ranges)
    return failed.join(sized(queue_table.read_queue(spark, store).select(*QUEUE_KEY), rows), "owner")


@query
def crawl_of_attempts(spark, sf_dir):
    """The outcome of a user's first two attempts is that of all their repositories."""
    log = samples.commits(spark, sf_dir)
    store = _crawl_store(spark, log)
    failed = _failed_repositories(spark, sf_dir, store)
    crawl.crawl_commit_messages(spark, store, log, failed, limit=None, token=TOKEN)
    return queue_table.read_queue(spark, store)


@query
def drain_after_crash(spark, sf_dir):
    """A turn dies after its claim; the next crawl releases and reads what it had claimed."""
    log = samples.commits(spark, sf_dir)
    store = _crawl_store(spark, log)
    queue_table.change_queue(spark, store, lambda q: queue.claim(q, TOKEN, 500))
    crawl.drain(
        lambda: crawl.crawl_commit_messages(spark, store, log, limit=None),
        before=lambda: crawl.recover(spark, store),
    )
    return _drained(spark, store)


@query
def drain(spark, sf_dir):
    log = samples.commits(spark, sf_dir)
    store = _crawl_store(spark, log)
    third = queue_table.read_queue(spark, store).count() // 3 + 1
    crawl.drain(lambda: crawl.crawl_commit_messages(spark, store, log, limit=third))
    return _drained(spark, store)


def _drained(spark, store):
    messages = run_store.read_split(spark, store, "COMMIT_MESSAGES")
    done = report.status_counts(queue_table.read_queue(spark, store))
    stored = messages.agg(F.lit("STORED").alias("status"), F.count(F.lit(1)).alias("count"))
    return done.unionByName(stored)
