from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from reposift.operators import queue as q
from reposift.operators import report
from reposift.plans import crawl
from reposift.plans.contents import crawl_file_contents, wanted_hashes
from reposift.session import new_folder, passing_tables, shared_dir, written_table
from reposift.sources import error_log, folders, run_store
from reposift.sources.error_log import read_misses
from reposift.sources.queue_table import change_queue, publish_queue, queue_versions, read_queue
from reposift.streaming.ingest import ingest_project_lines
from tests.conftest import rows
from tests.test_history import COMMIT, FILE
from tests.test_projects import PREFIX, line


def commits(spark, repos=6, each=3):
    data = [
        (f"o{r}", "r", f"c{r}-{n}", "t", n, "a@x", f"m{n}") for r in range(repos) for n in range(each)
    ]
    return spark.createDataFrame(data, COMMIT)


def start(spark, store, log):
    publish_queue(q.load_queue(log), store)


def counts(spark, store):
    return rows(report.status_counts(read_queue(spark, store)))


def test_crawl_messages(spark, store):
    log = commits(spark)
    start(spark, store, log)
    assert crawl.crawl_commit_messages(spark, store, log, limit=2, token=11)
    assert counts(spark, store) == [("FINISHED", 2), ("PENDING", 4)]
    stored = run_store.read_runs(spark, store, "COMMIT_MESSAGES", all_columns=True)
    assert rows(stored.select("repo_owner", "run").distinct()) == [("o0", 11), ("o1", 11)]
    assert stored.count() == 6


def test_passing_tables_are_removed(spark):
    with passing_tables(spark):
        table = written_table(spark.range(3), "t")
        folder = new_folder(spark, "x").rsplit("/", 1)[0]
        assert table.count() == 3 and folders.exists(spark, folder)
    assert not folders.exists(spark, folder)
    assert new_folder(spark, "x").rsplit("/", 1)[0] == shared_dir(spark)


def test_failures_and_bad_commits(spark, store):
    log = commits(spark).withColumn("error", F.when(F.col("commit_id") == "c1-1", "bad commit"))
    start(spark, store, log)
    failed = spark.createDataFrame(
        [("o0", "r", "second", 2), ("o0", "r", "first", 1), ("o5", "r", "not claimed", 1)],
        "owner string, repo string, error string, seq long",
    )
    assert crawl.crawl_commit_messages(spark, store, log, failed, limit=3, token=11)
    assert counts(spark, store) == [("ERROR", 1), ("FINISHED", 2), ("PENDING", 3)]
    done = read_queue(spark, store).filter("owner = 'o0'")
    assert rows(done) == [("o0", "r", "11", "first", True)]
    ids = rows(run_store.read_split(spark, store, "COMMIT_MESSAGES"), "commit_id")
    assert ids == [("c1-0",), ("c1-2",), ("c2-0",), ("c2-1",), ("c2-2",)]
    assert rows(error_log.read_error_log(spark, store)) == [("o1", "r", "bad commit", 11)]


def test_batch_of_failures_only(spark, store):
    log = commits(spark, repos=1)
    start(spark, store, log)
    failed = spark.createDataFrame([("o0", "r", None)], "owner string, repo string, error string")
    assert crawl.crawl_commit_messages(spark, store, log, failed)
    assert counts(spark, store) == [("ERROR", 1)]
    assert not crawl.crawl_commit_messages(spark, store, log, failed)


def test_drain(spark, store):
    log = commits(spark)
    start(spark, store, log)
    tokens = iter(range(100, 200))
    turns = crawl.drain(
        lambda: crawl.crawl_commit_messages(spark, store, log, limit=4, token=next(tokens))
    )
    assert turns == 2
    assert counts(spark, store) == [("FINISHED", 6)]
    assert run_store.list_runs(spark, store, "COMMIT_MESSAGES") == [100, 101]
    assert run_store.read_split(spark, store, "COMMIT_MESSAGES").count() == 18


def test_drain_of_an_empty_queue(spark, store):
    assert crawl.drain(lambda: crawl.crawl_commit_messages(spark, store, commits(spark))) == 0


def test_crawl_history_then_contents(spark, store):
    log = commits(spark, repos=2, each=2)
    trees = spark.createDataFrame(
        [
            ("o0", "r", "c0-0", "a.js", "h1"), ("o0", "r", "c0-0", "b.md", "h2"),
            ("o0", "r", "c0-1", "a.js", "h3"), ("o1", "r", "c1-0", "A.TS", "h1"),
        ],
        FILE,
    )
    start(spark, store, log)
    assert crawl.crawl_file_history(spark, store, log, trees, token=7)
    split = run_store.read_split(spark, store, "FILE_METADATA")
    assert rows(split, "repo_owner", "git_path", "hash_code", "commit_id") == [
        ("o0", "a.js", "h1", "c0-0"),
        ("o0", "a.js", "h3", "c0-1"),
        ("o1", "A.TS", "h1", "c1-0"),
        ("o1", "A.TS", None, "c1-1"),
    ]
    assert rows(wanted_hashes(spark, store)) == [("h1",), ("h3",)]
    source = spark.createDataFrame([("h1", "one"), ("h2", "two")], "hash_code string, contents string")
    assert crawl_file_contents(spark, store, source, token=8)
    assert rows(run_store.read_split(spark, store, "CONTENTS")) == [("h1", "one")]
    assert rows(run_store.existing_hashes(spark, store)) == [("h1",)]
    assert rows(read_misses(spark, store)) == [("h3", "missing object h3", 8)]
    assert not crawl_file_contents(spark, store, source, token=9)


def test_a_used_token_fails_before_anything_is_marked(spark, store):
    log = commits(spark)
    start(spark, store, log)
    assert crawl.crawl_commit_messages(spark, store, log, limit=2, token=5)
    before = rows(read_queue(spark, store))
    with pytest.raises(ValueError):
        crawl.crawl_commit_messages(spark, store, log, limit=2, token=5)
    assert rows(read_queue(spark, store)) == before


def test_dead_claims_are_released_and_live_ones_stay(spark, store):
    log = commits(spark)
    start(spark, store, log)
    for token in (5, 6):
        change_queue(spark, store, lambda latest: q.claim(latest, token, 1))
    crawl.recover(spark, store, [6])
    queue = read_queue(spark, store)
    assert (q.claimed(queue, 5).count(), q.claimed(queue, 6).count()) == (0, 1)


def test_batch_bounds_reach_the_scan(spark, tmp_path):
    commits(spark).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    batch = spark.createDataFrame([("o2", "r"), ("o3", "r")], "owner string, repo string")
    near = crawl.rows_of(batch, crawl.owner_range(batch))(stored)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(owner,o2)" in plan and "LessThanOrEqual(owner,o3)" in plan
    assert near.count() == 6


def test_stream(spark, tmp_path, store):
    lines = tmp_path / "lines"
    lines.mkdir()

    def ingest():
        ingest_project_lines(
            spark, str(lines), store, str(tmp_path / "progress"), max_files_per_batch=1
        ).awaitTermination()
        return rows(read_queue(spark, store), "owner", "repo", "completed")

    (lines / "a.csv").write_text(line() + "\n" + line(deleted="1", url=PREFIX + "gone/r") + "\n")
    (lines / "b.csv").write_text(line() + "\nbad line\n" + line(url=PREFIX + "p/r") + "\n")
    assert ingest() == [("o", "r", False), ("p", "r", False)]
    publish_queue(q.mark_completed(read_queue(spark, store), read_queue(spark, store), 1), store)
    (lines / "c.csv").write_text(line() + "\n" + line(url=PREFIX + "q/r") + "\n")
    assert ingest() == [("o", "r", True), ("p", "r", True), ("q", "r", False)]
    before = queue_versions(spark, store)
    assert len(ingest()) == 3
    assert queue_versions(spark, store) == before


def test_stream_takes_no_limit(spark, store):
    with pytest.raises(ValueError):
        ingest_project_lines(spark, "in", store, "progress", "filterTop5")


def session_with(conf, checkpoint_dir=None, master="spark://host"):
    context = SimpleNamespace(
        master=master, applicationId="app-1", getCheckpointDir=lambda: checkpoint_dir
    )
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder_is_the_one_the_cluster_names():
    named = session_with({"spark.checkpoint.dir": "/shared/checkpoints/"})
    assert shared_dir(named) == "/shared/checkpoints/reposift/app-1"
    assert shared_dir(session_with({}, "/set/later")) == "/set/later/reposift/app-1"
    with pytest.raises(ValueError):
        shared_dir(session_with({}))


def test_many_failed_owners_are_not_sent_to_every_executor(spark, tmp_path, monkeypatch):
    many = spark.range(110_000)
    many.selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01' as ts", "id as user_id", "'error' as event_type", "'{}' as props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    many.selectExpr(
        "id as o_orderkey", "id as o_custkey", "timestamp_ntz'2024-01-01' as o_orderdate", "'1' as o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    given = []
    monkeypatch.setattr(crawl, "crawl_commit_messages", lambda *args, **options: given.append(args[3]))
    QUERIES["crawl_of_attempts"](spark, str(tmp_path))
    plan = given[0]._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert given[0].count() == 110_000
