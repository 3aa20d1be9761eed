"""The stored queue: change logs, versions of several writers, the ledger of ingested batches."""

import random
import threading
from pathlib import Path

import pytest

from reposift.functions.status import is_pending
from reposift.operators import queue as q
from reposift.operators import report
from reposift.plans import crawl
from reposift.schemas import QUEUE
from reposift.session import sized, written_table
from reposift.sources import folders
from reposift.sources import queue_table as t
from reposift.streaming.ingest import add_lines, ingest_project_lines
from tests.conftest import rows
from tests.test_projects import PREFIX, line


def pairs(spark, n, owners=40):
    return spark.range(n).selectExpr(f"'o' || id % {owners} as owner", "'r' || id as repo")


def everything(version):
    return list(version.ranges)


@pytest.fixture
def ranged(spark, store):
    """A queue of 3,000 rows in several ranges."""
    with_adaptive(spark, lambda: t.publish_queue(q.load_queue(pairs(spark, 3_000)), store))
    assert len(t.queue_version(spark, store).ranges) > 2
    return store


def with_adaptive(spark, run, on="false"):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, on)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def figures_hold(spark, store):
    version = t.queue_version(spark, store)
    queue = t.read_queue(spark, store)
    assert sum(r.rows for r in version.ranges) == queue.count() == queue.select("owner", "repo").distinct().count()
    assert version.pending() == queue.filter(is_pending()).count()
    assert rows(t.stored_report(spark, store, "now")) == rows(report.queue_report(queue, "now"))
    for one in version.ranges[:2]:
        own = t.read_queue(spark, store, pick=lambda v, one=one: [r for r in v.ranges if r.number == one.number])
        assert own.count() == one.rows and own.filter(is_pending()).count() == one.pending


def test_changes_equal_those_of_a_plain_table(spark, ranged):
    plain = t.read_queue(spark, ranged)
    draw = random.Random(3)
    for turn in range(4):
        hit = pairs(spark, 3_000).filter(f"hash(repo, {turn}) % 7 = 0")
        change = draw.choice(
            [
                lambda queue: q.claim(queue, 100 + turn, 150),
                lambda queue: q.mark_error(queue, hit.selectExpr("*", "'503 Service Unavailable' as error")),
                lambda queue: q.mark_completed(queue, hit, 5),
                lambda queue: q.reset_errors(queue),
                lambda queue: q.load_queue(pairs(spark, 3_050, 43), queue),
            ]
        )
        plain = written_table(change(plain).select(*QUEUE.fieldNames()), "plain")
        t.apply_change(spark, ranged, change)
        assert rows(t.read_queue(spark, ranged)) == rows(plain)
    figures_hold(spark, ranged)
    t.compact_queue(spark, ranged, everything)
    assert all(not r.log for r in t.queue_version(spark, ranged).ranges)
    assert rows(t.read_queue(spark, ranged)) == rows(plain)
    figures_hold(spark, ranged)


def test_a_change_writes_only_what_it_touches(spark, ranged):
    before = {p for p in Path(ranged).rglob("*.parquet")}
    claimed = t.apply_change(spark, ranged, lambda queue: q.claim(queue, 7, 10), pick=lambda v: v.with_pending(10))
    assert len(claimed.read) == 1
    fresh = [p for p in Path(ranged).rglob("*.parquet") if p not in before]
    assert spark.read.parquet(*map(str, fresh)).count() == 10
    assert t.touched_rows(spark, ranged, claimed.segment).count() == 10
    first = pairs(spark, 3_000).orderBy("owner", "repo").limit(10)
    assert rows(t.touched_rows(spark, ranged, claimed.segment), "owner", "repo") == rows(first)


def test_a_change_of_nothing_makes_no_version(spark, ranged):
    before = t.queue_versions(spark, ranged)
    t.apply_change(spark, ranged, lambda queue: q.claim(queue, 7, 0))
    t.apply_change(spark, ranged, q.release_incomplete)
    assert t.queue_versions(spark, ranged) == before


def test_a_change_that_drops_further_columns(spark, ranged):
    t.apply_change(spark, ranged, lambda queue: q.claim(queue, 7, 20).select(*QUEUE.fieldNames()))
    assert t.read_queue(spark, ranged).filter("checkout_id = '7'").count() == 20
    figures_hold(spark, ranged)


def test_logs_are_compacted_as_they_grow(spark, store, monkeypatch):
    monkeypatch.setattr(t, "LOG_SEGMENTS", 3)
    t.publish_queue(q.load_queue(pairs(spark, 50)), store)
    for token in range(5):
        t.apply_change(spark, store, lambda queue: q.claim(queue, token, 5))
        assert all(len(r.log) < 3 for r in t.queue_version(spark, store).ranges)
    figures_hold(spark, store)
    assert t.read_queue(spark, store).filter(is_pending()).count() == 25


def test_two_claimers_and_both_survive(spark, ranged):
    """A second writer starts and ends while the first one is writing."""
    begun = []

    def first(queue):
        if not begun:
            begun.append(1)
            t.apply_change(spark, ranged, lambda latest: q.claim(latest, 72, 30))
        return q.claim(queue, 71, 30)

    t.apply_change(spark, ranged, first)
    queue = t.read_queue(spark, ranged)
    assert q.claimed(queue, 71).count() == q.claimed(queue, 72).count() == 30
    assert q.claimed(queue, 71).intersect(q.claimed(queue, 72)).count() == 0
    figures_hold(spark, ranged)


def test_a_change_of_other_ranges_is_not_made_again(spark, ranged):
    made = []

    def first(queue):
        made.append(1)
        if len(made) == 1:
            t.apply_change(spark, ranged, lambda latest: q.claim(latest, 72, None), pick=lambda v: [v.ranges[-1]])
        return q.claim(queue, 71, 10)

    t.apply_change(spark, ranged, first, pick=lambda v: [v.ranges[0]])
    assert made == [1]
    assert t.read_queue(spark, ranged).filter("checkout_id = '71'").count() == 10
    figures_hold(spark, ranged)


def test_claimers_in_threads(spark, store):
    t.publish_queue(q.load_queue(pairs(spark, 60)), store)
    failed = []

    def work(token):
        try:
            t.apply_change(spark, store, lambda queue: q.claim(queue, token, 10), tries=30)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=work, args=(token,)) for token in (1, 2, 3, 4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not failed
    counted = rows(report.progress_by_token(t.read_queue(spark, store)))
    assert counted == [(str(token), 10) for token in (1, 2, 3, 4)]


def test_a_large_range_is_split(spark, ranged, monkeypatch):
    before = len(t.queue_version(spark, ranged).ranges)
    monkeypatch.setattr(t, "RANGE_ROWS", 100)
    t.apply_change(spark, ranged, lambda queue: q.claim(queue, 7, 40), pick=lambda v: v.with_pending(40))
    with_adaptive(spark, lambda: t.compact_queue(spark, ranged, everything))
    assert len(t.queue_version(spark, ranged).ranges) > before
    figures_hold(spark, ranged)


def test_compaction_gives_way_to_a_writer(spark, ranged, monkeypatch):
    t.apply_change(spark, ranged, lambda queue: q.claim(queue, 7, 40))
    merged = t._merged

    def late(*args):
        monkeypatch.setattr(t, "_merged", merged)
        t.apply_change(spark, ranged, lambda queue: q.claim(queue, 8, 40))
        return merged(*args)

    monkeypatch.setattr(t, "_merged", late)
    assert t.compact_queue(spark, ranged, everything) is None
    assert t.read_queue(spark, ranged).filter("checkout_id in ('7', '8')").count() == 80


def test_one_writer_creates_a_file(spark, tmp_path):
    path, won = f"{tmp_path}/versions/1.json", []

    def create(i):
        if folders.create_once(spark, path, f"text {i}"):
            won.append(i)

    threads = [threading.Thread(target=create, args=(i,)) for i in range(8)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(won) == 1 and folders.read_text(spark, path) == f"text {won[0]}"


def test_a_token_is_taken_once(spark, store):
    t.claim_token(spark, store, 5)
    with pytest.raises(ValueError):
        t.claim_token(spark, store, 5)


def test_vacuum_keeps_what_is_still_named_or_being_written(spark, ranged):
    other = t._write_segment(t._touched(t.queue_version(spark, ranged), t._merged(spark, ranged, t.queue_version(spark, ranged).ranges), lambda x: q.claim(x, 9, 3)), ranged, False)[0]
    for token in range(3):
        t.apply_change(spark, ranged, lambda queue: q.claim(queue, token, 5))
    t.compact_queue(spark, ranged, everything)
    t.vacuum_queue(spark, ranged, keep=1)
    assert len(t.queue_versions(spark, ranged)) == 1
    assert Path(ranged, "queue", f"segment={other}").exists()
    figures_hold(spark, ranged)


def test_null_keys_and_keys_below_the_first(spark, store):
    queue = spark.createDataFrame([("m", "1", None, None, False), (None, "x", None, None, False)], QUEUE)
    t.publish_queue(queue, store)
    t.apply_change(spark, store, lambda latest: q.load_queue(spark.createDataFrame([("a", "0"), ("z", "9")], "owner string, repo string"), latest))
    t.apply_change(spark, store, lambda latest: q.claim(latest, 4, None))
    assert t.read_queue(spark, store).filter("checkout_id = '4'").count() == 4
    figures_hold(spark, store)


def test_an_empty_queue(spark, store):
    t.publish_queue(spark.createDataFrame([], QUEUE), store)
    t.apply_change(spark, store, lambda latest: q.claim(latest, 4, None))
    assert t.read_queue(spark, store).count() == 0
    assert rows(t.stored_report(spark, store, "now")) == [(0, "TIME", "now", 0)]
    t.apply_change(spark, store, lambda latest: q.load_queue(pairs(spark, 3), latest))
    figures_hold(spark, store)


def test_a_replayed_batch_changes_nothing(spark, store):
    lines = spark.createDataFrame([(line(),)], "value string")
    add_lines(lines, store, ("in", 0))
    t.apply_change(spark, store, lambda latest: q.claim(latest, 4, 1))
    more = spark.createDataFrame([(line(url=PREFIX + "p/r"),)], "value string")
    before = t.queue_versions(spark, store)
    add_lines(more, store, ("in", 0))
    assert t.queue_versions(spark, store) == before
    add_lines(more, store, ("in", 1))
    add_lines(more, store, ("elsewhere", 0))
    assert rows(t.read_queue(spark, store), "owner", "checkout_id") == [("o", "4"), ("p", None)]
    assert t.queue_version(spark, store).ledger == {"in": 1, "elsewhere": 0}


def test_micro_batches_beside_a_claimer(spark, tmp_path, store):
    lines = tmp_path / "lines"
    lines.mkdir()
    for i in range(4):
        (lines / f"{i}.csv").write_text(line(url=f"{PREFIX}o{i}/r") + "\n")
    stop, errors = threading.Event(), []

    def claimer():
        token = 0
        while not stop.is_set():
            token += 1
            try:
                t.apply_change(spark, store, lambda latest: q.claim(latest, token, 1), tries=50)
            except Exception as error:
                errors.append(error)
                return

    thread = threading.Thread(target=claimer)
    thread.start()
    try:
        ingest_project_lines(spark, str(lines), store, str(tmp_path / "progress"), max_files_per_batch=1).awaitTermination()
    finally:
        stop.set()
        thread.join()
    assert not errors
    t.apply_change(spark, store, lambda latest: q.claim(latest, 999, None))
    queue = t.read_queue(spark, store)
    assert queue.count() == 4 and queue.filter("checkout_id is not null").count() == 4
    assert queue.select("checkout_id").distinct().count() >= 1
    assert list(t.queue_version(spark, store).ledger.values()) == [3]
    figures_hold(spark, store)


def test_large_logs_and_batches_are_not_sent_to_every_executor(spark, store):
    pairs = spark.range(110_000).selectExpr("'owner' as owner", "'repo' || id as repo")
    t.publish_queue(q.load_queue(pairs), store)
    claimed = t.apply_change(spark, store, lambda queue: q.claim(queue, 1, None))
    batch = sized(t.touched_rows(spark, store, claimed.segment).select("owner", "repo"))
    of_batch = crawl.rows_of(batch, crawl.owner_range(batch))
    for joined in (t.read_queue(spark, store), of_batch(pairs)):
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
