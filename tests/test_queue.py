import random

import pytest
from pyspark.sql import functions as F

from reposift.functions import status
from reposift.operators import queue as q
from reposift.operators import report
from reposift.schemas import QUEUE
from reposift.sources import queue_table
from tests.conftest import rows


def make(spark, *data):
    return spark.createDataFrame(list(data), QUEUE)


def pairs(spark, *data):
    return spark.createDataFrame(list(data), "owner string, repo string")


def errors(spark, *data):
    return spark.createDataFrame(list(data), "owner string, repo string, error string, seq long")


def sample(spark):
    return make(
        spark,
        ("a", "1", None, None, False),
        ("a", "2", None, None, False),
        ("b", "1", "5", None, False),
        ("b", "2", "5", None, True),
        ("c", "1", None, "x", False),
        ("c", "2", "6", "y", True),
    )


def test_status_takes_the_first_that_applies(spark):
    got = [r[0] for r in sample(spark).select(status.queue_status()).collect()]
    assert got == ["PENDING", "PENDING", "IN_PROGRESS", "FINISHED", "ERROR", "ERROR"]


def test_predicates(spark):
    df = sample(spark)
    assert rows(df.filter(status.is_pending()), "owner", "repo") == [("a", "1"), ("a", "2")]
    assert rows(df.filter(status.is_in_progress()), "owner", "repo") == [("b", "1")]
    assert rows(df.filter(status.is_failed()), "owner", "repo") == [("c", "1"), ("c", "2")]


def test_error_bucket(spark):
    texts = [
        ("x No such file or directory 503 Service Unavailable", "No such file or directory"),
        ("503 Service Unavailable", "503 Service Unavailable"),
        ("503 service unavailable", "503 service unavailable"),
        ("Duplicate stages not allowed: 1", "Duplicate stages not allowed"),
        ("Duplicate stages not allowed", "Duplicate stages not allowed"),
        ("z" * 60, "z" * 50),
        ("", ""),
    ]
    df = spark.createDataFrame(texts, "t string, b string")
    assert df.filter(status.error_bucket(F.col("t")) != F.col("b")).count() == 0
    loose = df.select(status.error_bucket(F.col("t"), ignore_case=True)).collect()
    assert loose[2][0] == "503 Service Unavailable"


def test_error_text(spark):
    df = spark.createDataFrame([("it's " + "e" * 300,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(status.error_text(F.col("t"))).collect()]
    assert got == [("it's " + "e" * 300)[:254], "unknown", ""]


def test_load_replaces_or_merges(spark):
    given = pairs(spark, ("a", "1"), ("a", "1"), ("d", "1"))
    assert rows(q.load_queue(given), "owner", "repo") == [("a", "1"), ("d", "1")]
    merged = q.load_queue(given, sample(spark))
    assert merged.count() == 7
    assert rows(merged.filter("owner = 'd'")) == [("d", "1", None, None, False)]


def test_load_ignoring_case(spark):
    given = pairs(spark, ("Foo", "Bar"), ("foo", "bar"), ("B", "1"))
    assert q.load_queue(given).count() == 3
    assert rows(q.load_queue(given, ignore_case=True), "owner", "repo") == [("B", "1"), ("Foo", "Bar")]
    merged = q.load_queue(given, sample(spark), ignore_case=True)
    assert rows(merged.filter("owner in ('B', 'Foo')"), "owner", "repo") == [("Foo", "Bar")]


@pytest.mark.parametrize("tasks", [1, 5])
@pytest.mark.parametrize("limit,taken", [(0, 0), (1, 1), (2, 2), (9, 2), (None, 2)])
def test_claim(spark, limit, taken, tasks):
    claimed = q.claim(sample(spark).repartition(tasks), 77, limit)
    assert claimed.count() == 6
    batch = rows(q.claimed(claimed, 77))
    assert batch == [("a", "1"), ("a", "2")][:taken]
    untouched = claimed.filter("coalesce(checkout_id, '') <> '77'")
    assert untouched.exceptAll(sample(spark)).count() == 0


def test_claims_are_disjoint_and_complete(spark):
    queue = q.load_queue(pairs(spark, *[(f"o{i % 7}", f"r{i}") for i in range(50)]))
    seen = []
    for token in range(5):
        queue = q.claim(queue, token, 12)
        seen += rows(q.claimed(queue, token))
    assert len(seen) == len(set(seen)) == 50


def test_claim_of_a_stored_queue_needs_no_join(spark, store):
    stored = queue_table.publish_queue(sample(spark), store)
    plan = q.claim(stored, 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert "TakeOrderedAndProject" in plan


def test_mark_completed(spark):
    done = q.mark_completed(sample(spark), pairs(spark, ("a", "1"), ("a", "1"), ("c", "1"), ("z", "9")), 9)
    assert rows(done) == sorted(
        [
            ("a", "1", "9", None, True),
            ("a", "2", None, None, False),
            ("b", "1", "5", None, False),
            ("b", "2", "5", None, True),
            ("c", "1", "9", "x", True),
            ("c", "2", "6", "y", True),
        ],
        key=repr,
    )
    assert rows(report.status_counts(done)) == [("ERROR", 2), ("FINISHED", 2), ("IN_PROGRESS", 1), ("PENDING", 1)]


def test_mark_error_keeps_the_first(spark):
    given = errors(
        spark,
        ("b", "1", "second", 2),
        ("b", "1", "first", 1),
        ("b", "2", None, 1),
        ("c", "2", "late", 1),
        ("z", "9", "nobody", 1),
    )
    marked = {(r.owner, r.repo): r for r in q.mark_error(sample(spark), given, "seq").collect()}
    assert len(marked) == 6
    assert marked["b", "1"][2:] == (None, "first", False)
    assert marked["b", "2"][2:] == (None, "unknown", True)
    assert marked["c", "2"][2:] == ("6", "y", True)
    without = {(r.owner, r.repo): r for r in q.mark_error(sample(spark), given.drop("seq")).collect()}
    assert without["b", "1"].result == "first"


def test_update_ignoring_case(spark):
    upper = pairs(spark, ("A", "1"))
    assert q.mark_completed(sample(spark), upper, 9).filter("checkout_id = '9'").count() == 0
    done = q.mark_completed(sample(spark), upper, 9, ignore_case=True)
    assert rows(done.filter("checkout_id = '9'"), "owner", "repo") == [("a", "1")]


def test_reset_errors(spark):
    texts = [
        "a 503 Service Unavailable b",
        "Socket is closed",
        "Socketclosed",
        "socket is closed",
        "Read timed out after 120,000 ms",
        "File name too long",
        "",
        None,
    ]
    df = make(spark, *[("o", str(i), "5", t, True) for i, t in enumerate(texts)])
    reset = rows(q.reset_errors(df))
    assert [r[1] for r in reset if r[2:] == (None, None, False)] == ["0", "1", "2", "4"]
    loose = q.reset_errors(df, ignore_case=True).filter("result is null and not completed")
    assert loose.count() == 5
    assert q.reset_errors(df, []).exceptAll(df).count() == 0


def test_release(spark):
    df = sample(spark)
    assert rows(q.release_incomplete(df).filter("checkout_id is not null"), "owner", "repo") == [("b", "2"), ("c", "2")]
    assert q.release_stale(df, [5]).exceptAll(df).count() == 0
    assert rows(q.release_stale(df, ["6"])) == rows(q.release_incomplete(df))
    assert rows(q.release_stale(df, [])) == rows(q.release_incomplete(df))


def test_empty_queue(spark):
    empty = make(spark)
    for changed in (
        q.claim(empty, 1, 5),
        q.mark_completed(empty, pairs(spark, ("a", "1")), 1),
        q.mark_error(empty, errors(spark, ("a", "1", "e", 1))),
        q.reset_errors(empty),
    ):
        assert changed.columns == QUEUE.fieldNames()
        assert changed.count() == 0
    assert rows(report.queue_report(empty, "now")) == [(0, "TIME", "now", 0)]


def test_changes_keep_rows_and_keys(spark):
    draw = random.Random(7)
    data = [
        (f"o{i % 9}", f"r{i}", draw.choice([None, "1", "2"]), draw.choice([None, None, "503 Service Unavailable", "e"]), draw.random() < 0.4)
        for i in range(300)
    ]
    queue = make(spark, *data)
    hit = pairs(spark, *[(d[0], d[1]) for d in draw.choices(data, k=200)])
    for changed in (
        q.claim(queue, 3, 40),
        q.mark_completed(queue, hit, 3),
        q.mark_error(queue, hit.withColumn("error", F.lit("bad"))),
        q.reset_errors(queue),
        q.release_incomplete(queue),
        q.release_stale(queue, [2]),
    ):
        keys = changed.select("owner", "repo")
        assert keys.count() == keys.distinct().count() == 300
        assert sum(r[1] for r in rows(report.status_counts(changed))) == 300


def test_report(spark):
    full = report.in_report_order(report.queue_report(sample(spark), "now"))
    assert [tuple(r) for r in full.collect()] == [
        (0, "TIME", "now", 0),
        (1, "ERROR", "", 2),
        (1, "PENDING", "", 2),
        (1, "FINISHED", "", 1),
        (1, "IN_PROGRESS", "", 1),
        (2, "IN_PROGRESS", "5", 1),
        (3, "ERROR", "x", 1),
        (3, "ERROR", "y", 1),
    ]


def test_report_reads_the_queue_once(spark, store):
    queue = queue_table.publish_queue(sample(spark), store)
    plan = report.queue_report(queue, "now")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_versions(spark, store):
    assert queue_table.read_queue(spark, store).count() == 0
    queue = queue_table.publish_queue(sample(spark), store)
    for token in range(3):
        queue = queue_table.publish_queue(q.claim(queue, token, 1), store)
    assert queue_table.queue_versions(spark, store) == [1, 2, 3, 4]
    assert rows(q.claimed(queue, 1)) == [("a", "2")]
    queue_table.vacuum_queue(spark, store)
    assert queue_table.queue_versions(spark, store) == [3, 4]


def test_a_reader_survives_later_versions(spark, store):
    early = queue_table.publish_queue(sample(spark), store)
    for token in range(3):
        queue_table.publish_queue(q.claim(early, token, 1), store)
    assert early.count() == 6


def test_two_claims_of_one_version(spark, store):
    queue = queue_table.publish_queue(sample(spark), store)
    queue_table.publish_queue(q.claim(queue, 71, 1), store, expected=1)
    with pytest.raises(queue_table.QueueMoved):
        queue_table.publish_queue(q.claim(queue, 72, 1), store, expected=1)
    both = queue_table.change_queue(spark, store, lambda latest: q.claim(latest, 72, 1))
    assert q.claimed(both, 71).count() == q.claimed(both, 72).count() == 1


def test_a_segment_without_a_version_is_not_read(spark, store):
    queue_table.publish_queue(sample(spark), store)
    make(spark, ("torn", "write", None, None, False)).write.parquet(f"{store}/queue/segment=torn/range=0")
    assert queue_table.read_queue(spark, store).count() == 6
    again = queue_table.publish_queue(sample(spark), store)
    assert again.count() == 6


class Recorder:
    """Stands for a reader or writer; keeps what it is given."""

    def __init__(self):
        self.calls = {}

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.setdefault(name, []).append((args, kwargs))
            return self

        return call


def test_jdbc_options():
    class Frame:
        write = Recorder()

    queue_table.write_jdbc(Frame, "jdbc:x", "t", connections=4, properties={"user": "u"})
    calls = Frame.write.calls
    given = dict(args for args, _ in calls["option"])
    assert given == {"url": "jdbc:x", "dbtable": "t", "batchsize": 1000, "numPartitions": 4}
    assert calls["options"] == [((), {"user": "u"})]
    assert calls["mode"] == [(("append",), {})]

    class Session:
        read = Recorder()

    queue_table.scan_queue_jdbc(Session, "jdbc:x", "t", predicates=["a", "b"])
    assert Session.read.calls["jdbc"] == [(("jdbc:x", "t"), {"predicates": ["a", "b"], "properties": {}})]
