import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reposift.operators import contents as objects
from reposift.schemas import CONTENT, SPLITS
from reposift.session import written_table
from reposift.sources import error_log, files, run_store
from tests.conftest import rows


def content(spark, *pairs):
    return spark.createDataFrame(list(pairs), CONTENT)


def message(spark, *data):
    return spark.createDataFrame(list(data), SPLITS["COMMIT_MESSAGES"].schema)


def test_no_run_yet(spark, store):
    assert run_store.existing_hashes(spark, store).columns == ["hash_code"]
    assert run_store.existing_hashes(spark, store).count() == 0
    assert run_store.read_split(spark, store, "FILE_METADATA").count() == 0
    run_store.consolidate(spark, store)
    with pytest.raises(ValueError):
        run_store.read_split(spark, store, "NOTHING")


def test_runs_are_one_view(spark, store):
    run_store.store_records(content(spark, ("a", "1"), ("b", "2")), store, "CONTENTS", 1)
    run_store.store_records(content(spark, ("b", "2"), ("c", "3")), store, "CONTENTS", 2)
    assert run_store.list_runs(spark, store, "CONTENTS") == [1, 2]
    assert run_store.read_runs(spark, store, "CONTENTS").count() == 4
    assert rows(run_store.read_split(spark, store, "CONTENTS")) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert rows(run_store.read_split(spark, store, "CONTENTS", runs=[2]), "hash_code") == [("b",), ("c",)]


def test_a_run_is_replaced_only_on_demand(spark, store):
    run_store.store_records(content(spark, ("a", "1")), store, "CONTENTS", 1)
    with pytest.raises(ValueError):
        run_store.store_records(content(spark, ("b", "2")), store, "CONTENTS", 1)
    run_store.store_records(content(spark, ("b", "2")), store, "CONTENTS", 1, replace=True)
    assert rows(run_store.read_split(spark, store, "CONTENTS")) == [("b", "2")]


def test_records_need_their_columns(spark, store):
    with pytest.raises(ValueError):
        run_store.store_records(content(spark, ("a", "1")), store, "COMMIT_MESSAGES", 1)


def test_missing_hash_is_a_value_of_the_key(spark, store):
    change = spark.createDataFrame(
        [("o", "r", "p", None, 1, "c"), ("o", "r", "p", None, 2, "c"), ("o", "r", "p", "h", 1, "c")],
        SPLITS["FILE_METADATA"].schema,
    )
    run_store.store_records(change, store, "FILE_METADATA", 1)
    assert run_store.read_split(spark, store, "FILE_METADATA").count() == 2


def test_latest_run_survives(spark, store):
    run_store.store_records(message(spark, ("c", "new", "n"), ("d", "x", "y")), store, "COMMIT_MESSAGES", 9)
    run_store.store_records(message(spark, ("c", "old", "o")), store, "COMMIT_MESSAGES", 3)
    latest = run_store.read_split(spark, store, "COMMIT_MESSAGES", latest=True)
    assert rows(latest) == [("c", "new", "n"), ("d", "x", "y")]


@pytest.mark.parametrize("latest", [False, True])
def test_consolidate(spark, store, latest):
    run_store.store_records(content(spark, ("a", "1"), ("b", "2")), store, "CONTENTS", 1)
    run_store.store_records(content(spark, ("b", "2"), ("c", "3")), store, "CONTENTS", 2)
    before = rows(run_store.read_split(spark, store, "CONTENTS"))
    for run in (3, 4):
        assert run_store.consolidate(spark, store, run=run, latest=latest) == run
        assert run_store.list_runs(spark, store, "CONTENTS") == [run]
        assert rows(run_store.read_runs(spark, store, "CONTENTS").drop("run")) == before
    with pytest.raises(ValueError):
        run_store.consolidate(spark, store, run=4)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("latest", [False, True])
def test_consolidation_shuffles_no_contents(spark, store, latest):
    for run in (1, 2):
        run_store.store_records(content(spark, *[(str(i), "x" * i) for i in range(run * 40)]), store, "CONTENTS", run)
    stored = run_store.read_runs(spark, store, "CONTENTS", all_columns=True)
    found = run_store.kept_rows(stored, ["hash_code"], latest)
    assert "contents" not in plan_of(found)
    kept = written_table(found, "kept")
    rows_kept = run_store.rows_kept(stored, kept)
    plan = plan_of(rows_kept)
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange (hash|range|Single|Round)", plan)
    assert rows(rows_kept, "hash_code", "run") == sorted((str(i), 2 if latest or i >= 40 else 1) for i in range(80))


def test_consolidation_in_parts(spark, store, monkeypatch):
    """More bitmaps than may be sent at once: file by file, and each file is read for its part only."""
    many = [(f"{i:05}", f"text {i}") for i in range(70_000)]
    run_store.store_records(spark.createDataFrame(many, CONTENT).repartition(3), store, "CONTENTS", 1)
    run_store.store_records(content(spark, *many[::7]).repartition(2), store, "CONTENTS", 2)
    monkeypatch.setattr(run_store, "SENT_BITMAPS", 2)
    stored = run_store.read_runs(spark, store, "CONTENTS")
    kept = written_table(run_store.kept_rows(stored, ["hash_code"], False), "kept")
    parts = [run_store.rows_kept(stored, kept, part, 3) for part in range(3)]
    assert sum(part.count() for part in parts) == 70_000
    run_store.consolidate(spark, store, ["CONTENTS"], run=3)
    assert run_store.list_runs(spark, store, "CONTENTS") == [3]
    assert rows(run_store.read_runs(spark, store, "CONTENTS").drop("run")) == many


def test_a_large_run_stays(spark, store):
    def text(i):
        return " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest() for k in range(6))

    many = [(f"{i:05}", text(i)) for i in range(3_000)]
    run_store.store_records(content(spark, *many), store, "CONTENTS", 5)
    run_store.store_records(content(spark, *many[:5], ("new", "n"), ("new", "n")), store, "CONTENTS", 2)
    run_store.store_records(content(spark, ("new", "n"), ("more", "m")), store, "CONTENTS", 7)
    before = (Path(store) / "data/split=CONTENTS/run=5").stat().st_mtime
    run_store.consolidate(spark, store, ["CONTENTS"], run=8, tier=4.0)
    assert run_store.list_runs(spark, store, "CONTENTS") == [5, 8]
    assert (Path(store) / "data/split=CONTENTS/run=5").stat().st_mtime == before
    assert rows(run_store.read_runs(spark, store, "CONTENTS", [8]).drop("run")) == [("more", "m"), ("new", "n")]
    assert run_store.read_runs(spark, store, "CONTENTS").count() == 3_002
    run_store.store_records(content(spark, *many[:3]), store, "CONTENTS", 9)
    run_store.consolidate(spark, store, ["CONTENTS"], run=10, tier=4.0)
    assert run_store.read_runs(spark, store, "CONTENTS").count() == 3_002
    run_store.store_records(content(spark, *[(f"z{i}", text(-i)) for i in range(3_000)]), store, "CONTENTS", 11)
    run_store.consolidate(spark, store, ["CONTENTS"], run=12, tier=4.0)
    assert run_store.list_runs(spark, store, "CONTENTS") == [12]
    assert run_store.read_runs(spark, store, "CONTENTS").count() == 6_002


def test_a_large_run_with_duplicates_is_merged(spark, store):
    run_store.store_records(content(spark, *[("a", "x" * 500)] * 500), store, "CONTENTS", 1)
    run_store.store_records(content(spark, ("b", "y")), store, "CONTENTS", 2)
    run_store.consolidate(spark, store, ["CONTENTS"], run=3, tier=0.1)
    assert run_store.list_runs(spark, store, "CONTENTS") == [3]
    assert run_store.read_runs(spark, store, "CONTENTS").count() == 2


def test_consolidate_keeps_all_stored_columns(spark, store):
    record = spark.createDataFrame([("o", "r", "t", "a", "c", 5, "m")], SPLITS["COMMIT_MESSAGES"].stored)
    run_store.store_records(record, store, "COMMIT_MESSAGES", 1)
    run_store.store_records(message(spark, ("d", "b", "n")), store, "COMMIT_MESSAGES", 2)
    run_store.consolidate(spark, store, ["COMMIT_MESSAGES"], 3)
    stored = run_store.read_runs(spark, store, "COMMIT_MESSAGES", all_columns=True).drop("run")
    assert rows(stored) == [("o", "r", "t", "a", "c", 5, "m"), (None, None, None, "b", "d", None, "n")]


def test_unfinished_run_is_not_read_nor_removed(spark, store):
    run_store.store_records(content(spark, ("a", "1")), store, "CONTENTS", 1)
    content(spark, ("z", "9")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{store}/data/split=CONTENTS/run=2")
    assert rows(run_store.read_split(spark, store, "CONTENTS")) == [("a", "1")]
    run_store.consolidate(spark, store, ["CONTENTS"], run=3)
    assert rows(run_store.read_split(spark, store, "CONTENTS")) == [("a", "1")]


def test_run_filter_prunes_folders(spark, store):
    for run in (1, 2):
        run_store.store_records(content(spark, (str(run), "x")), store, "CONTENTS", run)
    one = run_store.read_runs(spark, store, "CONTENTS").filter("run = 2").select("hash_code")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan
    assert "ReadSchema: struct<hash_code:string>" in plan


def test_lookups(spark):
    stored = content(spark, ("a", "1"), ("b", "2"))
    asked = spark.createDataFrame([("a",), ("a",), ("z",)], "hash_code string")
    assert rows(objects.lookup_contents(asked, stored)) == [
        ("a", "1", None), ("a", "1", None), ("z", None, "missing object z"),
    ]
    assert rows(objects.found_contents(asked, stored)) == [("a", "1")] * 2
    assert rows(objects.missing_contents(asked, stored)) == [("z",)]
    assert rows(objects.new_hashes(asked, stored)) == [("z",)]


def test_dedup_of_hot_key_combines_before_the_shuffle(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hash_code"),
        F.lit("x").alias("contents"), F.lit(1).alias("run"),
    )
    for unique in (objects.dedup(df, ["hash_code"]), objects.dedup_latest(df, ["hash_code"], "run")):
        assert unique.count() == 6001
        plan = unique._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan[plan.index("Exchange"):]


def test_error_log(spark, store):
    assert error_log.read_error_log(spark, store).count() == 0
    errors = spark.createDataFrame([("o", "r", None), ("o", "r", "e" * 300)], "owner string, repo string, error string")
    for _ in range(2):
        error_log.log_errors(errors, store, 5)
    assert rows(error_log.read_error_log(spark, store)) == [("o", "r", "e" * 254, 5), ("o", "r", "unknown", 5)]


def test_list_files(spark, tmp_path):
    for name in ("a.txt", "sub/b.txt", "sub/deep/c.txt", ".hidden", ".dir/d.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    listed = files.list_files(spark, str(tmp_path))
    assert listed.columns == ["path", "length", "modificationTime"]
    names = rows(listed.select(F.substring_index("path", "/", -1), "length"))
    assert names == [("a.txt", 5), ("b.txt", 9), ("c.txt", 14)]
