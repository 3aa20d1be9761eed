import random
import re

import pytest
from pyspark.sql import functions as F

from reposift.functions import paths
from reposift.operators import history as h
from reposift.operators.attempts import failures, resolve_attempts
from reposift.operators.ordering import number_rows
from tests.conftest import rows

COMMIT = "owner string, repo string, commit_id string, tree_id string, commit_time_s long, author string, message string"
FILE = "owner string, repo string, commit_id string, path string, hash_code string"


def log(spark, *ids, repo="r"):
    """Commits of one repository, one second apart."""
    data = [("o", repo, c, "t" + c, i, "a@x", "m" + c) for i, c in enumerate(ids)]
    return spark.createDataFrame(data, COMMIT)


def trees(spark, repo="r", **files):
    data = [("o", repo, c, path, code) for c, tree in files.items() for path, code in tree.items()]
    return spark.createDataFrame(data, FILE)


def changes(df):
    return rows(df, "commit_id", "change_type", F.coalesce("new_path", "old_path"), "new_hash")


# Ways to cut the work: whole histories in a window, or everything split as far as it goes.
CUTS = [{}, {"per_group": 1, "max_group": 0}, {"per_group": 2}, {"per_group": 3, "max_group": 1}]


@pytest.mark.parametrize("cut", CUTS)
def test_changes(spark, cut):
    files = trees(
        spark,
        c1={"a": "1", "b": "1"},
        c2={"a": "2", "b": "1"},
        c3={"b": "1"},
        c4={"a": "2", "b": "3"},
        c5={"a": "2"},
    )
    commits = log(spark, "c1", "c2", "c3", "c4", "c5", "c6")
    assert changes(h.snapshot_changes(commits, files, **cut)) == [
        ("c1", "ADD", "a", "1"),
        ("c1", "ADD", "b", "1"),
        ("c2", "MODIFY", "a", "2"),
        ("c3", "DELETE", "a", None),
        ("c4", "ADD", "a", "2"),
        ("c4", "MODIFY", "b", "3"),
        ("c5", "DELETE", "b", None),
        ("c6", "DELETE", "a", None),
    ]


@pytest.mark.parametrize("cut", CUTS)
def test_single_snapshot_adds_all(spark, cut):
    got = h.snapshot_changes(log(spark, "c1"), trees(spark, c1={"a": "1"}), **cut)
    assert changes(got) == [("c1", "ADD", "a", "1")]


def test_unreadable_snapshot_is_skipped(spark):
    commits = log(spark, "c1", "c2", "c3").withColumn(
        "error", F.when(F.col("commit_id") == "c2", "missing tree")
    )
    files = trees(spark, c1={"a": "1"}, c2={"z": "9"}, c3={"a": "1", "b": "1"})
    assert changes(h.snapshot_changes(commits, files)) == [
        ("c1", "ADD", "a", "1"),
        ("c3", "ADD", "b", "1"),
    ]
    assert h.commit_messages(commits).count() == 2


def test_copies_and_conflicts_count_once(spark):
    files = trees(spark, c1={"a": "1"}, c2={"a": "1"})
    files = files.union(files).union(trees(spark, c1={"a": "0"}, c2={"a": "2"}))
    commits = log(spark, "c1", "c2")
    assert changes(h.snapshot_changes(commits.union(commits), files)) == [
        ("c1", "ADD", "a", "1"),
        ("c2", "MODIFY", "a", "2"),
    ]


@pytest.mark.parametrize("cut", CUTS)
def test_repeated_rows_change_nothing_and_cost_no_shuffle(spark, cut):
    commits, files = log(spark, "c1", "c2", "c3"), trees(spark, c1={"a": "1"}, c2={"a": "2", "b": "1"}, c3={"b": "1"})
    repeated = files.union(files).union(files)
    assert changes(h.snapshot_changes(commits, repeated, **cut)) == changes(h.snapshot_changes(commits, files, **cut))
    once, again = (
        h.snapshot_changes(commits, repeated, unique=unique, **cut)._jdf.queryExecution().executedPlan().toString()
        for unique in (True, False)
    )
    assert again.count("Exchange hash") == once.count("Exchange hash")


def test_commits_of_one_second(spark):
    files = trees(spark, x={"a": "1"}, y={"a": "2"})
    same = log(spark, "y", "x").withColumn("commit_time_s", F.lit(5).cast("long"))
    by_id = changes(h.snapshot_changes(same, files))
    assert by_id == [("x", "ADD", "a", "1"), ("y", "MODIFY", "a", "2")]
    logged = same.withColumn("seq", F.when(F.col("commit_id") == "y", 1).otherwise(2))
    assert changes(h.snapshot_changes(logged, files, order=["seq"])) == [
        ("x", "MODIFY", "a", "1"),
        ("y", "ADD", "a", "2"),
    ]


def test_repositories_do_not_mix(spark):
    commits = log(spark, "c1").union(log(spark, "c1", "c2", repo="q"))
    files = trees(spark, c1={"a": "1"}).union(trees(spark, "q", c2={"a": "1"}))
    got = rows(h.snapshot_changes(commits, files), "repo", "commit_id", "change_type")
    assert got == [("q", "c2", "ADD"), ("r", "c1", "ADD")]


def random_history(seed, repos=3, commits=25, files=6):
    draw = random.Random(seed)
    snapshots = []
    for repo in range(repos):
        for c in range(commits):
            tree = {f"f{i}.js": str(draw.randint(1, 3)) for i in range(files) if draw.random() < 0.7}
            snapshots.append((f"r{repo}", f"c{c:03}", c, tree if draw.random() < 0.9 else {}))
    return snapshots


@pytest.mark.parametrize("seed,cut", list(enumerate(CUTS)))
def test_changes_agree_with_brute_force_and_rebuild_the_last_snapshot(spark, seed, cut):
    snapshots = random_history(seed)
    commits = spark.createDataFrame([("o", r, c, "t", n, "a", "m") for r, c, n, _ in snapshots], COMMIT)
    files = spark.createDataFrame(
        [("o", r, c, p, code) for r, c, _, tree in snapshots for p, code in tree.items()], FILE
    )
    expected, previous, last = [], {}, {}
    for repo, commit, _, tree in snapshots:
        old = previous.get(repo, {})
        for path in old.keys() | tree.keys():
            if old.get(path) != tree.get(path):
                expected.append((repo, commit, path, tree.get(path)))
        previous[repo] = last[repo] = tree
    records = rows(h.file_history(commits, files, **cut), "repository", "commit_id", "git_path", "hash_code")
    assert records == sorted(expected, key=repr)

    rebuilt = {repo: {} for repo in last}
    for repo, _, path, code in sorted(records, key=lambda r: r[:3]):
        rebuilt[repo][path] = code
    for repo, tree in last.items():
        assert {p: code for p, code in rebuilt[repo].items() if code} == tree


def test_large_repositories_and_histories_are_split(spark):
    """One file of one repository holds a third of all rows; no window group may."""
    hot = [("o", "hot", f"c{n:05}", "a", str(n % 2)) for n in range(3000)]
    rest = [("o", f"r{n % 50}", f"c{n // 50:05}", "b", "1") for n in range(6000)]
    files = spark.createDataFrame(hot + rest, FILE)
    commits = files.select(
        "owner", "repo", "commit_id", F.lit("t").alias("tree_id"),
        F.substring("commit_id", 2, 5).cast("long").alias("commit_time_s"),
        F.lit("a").alias("author"), F.lit("m").alias("message"),
    )
    got = h.snapshot_changes(commits, files, unique=True, per_group=100, max_group=500)
    assert rows(got.groupBy("change_type").count()) == [("ADD", 51), ("MODIFY", 2999)]


@pytest.mark.parametrize("unique", [True, False])
def test_no_shuffle_of_snapshots_has_a_repository_alone_for_its_key(spark, tmp_path, unique):
    for name, df in (("log", log(spark, "c0", "c1")), ("files", trees(spark, c0={"a": "1"}, c1={"a": "2"}))):
        df.write.parquet(str(tmp_path / name))
    commits, files = (spark.read.parquet(str(tmp_path / name)) for name in ("log", "files"))
    batch = spark.createDataFrame([("o", "r")], "owner string, repo string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = h.snapshot_changes(commits, files, unique=unique, repositories=batch)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert changes(got) == [("c0", "ADD", "a", "1"), ("c1", "MODIFY", "a", "2")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"hashpartitioning\(owner#\d+, repo#\d+, \d+\)", plan)


@pytest.mark.parametrize("largest", [1, 10, 1000])
def test_numbering_of_repeated_rows_is_the_same_by_either_way(spark, largest):
    data = [("k", n // 3, n % 3 // 2) for n in range(60)]
    df = spark.createDataFrame(data, "k string, n long, x int").repartition(5)
    want = [(i + 1, *row[1:]) for i, row in enumerate(sorted(data))]
    assert rows(number_rows(df, ["k"], ["n"], largest), "position", "n", "x") == sorted(want, key=repr)


@pytest.mark.parametrize("largest", [1, 10, 1000])
def test_numbering(spark, largest):
    data = [("hot", n) for n in range(400)] + [(f"k{n}", n) for n in range(60)] + [(None, 7)]
    df = spark.createDataFrame(data, "k string, n long").repartition(7)
    numbered = number_rows(df, ["k"], ["n"], largest)
    got = {(r.k, r.n): (r.position, r.group_rows) for r in numbered.collect()}
    assert got == {(k, n): (n + 1, 400) if k == "hot" else (1, 1) for k, n in data}


def test_numbering_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, n long")
    for keys in (["k"], []):
        assert number_rows(empty, keys, ["n"], 0).count() == 0


def test_scan_commits(spark):
    got = h.scan_commits(log(spark, "z", "y", "x"))
    assert rows(got, "position", "commit_id") == [(1, "z"), (2, "y"), (3, "x")]


def test_commit_messages(spark):
    assert rows(h.commit_messages(log(spark, "c1"))) == [("o", "r", "tc1", "a@x", "c1", 0, "mc1")]


@pytest.mark.parametrize(
    "path,expected",
    [
        ("a/b.js", "js"),
        ("b.min.js", "js"),
        ("a.b/c", ""),
        (".gitignore", "gitignore"),
        ("x.", ""),
        ("", ""),
        ("a/b.js/", "js"),
        ("A.JS", "JS"),
    ],
)
def test_file_extension(spark, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.file_extension(F.col("p"))).first()[0] == expected


def test_checkout_path(spark):
    data = [("/mnt/x/o/r",), ("/mnt/x/o/r/",), ("o//r",), ("r",), ("",)]
    df = spark.createDataFrame(data, "p string")
    got = [tuple(r) for r in df.select(paths.checkout_owner(F.col("p")), paths.checkout_repo(F.col("p"))).collect()]
    assert got == [("o", "r")] * 3 + [(None, "r"), (None, None)]


def test_extension_filter(spark):
    df = spark.createDataFrame([("a.js",), ("A.JS",), ("b.ts",), ("c",)], "path string")
    assert rows(h.filter_extensions(df, "JS, ts")) == [("A.JS",), ("a.js",), ("b.ts",)]
    assert rows(h.filter_extensions(df, "JS, ts", case_sensitive=True)) == [("a.js",), ("b.ts",)]
    for keep_all in ("", " , ", []):
        assert h.filter_extensions(df, keep_all).count() == 4


def test_attempts(spark):
    data = [
        ("a", 1, False, "e1"), ("a", 2, True, None), ("a", 3, True, None),
        ("b", 1, False, "e1"), ("b", 2, False, "e2"), ("b", 3, False, "e3"), ("b", 4, True, None),
        ("c", 1, True, None),
        ("d", 2, False, "only"),
    ]
    df = spark.createDataFrame(data, "k string, attempt int, ok boolean, error string")
    resolved = resolve_attempts(df, ["k"], 3)
    assert rows(resolved) == [("a", 2, True, None), ("b", 3, False, "e3"), ("c", 1, True, None), ("d", 2, False, "only")]
    assert rows(failures(resolved), "k") == [("b",), ("d",)]
