import pytest

from pyspark.sql import functions as F

from reposift.operators import ordering
from reposift.operators import projects as p
from reposift.plans.project_load import load_project_queue, pairs_of_lines
from reposift.schemas import PROJECT
from reposift.session import written_table
from tests.conftest import rows

PREFIX = "https://api.github.com/repos/"


def line(
    url=PREFIX + "o/r",
    description='"d"',
    language="JavaScript",
    created="2012-01-02 03:04:05",
    forked="\\N",
    deleted="0",
    rest=",2013-01-01 00:00:00",
):
    return f'1,"{url}",7,"r",{description},"{language}","{created}",{forked},{deleted}{rest}'


def parse(spark, *lines, **options):
    df = spark.createDataFrame([(text,) for text in lines], "value string")
    return rows(p.parse_projects(df, **options))


GOOD = ("o", "r", 0, False, False, 1325473445000)


def test_good_line(spark):
    assert parse(spark, line()) == [GOOD]


def test_schema(spark):
    lines = spark.createDataFrame([(line(),)], "value string")
    parsed = p.parse_projects(lines)
    assert parsed.columns == PROJECT.fieldNames()
    assert [t for _, t in parsed.dtypes] == [f.dataType.simpleString() for f in PROJECT.fields]


@pytest.mark.parametrize(
    "text",
    [
        line(description='"says ""hi"""'),
        line(description='"a, b"'),
        line(description='""'),
        line(description=""),
        line(description='"d"  '),
        line(description='plain "text" inside'),
        line(rest=""),
        line(rest=",a,b,c"),
        line(url=PREFIX + " o\t/\x01r /more/segments"),
        line(description='"' + "," * 30000 + '"'),
        line(rest=",x" * 30000),
    ],
)
def test_lines_that_parse(spark, text):
    assert parse(spark, text) == [GOOD]


@pytest.mark.parametrize(
    "text",
    [
        "",
        "1,2",
        line(description='"bad"q'),
        line(description='"esc \\" q"'),
        line(description='"open'),
        line(url=PREFIX + "o"),
        line(url=PREFIX + "o/"),
        line(url=PREFIX + "/r"),
        line(url="http://x/o/r"),
        line(language="javascript"),
        line(language="Python"),
        line(language="JavaScript "),
        line(deleted="x"),
        line(deleted=" 1"),
        line(deleted=""),
        line(deleted="99999999999"),
        line(created="2012-13-45 00:00:00"),
        line(created="2012-01-02 24:00:00"),
        line(created="2012-01-02 03:04:05 trailing"),
        line(created="2012-01-02"),
        line(created=""),
        '1,"' + PREFIX + 'o/r",7,"r","d","JavaScript","2012-01-02 03:04:05",\\N',
    ],
)
def test_lines_that_are_dropped(spark, text):
    assert parse(spark, text) == []


@pytest.mark.parametrize(
    "forked,expected", [("\\N", False), ("", True), ('""', True), ("12", True), ("\\n", True)]
)
def test_forked(spark, forked, expected):
    assert parse(spark, line(forked=forked))[0][4] is expected


@pytest.mark.parametrize(
    "deleted,expected", [("1", True), ("0", False), ("+1", True), ("-1", False), ("2", False), ("01", True)]
)
def test_deleted(spark, deleted, expected):
    assert parse(spark, line(deleted=deleted))[0][3] is expected


def test_created_does_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # This hour does not exist in that zone.
        assert parse(spark, line(created="2012-03-11 02:30:00"))[0][5] == 1331433000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_languages(spark):
    lines = [line(language=name) for name in ("JavaScript", "TypeScript", "CoffeeScript")]
    assert [r[2] for r in parse(spark, *lines)] == [0, 1, 2]
    assert [r[2] for r in parse(spark, *lines, languages=["CoffeeScript"])] == [2]
    assert parse(spark, *lines, languages=[]) == []
    with pytest.raises(ValueError):
        parse(spark, *lines, languages=["Cobol"])


def test_rejected_lines_and_parsed_ones_are_all_lines(spark):
    texts = [line(), line(deleted="x"), line(created="no"), line(description='"b"q'), "1,2", ""]
    lines = spark.createDataFrame([(t,) for t in texts], "value string")
    rejected = {r["value"]: r["error"] for r in p.rejected_lines(lines).collect()}
    assert rejected == {
        line(deleted="x"): "deleted is not an integer",
        line(created="no"): "created_at is not a date",
        line(description='"b"q'): "not a CSV record",
        "1,2": "no owner and repository in the url",
        "": "no owner and repository in the url",
    }


def project_rows(spark):
    data = [
        ("a", "1", 0, True, False, 1),
        ("b", "2", 0, False, True, 1),
        ("c", "3", 0, False, False, 1),
        ("c", "3", 1, False, False, 2),
        ("d", "4", 0, False, False, 1),
    ]
    return spark.createDataFrame(data, PROJECT)


def test_filters(spark):
    df = project_rows(spark)
    assert p.filter_deleted(df).count() == 4
    assert p.filter_forked(df).count() == 4
    assert p.apply_project_filters(df).count() == 3
    assert p.apply_project_filters(df, "").count() == 5
    assert rows(p.apply_project_filters(df, ["filterTop2", "filterDeleted"]), "owner") == [("b",), ("c",)]


def test_top_n(spark):
    df = project_rows(spark)
    assert p.top_n_of("filterTopx, filterTop, filterTop1.5,filterTop7,filterTop2") == 7
    assert p.top_n_of("filtertop3") is None
    assert p.top_n_of("filterTop99999999999") is None
    assert p.filter_top_n(df, 0).count() == 0
    assert p.filter_top_n(df, 100).count() == 5
    with pytest.raises(ValueError):
        p.filter_top_n(df, -1)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 100])
def test_top_n_in_parallel(spark, n):
    copies = project_rows(spark).crossJoin(spark.range(40)).drop("id")
    few, many = (p.filter_top_n(copies.repartition(m), n) for m in (1, 40))
    assert rows(few) == rows(many) == rows(copies.orderBy(*copies.columns).limit(n))


def test_limit_comes_before_distinct(spark):
    texts = [line(), line(), line(url=PREFIX + "p/r")]
    lines = spark.createDataFrame([(t,) for t in texts], "value string")
    assert rows(pairs_of_lines(lines, "filterTop2")) == [("o", "r")]


def test_load(spark, tmp_path, store):
    def load(name, *texts, **options):
        (tmp_path / name).write_text("\n".join(texts) + "\n")
        return load_project_queue(spark, str(tmp_path / name), store, **options)

    assert rows(load("a.csv", line(), line()), "owner", "repo", "completed") == [("o", "r", False)]
    merged = load("b.csv", line(), line(url=PREFIX + "p/r"), merge=True)
    assert rows(merged, "owner") == [("o",), ("p",)]
    assert rows(load("c.csv", line(url=PREFIX + "q/r")), "owner") == [("q",)]


def test_plan_parses_each_line_once(spark):
    lines = spark.createDataFrame([(line(),)], "value string")
    plan = pairs_of_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1
    assert "PythonUDF" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_limit_is_merged_in_one_task(spark):
    stored = written_table(project_rows(spark), "projects")
    assert "TakeOrderedAndProject" in plan_of(p.filter_top_n(stored, 2))


def test_a_large_limit_is_one_filter(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MERGED", 10_000)
    stored = written_table(spark.range(50_000).select(F.lit("o").alias("owner"), F.md5(F.col("id").cast("string")).alias("repo")).repartition(60), "pairs")
    first = ordering.first_rows(stored, 20_000, ["owner", "repo"])
    assert "Exchange" not in plan_of(first) and "TakeOrdered" not in plan_of(first)
    assert rows(first) == rows(stored.orderBy("owner", "repo").limit(20_000))


@pytest.mark.parametrize("n", [1, 5, 7_000, 9_999, 10_000, 19_999, 20_000, 20_001])
def test_nth_row_among_ties_and_nulls(spark, monkeypatch, n):
    monkeypatch.setattr(ordering, "MERGED", 0)
    monkeypatch.setattr(ordering, "SAMPLE", 64)
    kind = F.when(F.col("id") % 5 == 0, None).otherwise(F.lit("x"))
    df = spark.range(20_000).select((F.col("id") % 3).alias("third"), kind.alias("kind"))
    got = ordering.first_rows(df, n, ["third"]).groupBy("third", "kind").count()
    want = df.orderBy("third", "kind").limit(n).groupBy("third", "kind").count()
    assert rows(got) == rows(want)
    found = ordering.nth_row(df, n, ["third", "kind"])
    assert (found is None) == (n > 20_000)
    if found:
        assert found.below < n <= found.upto


def test_within_first(spark, monkeypatch):
    df = spark.range(1_000)
    for merged in (10**6, 0):
        monkeypatch.setattr(ordering, "MERGED", merged)
        for n in (0, 1, 400, 1_000, 2_000):
            assert df.filter(ordering.within_first(df, n, ["id"])).count() == min(n, 1_000)


@pytest.mark.parametrize("text", ['"u"x,a,b', 'u,"open', '1,"a"b"c",2'])
def test_fields_do_not_depend_on_the_length_of_a_line(spark, text):
    padded = text + "," + "x" * 25_000
    lines = spark.createDataFrame([(text,), (padded,), (line(),), (line() + ",z" * 30_000,)], "value string")
    found = [r[1:] for r in p.split_lines(lines).collect()]
    assert found[0] == found[1] == (None,) * len(p.LINE_FIELDS)
    assert found[2][1:9] == found[3][1:9] and found[2][1] is not None
