import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gneiss.functions import aggs as A
from gneiss.functions import exprs as E
from gneiss.functions import preds as P
from gneiss.operators import ops

c = F.col


def values(df):
    return [r[0] if len(r) == 1 else tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def ints(spark):
    return spark.createDataFrame([(10,), (20,), (30,)], "value long")


def test_global_aggregates(ints):
    df = ops.global_agg(ints, {"s": A.sum0(c("value")), "lo": A.min_("value"), "hi": A.max_("value"), "a": A.int_avg(c("value"), "bigint"), "n": A.count_all(), "d": A.count_distinct(c("value"))})
    assert values(df) == [(60, 10, 30, 20, 3, 3)]


def test_masked_sum(ints):
    assert values(ops.global_agg(ints.filter("value <> 20"), {"s": A.sum0(c("value"))})) == [40]


def test_expressions(ints):
    assert values(ints.select(E.sub(c("value"), 3))) == [7, 17, 27]
    assert values(ints.agg(A.sum0(E.literal(5, "bigint")))) == [15]


def test_small_integers_dont_overflow(spark):
    df = spark.sql("SELECT CAST(100 AS TINYINT) AS x")
    assert values(df.select(E.add(c("x"), c("x")))) == [200]


def test_average_truncates_toward_zero_and_survives_large_sums(spark):
    assert values(spark.createDataFrame([(-7,), (-4,), (-9,)], "x long").agg(A.int_avg(c("x"), "bigint"))) == [-6]
    assert values(spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "x long").agg(A.int_avg(c("x"), "bigint"))) == [2**62]
    out = spark.sql("SELECT CAST(3 AS SMALLINT) AS x").agg(A.int_avg(c("x"), "smallint").alias("a"))
    assert out.dtypes == [("a", "smallint")]


def test_no_rows(ints):
    none = ints.filter("false")
    assert values(ops.global_agg(none, {"s": A.sum0(c("value")), "n": A.count_all(), "a": A.int_avg(c("value"), "bigint"), "m": A.min_("value")})) == [(0, 0, None, None)]
    assert values(ops.group_agg(none, {"k": c("value")}, {"n": A.count_all()})) == []


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2013, 7, d),) for d in (17, 15, 19)], "d date")
    assert values(ops.global_agg(df, {"lo": A.min_("d"), "hi": A.max_("d")})) == [(dt.date(2013, 7, 15), dt.date(2013, 7, 19))]


def test_case_limit_offset(spark):
    df = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c"), (40, "d")], "value long, name string").coalesce(1)
    assert values(df.select(E.case_when([(c("value") > 15, c("name"))], F.lit("")))) == ["", "b", "c", "d"]
    assert values(ops.limit(df, 2, 1)) == [(20, "b"), (30, "c")]
    assert values(ops.limit(df, 0)) == []


def test_length_is_in_bytes(spark):
    df = spark.createDataFrame([("",), ("abc",), ("héé",)], "name string")
    assert values(df.select(E.byte_length(c("name")))) == [0, 3, 5]


def test_group_by(spark):
    df = spark.createDataFrame([(1, 10), (2, 7), (1, 20), (2, 3), (1, 5)], "key long, value long")
    assert sorted(values(ops.group_agg(df, {"key": c("key")}, {"n": A.count_all(), "s": A.sum0(c("value"))}))) == [(1, 3, 35), (2, 2, 10)]
    assert values(ops.top_groups(df, {"key": c("key")}, {"n": A.count_all()}, "n", having=c("n") > 2)) == [(1, 3)]


def test_projection_renames(spark):
    df = ops.project(spark.createDataFrame([(10, 100), (20, 200)], "a long, b long"), ["b"], ["answer"])
    assert df.columns == ["answer"] and values(df) == [100, 200]


def test_order_by(spark):
    df = spark.createDataFrame([(1, 10), (1, 30), (1, 20), (2, 99)], "a long, b long")
    assert values(ops.top_k(df, [c("a").asc(), c("b").desc()], 2)) == [(1, 30), (1, 20)]
    assert values(ops.top_rows(df, ["a"], [c("b").desc()], n=1)) == [2]


def test_regexp_replace(spark):
    df = spark.createDataFrame([("https://www.example.com/path",), ("http://openai.com/docs",), ("plain",), ("http://a/b\n",)], "r string")
    assert values(df.select(E.regexp_replace(c("r"), r"^https?://(?:www\.)?([^/]+)/.*$", r"\1"))) == ["example.com", "openai.com", "plain", "http://a/b\n"]
    assert E.java_replacement(r"\1 costs $5 \\") == r"$1 costs \$5 \\"
    assert E.java_pattern(r"a[$]\$$") == r"a[$]\$\z"


@pytest.mark.parametrize(
    ("pattern", "texts", "expected"),
    [
        ("https://%/search", ["https://example.com/search", "http://example.com/search", "https://example.com/about"], [True, False, False]),
        ("a_", ["ab", "ac", "a_", "a%"], [True] * 4),
        (r"a\_", ["ab", "ac", "a_", "a%"], [False, False, True, False]),
        (r"a\%", ["ab", "ac", "a_", "a%"], [False, False, False, True]),
        (r"\ab", ["ab", "\\ab"], [True, False]),
        ("a\\", ["a\\", "a"], [True, False]),
        ("%google%", ["https://google.com/search", "https://example.com/google", "plain", "a\ngoogle"], [True, True, False, True]),
        ("https://%", ["https://a", "http://a"], [True, False]),
        ("%google", ["https://google.com", "https://example.com/google"], [False, True]),
        ("%ab%ba%", ["abba", "aba", "xabxbax"], [True, False, True]),
        ("a%a", ["a", "aa", "aba"], [False, True, True]),
        ("a%b%a", ["aba", "aa", "abxa", "ab"], [True, False, True, False]),
        ("%", ["", "x"], [True, True]),
        ("%%", ["", "x"], [True, True]),
        ("", ["", "x"], [True, False]),
    ],
)
def test_like(spark, pattern, texts, expected):
    df = spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1)
    assert values(df.select(P.like(c("v"), pattern))) == expected
    assert values(df.select(P.not_like(c("v"), pattern))) == [not x for x in expected]


def test_predicate_builder(spark):
    df = spark.range(8)
    even, low = c("id") % 2 == 0, c("id") < 4
    assert values(df.filter(P.build_predicate(["and", even, "not", low]))) == [4, 6]
    assert values(df.filter(P.build_predicate(["xor", even, low]))) == [1, 3, 4, 6]
    for bad in (["and", even], [], [even, low]):
        with pytest.raises(ValueError):
            P.build_predicate(bad)
    with pytest.raises(ValueError):
        P.in_(c("id"), [])


def test_typed_literals():
    from pyspark.sql import types as T

    with pytest.raises(ValueError):
        P.typed("abc", T.LongType())


def test_times(spark):
    df = spark.createDataFrame([(dt.datetime(2013, 7, 15, 11, 42, 59),)], "t timestamp_ntz")
    assert values(df.select(E.minute(c("t")), E.trunc_minute(c("t")), E.trunc_hour(c("t")))) == [(42, dt.datetime(2013, 7, 15, 11, 42), dt.datetime(2013, 7, 15, 11))]


def test_minutes_of_a_stream(spark, tmp_path):
    from gneiss.streaming.minutes import views_per_minute

    rows = [(dt.datetime(2024, 1, 1, 0, m, 5 * s),) for m in range(3) for s in range(m + 1)] + [(dt.datetime(2024, 1, 1, 9),)]
    df = spark.createDataFrame(rows, "EventTime timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = views_per_minute(stream).writeStream.outputMode("complete").format("memory").queryName("minutes").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("minutes").collect())) == sorted(map(tuple, views_per_minute(df).collect()))


def test_division_by_type_errors(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(P.like(F.array(c("id")), "%x%")).collect()


def test_default_names(ints):
    aggs = [(A.sum0, "value"), (A.sum0, c("value") + 1), (A.count_all, None), (A.max_, "value", "top"), (A.min_, c("value"), None)]
    df = ops.global_agg(ints, aggs)
    assert df.columns == ["value", "aggregation_1", "aggregation_2", "top", "aggregation_4"]
    named = ops.global_agg(ints, {"a": A.sum0(c("value")), "b": A.sum0(c("value") + 1), "c": A.count_all(), "d": A.max_("value"), "e": A.min_("value")})
    assert values(df) == values(named)
    groups = ops.group_agg(ints, ["value", c("value") % 2], [(A.count_all, None)])
    assert groups.columns == ["value", "group_1", "aggregation_0"]
    assert ops.group_agg(ints, [], [(A.count_all, None)]).count() == 1
