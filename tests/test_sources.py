import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from gneiss import runner, schema
from gneiss.plans import hits
from gneiss.sources import csvfiles, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_hits_schema():
    s = schema.hits_schema()
    assert len(s) == 105 and s[0].name == "WatchID" and s[-1].name == "CLID"
    with pytest.raises(ValueError):
        schema.make_schema([("a", "int7")])
    with pytest.raises(ValueError):
        schema.make_schema([("a", "int8"), ("a", "int8")])


def test_schema_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,int64\nname,string\n")
    assert schema.load_schema(spark, str(tmp_path / "s.csv")).names == ["id", "name"]
    (tmp_path / "bad.csv").write_text("id,int64,x\n")
    with pytest.raises(ValueError):
        schema.load_schema(spark, str(tmp_path / "bad.csv"))


def test_csv_quoting(spark, tmp_path):
    s = schema.make_schema([("id", "int64"), ("text", "string")])
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbf1,"a,b"\n2,"say ""hi"""\n3,"two\nlines"\n4,\n5,""\n6, x \n')
    assert rows(csvfiles.read_csv(spark, str(tmp_path / "a.csv"), s)) == [(1, "a,b"), (2, 'say "hi"'), (3, "two\nlines"), (4, ""), (5, ""), (6, " x ")]
    (tmp_path / "b.csv").write_text("1;x\n")
    assert rows(csvfiles.read_csv(spark, str(tmp_path / "b.csv"), s, sep=";")) == [(1, "x")]
    (tmp_path / "empty.csv").write_text("")
    assert rows(csvfiles.read_csv(spark, str(tmp_path / "empty.csv"), s)) == []
    with pytest.raises(PySparkException):
        csvfiles.read_csv(spark, str(tmp_path / "missing.csv"), s)


def test_lenient_integers_and_strict_dates(spark, tmp_path):
    (tmp_path / "a.csv").write_text("12abc\n\n70000\n-5\nx\n".replace("\n\n", '\n""\n'))
    s = schema.make_schema([("a", "int16")])
    assert rows(csvfiles.read_csv(spark, str(tmp_path / "a.csv"), s)) == [(12,), (0,), (0,), (-5,), (0,)]
    for kind, text in (("date", "2013-7-1"), ("date", ""), ("timestamp", "2013-07-01"), ("double", "x")):
        (tmp_path / "d.csv").write_text(f'"{text}",\n')
        with pytest.raises(PySparkException):
            csvfiles.read_csv(spark, str(tmp_path / "d.csv"), schema.make_schema([("a", kind), ("b", "string")])).collect()


ALL = schema.make_schema([("i8", "int8"), ("i16", "int16"), ("i32", "int32"), ("i64", "int64"), ("i128", "int128"), ("d", "double"), ("s", "string"), ("date", "date"), ("ts", "timestamp")])
ROW = (2, 20, 200, 2000, Decimal(-(10**18)), 2.5, "quoted,value", dt.date(2013, 7, 16), dt.datetime(2013, 7, 16, 11))


def test_all_types(spark, tmp_path):
    df = spark.createDataFrame([ROW], ALL).coalesce(1)
    golden = '2,20,200,2000,-1000000000000000000,2.5,"quoted,value",2013-07-16,2013-07-16 11:00:00\n'
    csvfiles.write_csv(df, str(tmp_path / "out"), header=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == ",".join(ALL.names) + "\n" + golden
    assert csvfiles.write_csv_file(df, str(tmp_path / "f.csv")) == 1
    assert (tmp_path / "f.csv").read_text() == ",".join(ALL.names) + "\n" + golden
    assert rows(csvfiles.round_trip(df)) == [ROW]


def test_header_without_rows(spark, tmp_path):
    csvfiles.write_csv_file(spark.createDataFrame([], ALL), str(tmp_path / "f.csv"))
    assert (tmp_path / "f.csv").read_text() == ",".join(ALL.names) + "\n"


def test_round_trip_of_many_rows(spark, tmp_path):
    s = schema.make_schema([("id", "int64"), ("data", "string")])
    data = [(i - 2500, "".join(chr(32 + (i * 7 + k) % 90) for k in range(i % 40)) + ("\n" if i % 9 == 0 else "") + 'é"' * (i % 3)) for i in range(5000)] + [(9223372036854775807, "A" * 10_000), (-9223372036854775807, "")]
    df = spark.createDataFrame(data, s)
    assert sorted(rows(csvfiles.round_trip(df))) == sorted(data)
    tables.write_table(df, str(tmp_path / "t"))
    assert tables.rows_count(spark, str(tmp_path / "t")) == len(data)
    csvfiles.table_to_csv(spark, str(tmp_path / "t"), str(tmp_path / "c"))
    csvfiles.csv_to_table(spark, str(tmp_path / "c"), s, str(tmp_path / "t2"))
    assert sorted(rows(tables.read_table(spark, str(tmp_path / "t2")))) == sorted(data)
    assert tables.schema_of(spark, str(tmp_path / "t2")).names == ["id", "data"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("hits")
    names = schema.hits_schema().names
    kinds = [schema.NAMES[f.dataType] for f in schema.hits_schema()]
    cell = {"string": "http://google.com/x", "date": "2013-07-15", "timestamp": "2013-07-15 10:11:12"}
    lines = [",".join(str(i + 1) if n in ("WatchID", "UserID") else "62" if n == "CounterID" else "0" if n in ("IsRefresh", "DontCountHits") else cell.get(k, "1") for n, k in zip(names, kinds)) for i in range(5)]
    (path / "hits.csv").write_text("\n".join(lines) + "\n")
    done = runner.convert(spark, str(path / "hits.csv"), str(path / "hits.parquet"))
    assert done["status"] == "ok" and done["input_bytes"] > 0 and done["output_bytes"] > 0
    return path


def test_runner(spark, table, tmp_path):
    out = runner.run(spark, str(table / "hits.parquet"), str(tmp_path))
    assert [r["query"] for r in out] == list(range(1, 44)) and all(r["status"] == "ok" for r in out), [r for r in out if r["status"] != "ok"]
    assert (tmp_path / "q1.csv").read_text() == "q1\n5\n"
    assert (tmp_path / "q24.csv").read_text().splitlines()[0].split(",") == schema.hits_schema().names
    assert (tmp_path / "summary.csv").read_text().splitlines()[0] == ",".join(runner.SUMMARY)


def test_a_failing_query_is_recorded(spark, table, tmp_path):
    tables.write_table(spark.read.parquet(str(table / "hits.parquet")).drop("URL"), str(tmp_path / "t"))
    out = runner.run(spark, str(tmp_path / "t"), str(tmp_path / "o"), [1, 34])
    assert [r["status"] for r in out] == ["ok", "error"] and out[1]["error"]


def test_single_runs_share_a_summary(spark, table, tmp_path):
    hits_table, folder = str(table / "hits.parquet"), tmp_path / "out"
    first = runner.run_one(spark, 0, hits_table, str(folder / "a.csv"), str(tmp_path / "logs" / "a.log"))
    assert first["status"] == "ok" and first["clickbench_query"] == 1 and first["rows"] == 1
    assert (folder / "a.csv").read_text() == "q1\n5\n" and first["output_bytes"] == 5
    none = runner.run_one(spark, 43, hits_table, str(folder / "b.csv"), str(tmp_path / "logs" / "b.log"))
    assert none["status"] == "unsupported" and (folder / "b.csv").read_text() == ""
    bad = runner.run_one(spark, 0, str(tmp_path / "missing"), str(folder / "c.csv"), str(tmp_path / "logs" / "c.log"))
    assert bad["status"] == "error" and bad["runner_exit_code"] == 1 and bad["error"]
    lines = (folder / "summary.csv").read_text().splitlines()
    assert lines[0] == ",".join(runner.SINGLE) and len(runner.SINGLE) == 14
    assert [line.split(",")[2] for line in lines[1:]] == ["ok", "unsupported", "error"]
    assert "status=ok\n" in (tmp_path / "logs" / "a.log").read_text()


def test_explain(spark, table):
    found = {n: names for n, _, _, names in runner.explain(spark, str(table / "hits.parquet"), [1, 3, 24, 37])}
    assert found[1] == "" and found[3] == "AdvEngineID|ResolutionWidth" and found[37] == "CounterID|DontCountHits|EventDate|IsRefresh|URL"
    assert len(found[24].split("|")) == 105


def test_constants_are_those_of_the_real_table():
    assert hits.Constants().counter == 62
