"""One query per operator, over the driver's tables, with the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss import session
from gneiss.functions import aggs as A
from gneiss.functions import exprs as E
from gneiss.functions import preds as P
from gneiss.operators import ops
from gneiss.sources import csvfiles, tables

_c = F.col
#: name: (function of a reader of tables, SQL).  Columns are made when a query is, as they need a session.
_ALL: dict = {}


def _add(name: str, sql: str):
    def keep(f):
        _ALL[f"op_{name}"] = (f, sql)
        return f

    return keep


def _filter(name: str, table: str, columns: str, condition: Callable[[], Column], sql: str) -> None:
    _ALL[f"op_{name}"] = (lambda t: ops.where(t(table), condition()).select(*columns.split(", ")), f"SELECT {columns} FROM {table} WHERE {sql}")


def _agg(name: str, table: str, aggs: Callable[[], dict[str, Column]], sql: str, condition: Callable[[], Column] | None = None) -> None:
    _ALL[f"op_{name}"] = (lambda t: ops.global_agg(t(table) if condition is None else t(table).filter(condition()), aggs()), f"SELECT {sql} FROM {table}")


# Sources and projections.
_add("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")(lambda t: tables.read_table(t.spark, t.path("lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"]))
_add("scan_all", "SELECT * FROM nation")(lambda t: ops.scan(t("nation")))
_add("count_star", "SELECT count(*) AS n FROM lineitem")(lambda t: ops.global_agg(tables.read_table(t.spark, t.path("lineitem"), []), {"n": A.count_all()}))
_add("rename", "SELECT o_custkey AS customer, o_orderkey FROM orders")(lambda t: ops.project(t("orders"), ["o_custkey", "o_orderkey"], ["customer", None]))
_add("csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_size FROM part")(lambda t: csvfiles.round_trip(t("part").select("p_partkey", "p_name", "p_brand", "p_size")))
_add("csv_quoting", "SELECT conv_id, turn, role, text FROM conversations")(lambda t: csvfiles.round_trip(t("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
_add("csv_typed", "SELECT o_orderkey, o_totalprice, o_orderdate, CAST(o_orderdate AS DATE) AS day FROM orders")(
    lambda t: csvfiles.round_trip(t("orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.col("o_orderdate").cast("date").alias("day")))
)


@_add("table_write", "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem")
def _table_write(t):
    path = session.scratch(t.spark, "table")
    tables.write_table(t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"), path)
    return tables.read_table(t.spark, path)


@_add("csv_conversions", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _csv_conversions(t):
    """Table to CSV, CSV to table: both conversions."""
    df, path = t("customer").select("c_custkey", "c_name", "c_acctbal"), session.scratch(t.spark, "convert")
    tables.write_table(df, f"{path}/from")
    csvfiles.table_to_csv(t.spark, f"{path}/from", f"{path}/csv")
    csvfiles.csv_to_table(t.spark, f"{path}/csv", df.schema, f"{path}/to", multi_line=False)
    return tables.read_table(t.spark, f"{path}/to")


_add("default_names", "SELECT l_returnflag, l_linenumber % 2 AS group_1, count(*) AS aggregation_0, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, max(l_orderkey) AS top FROM lineitem GROUP BY 1, 2")(
    lambda t: ops.group_agg(t("lineitem"), ["l_returnflag", _c("l_linenumber") % 2], [(A.count_all, None), (A.sum0, "l_linenumber"), (A.max_, "l_orderkey", "top")])
)

# Predicates.
_filter("filter_eq", "orders", "o_orderkey, o_custkey", lambda: _c("o_orderstatus") == "F", "o_orderstatus = 'F'")
_filter("filter_ne", "orders", "o_orderkey", lambda: P.compare(_c("o_orderpriority"), "<>", "5-LOW"), "o_orderpriority <> '5-LOW'")
_filter("filter_lt", "lineitem", "l_orderkey, l_linenumber", lambda: P.compare(_c("l_quantity"), "<", 10.0), "l_quantity < 10")
_filter("filter_le", "lineitem", "l_orderkey, l_linenumber", lambda: P.compare(_c("l_discount"), "<=", 0.02), "l_discount <= 0.02")
_filter("filter_gt", "orders", "o_orderkey", lambda: P.compare(_c("o_totalprice"), ">", 300000.0), "o_totalprice > 300000")
_filter("filter_ge", "orders", "o_orderkey", lambda: _c("o_orderdate") >= F.lit(dt.datetime(1997, 1, 1)).cast("timestamp_ntz"), "o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
_filter("filter_column_pair", "lineitem", "l_orderkey, l_linenumber", lambda: _c("l_tax") > _c("l_discount"), "l_tax > l_discount")
for _name, _pattern in (("contains", "%in%"), ("prefix", "red%"), ("suffix", "%ring"), ("general", "%a%e%t"), ("single", "_ed%"), ("equal", "small ring")):
    _filter(f"like_{_name}", "part", "p_partkey, p_name", lambda p=_pattern: P.like(_c("p_name"), p), f"p_name LIKE '{_pattern}'")
_filter("like_escape", "pages", "page_id", lambda: P.like(F.translate("url", "/e", "%_"), r"%\%\_n\%%"), r"translate(url, '/e', '%_') LIKE '%\%\_n\%%' ESCAPE '\'")
_filter("like_url", "pages", "page_id", lambda: P.like(_c("url"), "https://%/en/%"), "url LIKE 'https://%/en/%'")
_filter("like_long_text", "documents", "doc_id", lambda: P.like(_c("text"), "%a%e%z%"), "text LIKE '%a%e%z%'")
_filter("not_like", "pages", "page_id", lambda: P.not_like(_c("url"), "%.net/%"), "url NOT LIKE '%.net/%'")
_filter("and_or_not", "orders", "o_orderkey", lambda: P.build_predicate(["and", "or", _c("o_orderstatus") == "F", _c("o_orderstatus") == "O", "not", _c("o_totalprice") > 100000.0]), "(o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT o_totalprice > 100000")
_filter("xor", "lineitem", "l_orderkey, l_linenumber", lambda: P.xor(_c("l_quantity") > 25, _c("l_discount") > 0.05), "(l_quantity > 25) <> (l_discount > 0.05)")
_filter("in", "nation", "n_nationkey, n_name", lambda: P.in_(_c("n_regionkey"), [1, 3]), "n_regionkey IN (1, 3)")
_filter("not_empty", "events", "event_id", lambda: P.not_empty(_c("event_type")), "event_type <> ''")
_filter("between_date", "orders", "o_orderkey", lambda: P.between(_c("o_orderdate").cast("date"), F.lit(dt.date(1996, 1, 1)), F.lit(dt.date(1996, 6, 30))), "CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
_add("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")(lambda t: ops.group_agg(t("orders"), {"o_custkey": _c("o_custkey")}, {"n": A.count_all()}).filter("n > 12"))


# Scalar expressions.
def _expr(name: str, table: str, key: str, expr: Callable[[], Column], sql: str) -> None:
    _ALL[f"op_{name}"] = (lambda t: t(table).select(key, expr().alias("v")), f"SELECT {key}, {sql} AS v FROM {table}")


_expr("add", "part", "p_partkey", lambda: E.add(_c("p_size"), _c("p_partkey")), "CAST(p_size AS BIGINT) + p_partkey")
_expr("add_double", "lineitem", "l_orderkey", lambda: E.add_double(_c("l_tax"), _c("l_discount")), "l_tax + l_discount")
_expr("sub", "part", "p_partkey", lambda: E.sub(_c("p_size"), 3), "CAST(p_size AS BIGINT) - 3")
_expr("sub_double", "lineitem", "l_orderkey", lambda: E.sub_double(_c("l_extendedprice"), 1.5), "l_extendedprice - 1.5")
_expr("length_bytes", "documents", "doc_id", lambda: E.byte_length(_c("text")), "strlen(text)")
_expr("extract_minute", "events", "event_id", lambda: E.minute(_c("ts")), "CAST(extract(minute FROM ts) AS TINYINT)")
_expr("trunc_minute", "events", "event_id", lambda: E.trunc_minute(_c("ts")), "date_trunc('minute', ts)")
_expr("trunc_hour", "events", "event_id", lambda: E.trunc_hour(_c("ts")), "date_trunc('hour', ts)")
_expr("regexp_replace", "pages", "page_id", lambda: E.regexp_replace(_c("url"), r"^https?://(?:www\.)?([^/]+)/.*$", r"\1"), r"regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1', 'g')")
_expr("case_when", "part", "p_partkey", lambda: E.case_when([(_c("p_size") > 30, F.lit("large")), (_c("p_size") > 10, F.lit("middle"))], F.lit("")), "CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE '' END")
_add("literal_key", "SELECT CAST(7 AS BIGINT) AS seven, n_regionkey, count(*) AS n FROM nation GROUP BY 1, 2")(lambda t: ops.group_agg(t("nation"), {"seven": E.literal(7, "bigint"), "n_regionkey": _c("n_regionkey")}, {"n": A.count_all()}))

# Aggregates.
_agg("sum", "part", lambda: {"v": A.sum0(_c("p_size"))}, "CAST(sum(p_size) AS BIGINT) AS v")
_agg("sum_empty", "part", lambda: {"v": A.sum0(_c("p_size")), "n": A.count_all()}, "CAST(coalesce(sum(p_size) FILTER (WHERE p_size < 0), 0) AS BIGINT) AS v, count(*) FILTER (WHERE p_size < 0) AS n", lambda: _c("p_size") < 0)
_agg("sum_expr", "part", lambda: {"v": A.sum0(E.add(_c("p_size"), 5))}, "CAST(sum(p_size + 5) AS BIGINT) AS v")
_agg("min_max_int", "orders", lambda: {"lo": A.min_("o_custkey"), "hi": A.max_("o_custkey")}, "min(o_custkey) AS lo, max(o_custkey) AS hi")
_agg("min_max_string", "part", lambda: {"lo": A.min_("p_name"), "hi": A.max_("p_name")}, "min(p_name) AS lo, max(p_name) AS hi")
_agg("min_max_date", "lineitem", lambda: {"lo": A.min_(_c("l_shipdate").cast("date")).cast("string"), "hi": A.max_(_c("l_shipdate").cast("date")).cast("string")}, "CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS lo, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS hi")
_agg("min_max_timestamp", "events", lambda: {"lo": A.min_("ts"), "hi": A.max_("ts")}, "min(ts) AS lo, max(ts) AS hi")
_agg("int_avg", "part", lambda: {"a": A.int_avg(_c("p_size"), "int"), "b": A.int_avg(E.sub(F.lit(0), _c("p_partkey")), "bigint")}, "CAST(sum(CAST(p_size AS HUGEINT)) // count(*) AS INTEGER) AS a, CAST(sum(CAST(-p_partkey AS HUGEINT)) // count(*) AS BIGINT) AS b")
_agg("count_expr", "orders", lambda: {"n": A.count(_c("o_orderstatus"))}, "count(o_orderstatus) AS n")
_agg("count_distinct_int", "orders", lambda: {"n": A.count_distinct(_c("o_custkey"))}, "count(DISTINCT o_custkey) AS n")
_agg("count_distinct_string", "part", lambda: {"n": A.count_distinct(_c("p_name"))}, "count(DISTINCT p_name) AS n")
_agg("count_distinct_date", "orders", lambda: {"n": A.count_distinct(_c("o_orderdate"))}, "count(DISTINCT o_orderdate) AS n")
_agg("count_distinct_double", "lineitem", lambda: {"n": A.count_distinct(_c("l_extendedprice"))}, "count(DISTINCT l_extendedprice) AS n")
_add("group_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2")(lambda t: ops.group_agg(t("lineitem"), {k: _c(k) for k in ("l_returnflag", "l_linestatus")}, {"n": A.count_all(), "s": A.sum0(_c("l_linenumber"))}))
_add("group_expr", "SELECT strlen(p_name) AS l, count(*) AS n FROM part GROUP BY 1")(lambda t: ops.group_agg(t("part"), {"l": E.byte_length(_c("p_name"))}, {"n": A.count_all()}))

# Orders and limits.
_add("topk_asc", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")(lambda t: ops.top_rows(t("orders"), ["o_orderkey"], [_c("o_orderkey").asc()]))
_add("topk_desc", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 10")(lambda t: ops.top_rows(t("part"), ["p_partkey", "p_size"], [_c("p_size").desc(), _c("p_partkey")]))
_add("topk_multi", "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey DESC LIMIT 7")(lambda t: ops.top_rows(t("supplier"), ["s_suppkey", "s_nationkey"], [_c("s_nationkey").asc(), _c("s_suppkey").desc()], n=7))
_add("topk_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5 OFFSET 20")(lambda t: ops.top_rows(t("orders"), ["o_orderkey"], [_c("o_orderkey").desc()], n=5, offset=20))
_add("order_all", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name")(lambda t: ops.top_k(t("nation").select("n_nationkey", "n_name"), [_c("n_name")]))
_add("limit_offset", "SELECT count(*) AS n FROM (SELECT * FROM supplier LIMIT 7 OFFSET 2)")(lambda t: ops.global_agg(ops.limit(t("supplier"), 7, 2), {"n": A.count_all()}))
_add("limit_zero", "SELECT n_name FROM nation LIMIT 0")(lambda t: ops.limit(t("nation").select("n_name"), 0))


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.path(name))


def registered() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(_Tables(spark, sf_dir))) for name, (f, _) in _ALL.items()}


def registered_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
