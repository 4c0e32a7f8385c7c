"""The 43 queries over the web-analytics table ``hits``, and a small table of its shape made from other tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import aggs as A
from gneiss.functions import exprs as E
from gneiss.functions import preds as P
from gneiss.operators.ops import global_agg, top_groups, top_k, top_rows

VIEW = """
SELECT e.event_id AS WatchID, e.user_id AS UserID,
 date_trunc('second', e.ts) AS EventTime, CAST(e.ts AS DATE) AS EventDate,
 CAST(e.user_id % 7 AS BIGINT) AS CounterID, CAST(e.user_id % 23 AS BIGINT) AS RegionID,
 CAST((e.event_id * 2654435761) % 100003 AS BIGINT) AS ClientIP,
 CASE WHEN e.event_id % 17 = 0 THEN '' ELSE p.url END AS URL,
 CASE WHEN e.event_id % 5 = 0 THEN '' ELSE r.url END AS Referer,
 CASE WHEN e.event_id % 4 = 0 THEN '' ELSE concat('Title ', e.event_type) END AS Title,
 CASE WHEN e.event_id % 3 = 0 THEN '' ELSE concat(e.event_type, ' ', CAST(e.event_id % 37 AS STRING)) END AS SearchPhrase,
 CAST(CASE WHEN e.event_id % 11 = 0 THEN e.event_id % 5 ELSE 0 END AS SMALLINT) AS AdvEngineID,
 CAST(CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE e.event_id % 4 END AS SMALLINT) AS SearchEngineID,
 CAST(e.event_id % 8 - 1 AS SMALLINT) AS TraficSourceID,
 CAST(800 + (e.event_id % 13) * 100 AS SMALLINT) AS ResolutionWidth,
 CAST(CASE WHEN e.event_id % 9 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS IsRefresh,
 CAST(CASE WHEN e.event_id % 10 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS DontCountHits,
 CAST(CASE WHEN e.event_id % 6 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS IsLink,
 CAST(CASE WHEN e.event_id % 19 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS IsDownload,
 CAST(e.user_id % 4 AS SMALLINT) AS MobilePhone,
 CASE WHEN e.user_id % 4 = 0 THEN '' ELSE concat('model-', CAST(e.user_id % 12 AS STRING)) END AS MobilePhoneModel,
 CAST(p.page_id * 1000003 AS BIGINT) AS URLHash, CAST(r.page_id * 7919 AS BIGINT) AS RefererHash,
 CAST(1000 + (e.event_id % 5) * 10 AS SMALLINT) AS WindowClientWidth,
 CAST(600 + (e.event_id % 3) * 10 AS SMALLINT) AS WindowClientHeight
FROM {events} e JOIN {pages} p ON p.page_id = e.event_id % 50 JOIN {pages} r ON r.page_id = (e.event_id * 7 + 3) % 50
"""


def hits_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the shape of hits (25 of its columns) from ``events`` and ``pages``."""
    df = spark.sql(VIEW, events=spark.read.parquet(f"{sf_dir}/events.parquet"), pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return df.withColumn("EventTime", F.col("EventTime").cast("timestamp_ntz"))


@dataclass(frozen=True)
class Constants:
    """What the queries compare with.  Fixed values: the defaults are those for the real table."""

    counter: int = 62
    month: tuple = ("2013-07-01", "2013-07-31")
    days: tuple = ("2013-07-14", "2013-07-15")
    title: str = "%Google%"
    not_url: str = "%.google.%"
    url: str = "%google%"
    having_28: int = 100_000
    having_29: int = 100_000
    offset_39: int = 1000
    offset_40: int = 1000
    offset_41: int = 100
    offset_42: int = 10_000
    offset_43: int = 1000
    referer_hash: int = 3594120000172545465
    url_hash: int = 2868770270353813622
    user: int = 435090932899640449


#: For the small table of hits_view.
SMALL = Constants(2, ("2024-01-01", "2024-01-31"), ("2024-01-14", "2024-01-15"), "%error%", "%.net/%", "%.net/%", 1000, 100, 5, 100, 0, 0, 10, 300922, 12000036, 7)
DOMAIN = (r"^https?://(?:www\.)?([^/]+)/.*$", r"\1")

_c = F.col


def _keys(*names: str) -> dict[str, Column]:
    return {n: _c(n) for n in names}


def _day(text: str) -> Column:
    return F.lit(dt.date.fromisoformat(text))


def _in_month(k: Constants, *more: Column) -> Column:
    return P.all_of(_c("CounterID") == k.counter, P.between(_c("EventDate"), *map(_day, k.month)), _c("IsRefresh") == 0, *more)


def _sums(hits: DataFrame, n: int) -> DataFrame:
    """SUM(ResolutionWidth + k) for k below n, from one sum and one count: sum + k * count."""
    one = hits.agg(A.sum0(_c("ResolutionWidth")).alias("s"), A.count_all().alias("c"))
    return one.select(*((_c("s") + k * _c("c")).alias(f"q30_sum_resolution_width_plus_{k}") for k in range(n)))


def _clients(hits: DataFrame) -> DataFrame:
    """Keys that follow from ClientIP are derived behind the aggregation, so only one is hashed."""
    top = top_groups(hits, _keys("ClientIP"), {"c": A.count_all()}, "c")
    return top.select("ClientIP", *(E.sub(_c("ClientIP"), k).alias(f"group_{k}") for k in (1, 2, 3)), "c")


def _engine(hits: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    aggs = {"c": A.count_all(), "sum_is_refresh": A.sum0(_c("IsRefresh")), "avg_resolution_width": A.int_avg(_c("ResolutionWidth"), "smallint")}
    return top_groups(hits, _keys(*keys), aggs, "c", where)


def _count(name: str):
    return {name: A.count_all()}


def queries(k: Constants) -> dict[int, object]:
    """Functions from hits to the result of each query, by number."""
    phrase, users = P.not_empty(_c("SearchPhrase")), {"u": A.count_distinct(_c("UserID"))}
    url = lambda: P.like(_c("URL"), k.url)
    views = "PageViews"
    source = E.case_when([((_c("SearchEngineID") == 0) & (_c("AdvEngineID") == 0), _c("Referer"))], F.lit(""))
    return {
        1: lambda h: global_agg(h, _count("q1")),
        2: lambda h: global_agg(h.filter(_c("AdvEngineID") != 0), _count("q2")),
        3: lambda h: global_agg(h, {"q3_sum_adv_engine_id": A.sum0(_c("AdvEngineID")), "q3_count": A.count_all(), "q3_avg_resolution_width": A.int_avg(_c("ResolutionWidth"), "smallint")}),
        4: lambda h: global_agg(h, {"q4": A.int_avg(_c("UserID"), "bigint")}),
        5: lambda h: global_agg(h, {"q5": A.count_distinct(_c("UserID"))}),
        6: lambda h: global_agg(h, {"q6": A.count_distinct(_c("SearchPhrase"))}),
        7: lambda h: global_agg(h, {"q7_min_event_date": A.min_("EventDate"), "q7_max_event_date": A.max_("EventDate")}),
        8: lambda h: top_groups(h, _keys("AdvEngineID"), _count("c"), "c", _c("AdvEngineID") != 0, n=None),
        9: lambda h: top_groups(h, _keys("RegionID"), users, "u"),
        10: lambda h: top_groups(h, _keys("RegionID"), {"sum_adv_engine_id": A.sum0(_c("AdvEngineID")), "c": A.count_all(), "avg_resolution_width": A.int_avg(_c("ResolutionWidth"), "smallint"), "uniq_user_id": A.count_distinct(_c("UserID"))}, "c"),
        11: lambda h: top_groups(h, _keys("MobilePhoneModel"), users, "u", P.not_empty(_c("MobilePhoneModel"))),
        12: lambda h: top_groups(h, _keys("MobilePhone", "MobilePhoneModel"), users, "u", P.not_empty(_c("MobilePhoneModel"))),
        13: lambda h: top_groups(h, _keys("SearchPhrase"), _count("c"), "c", phrase),
        14: lambda h: top_groups(h, _keys("SearchPhrase"), users, "u", phrase),
        15: lambda h: top_groups(h, _keys("SearchEngineID", "SearchPhrase"), _count("c"), "c", phrase),
        16: lambda h: top_groups(h, _keys("UserID"), _count("c"), "c"),
        17: lambda h: top_groups(h, _keys("UserID", "SearchPhrase"), _count("c"), "c"),
        # No order is asked for; the keys' order makes it the same on each run.
        18: lambda h: top_k(h.groupBy("UserID", "SearchPhrase").agg(A.count_all().alias("c")), [_c("UserID"), _c("SearchPhrase")], 10),
        19: lambda h: top_groups(h, _keys("UserID") | {"group_1": E.minute(_c("EventTime"))} | _keys("SearchPhrase"), _count("c"), "c"),
        20: lambda h: h.filter(_c("UserID") == k.user).select("UserID"),
        21: lambda h: global_agg(h.filter(url()), _count("q21")),
        22: lambda h: top_groups(h, _keys("SearchPhrase"), {"min_url": A.min_("URL"), "c": A.count_all()}, "c", url() & phrase),
        23: lambda h: top_groups(h, _keys("SearchPhrase"), {"min_url": A.min_("URL"), "min_title": A.min_("Title"), "c": A.count_all()} | users, "c", P.like(_c("Title"), k.title) & P.not_like(_c("URL"), k.not_url) & phrase),
        24: lambda h: top_rows(h, h.columns, [_c("EventTime"), _c("WatchID")], url()),
        25: lambda h: top_rows(h, ["SearchPhrase"], [_c("EventTime"), _c("WatchID")], phrase),
        26: lambda h: top_rows(h, ["SearchPhrase"], [_c("SearchPhrase")], phrase),
        27: lambda h: top_rows(h, ["SearchPhrase"], [_c("EventTime"), _c("SearchPhrase")], phrase),
        28: lambda h: top_groups(h, _keys("CounterID"), {"l": A.int_avg(E.byte_length(_c("URL")), "bigint"), "c": A.count_all()}, "l", P.not_empty(_c("URL")), _c("c") > k.having_28, 25),
        29: lambda h: top_groups(h, {"k": E.regexp_replace(_c("Referer"), *DOMAIN)}, {"l": A.int_avg(E.byte_length(_c("Referer")), "bigint"), "c": A.count_all(), "min_referer": A.min_("Referer")}, "l", P.not_empty(_c("Referer")), _c("c") > k.having_29, 25),
        30: lambda h: _sums(h, 90),
        31: lambda h: _engine(h, "SearchEngineID", "ClientIP", where=phrase),
        32: lambda h: _engine(h, "WatchID", "ClientIP", where=phrase),
        33: lambda h: _engine(h, "WatchID", "ClientIP"),
        34: lambda h: top_groups(h, _keys("URL"), _count("c"), "c"),
        35: lambda h: top_groups(h, {"group_0": F.lit(1).cast("bigint")} | _keys("URL"), _count("c"), "c"),
        36: _clients,
        37: lambda h: top_groups(h, _keys("URL"), _count(views), views, _in_month(k, _c("DontCountHits") == 0, P.not_empty(_c("URL")))),
        38: lambda h: top_groups(h, _keys("Title"), _count(views), views, _in_month(k, _c("DontCountHits") == 0, P.not_empty(_c("Title")))),
        39: lambda h: top_groups(h, _keys("URL"), _count(views), views, _in_month(k, _c("IsLink") != 0, _c("IsDownload") == 0), offset=k.offset_39),
        40: lambda h: top_groups(h, _keys("TraficSourceID", "SearchEngineID", "AdvEngineID") | {"group_3": source} | _keys("URL"), _count(views), views, _in_month(k), offset=k.offset_40),
        41: lambda h: top_groups(h, _keys("URLHash", "EventDate"), _count(views), views, _in_month(k, P.in_(_c("TraficSourceID"), [-1, 6]), _c("RefererHash") == k.referer_hash), offset=k.offset_41),
        42: lambda h: top_groups(h, _keys("WindowClientWidth", "WindowClientHeight"), _count(views), views, _in_month(k, _c("DontCountHits") == 0, _c("URLHash") == k.url_hash), offset=k.offset_42),
        43: lambda h: top_k(h.filter(P.all_of(_c("CounterID") == k.counter, P.between(_c("EventDate"), *map(_day, k.days)), _c("IsRefresh") == 0, _c("DontCountHits") == 0)).groupBy(E.trunc_minute(_c("EventTime")).alias("M")).agg(A.count_all().alias(views)), [_c("M")], 10, k.offset_43),
    }


def sql(k: Constants) -> dict[int, str]:
    """The same queries in DuckDB's SQL, over hits."""
    avg = lambda x, kind: f"CAST(sum(CAST({x} AS HUGEINT)) // count(*) AS {kind})"
    month = f"CounterID = {k.counter} AND EventDate BETWEEN DATE '{k.month[0]}' AND DATE '{k.month[1]}' AND IsRefresh = 0"
    big = lambda x: f"CAST(coalesce(sum({x}), 0) AS BIGINT)"

    def top(keys: str, aggs: str, by: str, where: str = "true", having: str = "true", n: str = "LIMIT 10") -> str:
        names = [x.split(" AS ")[-1].strip() for x in keys.split(", ")]
        order = ", ".join(x for x in names if x != by)
        return f"SELECT {keys}, {aggs} FROM hits WHERE {where} GROUP BY {', '.join(str(i + 1) for i in range(len(names)))} HAVING {having} ORDER BY {by} DESC, {order} {n}"

    users, phrase, url = "count(DISTINCT UserID) AS u", "SearchPhrase <> ''", f"URL LIKE '{k.url}'"
    engine = f"count(*) AS c, {big('IsRefresh')} AS sum_is_refresh, {avg('ResolutionWidth', 'SMALLINT')} AS avg_resolution_width"
    views = "count(*) AS PageViews"
    return {
        1: "SELECT count(*) AS q1 FROM hits",
        2: "SELECT count(*) AS q2 FROM hits WHERE AdvEngineID <> 0",
        3: f"SELECT {big('AdvEngineID')} AS q3_sum_adv_engine_id, count(*) AS q3_count, {avg('ResolutionWidth', 'SMALLINT')} AS q3_avg_resolution_width FROM hits",
        4: f"SELECT {avg('UserID', 'BIGINT')} AS q4 FROM hits",
        5: "SELECT count(DISTINCT UserID) AS q5 FROM hits",
        6: "SELECT count(DISTINCT SearchPhrase) AS q6 FROM hits",
        7: "SELECT min(EventDate) AS q7_min_event_date, max(EventDate) AS q7_max_event_date FROM hits",
        8: top("AdvEngineID", "count(*) AS c", "c", "AdvEngineID <> 0", n=""),
        9: top("RegionID", users, "u"),
        10: top("RegionID", f"{big('AdvEngineID')} AS sum_adv_engine_id, count(*) AS c, {avg('ResolutionWidth', 'SMALLINT')} AS avg_resolution_width, count(DISTINCT UserID) AS uniq_user_id", "c"),
        11: top("MobilePhoneModel", users, "u", "MobilePhoneModel <> ''"),
        12: top("MobilePhone, MobilePhoneModel", users, "u", "MobilePhoneModel <> ''"),
        13: top("SearchPhrase", "count(*) AS c", "c", phrase),
        14: top("SearchPhrase", users, "u", phrase),
        15: top("SearchEngineID, SearchPhrase", "count(*) AS c", "c", phrase),
        16: top("UserID", "count(*) AS c", "c"),
        17: top("UserID, SearchPhrase", "count(*) AS c", "c"),
        18: "SELECT UserID, SearchPhrase, count(*) AS c FROM hits GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10",
        19: top("UserID, CAST(extract(minute FROM EventTime) AS TINYINT) AS group_1, SearchPhrase", "count(*) AS c", "c"),
        20: f"SELECT UserID FROM hits WHERE UserID = {k.user}",
        21: f"SELECT count(*) AS q21 FROM hits WHERE {url}",
        22: top("SearchPhrase", "min(URL) AS min_url, count(*) AS c", "c", f"{url} AND {phrase}"),
        23: top("SearchPhrase", f"min(URL) AS min_url, min(Title) AS min_title, count(*) AS c, {users}", "c", f"Title LIKE '{k.title}' AND URL NOT LIKE '{k.not_url}' AND {phrase}"),
        24: f"SELECT * FROM hits WHERE {url} ORDER BY EventTime, WatchID LIMIT 10",
        25: f"SELECT SearchPhrase FROM hits WHERE {phrase} ORDER BY EventTime, WatchID LIMIT 10",
        26: f"SELECT SearchPhrase FROM hits WHERE {phrase} ORDER BY SearchPhrase LIMIT 10",
        27: f"SELECT SearchPhrase FROM hits WHERE {phrase} ORDER BY EventTime, SearchPhrase LIMIT 10",
        28: top("CounterID", f"{avg('strlen(URL)', 'BIGINT')} AS l, count(*) AS c", "l", "URL <> ''", f"count(*) > {k.having_28}", "LIMIT 25"),
        29: f"SELECT regexp_replace(Referer, '{DOMAIN[0]}', '{DOMAIN[1]}', 'g') AS k, {avg('strlen(Referer)', 'BIGINT')} AS l, count(*) AS c, min(Referer) AS min_referer FROM hits WHERE Referer <> '' GROUP BY 1 HAVING count(*) > {k.having_29} ORDER BY l DESC, k LIMIT 25",
        30: "SELECT " + ", ".join(f"CAST(sum(CAST(ResolutionWidth AS BIGINT) + {i}) AS BIGINT) AS q30_sum_resolution_width_plus_{i}" for i in range(90)) + " FROM hits",
        31: top("SearchEngineID, ClientIP", engine, "c", phrase),
        32: top("WatchID, ClientIP", engine, "c", phrase),
        33: top("WatchID, ClientIP", engine, "c"),
        34: top("URL", "count(*) AS c", "c"),
        35: top("CAST(1 AS BIGINT) AS group_0, URL", "count(*) AS c", "c"),
        36: top("ClientIP, ClientIP - 1 AS group_1, ClientIP - 2 AS group_2, ClientIP - 3 AS group_3", "count(*) AS c", "c"),
        37: top("URL", views, "PageViews", f"{month} AND DontCountHits = 0 AND URL <> ''"),
        38: top("Title", views, "PageViews", f"{month} AND DontCountHits = 0 AND Title <> ''"),
        39: top("URL", views, "PageViews", f"{month} AND IsLink <> 0 AND IsDownload = 0", n=f"LIMIT 10 OFFSET {k.offset_39}"),
        40: top("TraficSourceID, SearchEngineID, AdvEngineID, CASE WHEN SearchEngineID = 0 AND AdvEngineID = 0 THEN Referer ELSE '' END AS group_3, URL", views, "PageViews", month, n=f"LIMIT 10 OFFSET {k.offset_40}"),
        41: top("URLHash, EventDate", views, "PageViews", f"{month} AND TraficSourceID IN (-1, 6) AND RefererHash = {k.referer_hash}", n=f"LIMIT 10 OFFSET {k.offset_41}"),
        42: top("WindowClientWidth, WindowClientHeight", views, "PageViews", f"{month} AND DontCountHits = 0 AND URLHash = {k.url_hash}", n=f"LIMIT 10 OFFSET {k.offset_42}"),
        43: f"SELECT date_trunc('minute', EventTime) AS M, {views} FROM hits WHERE CounterID = {k.counter} AND EventDate BETWEEN DATE '{k.days[0]}' AND DATE '{k.days[1]}' AND IsRefresh = 0 AND DontCountHits = 0 GROUP BY 1 ORDER BY M LIMIT 10 OFFSET {k.offset_43}",
    }


def registered() -> dict:
    """Over the small table: functions of (spark, sf_dir) by name."""
    return {f"hits_q{n:02d}": (lambda spark, sf_dir, n=n: queries(SMALL)[n](hits_view(spark, sf_dir))) for n in sql(SMALL)}


def registered_sql() -> dict[str, str]:
    view = VIEW.format(events="events", pages="pages")
    return {f"hits_q{n:02d}": f"WITH hits AS ({view}) {q}" for n, q in sql(SMALL).items()}
