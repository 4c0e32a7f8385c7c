"""Type names, schema files, and the schema of the web-analytics table ``hits``."""

from __future__ import annotations

import csv

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: Names of types in schema files, and what they are here.  Strings are bytes in UTF-8, timestamps have no time zone and whole seconds.
TYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "int128": T.DecimalType(38, 0),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
}
NAMES = {v: k for k, v in TYPES.items()}

# Names and types of the columns of hits, in their order.
_HITS = """
WatchID:int64 JavaEnable:int16 Title:string GoodEvent:int16 EventTime:timestamp EventDate:date CounterID:int64
ClientIP:int64 RegionID:int64 UserID:int64 CounterClass:int16 OS:int16 UserAgent:int16 URL:string
Referer:string IsRefresh:int16 RefererCategoryID:int16 RefererRegionID:int64 URLCategoryID:int16 URLRegionID:int64 ResolutionWidth:int16
ResolutionHeight:int16 ResolutionDepth:int16 FlashMajor:int16 FlashMinor:int16 FlashMinor2:string NetMajor:int16 NetMinor:int16
UserAgentMajor:int16 UserAgentMinor:string CookieEnable:int16 JavascriptEnable:int16 IsMobile:int16 MobilePhone:int16 MobilePhoneModel:string
Params:string IPNetworkID:int64 TraficSourceID:int16 SearchEngineID:int16 SearchPhrase:string AdvEngineID:int16 IsArtifical:int16
WindowClientWidth:int16 WindowClientHeight:int16 ClientTimeZone:int16 ClientEventTime:timestamp SilverlightVersion1:int16 SilverlightVersion2:int16 SilverlightVersion3:int64
SilverlightVersion4:int16 PageCharset:string CodeVersion:int64 IsLink:int16 IsDownload:int16 IsNotBounce:int16 FUniqID:int64
OriginalURL:string HID:int64 IsOldCounter:int16 IsEvent:int16 IsParameter:int16 DontCountHits:int16 WithHash:int16
HitColor:string LocalEventTime:timestamp Age:int16 Sex:int16 Income:int16 Interests:int16 Robotness:int16
RemoteIP:int64 WindowName:int32 OpenerName:int32 HistoryLength:int16 BrowserLanguage:string BrowserCountry:string SocialNetwork:string
SocialAction:string HTTPError:int16 SendTiming:int64 DNSTiming:int64 ConnectTiming:int64 ResponseStartTiming:int64 ResponseEndTiming:int64
FetchTiming:int64 SocialSourceNetworkID:int16 SocialSourcePage:string ParamPrice:int64 ParamOrderID:string ParamCurrency:string ParamCurrencyID:int16
OpenstatServiceName:string OpenstatCampaignID:string OpenstatAdID:string OpenstatSourceID:string UTMSource:string UTMMedium:string UTMCampaign:string
UTMContent:string UTMTerm:string FromTag:string HasGCLID:int16 RefererHash:int64 URLHash:int64 CLID:int64
"""


def make_schema(pairs: list[tuple[str, str]]) -> T.StructType:
    """From (name, type name); raises on a type name that doesn't exist or a column name that comes twice."""
    names = [n for n, _ in pairs]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"columns named twice: {sorted(twice)}")
    if unknown := {t for _, t in pairs if t not in TYPES}:
        raise ValueError(f"unknown types: {sorted(unknown)}")
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in pairs])


def hits_schema() -> T.StructType:
    return make_schema([tuple(x.split(":")) for x in _HITS.split()])


def load_schema(spark: SparkSession, path: str) -> T.StructType:
    """A schema file: CSV without header, with a name and a type name in each line."""
    rows = list(csv.reader(r.value for r in spark.read.text(path).collect()))
    if bad := [r for r in rows if len(r) != 2]:
        raise ValueError(f"a line of a schema file has two fields: {bad[0]}")
    return make_schema([tuple(r) for r in rows])
