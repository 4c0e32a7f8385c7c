"""WARC archives of pages, and their capture index by external merging.

Pages are written as WARC 1.1 files with a gzip member for each record.  Tasks put members together to files of about FILE_BYTES bytes, which Spark's
text writer takes as one value each, so any store that Spark writes to will do; the writer's line separator behind it is an empty member.
Of the pages with equal payloads the one with the smallest id is a response and the others are revisits of it, without a payload.
Read back, every file gives a run of captures sorted by (URL key, timestamp, id), with the place of the member in the file.  Runs are
stored, cut at the same range bounds, and a loser tree merges the pieces of all runs in each range of about RANGE_ROWS captures, so
the ranges one after the other are the ordered capture histories.

Defined results: a null payload is empty; a null URL has no target header and the key ''; line breaks in a URL are written as %0D and
%0A; pages with a null id are responses if no page with an id has their payload, else revisits; captures with equal keys and times are in the
order of ids as text, then of files; a very long payload is a record and, with those before it in its file, whole in the memory of one task; repeated ids are
repeated records; an empty table gives no record.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import base

#: Compressed bytes from which on a file is closed, and captures that a task merges; a file is read by one task.
FILE_BYTES, RANGE_ROWS = 1 << 23, 1 << 17
#: A gzip member without content, as characters of one byte each.
EMPTY = gzip.compress(b"", mtime=0).decode("latin-1")
#: The date of page 0 where pages have no date of their own; a page is dated as many seconds later as its id says.
EPOCH = 1_704_067_200
CAPTURES = "run string, seq long, url_key string, timestamp string, url string, page_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, offset long, length long"
NAMES = [c.split()[0] for c in CAPTURES.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits are four base32 digits."""
    sha = F.sha1(payload.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(sha, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*quads)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(value) the WARC record of each page."""
    payload = F.coalesce(base.quoted(payload_col), F.lit(""))
    rows = pages.select(base.quoted(id_col).alias("id"), base.quoted(url_col).alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    shared = rows.filter(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    shared = base.sized(shared.select(F.col("digest").alias("__digest"), F.col("n").alias("__n"), "first"))
    joined = rows.join(shared, (F.col("digest") == F.col("__digest")) & (F.col("n") == F.col("__n")), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce(base.id_key(rows, "id"), F.lit(0)), F.lit(1 << 31))
    # Without a zone, so that the session's doesn't matter.
    date = F.replace((F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)).cast("string"), F.lit(" "), F.lit("T"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.concat(date, F.lit("Z"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(head, block, F.lit("\r\n\r\n")).cast("binary").alias("value"))


def _members(batches):
    """(value) contents of files: a gzip member for each record."""
    parts, size = [], 0
    for batch in batches:
        for record in batch.column(0):
            packer = zlib.compressobj(wbits=31)
            parts.append(packer.compress(record.as_buffer()) + packer.flush())
            size += len(parts[-1])
            if size >= FILE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, **columns) -> None:
    """Write the pages as WARC files into a folder."""
    with base.small_batches(pages.sparkSession):
        files = records(pages, **columns).mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
        files.write.option("lineSep", EMPTY).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then port, path and query: a sort key that keeps hosts together."""
    rest = (url or "").split("#")[0]
    scheme, there, after = rest.partition("://")
    if not there:
        return rest.lower()
    cut = min((i for i in (after.find("/"), after.find("?")) if i >= 0), default=len(after))
    host, _, port = after[:cut].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (after[cut:] or "/")


def members(data):
    """Yields (offset, length, content) of each gzip member that isn't empty, one after the other."""
    at, data = 0, memoryview(data)
    while at < len(data):
        unpacker, end, parts = zlib.decompressobj(wbits=31), at, []
        while not unpacker.eof:
            if end >= len(data):
                raise ValueError(f"the member at byte {at} has no end")
            piece = data[end : end + (1 << 14)]
            parts.append(unpacker.decompress(piece))
            end += len(piece)
        end -= len(unpacker.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def parse(record: bytes) -> tuple[dict, bytes]:
    """(headers, block) of a record."""
    end = record.find(b"\r\n\r\n")
    first, *lines = record[:end].split(b"\r\n")
    if end < 0 or not first.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines)}
    stop = end + 4 + int(headers["content-length"])
    if record[stop:] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where it says")
    return headers, record[end + 4 : stop]


def payload(headers: dict, block: bytes) -> bytes | None:
    """The payload of a response; None for a revisit."""
    return None if headers["warc-type"] == "revisit" else block[block.index(b"\r\n\r\n") + 4 :]


def _captures(batches):
    """A sorted run of CAPTURES of each file."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            run = []
            for offset, length, record in members(content.as_buffer()):
                headers, block = parse(record)
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                body = payload(headers, block)
                if body is not None and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"the payload at byte {offset} of {path} has another digest")
                size = int(block[: block.index(b"\r\n\r\n")].rpartition(b"Content-Length: ")[2])
                page = headers["warc-record-id"][len("<urn:page:") : -1] or None
                refers = headers["warc-refers-to"][len("<urn:page:") : -1] if "warc-refers-to" in headers else None
                url = headers.get("warc-target-uri")
                run.append((url_key(url), headers["warc-date"], url, page, headers["warc-type"], digest, size, refers, offset, length))
            run.sort(key=lambda x: (x[0], x[1], x[3] or "", x[8]))
            rows = [(path, i, *x) for i, x in enumerate(run)]
            types = {"seq": pa.int64(), "payload_bytes": pa.int64(), "offset": pa.int64(), "length": pa.int64()}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(NAMES, zip(*rows))], names=NAMES)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """CAPTURES of all files of a folder, a sorted run each; payloads are checked against their digests."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_captures, CAPTURES)


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of a match, so the next row costs one match per level."""

    DONE = (1,)

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [self.DONE]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return self.DONE if row is None else (0, *row)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self.heads[self.losers[node]] < self.heads[i]:
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.heads[winner := self.losers[0]] is not self.DONE:
            yield self.heads[winner][1:]
            self.heads[winner] = self._next(winner)
            self._play(winner)


def _merge(batches):
    """All rows of a range, merged from its pieces of runs."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    pieces: dict = {}
    keys = zip(*(table.column(c).to_pylist() for c in ("run", "seq", "url_key", "timestamp", "page_id")))
    for i, (run, seq, key, timestamp, page) in enumerate(keys):
        pieces.setdefault(run, []).append((key, timestamp, page or "", run, seq, i))
    for piece in pieces.values():
        # A shuffle keeps the order of a run's rows but may bring its blocks in any order.
        piece.sort(key=lambda x: x[4])
    order = pa.array([x[-1] for x in LoserTree(list(pieces.values()))], pa.int64())
    yield from table.take(order).combine_chunks().to_batches(max_chunksize=8192)


def histories(captures: DataFrame) -> DataFrame:
    """Captures in the order of URL key, timestamp and id, over all partitions; captures: sorted runs, computed once."""
    n = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // RANGE_ROWS))
    return captures.repartitionByRange(n, "url_key", "timestamp", "page_id", "run", "seq").mapInArrow(_merge, CAPTURES)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = base.table(spark, sf_dir, "pages")
    path = base.scratch(spark, "warc")
    write(pages, path)
    captures = base.checkpoint(runs(spark, path))
    base.remove(spark, path)
    done = histories(captures)
    kind = base.kind(pages, "page_id")
    return done.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP6_SQL = r"""
WITH bodies AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first FROM bodies
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
