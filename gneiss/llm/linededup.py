"""Line deduplication across documents.

Lines are hashed (128 bits), dealt out by ranges of (hash, document) and sorted by
(hash, document, position) inside each range.  One stream over a range sees the
occurrences of a line one after the other, so it holds back only those of the first
``min_docs`` - 1 documents.  As documents are part of the range bounds, a line that a
third of all documents hold spans many ranges; the stream reports the number of
documents of the first and the last hash of its range, and the sums of these
reports (two at most per range) decide.  The result is a compressed bitmap of
kept lines per document, not text; :func:`apply_bitmaps` makes text of it.

With ``keep_first`` a line that would go stays where it occurs first, by (document, text hash, position).  A range leaves
out the first occurrence of a hash that begins in it; as its first hash may have begun in an earlier range,
reports also have the first occurrence they know, and the least of these is put back.

Defined results: ids that aren't integers are known by their 64-bit hash; a null or empty text is one empty line; a very long text
is split whole, its lines are rows as any others; a line that strips to
nothing is never dropped (``min_chars`` of 0 counts as 1); repeated rows with the same id and
text are one document, rows with the same id and other texts are two; an empty table gives
an empty result.  Only the two named columns are read, so other columns never clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import base, kernels

COLUMNS = ["h1", "h2", "doc", "text_hash", "pos", "n_docs"]
SCHEMA = "h1 long, h2 long, doc long, text_hash long, pos int, n_docs long"


#: Words that a long passage has more than; the lowest bit of h2 tells where passages have a bound of their own.
PASSAGE = 50


def _split(min_chars: int, passages: bool = False):
    """(h1, h2, doc, text_hash, pos) of every line whose key has min_chars code points or more."""
    least = max(1, min_chars)

    def run(batches):
        for whole in batches:
            for batch in kernels.slices(whole):
                h1, h2, at, pos = [], [], [], []
                for i, text in enumerate(kernels.texts(batch.column(2))):
                    for p, line in enumerate(text.split(b"\n")):
                        key = line.strip(b" \t\n\x0b\x0c\r").lower()
                        if key and (least == 1 or len(key.decode("utf-8", "replace")) >= least):
                            h = xxhash.xxh3_128_intdigest(key)
                            if passages:
                                h = h >> 1 << 1 | (len(key.split()) > PASSAGE)
                            h1.append(h >> 64)
                            h2.append(h & 0xFFFFFFFFFFFFFFFF)
                            at.append(i)
                            pos.append(p)
                at = pa.array(at, pa.int32())
                hashes = [pa.array(np.array(h, dtype=np.uint64).view(np.int64)) for h in (h1, h2)]
                yield pa.RecordBatch.from_arrays([*hashes, batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32())], names=COLUMNS[:5])

    return run


def lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, passages: bool = False) -> DataFrame:
    text = F.coalesce(base.quoted(text_col), F.lit(""))
    rows = docs.select(base.id_key(docs, id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(_split(min_chars, passages), "h1 long, h2 long, doc long, text_hash long, pos int")


def _batch(rows: np.ndarray) -> pa.RecordBatch:
    """rows: (h1, h2, doc, text_hash, pos, whether doc is null)"""
    arrays = [pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2], mask=rows[:, 5].astype(bool)), pa.array(rows[:, 3]), pa.array(rows[:, 4].astype(np.int32)), pa.nulls(len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=COLUMNS)


def stream(min_docs: int, keep_first: bool = False, passage_docs: int | None = None):
    """Over rows sorted by (h1, h2, doc, text_hash, pos): the rows of hashes with min_docs documents or more; all rows of
    the first and the last hash, which may go on in other ranges; and for these two a report with n_docs, the document of
    the first occurrence, and -1 - its position.  keep_first: without the first occurrence of hashes that begin here.
    passage_docs: the bound of hashes with an odd h2, if they have their own."""
    passage_docs = min_docs if passage_docs is None else passage_docs

    def report(key, docs, least):
        doc = None if least[3] else int(least[0])
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([doc], pa.int64()), pa.array([int(least[1])], pa.int64()), pa.array([-1 - int(least[2])], pa.int32()), pa.array([docs], pa.int64())], names=COLUMNS)

    def run(batches):
        key, last, docs, first, waiting, least = None, None, 0, True, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).fill_null(0).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy().astype(np.int64), null.astype(np.int64)], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1])
            ends = np.append(starts[1:], len(rows))
            # Only the first and the last hash of a batch can have rows in other batches.
            wanted = ends - starts >= np.where(rows[starts, 1] & 1, passage_docs, min_docs)
            wanted[0] = wanted[-1] = True
            out = []
            for lo, hi in zip(starts[wanted].tolist(), ends[wanted].tolist()):
                part = rows[lo:hi]
                if (k := (int(part[0, 0]), int(part[0, 1]))) != key:
                    if key is not None and first:
                        yield report(key, docs, least)
                        first = False
                    key, last, docs, waiting, least = k, None, 0, [], part[0, 2:]
                who = part[:, [2, 3, 5]]
                docs += int((who[1:] != who[:-1]).any(axis=1).sum()) + (last is None or bool((who[0] != last).any()))
                last = who[-1]
                # Rows that repeat an id and a text are one document, so its first line can be there several times.
                waiting.append(part if first or not keep_first else part[(part[:, 2:] != least).any(axis=1)])
                if first or docs >= (passage_docs if k[1] & 1 else min_docs):
                    out += waiting
                    waiting = []
            if out:
                yield _batch(np.concatenate(out))
        if key is not None:
            if waiting:
                yield _batch(np.concatenate(waiting))
            yield report(key, docs, least)

    return run


def _pack(batches):
    for batch in batches:
        maps = []
        for positions in batch.column("positions").to_pylist():
            bits = np.ones(max(positions) + 1, dtype=np.uint8)
            bits[positions] = 0
            maps.append(zlib.compress(len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_hash"), pa.array(maps, pa.binary())], names=["doc", "text_hash", "keep"])


def unpack(keep: bytes) -> np.ndarray:
    """A bitmap's flags, true for kept lines; the lines behind its end are kept."""
    raw = zlib.decompress(keep)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, passage_docs: int | None = None) -> DataFrame:
    """(doc, text_hash, keep) of each document that loses lines; text_hash is xxhash64 of its text.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.  Keys of min_chars code points or more
    that min_docs documents or more hold lose all their lines, or with keep_first all but the first by (document, text hash, position).
    passage_docs: another bound for keys of more than PASSAGE words.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc", "text_hash"]
    dealt = lines(docs, id_col, text_col, min_chars, passage_docs is not None).repartitionByRange(n, *order).sortWithinPartitions(*order, "pos")
    found = base.checkpoint(dealt.mapInArrow(stream(min_docs, keep_first, passage_docs), SCHEMA))
    # Two reports at most for each of n ranges: a bounded table.
    reports = found.filter("pos < 0").groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.min(F.struct("doc", "text_hash", (-1 - F.col("pos")).alias("pos"))).alias("first"))
    gone = found.filter("pos >= 0").join(F.broadcast(reports.filter(F.col("n") < (F.lit(min_docs) if passage_docs is None else F.when(F.col("h2").bitwiseAND(1) == 1, passage_docs).otherwise(min_docs))).select("h1", "h2")), ["h1", "h2"], "left_anti")
    if keep_first:
        at = reports.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first")
        same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("pos") == F.col("first.pos"))
        gone = gone.join(F.broadcast(at), same, "left_anti")
    return gone.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("positions")).mapInArrow(_pack, "doc long, text_hash long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "lines") -> DataFrame:
    """docs with a struct column named by ``into`` (n_lines, n_dropped, kept): kept is the text of the kept lines, '' for a null text.

    Bitmaps are broadcast below a checked size, and texts stay where they are; beyond, both sides are shuffled."""

    @F.pandas_udf("n_dropped long, kept string")
    def cut(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
        dropped, kept = [], []
        for t, k in zip(text, keep):
            if k is None:
                dropped.append(0)
                kept.append(None)
                continue
            parts, flags = t.split("\n"), unpack(k)
            kept.append("\n".join([*(p for p, f in zip(parts, flags) if f), *parts[len(flags) :]]))
            dropped.append(int(len(flags) - flags.sum()))
        return pd.DataFrame({"n_dropped": dropped, "kept": kept})

    doc, text_hash, keep, done_ = base.unused(docs.columns, "__doc", "__hash", "__keep", "__cut")
    side = base.sized(bitmaps.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("keep").alias(keep)))
    text = F.coalesce(base.quoted(text_col), F.lit(""))
    joined = docs.join(side, base.id_key(docs, id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(text_hash)), "left")
    done = joined.withColumn(done_, cut(F.when(F.col(keep).isNotNull(), text), F.col(keep)))
    struct = F.struct(
        (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.col(f"{done_}.n_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.col(f"{done_}.kept"), text).alias("kept"),
    )
    return done.select(*(base.quoted(c) for c in docs.columns), struct.alias(into))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_bitmaps(docs, keep_bitmaps(docs))
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, p AS pos, string_split(coalesce(text, ''), chr(10))[p] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), gone AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM gone) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
