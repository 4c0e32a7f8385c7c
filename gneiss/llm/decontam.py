"""Benchmark decontamination with a positional inverted index.

The index is cut by document: a shard holds all words of some documents as postings (term, positions), sorted by a 64-bit hash of
the term, and is stored once in the shared folder.  A query takes the windows of the benchmark
items; in each shard a window's lists are intersected, shifted by their offsets, from its
rarest term on, so most windows end with the first list or two.  Matches are exact phrases, or with ``slop`` such of
proximity: some start t and rising positions of the window's words in one document, the k-th at most ``slop`` away from t + k.  Each start
matches at the leftmost such positions; its span goes from the first to the last.  Nothing is shuffled but the matches themselves.

The benchmark is the query set.  Items are cut into pieces of PIECE words that overlap by all but one word of a window, and sent to the
workers in blocks of about BLOCK_CHARS characters; each block is a pass over the index, not over the documents.

Defined results: a null text has no words; an item without words matches nothing; an item with a null id marks words but is not listed; a very
long document is a shard of its own, whole; repeated documents have equal results each; repeated item ids count once, repeated items are one;
empty tables give no matches.  Ids of documents keep their type, item ids are strings.  Only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import base, kernels

#: Characters of benchmark text that are sent to the workers at once, and words of a piece of an item.
BLOCK_CHARS, PIECE = 1 << 23, 1 << 16
#: Words after which a shard is closed.
SHARD_WORDS = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
INDEX = "docs array<{0}>, hashes array<long>, n_words array<long>, begins array<long>, terms binary, starts binary, places binary"
MATCHES = "doc {0}, text_hash long, item string, spans array<long>"


def tokens(text: bytes) -> list[bytes]:
    """Runs of digits, a-z (after lower-casing A-Z) and all non-ASCII characters."""
    return WORD.findall(text.lower())


def hashes_of(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _index(gap: int):
    """Shards of postings; between two documents lie ``gap`` unused positions, so no match reaches over."""

    def shard(kind, docs, hashes, counts, known, ids):
        begins = np.concatenate([[0], np.cumsum(np.array(counts[:-1], dtype=np.int64) + gap)]).astype(np.int64)
        place = np.concatenate([np.arange(n, dtype=np.int64) + b for n, b in zip(counts, begins)])
        keys = hashes_of(known)
        terms, rank = np.unique(keys, return_inverse=True)
        term = rank.astype(np.int32)[np.concatenate(ids)]
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(terms))).astype(np.int64)
        short = begins[-1] + counts[-1] < 2**31
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (terms, starts, place[order].astype(np.int32 if short else np.int64))]
        lists = [pa.array([x], pa.list_(t)) for x, t in ((docs, kind), (hashes, pa.int64()), (counts, pa.int64()), (begins.tolist(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*lists, *binary], names=[c.split()[0] for c in INDEX.split(", ")])

    def run(batches):
        kind, docs, hashes, counts, known, ids, size = None, [], [], [], {}, [], 0
        for whole in batches:
            kind = whole.column(0).type
            for batch in kernels.slices(whole, 128):
                for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), kernels.texts(batch.column(2))):
                    words = tokens(text)
                    for w in set(words):
                        known.setdefault(w, len(known))
                    ids.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
                    docs.append(doc)
                    hashes.append(text_hash)
                    counts.append(len(words))
                    size += len(words)
                    if size >= SHARD_WORDS:
                        yield shard(kind, docs, hashes, counts, known, ids)
                        docs, hashes, counts, known, ids, size = [], [], [], {}, [], 0
        if docs:
            yield shard(kind, docs, hashes, counts, known, ids)

    return run


def intersect(lists: list[np.ndarray], order, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) positions of the matches of a window whose k-th word is at the positions lists[k], one for each start; order: from
    the rarest list on."""
    rarest, *rest = order
    starts = lists[rarest].astype(np.int64) - rarest
    if slop:
        starts = np.unique((starts[:, None] + np.arange(-slop, slop + 1)).ravel())
    for k in rest:
        at = np.searchsorted(lists[k], starts + k - slop)
        there = lists[k][np.minimum(at, len(lists[k]) - 1)]
        starts = starts[(at < len(lists[k])) & (there <= starts + k + slop)]
        if not len(starts):
            break
    if not slop or not len(starts):
        return starts, starts + len(lists)
    first, last = None, np.full(len(starts), np.iinfo(np.int64).min)
    for k, places in enumerate(lists):
        at = np.searchsorted(places, np.maximum(starts + k - slop, last + 1))
        last = places[np.minimum(at, len(places) - 1)].astype(np.int64)
        good = (at < len(places)) & (last <= starts + k + slop)
        starts, last, first = starts[good], last[good], last[good] if first is None else first[good]
    return first, last + 1


def _search(query, slop: int):
    def run(batches):
        vocabulary, items, groups = query.value
        for batch in batches:
            for row in range(batch.num_rows):
                docs, hashes, counts, begins = (batch.column(k)[row].values for k in range(4))
                terms, starts = np.frombuffer(batch.column(4)[row].as_py(), np.uint64), np.frombuffer(batch.column(5)[row].as_py(), np.int64)
                begins = begins.to_numpy()
                short = begins[-1] + counts[-1].as_py() < 2**31
                places = np.frombuffer(batch.column(6)[row].as_py(), np.int32 if short else np.int64)
                if not len(terms):
                    continue
                ends = np.append(starts[1:], len(places))
                at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                seen = terms[at] == vocabulary
                first, count = np.where(seen, starts[at], 0), np.where(seen, ends[at] - starts[at], 0)
                found = []
                for windows, owner in groups:
                    sizes = count[windows]
                    live = np.flatnonzero(sizes.min(axis=1) > 0)
                    for w, order in zip(live.tolist(), np.argsort(sizes[live], axis=1, kind="stable").tolist()):
                        lo, hi = intersect([places[first[t] : first[t] + count[t]] for t in windows[w]], order, slop)
                        if len(lo):
                            found.append((np.full(len(lo), owner[w]), lo, hi))
                if found:
                    owner, lo, hi = (np.concatenate(x) for x in zip(*found))
                    doc = np.searchsorted(begins, lo, "right") - 1
                    yield _spans(items, docs, hashes, doc, owner, lo - begins[doc], hi - begins[doc])

    return run


def _spans(items, docs, hashes, doc, owner, lo, hi) -> pa.RecordBatch:
    """A row for each document and item, with its joined spans (start, end, start, end ...) in words."""
    order = np.lexsort((lo, owner, doc))
    doc, owner, lo, hi = doc[order], owner[order], lo[order], hi[order]
    group = np.concatenate([[True], (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])])
    # The largest end so far within a group: groups are told apart by more than any end.
    shift = (np.cumsum(group) - 1) * (int(hi.max()) + 1)
    hi = np.maximum.accumulate(hi + shift) - shift
    span = group | np.concatenate([[True], lo[1:] > hi[:-1]])
    begins, ends = lo[span], hi[np.append(np.flatnonzero(span)[1:] - 1, len(hi) - 1)]
    flat = np.stack([begins, ends], axis=1).ravel()
    offsets = np.append(2 * np.flatnonzero(group[span]), len(flat))
    at = pa.array(doc[group])
    return pa.RecordBatch.from_arrays([docs.take(at), hashes.take(at), pa.array([items[i] for i in owner[group]], pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))], names=["doc", "text_hash", "item", "spans"])


def _pieces(window: int):
    """(item, text, chars): the words of items in pieces; neighbours share window - 1 words, so each window is in one piece at least."""

    def run(batches):
        for whole in batches:
            for batch in kernels.slices(whole, 64):
                items, parts = [], []
                for item, text in zip(batch.column(0).to_pylist(), kernels.texts(batch.column(1))):
                    words = tokens(text)
                    for lo in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
                        items.append(item)
                        parts.append(b" ".join(words[lo : lo + PIECE + window - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(parts, pa.binary()), pa.array(list(map(len, parts)), pa.int64())], names=["item", "words", "chars"])

    return run


def query_windows(items: list[tuple], window: int) -> tuple[np.ndarray, list, list]:
    """Of some (id, words joined by spaces): the hashes of the terms, the ids, and [(windows as rows of terms, their items)] by length."""
    vocabulary: dict[bytes, int] = {}
    by_width: dict[int, list] = {}
    for i, (_, text) in enumerate(items):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in bytes(text).split()], dtype=np.int32)
        if len(ids):
            rows = np.unique(sliding_window_view(ids, min(window, len(ids))), axis=0)
            by_width.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), i)))
    groups = [(np.concatenate([r for r, _ in x]), np.concatenate([o for _, o in x])) for x in by_width.values()]
    return hashes_of(vocabulary), [k for k, _ in items], groups


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 10) -> DataFrame:
    """The stored index of all documents; ``gap``: unused positions between two, at least 2 * slop + 1 of the queries to come."""
    text = F.coalesce(base.quoted(text_col), F.lit(""))
    rows = docs.select(base.quoted(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return base.checkpoint(rows.mapInArrow(_index(gap), INDEX.format(base.kind(docs, id_col))))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, matches): (doc, text_hash, n_words) of every row, and MATCHES of rows with windows of ``window`` words of an
    item (all its words, if fewer).  text_hash is xxhash64 of the text, a null one as empty."""
    sc, kind = docs.sparkSession.sparkContext, base.kind(docs, id_col)
    shards = index(docs, id_col, text_col, window + 2 * slop)
    documents = shards.select(F.explode(F.arrays_zip("docs", "hashes", "n_words")).alias("d")).select(F.col("d.docs").alias("doc"), F.col("d.hashes").alias("text_hash"), F.col("d.n_words").alias("n_words"))
    pieces = items.select(base.quoted(item_col).cast("string").alias("item"), base.quoted(item_text_col).alias("text")).mapInArrow(_pieces(window), "item string, words binary, chars long")
    pieces = base.checkpoint(pieces.distinct())
    blocks = max(1, -(-(pieces.select(F.sum("chars")).first()[0] or 0) // BLOCK_CHARS))
    matches = None
    for block in range(blocks):
        # About BLOCK_CHARS characters.
        part = pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).select("item", "words").orderBy("item", "words")
        found = shards.mapInArrow(_search(sc.broadcast(query_windows([tuple(r) for r in part.collect()], window)), slop), MATCHES.format(kind))
        matches = found if matches is None else matches.unionByName(found)
    return documents, matches


def covered(spans: Column) -> Column:
    """Words that some (start, end) spans, sorted by start, cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["s"], a["end"]))).alias("n"), F.greatest(a["end"], s["e"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def per_document(matches: DataFrame) -> DataFrame:
    """(doc, text_hash, n_hit, items) of documents with a match."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("s"), F.get("spans", i + 1).alias("e")))
    # Repeated rows bring the same spans again.
    by_item = matches.groupBy("doc", "text_hash", "item", "spans").agg(F.lit(1)).select("doc", "text_hash", "item", pairs.alias("pairs"))
    grouped = by_item.groupBy("doc", "text_hash").agg(F.collect_list("pairs").alias("pairs"), F.collect_set("item").alias("items"))
    return grouped.select("doc", "text_hash", covered(F.sort_array(F.flatten("pairs"))).alias("n_hit"), F.sort_array("items").alias("items"))


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a window of an item."""
    doc, text_hash = base.unused(docs.columns, "__doc", "__hash")
    bad = base.sized(search(docs, items, id_col, text_col)[1].select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash)).distinct())
    same = base.quoted(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(base.quoted(text_col), F.lit(""))) == F.col(text_hash))
    return docs.join(bad, same, "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, matches = search(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
    hits = per_document(matches).select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), "n_hit", "items")
    done = documents.join(hits, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return done.select(F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
  FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0
), places AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM docs, (SELECT DISTINCT n FROM windows), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), matched AS (
  SELECT r, i, p.n, item_id FROM places p JOIN windows USING (n, t)
), hits AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM matched) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM matched) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""
