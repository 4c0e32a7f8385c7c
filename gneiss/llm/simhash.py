"""SimHash near-deduplication with vantage-point trees.

Every whole text becomes a 64-bit fingerprint; equal fingerprints are merged before anything else.  A vantage-point
tree over a bounded sample of fingerprints deals the distinct ones out to shards: a node has a
vantage point and a radius, and a fingerprint lives inside or outside by its Hamming distance.  By the
triangle inequality only those within ``bits`` of a radius can be near a fingerprint on its other side; such a one
that lives inside also visits the outside shards, so every near pair meets in the home shard of
one of the two.  Within a shard a second tree prunes in the same way down to small leaves, which are compared in
full.  Shards return a spanning forest of their links, not the pairs, and the links are merged to components.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked as any other; a very long text is hashed
in pieces of CHUNK words that overlap, so whole; repeated rows are copies of each other; a component of null ids only has a null id; of
several links to a component the smallest fingerprint and id count, so ties don't matter; an empty table gives an empty result.
Ids keep their type.  Only the two named columns are read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import base, kernels
from gneiss.llm.components import components, merge

#: Fingerprints that a shard is meant to be home of, sampled fingerprints per shard, and the most shards.
SHARD, SAMPLE, MAX_SHARDS = 8192, 16, 1 << 16
#: Leaves of a shard's own tree, and words of a text that are in memory as shingles at once.
LEAF, CHUNK = 512, 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, CHUNK):
        part = words[lo : lo + CHUNK + width - 1]
        shingles = zip(*(part[k:] for k in range(width))) if len(words) >= width else [words]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(42)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches):
        for whole in batches:
            for batch in kernels.slices(whole):
                prints = np.array([fingerprint(t, width) for t in kernels.texts(batch.column(2))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc", "text_hash", "fp"])

    return run


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(points: np.ndarray, seed: int) -> tuple | None:
    """(point, radius) that halves points best with few of them near the radius; None if nothing splits them."""
    best = None
    for v in np.random.default_rng(seed).choice(points, min(4, len(points)), replace=False):
        d = distance(points, v)
        r = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        for radius in (r, r - 1):
            inner = np.count_nonzero(d <= radius) / len(d)
            score = abs(inner - 0.5) + np.count_nonzero((d > radius - 2) & (d <= radius + 2)) / len(d)
            if 0.1 <= inner <= 0.9 and (best is None or score < best[0]):
                best = (score, v, radius)
    return best and best[1:]


def grow(points: np.ndarray, shards: int, seed: int = 1):
    """The router: nested (point, radius, inside, outside), and None for a shard."""
    if shards <= 1 or len(points) < 2 or (cut := vantage(points, seed)) is None:
        return None
    inside = distance(points, cut[0]) <= cut[1]
    return (*cut, grow(points[inside], shards // 2, 2 * seed), grow(points[~inside], shards - shards // 2, 2 * seed + 1))


def descend(tree, prints: np.ndarray, home: np.ndarray, bits: int, path: int = 1):
    """Yields (path, indices, home) of each leaf that a fingerprint lives in (home) or visits."""
    todo = [(tree, path, np.arange(len(prints)), home)]
    while todo:
        node, path, at, home = todo.pop()
        if not len(at):
            continue
        if node is None:
            yield path, at, home
            continue
        point, radius, inside, outside = node
        d = distance(prints[at], point).astype(np.int16)
        inner = (home & (d <= radius)) | (~home & (d <= radius + bits))
        outer = (home & (d > radius)) | (d > radius - bits)
        todo.append((inside, 2 * path, at[inner], home[inner]))
        todo.append((outside, 2 * path + 1, at[outer], (home & (d > radius))[outer]))


def compare(prints: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """Labels of a leaf: all its fingerprints against those at home."""
    label = np.arange(len(prints))
    at = np.flatnonzero(home)
    if len(at) > 1 << 15 and bits <= 2:
        return flips(prints, at, bits, label)
    rows = max(1, (1 << 21) // max(1, len(at)))
    for lo in range(0, len(prints), rows):
        i, j = np.nonzero(distance(prints[lo : lo + rows, None], prints[None, at]) <= bits)
        i, j = i + lo, at[j]
        merge(label, i[i != j], j[i != j])
    return label


def flips(prints: np.ndarray, at: np.ndarray, bits: int, label: np.ndarray) -> np.ndarray:
    """The same for a crowd that no vantage point splits: looks up each fingerprint with each one or two bits flipped."""
    order = at[np.argsort(prints[at])]
    sorted_ = prints[order]
    one = [np.uint64(1 << k) for k in range(64)]
    for mask in [np.uint64(0), *one, *((x | y for i, x in enumerate(one) for y in one[:i]) if bits > 1 else ())]:
        want = prints ^ mask
        place = np.minimum(np.searchsorted(sorted_, want), len(sorted_) - 1)
        hit = np.flatnonzero(sorted_[place] == want)
        merge(label, hit, order[place[hit]])
    return label


def link(prints: np.ndarray, home: np.ndarray, bits: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a shard, as indices: a spanning forest of each leaf of its own tree."""
    at_home = prints[home]
    cut = vantage(at_home, depth) if len(at_home) > LEAF and depth < 40 else None
    if cut is None:
        label = compare(prints, home, bits)
        a = np.flatnonzero(label != np.arange(len(label)))
        return a, label[a]
    parts = [(at, link(prints[at], stays, bits, depth + 1)) for _, at, stays in descend((*cut, None, None), prints, home, bits)]
    return tuple(np.concatenate([at[x[k]] for at, x in parts]) for k in (0, 1)) if parts else (np.empty(0, int),) * 2


def _deal(tree, bits: int):
    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for path, at, home in descend(tree.value if tree else None, prints, np.ones(len(prints), dtype=bool), bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), path)), pa.array(prints[at].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    return run


def _links(bits: int):
    def run(shard: pa.Table) -> pa.Table:
        prints = shard.column("fp").to_numpy().view(np.uint64)
        home = np.asarray(shard.column("home").to_pylist(), dtype=bool)
        a, b = link(prints, home, bits)
        label = np.arange(len(prints))
        merge(label, a, b)
        a = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(prints[a].view(np.int64)), "b": pa.array(prints[label[a]].view(np.int64))})

    return run


def tree_links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b): links of ``bits`` bits or fewer between distinct fingerprints (fp, computed once), a spanning forest of each shard's."""
    n = distinct.count()
    shards = min(MAX_SHARDS, -(-n // SHARD))
    tree = None
    if shards > 1:
        # About SAMPLE fingerprints for each shard, by a share of a hash's values, so no task sees them all.
        below = F.shiftrightunsigned(F.xxhash64("fp"), 1) < int((1 << 63) * min(1.0, SAMPLE * shards / n))
        sample = np.sort(distinct.filter(below).select("fp").toPandas()["fp"].to_numpy().view(np.uint64))
        tree = distinct.sparkSession.sparkContext.broadcast(grow(sample, shards))
    dealt = distinct.select("fp").mapInArrow(_deal(tree, bits), "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, width: int = 3) -> DataFrame:
    """(doc, text_hash, fp, root, component) of every row: fp is the fingerprint as a long, root the smallest fingerprint
    reachable over links of ``bits`` bits or fewer, component the smallest id so reachable; text_hash is xxhash64 of the text."""
    text = F.coalesce(base.quoted(text_col), F.lit(""))
    rows = docs.select(base.quoted(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = base.checkpoint(rows.mapInArrow(_fingerprints(width), f"doc {base.kind(docs, id_col)}, text_hash long, fp long"))
    distinct = base.checkpoint(rows.groupBy("fp").agg(F.min("doc").alias("least")))
    linked = components(tree_links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    least = linked.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("fp", "root", "component")
    # A table of its own, so that a fingerprint with a third of all rows can be split in the join.
    classes = base.checkpoint(distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component")))
    return rows.join(classes, "fp").select("doc", "text_hash", "fp", "root", "component")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=near_duplicates) -> DataFrame:
    """One row of docs from each class of near-duplicates, that with the smallest id (and text hash, if ids repeat; a null id
    comes last).  Of rows that repeat an id and a text, that with the smallest other columns, as JSON, stays.
    classes: the function that finds them, this module's or that of ``jaccard``.

    Only ids and hashes of the rows that go are joined with docs; below a checked size they are broadcast and no text moves.
    """
    found = base.checkpoint(classes(docs, id_col, text_col).select("doc", "text_hash", "root"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "text_hash")).alias("first"), F.count(F.lit(1)).alias("rows"))
    members = found.join(base.sized(first.filter("rows > 1").select("root", F.col("first.doc").alias("d"), F.col("first.text_hash").alias("h"))), "root")
    stays = F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    doc, text_hash = base.unused(docs.columns, "__doc", "__hash")
    text = F.coalesce(base.quoted(text_col), F.lit(""))
    same = base.quoted(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(text_hash))
    kept = docs.join(base.sized(members.filter(~stays).select("doc", "text_hash").distinct().toDF(doc, text_hash)), same, "left_anti")
    again = base.sized(members.filter(stays).groupBy("doc", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc", "text_hash").toDF(doc, text_hash))
    if not again.limit(1).count():
        return kept
    all_ = [base.quoted(c) for c in docs.columns]
    others = [base.quoted(c) for c in docs.columns if c.lower() not in (id_col.lower(), text_col.lower())]
    repeats = kept.join(again, same, "left_semi").groupBy(base.quoted(id_col).alias("a"), F.xxhash64(text).alias("b"))
    one = repeats.agg(F.min_by(F.struct(*all_), F.to_json(F.struct(F.lit(0).alias("z"), *others))).alias("row"))
    return kept.join(again, same, "left_anti").unionByName(one.select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(base.table(spark, sf_dir, "documents"))
    return done.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
