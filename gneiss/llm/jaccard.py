"""SimHash near-deduplication by the similarity of texts' shingles, for stages that have to find copies as unlike as 0.8.

Two texts are near-duplicates if the Jaccard similarity of their sets of ``width``-word shingles is ``SIMILAR`` or more; classes
are the components of that relation.  Texts with equal sets are merged first.  Fingerprints of the sets that are BITS bits apart or less,
found by vantage-point trees, are the first candidates.  Texts just at 0.8 differ in 3 to 11 of 64 bits; with such a radius nearly every
fingerprint lies at the boundary of every node, and no tree prunes anything.  So the rest is found by minimum hashes: each distinct set has
BANDS keys of ROWS of them each; sets that share a key are candidates.  Every candidate is verified on the whole sets, so
no link is wrong.  A pair just at 0.8 shares no key with probability (1 - 0.8^4)^32 = 5e-8, a more similar one with less.

The sets of a key are first compared with one of them, its leader; then only pairs in different classes are open.  Those of keys with
JOINED open pairs or fewer are joined with the texts, so that work grows with the sets.  Sets of keys with more are much like each other but not enough;
blocks of them, of about BLOCK_CHARS characters, are broadcast one after the other as inverted
indexes of shingles.  Each set counts the shingles it shares with all of a block, and at most one link to each other class comes out.

Defined results: texts are split at ASCII white space with A-Z lower-cased; a text of fewer words than ``width`` is one shingle; null texts, empty ones and
those of white space have the empty set and are copies of each other; very long texts are compared whole; repeated rows are copies; of ties
the smallest id and hash count; an empty table gives an empty result.  Ids keep their type.  Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import base, kernels, simhash
from gneiss.llm.components import components

#: Similarity from which on texts are near-duplicates, as a fraction.
SIMILAR = (4, 5)
#: Bits by which fingerprints of first candidates differ; keys per set, minimum hashes per key, and shingles that are hashed at once.
BITS, BANDS, ROWS, CHUNK = 2, 32, 4, 1 << 11
#: Open pairs of a key that are joined.
JOINED = 32
#: Characters of the texts of a block.
BLOCK_CHARS = 1 << 23


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = _mix(out + h[k : k + n])
    return np.unique(out)


_KINDS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bands(set_: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set that isn't empty."""
    least = np.full(len(_KINDS), ~np.uint64(0))
    for lo in range(0, len(set_), CHUNK):
        part = set_[None, lo : lo + CHUNK] ^ _KINDS[:, None]
        part *= _KINDS[:, None] | np.uint64(1)
        np.minimum(least, part.min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mix(out + column)
    return out


def fingerprint(set_: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; that of the empty set is 0."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(set_), 1 << 16):
        ones += np.unpackbits(set_[lo : lo + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(set_), bitorder="little").view("<i8")[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _sets(width: int):
    """(doc, text_hash, fp, n, sim, bands): a hash of each text's set, its size, fingerprint and keys; the empty set has none."""

    def run(batches):
        for whole in batches:
            for batch in kernels.slices(whole):
                sets = [shingles(t, width) for t in kernels.texts(batch.column(2))]
                prints = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64)
                keys = pa.array([bands(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(fingerprint, sets)), pa.int64()), keys], names=["doc", "text_hash", "fp", "n", "sim", "bands"])

    return run


def block_index(rows: list[tuple], width: int) -> tuple:
    """Of some (fp, root, text): arrays of fps, roots and sizes, and the sorted shingles with their owners."""
    sets = [shingles(t.encode(), width) for *_, t in rows]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat, owner = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    keys, starts = np.unique(flat[order], return_index=True)
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), sizes, keys, np.append(starts, len(flat)), owner[order]


def linked_in_block(set_: np.ndarray, fp: int, root: int, index: tuple) -> np.ndarray:
    """Sets of a block that are similar to a set of another class and have a larger fp; one of each class."""
    fps, roots, sizes, keys, starts, owner = index
    at = np.minimum(np.searchsorted(keys, set_), len(keys) - 1)
    at = at[keys[at] == set_]
    both = np.zeros(len(fps), dtype=np.int64)
    for k in at.tolist():
        # Each owner is there once.
        both[owner[starts[k] : starts[k + 1]]] += 1
    good = np.flatnonzero((SIMILAR[1] * both >= SIMILAR[0] * (len(set_) + sizes - both)) & (roots != root) & (fps > fp))
    return fps[good[np.unique(roots[good], return_index=True)[1]]]


def _block_links(width: int, index):
    """(a, b): links of texts' sets with those of a block."""

    def run(batches):
        for whole in batches:
            for batch in kernels.slices(whole, 64):
                fps, roots = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [linked_in_block(shingles(t, width), fp, root, index.value) for fp, root, t in zip(fps, roots, kernels.texts(batch.column(2)))]
                a = np.repeat(np.array(fps, dtype=np.int64), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["a", "b"])

    return run


def _verify(width: int):
    """(a, b) of the pairs whose texts are similar."""

    def run(batches):
        last, one = None, None
        for whole in batches:
            for batch in kernels.slices(whole, 64):
                a, texts, others = batch.column(0).to_pylist(), kernels.texts(batch.column(2)), kernels.texts(batch.column(3))
                good = []
                for fp, x, y in zip(a, texts, others):
                    if fp != last:
                        last, one = fp, shingles(x, width)
                    good.append(similar(one, shingles(y, width)))
                good = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return run


def _sized(x: str, y: str):
    """Sizes that allow a similar pair."""
    return F.least(x, y) * SIMILAR[1] >= F.greatest(x, y) * SIMILAR[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc, text_hash, fp, root, component) of every row: fp is a hash of the text's set of shingles, root the smallest
    one reachable over links, component the smallest id so reachable; text_hash is xxhash64 of the text."""
    text = F.coalesce(base.quoted(text_col), F.lit(""))
    source = docs.select(base.quoted(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = base.checkpoint(source.mapInArrow(_sets(width), f"doc {base.kind(docs, id_col)}, text_hash long, fp long, n long, sim long, bands array<long>"))
    # One row stands for all that have its set.
    distinct = base.checkpoint(rows.groupBy("fp").agg(F.min("doc").alias("least"), F.min("n").alias("n"), F.min("sim").alias("sim"), F.min(F.struct("text_hash", "doc")).alias("at"), F.min("bands").alias("bands")))

    # Each key of two sets or more, with its leader; a table of its own, so that a key with very many sets can be split in the joins.
    keyed = distinct.select("fp", "n", F.explode("bands").alias("band"))
    leaders = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("sets"), F.min(F.struct("fp", "n")).alias("x")).filter("sets > 1")
    leaders = base.checkpoint(leaders.select("band", F.col("x.fp").alias("lead"), F.col("x.n").alias("m")))
    members = base.checkpoint(keyed.join(leaders, "band"))
    wanted = members.select("fp").distinct().join(distinct, "fp").select("fp", F.col("at.doc").alias("d"), F.col("at.text_hash").alias("h"))
    found = source.join(base.sized(wanted), (F.col("text_hash") == F.col("h")) & F.col("doc").eqNullSafe(F.col("d")))
    # Rows may repeat an id and a text.
    texts = base.checkpoint(found.groupBy("fp").agg(F.min("text").alias("text")))

    def links(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(texts.toDF("b", "other"), "b").join(texts.toDF("a", "text"), "a")
        return base.checkpoint(both.select("a", "b", "text", "other").mapInArrow(_verify(width), "a long, b long"))

    def by_blocks(fps: DataFrame) -> DataFrame:
        """Links between the classes of these (fp, root)."""
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        some = base.checkpoint(texts.join(fps.distinct(), "fp").select("fp", "root", "text").repartition(parts, "fp"))
        size = some.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        blocks, found = max(1, -(-size // BLOCK_CHARS)), some.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
        for block in range(blocks):
            # About BLOCK_CHARS characters.
            part = some.filter(F.pmod(F.xxhash64(F.lit("block"), "fp"), F.lit(blocks)) == block).collect()
            if part:
                index = docs.sparkSession.sparkContext.broadcast(block_index([tuple(r) for r in part], width))
                new = some.mapInArrow(_block_links(width, index), "a long, b long")
                found = found.unionByName(new)
        return base.checkpoint(found)

    prints = base.checkpoint(distinct.filter("n > 0").groupBy("sim").agg(F.min("fp").alias("lead")))
    near = simhash.tree_links(prints.select(F.col("sim").alias("fp")), BITS)
    near = near.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = distinct.join(prints, "sim").filter("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    starred = members.filter((F.col("fp") != F.col("lead")) & _sized("n", "m")).select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    linked = components(links(starred.unionByName(near).unionByName(equal)))
    now = base.checkpoint(members.join(linked.toDF("fp", "r"), "fp", "left").select("band", "fp", "n", F.coalesce("r", "fp").alias("root")))
    classes = now.groupBy("band", "root").agg(F.count(F.lit(1)).cast("double").alias("k"))
    # The pairs of each key that are in different classes.
    keys = classes.groupBy("band").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("open"))
    keys = base.checkpoint(keys.filter("open > 0"))
    some = now.join(keys.filter(F.col("open") <= JOINED).select("band"), "band")
    pairs = some.join(some.toDF("band", "fp2", "n2", "root2"), "band").filter((F.col("root") < F.col("root2")) & _sized("n", "n2"))
    new = links(pairs.select(F.col("fp2").alias("a"), F.col("fp").alias("b")))
    crowded = by_blocks(now.join(keys.filter(F.col("open") > JOINED).select("band"), "band").select("fp", "root"))
    linked = components(linked.toDF("a", "b").unionByName(new).unionByName(crowded))
    linked = linked.withColumnRenamed("node", "fp")
    least = linked.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("fp", "root", "component")
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component"))
    # A table of its own, so that a set with a third of all rows can be split in the join.
    return rows.join(base.checkpoint(classes), "fp").select("doc", "text_hash", "fp", "root", "component")
