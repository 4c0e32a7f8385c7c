"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import base

#: Links that a task holds at once, and links that are left to one task (16 bytes each).
SLAB, SOLO = 1 << 20, 1 << 21


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """label: the smallest index linked with each index, updated by the links (a, b)."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(shorter := label[label], label):
            label[:] = shorter


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links (a, b), sorted, and the smallest node that each is linked with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    merge(label, at[: len(a)], at[len(a) :])
    return nodes, nodes[label]


def _slabs(batches, rows: int):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _forests(slab: int):
    """(a, b), a > b: each SLAB of links becomes links of its nodes to their roots."""

    def run(batches):
        for links in _slabs(batches, slab):
            nodes, least = roots(links.column(0).to_numpy(), links.column(1).to_numpy())
            linked = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(least[linked])], names=["a", "b"])

    return run


def _all_roots(batches):
    for links in _slabs(batches, SOLO + 1):
        nodes, least = roots(links.column(0).to_numpy(), links.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b: long, not null): root is the smallest node it is linked with.

    Tasks first replace their links by spanning forests.  If SOLO links or fewer are left, one task merges them.  Beyond that two
    steps alternate until nothing changes: each node links its larger neighbours to its smallest one, then itself and
    its smaller neighbours to the smallest of these.  Each step is a minimum per node and a join, never
    a list of a node's neighbours; each round is written to the shared folder.  Links of a node with itself and
    repeated ones count for nothing; no links give an empty result.
    """

    def stars(pairs: DataFrame, keep) -> DataFrame:
        # A table of its own, so that the pairs of a node with very many neighbours can be split in the join.
        least = base.checkpoint(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        return keep(pairs.join(least, "a"))

    # The shuffle keeps the workers of what made the links out of the tasks that merge them.
    kept = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = base.checkpoint(kept.mapInArrow(_forests(SLAB), "a long, b long"))
    if now.count() <= SOLO:
        return base.checkpoint(now.coalesce(1).mapInArrow(_all_roots, "node long, root long"))
    mark = None
    while True:
        n, total = now.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == mark:
            break
        mark = (n, total)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stars(both, lambda j: j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        small = stars(large, lambda j: j.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b"))
        now = base.checkpoint(small.distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select("b", "b").distinct().toDF("node", "root"))
