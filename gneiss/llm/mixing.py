"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations only.

A source's target is the smaller of its cap (``max_epochs`` times its words) and its share by
weight of what the capped sources leave.  Every document is taken ``floor(target / words)``
times, and once more if its seeded key lies under its source's threshold.  The threshold is the one of all
prefixes of the keys (24 bits) whose words come nearest to what the whole repetitions leave.  It is
found by sums over 4096 buckets of keys per source and then over the 4096 parts of the bucket that
holds it, so no source's documents ever meet in one task.

Defined results: a null or empty text has size 0 and is taken as 0 words; a very long text is counted whole and is one document, so a
source's words come near its target but for the size of its largest document at the threshold; equal keys are taken together; a null source is a source of its own, last
in order; repeated rows with the same id and text are decided alike; an empty table gives an empty result.  Added columns are in one
struct, whose name is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm import base

BITS = 12


def _key(id_col: str, text_col: str, seed: str) -> Column:
    text = F.concat(F.lit(seed + "|"), F.coalesce(base.quoted(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(base.quoted(text_col), F.lit("")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 2 * BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame, id_col: str, text_col: str, seed: str, size: str = "__size", key: str = "__key") -> DataFrame:
    """docs with two more columns: their words, and 24 seeded bits."""
    return docs.withColumns({size: F.size(base.words(base.quoted(text_col))).cast("long"), key: _key(id_col, text_col, seed)})


def weighted(sources: DataFrame, weights: tuple) -> DataFrame:
    """(source, words) with w: the weights, repeating, by code point of the source, null last.

    Ranks come from a range sort and the row counts of its partitions, not from one sorted task.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("m", F.monotonically_increasing_id())
    ranged = base.checkpoint(ranged.withColumns({"part": F.shiftright("m", 33), "row": F.col("m").bitwiseAND((1 << 33) - 1)}))
    # One row per partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("row")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank % len(weights) + 1).cast("int"))
    return ranged.join(F.broadcast(offsets), "part").select("source", "words", w.alias("w"))


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """The words per unit of weight at which the targets min(cap, level * w) add up to all words."""
    total, w = sources.select(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level, capped = (total / w if w else 0.0), 0
    while True:
        full = F.col("words") * max_epochs <= F.col("w") * level
        n, used, left = sources.select(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("words") * max_epochs)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not left:
            return level
        level, capped = (total - used) / left, n


def _prefixes(sums: DataFrame, by: str) -> DataFrame:
    """With upto: the words of a source up to and with a bucket."""
    return sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))


def plan(meta: DataFrame, weights: tuple, max_epochs: int) -> DataFrame:
    """meta: (source, size, key).  (source, source_size, target, whole, threshold) of each source."""
    buckets = base.checkpoint(meta.groupBy("source", F.shiftright("key", BITS).alias("b")).agg(F.sum("size").alias("words")))
    sources = base.checkpoint(weighted(buckets.groupBy("source").agg(F.sum("words").alias("words")), weights))
    level = water_level(sources, max_epochs)
    cap = F.col("words") * max_epochs
    full = cap <= F.col("w") * level
    sources = sources.select("source", F.col("words").alias("source_size"), F.when(full, cap.cast("double")).otherwise(F.lit(level) * F.col("w")).alias("target"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs).cast("long"))).otherwise(F.lit(0).cast("long"))
    sources = sources.withColumn("whole", whole).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    sources = base.checkpoint(sources)
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    # A source has 4096 buckets at most.
    upto = _prefixes(buckets, "b")
    cut = upto.alias("l").join(sources.alias("r"), same).filter((F.col("upto") - F.col("words") <= F.col("need")) & (F.col("need") < F.col("upto")) & (F.col("need") > 0))
    cut = base.checkpoint(cut.select("l.source", "b", "need", (F.col("upto") - F.col("words")).alias("before")))
    inner = meta.alias("l").join(cut.alias("r"), same & (F.shiftright("key", BITS) == F.col("b")))
    inner = inner.groupBy("l.source", "key", "need", "before").agg(F.sum("size").alias("words"))
    points = _prefixes(inner, "key").select("source", "need", (F.col("before") + F.col("upto")).alias("upto"), (F.col("key") + 1).alias("threshold"))
    points = points.unionByName(cut.select("source", "need", F.col("before").alias("upto"), F.shiftleft("b", BITS).alias("threshold")))
    best = points.groupBy("source").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("need")).alias("off"), "upto", "threshold")).alias("best"))
    out = sources.alias("l").join(best.alias("r"), same, "left")
    return out.select("l.source", "source_size", "target", "whole", F.coalesce(F.col("best.threshold"), F.lit(0)).alias("threshold"))


def apply(rows: DataFrame, source_col: str, plans: DataFrame, into: str = "mix", size: str = "__size", key: str = "__key") -> DataFrame:
    """rows: as measured() gives them.  Adds the struct ``into`` (size, source_size, target, repeats, taken) for size and key.

    The plans have a row per source; beyond a checked number, the join is a shuffle in which a hot source can be split.
    """
    names = base.unused(rows.columns, *(f"__{c}" for c in plans.columns))
    side = base.sized(plans.toDF(*names))
    plan_ = dict(zip(plans.columns, map(F.col, names)))
    joined = rows.join(side, base.quoted(source_col).eqNullSafe(plan_["source"]))
    words = base.quoted(size)
    repeats = plan_["whole"] + (base.quoted(key) < plan_["threshold"]).cast("long")
    struct = F.struct(words.alias("size"), plan_["source_size"].alias("source_size"), plan_["target"].alias("target"), repeats.alias("repeats"), (words * repeats).alias("taken"))
    return joined.select(*(base.quoted(c) for c in rows.columns if c not in (size, key)), struct.alias(into))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", into: str = "mix") -> DataFrame:
    """docs with a struct named by ``into``; only size and key of a document are shuffled or stored for the plan, not its text."""
    size, key = base.unused([*docs.columns, into], "__size", "__key")
    rows = measured(docs, id_col, text_col, seed, size, key)
    meta = base.checkpoint(rows.select(base.quoted(source_col).alias("source"), F.col(size).alias("size"), F.col(key).alias("key")))
    return apply(rows, source_col, plan(meta, weights, max_epochs), into, size, key)


def repeated(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """The mix itself: a row for each repetition, without the struct."""
    repeats, (n,) = F.col(f"{into}.repeats"), base.unused(mixed.columns, "__n")
    kept = mixed.filter(repeats > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), repeats)))
    return kept.drop(into, n)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = base.checkpoint(measured(docs, "doc_id", "text", "mix").drop("text"))
    meta = rows.select("source", F.col("__size").alias("size"), F.col("__key").alias("key"))
    return apply(rows, "source", plan(meta, (5, 2, 1), 3)).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
    CAST('0x' || substr(sha256('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 6) AS BIGINT) AS key
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words FROM docs GROUP BY source
), weighed AS (
  SELECT source, words, 3 * words AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM totals
), prefixes AS (
  SELECT source, cap, w, sum(words) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    coalesce(sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_w
  FROM weighed
), level AS (
  SELECT arg_min(level, used_w) AS level FROM (
    SELECT cap, w, used_w, CAST(total - used AS DOUBLE) / CAST(all_w - used_w AS DOUBLE) AS level FROM prefixes
  ) WHERE cap > w * level
), targets AS (
  SELECT source, words, CASE WHEN cap <= w * level THEN CAST(cap AS DOUBLE) ELSE level * w END AS target FROM weighed, level
), needs AS (
  SELECT source, words, target, CASE WHEN words > 0 THEN least(CAST(floor(target / words) AS BIGINT), 3) ELSE 0 END AS whole FROM targets
), keys AS (
  SELECT source, key, sum(size) AS words FROM docs GROUP BY source, key
), points AS (
  SELECT source, key + 1 AS threshold, sum(words) OVER (PARTITION BY source ORDER BY key) AS upto FROM keys
  UNION ALL SELECT source, 0, 0 FROM totals
), best AS (
  SELECT n.source, n.words, n.target, n.whole,
    min({'off': abs(CAST(p.upto AS DOUBLE) - greatest(0.0, n.target - n.whole * n.words)), 'upto': p.upto, 'threshold': p.threshold}) AS b
  FROM needs n JOIN points p ON n.source IS NOT DISTINCT FROM p.source GROUP BY ALL
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, b.words AS source_size, b.target,
  CAST(d.size * (b.whole + CASE WHEN d.key < b.b.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM docs d JOIN best b ON d.source IS NOT DISTINCT FROM b.source
"""
