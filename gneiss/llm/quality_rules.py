"""Quality rules by host, in DataFrame operations only.

Each document is measured by expressions over its whole text.  Rules turn the measures into
failures, which are counted by host; the failure rate of a host is shrunk by a beta prior fitted to all
hosts (moments of the beta-binomial, hosts weighted by their documents), so a host with few documents is judged mostly as the average host.  Hosts above
``max_rate`` are rejected, and the verdict is joined back to the documents.

Defined results: a null or empty text has no words, and so fails the base; a very long one is measured whole, by one task; a rate of just
max_rate is kept; a null host is a host of its own;
repeated rows are judged alike and each counts for its host; an empty table gives an empty result.  Measures and verdicts are in one struct, whose name is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import base

#: Rules over the measures; each is true for a document that fails.  The first two are the base.
RULES: dict[str, Callable[[], Column]] = {
    "too_short": lambda: F.col("n_words") < 50,
    "repetitive": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
}
BASE = ("too_short", "repetitive")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more, each word counted once.

    Windows are sorted with their places, so equal ones are neighbours; the places of those that have an equal neighbour
    are sorted, and each adds the words that the one before doesn't cover.
    """

    def of(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - 3)
        windows = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("t"), i.alias("i")))

        def twice(s: Column) -> Column:
            same = lambda x, j, d: F.coalesce(F.get(s, j + d)["t"] == x["t"], F.lit(False))
            return F.transform(F.filter(s, lambda x, j: same(x, j, -1) | same(x, j, 1)), lambda x: x["i"])

        def covered(places: Column) -> Column:
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
            return F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).cast("long").alias("n"), (i + 3).alias("end")), lambda a: a["n"])

        return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(covered(F.sort_array(let(F.sort_array(windows), twice))))

    return let(w, of)


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    w = base.words(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(base.WHITE))) > 0)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w),
    }


def host_verdicts(judged: DataFrame, host: str, failed: Column, max_rate: float, min_strength: float = 1.0, max_strength: float = 1e6) -> DataFrame:
    """(host, rate, rejected): the failure rate of each host under a beta prior, and whether it is above max_rate.

    The prior's mean is the rate over all documents.  Its strength s = a + b follows from the weighted squares of the hosts' rates about it,
    less what they have as binomial shares: with rho = 1 / (s + 1), their expectation is
    mean * (1 - mean) * (hosts - 1 + rho * (N - sum(n^2) / N - hosts + 1)).  It is kept between the two strengths; hosts of which none
    has two documents don't tell it, and have the largest.
    """
    hosts = base.checkpoint(judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("k")))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    total, fails, count, squares, rates = hosts.select(*(F.coalesce(x, F.lit(0.0)) for x in (F.sum(n), F.sum(k), F.count(F.lit(1)).cast("double"), F.sum(n * n), F.sum(k * k / n)))).first()
    mean, strength = fails / total if total else 0.0, max_strength
    spare = total - squares / total - count + 1 if total else 0.0
    if 0 < mean < 1 and spare > 0:
        rho = ((rates - fails * mean) / (mean * (1 - mean)) - (count - 1)) / spare
        strength = 1 / min(1 / (1 + min_strength), max(1 / (1 + max_strength), rho)) - 1
    rate = (F.col("k") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", rate.alias("rate"), (rate > max_rate).alias("rejected"))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, into: str = "rules") -> DataFrame:
    """docs without the text and with a struct named by ``into``: measures, failed, base_failed, host_rate, kept."""
    failed, base_failed = F.lit(False), F.lit(False)
    for name, rule in RULES.items():
        failed = failed | rule()
        base_failed = base_failed | rule() if name in BASE else base_failed
    others = [c for c in docs.columns if c.lower() not in (text_col.lower(), host_col.lower())]
    held = F.struct(*others).alias("__row")
    names = list(measures(F.lit("")))
    measured = docs.select(held, F.col(host_col).alias("__host"), *(c.alias(k) for k, c in measures(F.col(text_col)).items()))
    # Measured once; hosts are counted and verdicts joined over these small rows.
    rows = base.checkpoint(measured.select("*", failed.alias("__failed"), base_failed.alias("__base_failed")))
    verdicts = host_verdicts(rows, "__host", F.col("__failed"), max_rate)
    joined = rows.join(verdicts, F.col("__host").eqNullSafe(F.col("host")))
    rules = F.struct(*names, F.col("__failed").alias("failed"), F.col("__base_failed").alias("base_failed"), F.col("rate").alias("host_rate"), (~F.col("__base_failed") & ~F.col("rejected")).alias("kept"))
    return joined.select(*(F.col("__row")[c].alias(c) for c in others), F.col("__host").alias(host_col), rules.alias(into))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judge(base.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", *(f"rules.{c}" for c in (*measures(F.lit("")), "base_failed", "kept")))


OP2_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), measured AS (
  SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d LEFT JOIN repeats USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed
  FROM measured
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM judged GROUP BY source
), sums AS (
  SELECT sum(CAST(n AS DOUBLE)) AS t, sum(CAST(k AS DOUBLE)) AS f, CAST(count(*) AS DOUBLE) AS h, sum(CAST(n AS DOUBLE) * n) AS q, sum(CAST(k AS DOUBLE) * k / n) AS r FROM hosts
), prior AS (
  SELECT f / t AS m, CASE WHEN f > 0 AND f < t AND t - q / t - h + 1 > 0
    THEN 1 / least(0.5, greatest(1 / (1 + 1e6), ((r - f * (f / t)) / (f / t * (1 - f / t)) - (h - 1)) / (t - q / t - h + 1))) - 1 ELSE 1e6 END AS s
  FROM sums
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (k + m * s) / (n + s) <= 0.5 AS kept
FROM judged j JOIN hosts h ON j.source IS NOT DISTINCT FROM h.source, prior
"""
