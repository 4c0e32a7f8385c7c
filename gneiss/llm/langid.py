"""Language identification by character language models with interpolated Kneser-Ney smoothing.

A model has the character trigrams of each language.  Letters are lower-cased and everything else is one space.  N-grams are packed into
64 bits without collisions, mixed by a bijective hash, and kept as sorted arrays with the log
probabilities beside them; a whole text is scored by binary search.  Languages are put into blocks of BLOCK, each with arrays of
its own, so that the model grows with the languages' n-grams and not with languages times all n-grams.  The language with the lowest
cross-entropy per character wins.  The score is its share of the posterior, sharpened by a
temperature fitted on training rows that the counts don't hold; a text whose cross-entropy is above what 99.9 % of these rows
have is marked as rejected.

The model is fitted on a bounded sample of the distinct labelled texts of at most LONGEST characters: about MAX_DOCS for each language,
and MAX_CHARS characters for all, shared evenly between the languages, by a share of a hash's values; each language has its first text by
the hash at least, so all are learned.  N-grams are counted on the executors over whole texts.

Defined results: a null text, or one without letters, is ``und`` with score 0; of languages with equal cross-entropy the first by name wins;
a very long text is scored whole, in pieces of CHUNK characters that overlap; texts that repeat in a language are learned once; rows
with a null language or text aren't learned from; without any language to learn all texts are ``und``; an empty table gives an empty result.
Only the named columns are read, and the result's struct has the name that ``into`` says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import base, kernels

#: Texts of a language to learn from, of these to calibrate with at most, characters of all languages, and of a text.
MAX_DOCS, CALIBRATION_DOCS, MAX_CHARS, LONGEST = 2000, 200, 1 << 25, 1 << 20
#: Languages that share arrays, and the discount where counts don't give one.
BLOCK, DISCOUNT = 8, 0.75
#: Characters of a text that are scored at once.
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = np.uint64(21)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with single spaces (32) for the rest, and a space at either end."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds, where = np.unique(raw, return_inverse=True)
    clean = np.array([c if chr(c).isalpha() else 32 for c in kinds.tolist()], dtype=np.uint64)[where]
    return clean[np.concatenate([[True], (clean[1:] != 32) | (clean[:-1] != 32)])]


def pack(c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of c, n up to 3: 21 bits per character, times an odd number."""
    out = np.zeros(max(0, len(c) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = (out << BITS) | c[k : len(c) - n + 1 + k]
    return out * MIX


def unpack(keys: np.ndarray, n: int) -> np.ndarray:
    plain = keys * np.uint64(pow(int(MIX), -1, 1 << 64))
    return np.stack([(plain >> (BITS * np.uint64(k))) & np.uint64((1 << 21) - 1) for k in range(n - 1, -1, -1)], axis=1)


def _count(batches):
    """(lang, key, n): trigram counts of some texts."""
    for whole in batches:
        parts: dict = {}
        for batch in kernels.slices(whole):
            for lang, text in zip(batch.column(0).to_pylist(), kernels.texts(batch.column(1))):
                parts.setdefault(lang, []).append(pack(codes(text.decode("utf-8", "replace")), 3))
        for lang, keys in parts.items():
            keys, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])


class Levels:
    """Sorted hashes of the n-grams seen in training, with a row of values per language."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def _tally(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, where = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(where, weights=n, minlength=len(kinds))


def discount_of(n: np.ndarray) -> float:
    """n1 / (n1 + 2 * n2) for the numbers of n-grams seen once and twice; DISCOUNT if one of them is 0."""
    n1, n2 = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
    return n1 / (n1 + 2 * n2) if n1 and n2 else DISCOUNT


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """counts: trigram hashes and counts of each language.  The model: blocks of languages, and what calibrate() adds.

    p3(c|ab) = max(n(abc) - d3, 0) / n(ab) + d3 * kinds(ab) / n(ab) * p2(c|b); p2 and p1 are the same over numbers of distinct
    left neighbours, and p0 is uniform over the characters of all languages and one for all others.
    """
    langs = sorted(counts)
    alphabet = len(np.unique(np.concatenate([unpack(counts[x][0], 3)[:, 2] for x in langs]))) + 1
    blocks = [_block({x: counts[x] for x in langs[k : k + BLOCK]}, alphabet) for k in range(0, len(langs), BLOCK)]
    return {"langs": langs, "blocks": blocks, "temperature": 1.0, "limits": None}


def _block(counts: dict, alphabet: int) -> dict:
    """Arrays by order: n-grams of all languages of the block, with a row of values for each, a column per language."""
    langs = list(counts)
    trigrams = np.unique(np.concatenate([counts[x][0] for x in langs]))
    grams3 = unpack(trigrams, 3)
    bigrams = np.unique(np.concatenate([pack_rows(grams3[:, 1:]), pack_rows(grams3[:, :2])]))
    chars = np.unique(grams3)
    unseen, p1s, bow2s, p2s, bow3s, p3s = [], [], [], [], [], []
    one = Levels(chars, None)
    two = Levels(bigrams, None)
    grams2 = unpack(bigrams, 2)
    for lang in langs:
        keys, n = counts[lang]
        rows = unpack(keys, 3)
        # Continuation counts: distinct left neighbours of bc, and of c.
        k2, n2 = _tally(pack_rows(rows[:, 1:]), np.ones(len(rows)))
        r2 = unpack(k2, 2)
        k1, n1 = _tally(r2[:, 1], np.ones(len(r2)))
        d1, d2, d3 = discount_of(n1), discount_of(n2), discount_of(n)
        floor = d1 * len(k1) / n1.sum() / alphabet
        p1 = np.full(len(chars), floor)
        p1[one.find(k1)[0]] += np.maximum(n1 - d1, 0) / n1.sum()
        total2, kinds2 = np.zeros(len(chars)), np.zeros(len(chars))
        np.add.at(total2, one.find(r2[:, 0])[0], n2)
        np.add.at(kinds2, one.find(r2[:, 0])[0], 1)
        bow2 = np.where(total2 > 0, d2 * kinds2 / np.maximum(total2, 1), 1)
        p2 = bow2[one.find(grams2[:, 0])[0]] * p1[one.find(grams2[:, 1])[0]]
        p2[two.find(k2)[0]] += np.maximum(n2 - d2, 0) / total2[one.find(r2[:, 0])[0]]
        context = two.find(pack_rows(rows[:, :2]))[0]
        total3, kinds3 = np.bincount(context, weights=n, minlength=len(bigrams)), np.bincount(context, minlength=len(bigrams))
        bow3 = np.where(total3 > 0, d3 * kinds3 / np.maximum(total3, 1), 1)
        p3 = bow3[two.find(pack_rows(grams3[:, :2]))[0]] * p2[two.find(pack_rows(grams3[:, 1:]))[0]]
        p3[np.searchsorted(trigrams, keys)] += np.maximum(n - d3, 0) / total3[context]
        for to, x in ((unseen, floor), (p1s, p1), (bow2s, bow2), (p2s, p2), (bow3s, bow3), (p3s, p3)):
            to.append(np.log(x))
    col = lambda x: np.stack(x, axis=1)
    return {"chars": chars, "unseen": np.array(unseen), "p1": col(p1s), "bow2": col(bow2s), "bigrams": bigrams, "p2": col(p2s), "bow3": col(bow3s), "trigrams": trigrams, "p3": col(p3s)}


def pack_rows(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = (out << BITS) | rows[:, k]
    return out * MIX


def _back_off(model: dict, c: np.ndarray) -> np.ndarray:
    """Log probabilities of the last characters of trigrams (rows of c) that no language of a block has."""
    one, two = Levels(model["chars"], None), Levels(model["bigrams"], None)
    at, seen = one.find(c[:, 2])
    p = np.where(seen[:, None], model["p1"][at], model["unseen"])
    at, seen = one.find(c[:, 1])
    p = p + np.where(seen[:, None], model["bow2"][at], 0)
    at, seen = two.find(pack_rows(c[:, 1:]))
    p = np.where(seen[:, None], model["p2"][at], p)
    at, seen = two.find(pack_rows(c[:, :2]))
    return p + np.where(seen[:, None], model["bow3"][at], 0)


def entropies(model: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character (nats) of each text in each language, and the number of its letters and spaces."""
    sums, sizes = np.zeros((len(texts), len(model["langs"]))), np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        c = codes(text.decode("utf-8", "replace"))
        if not (c != 32).any():
            continue
        for lo in range(0, max(1, len(c) - 2), CHUNK):
            part = c[lo : lo + CHUNK + 2]
            keys = pack(part, 3)
            for k, block in enumerate(model["blocks"]):
                at, seen = Levels(block["trigrams"], None).find(keys)
                all_ = block["p3"][at[seen]].sum(axis=0)
                if not seen.all():
                    miss = np.flatnonzero(~seen)
                    all_ += _back_off(block, np.stack([part[miss], part[miss + 1], part[miss + 2]], axis=1)).sum(axis=0)
                sums[i, k * BLOCK : k * BLOCK + len(all_)] += all_
        sizes[i] = len(c) - 2
    return -sums / np.maximum(sizes, 1)[:, None], sizes


def decide(model: dict, texts: list[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    h, sizes = entropies(model, texts)
    best = h.argmin(axis=1)
    # The evidence of a text grows with its length, slower than its number of dependent characters.
    z = -(h - h.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(sizes, 1))[:, None] / model["temperature"]
    score = 1 / np.exp(z).sum(axis=1)
    there = sizes > 0
    rejected = ~there | (h[np.arange(len(h)), best] > (np.inf if model["limits"] is None else model["limits"][best]))
    return [model["langs"][b] if t else "und" for b, t in zip(best, there)], np.where(there, score, 0.0), rejected


def calibrate(model: dict, rows: list[tuple[str, bytes]]) -> dict:
    """Temperature and limits from (language, text) rows that weren't counted."""
    h, sizes = entropies(model, [t for _, t in rows])
    use = np.flatnonzero(sizes > 0)
    truth = np.array([model["langs"].index(x) for x, _ in rows], dtype=int)[use]
    if len(use):
        margin = -(h[use] - h[use].min(axis=1, keepdims=True)) * np.sqrt(sizes[use])[:, None]
        loss = lambda t: float(np.mean(np.log(np.exp(margin / t).sum(axis=1)) - margin[np.arange(len(use)), truth] / t))
        model["temperature"] = min(np.geomspace(0.3, 20, 80).tolist(), key=loss)
        own = h[use, truth]
        model["limits"] = np.array([np.quantile(own[truth == k], 0.999) if (truth == k).any() else np.inf for k in range(len(model["langs"]))]) * 1.05
    return model


def _counts(rows: DataFrame) -> dict:
    """Trigram hashes and counts of each language; as many as a bounded sample has."""
    counted = rows.select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    return {x: (g["key"].to_numpy().view(np.uint64), g["n"].to_numpy(dtype=np.float64)) for x, g in counted.sort_values(["lang", "key"]).groupby("lang")}


def sampled(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text, h, held) of the texts to learn from, computed once; held: whether one is for calibration.  h is a hash in 63 bits."""
    text = base.quoted(text_col)
    rows = docs.filter(usable & base.quoted(lang_col).isNotNull() & text.isNotNull()).select(base.quoted(lang_col).alias("lang"), text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("h")).filter(F.length("text") <= LONGEST)
    sizes = base.checkpoint(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.avg(F.length("text")).alias("chars"), F.min("h").alias("least")))
    langs = max(1, sizes.count())
    whole = F.lit(float(1 << 63))
    each = MAX_CHARS / langs / F.greatest(F.lit(1.0), F.col("n") * F.col("chars"))
    share = F.least(F.lit(1.0), MAX_DOCS / F.col("n"), each)
    limits = sizes.select(F.col("lang").alias("of"), "least", (share * whole).alias("upto"), (F.least(share / 10, CALIBRATION_DOCS / F.col("n")) * whole).alias("held"))
    taken = rows.join(base.sized(limits), F.col("lang") == F.col("of")).filter((F.col("h") < F.col("upto")) | (F.col("h") == F.col("least")))
    once = base.checkpoint(taken.groupBy("lang", "h").agg(F.min("text").alias("text"), F.first(F.col("h") < F.col("held")).alias("held")))
    # A language with no other texts has them all counted.
    counted = once.filter("NOT held").select(F.col("lang").alias("of")).distinct()
    return once.join(base.sized(counted), F.col("lang") == F.col("of"), "left").select("lang", "text", "h", (F.col("held") & F.col("of").isNotNull()).alias("held"))


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """A model of all languages of the usable rows with a language and a text."""
    chosen = sampled(docs, usable, text_col, lang_col)
    counts = _counts(chosen.filter("NOT held"))
    if not counts:
        return None
    # A bounded part of the sample.
    held = [(r["lang"], r["text"].encode()) for r in chosen.filter("held").select("lang", "text", "h").orderBy("lang", "h").collect() if r["lang"] in counts]
    return calibrate(kneser_ney(counts), held)


def identified(docs: DataFrame, model: dict | None, text_col: str = "text", into: str = "__lang") -> DataFrame:
    """docs with a struct named by ``into``: lang, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def identify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs, scores, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
            for part in kernels.slices(column):
                n = len(part)
                x, s, r = decide(shared.value, kernels.texts(part)) if shared.value else (["und"] * n, np.zeros(n), np.ones(n, bool))
                langs += x
                scores.append(s)
                rejected.append(r)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))], names=["lang", "score", "rejected"])

    return docs.withColumn(into, identify(base.quoted(text_col)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = base.fold(F.col("doc_id"), 4) == 2
    done = identified(docs.select("doc_id", "text"), train(docs, ~held_out))
    return done.select("doc_id", held_out.alias("held_out"), F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"), F.col("__lang.rejected").alias("rejected"))
