"""A quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Each word has a sparse index vector of +1 and -1 that follows from its hash.  A word's vector is the sum of the index
vectors of its neighbours in the sample's texts, for all words seen MIN_COUNT times there; the same is done for word shapes (runs of
letter classes, digits and marks), which also cover other words.  A document is the mean of its word vectors and of its
shape vectors, with their norms, its length, and its shares of distinct words, of unknown ones and of words equal to the one before.  A
numpy network with one hidden layer scores it; a temperature fitted on rows set aside calibrates the probability.

The model is fitted on the driver on a bounded sample of labelled rows: about MAX_ROWS rows and MAX_CHARS characters, by a share of the
values of a hash of id and text, of texts of at most LONGEST characters.  Scoring reads every whole text, however long.

Defined results: a null or empty text has only zero features and a score as any other; labels that are null are ignored, several labels of
an id count as their smallest; rows that repeat an id and a text are in the sample once; without any label, or with too long texts only, each
score is 0.5; an empty table gives an empty result.  Only the named columns are read, and the score's column has the name that ``into`` says.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import base, kernels

MAX_ROWS, MAX_CHARS = 4000, 1 << 24
#: Characters of a text that is too long for the fitting sample by itself.
LONGEST = 1 << 20
#: A word needs MIN_COUNT occurrences in the sample for a vector of its own; below, it is as unknown as words that come later.
DIM, NONZERO, MIN_COUNT, SPAN = 64, 8, 3, 2
HIDDEN, EPOCHS, CHUNK = 32, 60, 1 << 16

_CLASSES = [(re.compile(r"[^\W\d_a-z]+"), lambda m: "A" if m[0].isupper() else "a"), (re.compile(r"[a-z]+"), "a"), (re.compile(r"a+"), "a"), (re.compile(r"\d+"), "0")]


def shape(word: bytes) -> str:
    out = word.decode("utf-8", "replace")
    for pattern, by in _CLASSES:
        out = pattern.sub(by, out)
    return out


def index_vectors(terms: list[bytes]) -> np.ndarray:
    """A row for each term: 7 bits of its hash give a place and a sign, NONZERO times."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, terms), dtype=np.uint64, count=len(terms))
    out, rows = np.zeros((len(terms), DIM), dtype=np.float32), np.arange(len(terms))
    for k in range(NONZERO):
        bits = (h >> np.uint64(7 * k)).astype(np.int64)
        out[rows, bits & (DIM - 1)] += 1 - 2 * (bits >> 6 & 1)
    return out


def context_vectors(texts: list[np.ndarray], terms: list[bytes]) -> np.ndarray:
    """A unit vector for each term from the index vectors of its neighbours up to SPAN away, and a last row of zeros for unknown ones;
    texts: places of terms, unknown ones last."""
    basis = np.vstack([index_vectors(terms), np.zeros((1, DIM), np.float32)])
    out = np.zeros((len(terms) + 1, DIM), dtype=np.float32)
    for ids in texts:
        for gap in range(1, SPAN + 1):
            if len(ids) > gap:
                for at, near in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
                    order = np.argsort(at, kind="stable")
                    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                    out[at[order[starts]]] += np.add.reduceat(basis[near[order]], starts, axis=0)
    out[-1] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


class Features:
    """Words to ids, ids to vectors, documents to pooled rows."""

    def __init__(self, words: dict, word_vectors: np.ndarray, shapes: dict, shape_vectors: np.ndarray):
        self.words, self.word_vectors, self.shapes, self.shape_vectors = words, word_vectors, shapes, shape_vectors

    def ids(self, word: bytes) -> tuple[int, int]:
        return self.words.get(word, len(self.words)), self.shapes.get(shape(word), len(self.shapes))

    def row(self, words: list[bytes], cache: dict) -> np.ndarray:
        n = len(words)
        if not n:
            return np.zeros(2 * DIM + 6, dtype=np.float32)
        sums, unknown, distinct = np.zeros((2, DIM)), 0, set()
        for lo in range(0, n, CHUNK):
            part = words[lo : lo + CHUNK]
            kinds = Counter(part)
            pairs = []
            for w in kinds:
                if (p := cache.get(w)) is None:
                    if len(cache) > 100_000:
                        cache.clear()
                    cache[w] = p = self.ids(w)
                pairs.append(p)
            at, times = np.array(pairs), np.fromiter(kinds.values(), dtype=np.float32, count=len(kinds))
            sums[0] += times @ self.word_vectors[at[:, 0]]
            sums[1] += times @ self.shape_vectors[at[:, 1]]
            unknown += float(times[at[:, 0] == len(self.words)].sum())
            distinct |= kinds.keys()
        mean = sums / n
        return np.concatenate([mean[0], mean[1], np.linalg.norm(mean, axis=1), [np.log1p(n), len(distinct) / n, unknown / n, sum(map(eq, words, islice(words, 1, None))) / n]]).astype(np.float32)


class Network:
    """One hidden layer of rectified units, trained by Adam on cross-entropy; calibrated by a temperature."""

    def __init__(self, seed: int = 5):
        self.rng, self.temperature = np.random.default_rng(seed), 1.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(0, x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.mean, self.sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-4)
        x, held = np.clip((x - self.mean) / self.sd, -8, 8), np.arange(len(x)) % 5 == 4
        r = self.rng
        self.p = [r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        tx, ty = x[~held], y[~held]
        for _ in range(EPOCHS):
            for at in np.array_split(r.permutation(len(tx)), max(1, len(tx) // 128)):
                h, z = self._forward(tx[at])
                dz = (1 / (1 + np.exp(-z)) - ty[at]) / len(at)
                dh = np.outer(dz, self.p[2]) * (h > 0)
                grads = [tx[at].T @ dh + 1e-3 * self.p[0], dh.sum(axis=0), h.T @ dz + 1e-3 * self.p[2], np.array([dz.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if held.any():
            z, t = self._forward(x[held])[1], y[held]
            loss = lambda k: float(np.mean(np.logaddexp(0, z / k) - t * z / k))
            self.temperature = min(np.geomspace(0.3, 6, 60).tolist(), key=loss)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self._forward(np.clip((x - self.mean) / self.sd, -8, 8))[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column) -> list[tuple[bytes, int]]:
    """(id, text, label) of about MAX_ROWS labelled rows and MAX_CHARS characters, all if there are fewer: those whose hash of id and text
    is low enough.  Only texts of over LONGEST characters are passed over."""
    label = base.quoted(label_col)
    named = labels.select(base.quoted(id_col).alias("id"), label.alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
    text = F.coalesce(base.quoted(text_col), F.lit(""))
    rows = docs.filter(usable).select(base.quoted(id_col).alias("id"), text.alias("text"), F.xxhash64(base.quoted(id_col), text).alias("hash"), F.length(text).alias("n")).filter(F.col("n") <= LONGEST)
    labelled = base.checkpoint(rows.select("id", "hash", "n").join(named, "id").distinct())
    n, chars = labelled.select(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = min(1.0, MAX_ROWS / max(1, n), MAX_CHARS / max(1, chars))
    # About MAX_ROWS rows.
    taken = base.checkpoint(labelled.filter(F.shiftrightunsigned("hash", 1) < int((1 << 63) * share)) if share < 1 else labelled)
    texts = rows.join(F.broadcast(taken.select("id", "hash", "label")), ["id", "hash"])
    once = texts.groupBy("id", "hash", "label").agg(F.min("text").alias("text"))
    return sorted((r["id"], r["text"].encode(), int(r["label"])) for r in once.collect())


def fit(rows: list[tuple]) -> tuple[Features, Network] | None:
    if not rows:
        return None
    known: dict[bytes, int] = {}
    texts = []
    for _, t, _ in rows:
        words = t.split()
        for w in words:
            known.setdefault(w, len(known))
        texts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))

    def frequent(names: list, times: np.ndarray) -> tuple[dict, np.ndarray]:
        """Places of the terms seen often enough, and the place of each name."""
        kept = {x: i for i, x in enumerate(sorted(x for x, n in zip(names, times.tolist()) if n >= MIN_COUNT))}
        return kept, np.array([kept.get(x, len(kept)) for x in names], dtype=np.int32)

    times = np.bincount(np.concatenate(texts), minlength=len(known))
    words, word_at = frequent(list(known), times)
    kinds: dict[str, int] = {}
    shape_of = np.array([kinds.setdefault(shape(w), len(kinds)) for w in known], dtype=np.int32)
    del known
    shapes, shape_at = frequent(list(kinds), np.bincount(shape_of, weights=times, minlength=len(kinds)))
    shape_at = shape_at[shape_of]
    vectors = context_vectors([word_at[ids] for ids in texts], list(words)), context_vectors([shape_at[ids] for ids in texts], [x.encode() for x in shapes])
    # A shape is also its own neighbour, so that rare ones stay apart.
    own = np.vstack([index_vectors([x.encode() for x in shapes]), np.zeros((1, DIM), np.float32)]) / np.sqrt(NONZERO)
    features, cache = Features(words, vectors[0], shapes, (vectors[1] + own).astype(np.float32)), {}
    x = np.stack([features.row(t.split(), cache) for _, t, _ in rows])
    return features, Network().fit(x.astype(np.float64), np.array([y for *_, y in rows], dtype=np.float64))


def scored(docs: DataFrame, model, text_col: str = "text", into: str = "__score") -> DataFrame:
    """docs with the probability of label 1 in the column ``into``."""
    # Plain values: broadcasts are unpickled without this package.
    shared = docs.sparkSession.sparkContext.broadcast(model and tuple({k: v for k, v in vars(x).items() if k != "rng"} for x in model))

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, cache = shared.value and (Features(**shared.value[0]), Network()), {}
        if model:
            vars(model[1]).update(shared.value[1])
        for column in columns:
            out = [np.full(len(column), 0.5)] if model is None else []
            for part in kernels.slices(column) if model else ():
                rows = np.stack([model[0].row(t.split(), cache) for t in kernels.texts(part)])
                out.append(model[1].probability(rows.astype(np.float64)))
            yield pa.array(np.concatenate([np.zeros(0), *out]))

    return docs.withColumn(into, score(base.quoted(text_col)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5):
    """A model from labelled rows outside fold 0 of ``folds``."""
    return fit(sample(docs, labels, id_col, text_col, label_col, base.fold(F.col(id_col), folds) != 0))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = scored(docs, train(docs, base.table(spark, sf_dir, "labels")))
    return done.select("doc_id", (base.fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))
