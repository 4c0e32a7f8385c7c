"""Language-model scoring with a log-frequency Bloom filter.

All n-grams (n = 1, 2) of the training texts are counted over the whole input: tasks send sorted 48-bit hashes with
counts to the segment of the hash space that each belongs to, as one block per segment, so a frequent
n-gram is one entry per block.  A segment adds the counts up, quantises them to levels (level j: 2^(j-1) to
2^j - 1) and sets bits for (n-gram, 1), ..., (n-gram, level) in its part of the filter, which has ENTRY_BITS bits for each of these entries: below
1 % of absent entries read as present.  Every n-gram is in the filter at every size.  A filter that can't exceed MAX_BITS is broadcast.  Otherwise chunks of texts send their distinct n-grams,
with 0 for what only texts outside the training set have, to the segments, and a segment fills its part, reads the level of each distinct n-gram once and sends
each chunk a byte for every n-gram it sent; the scores are the same.  A count is read by probing levels until one is absent, and stands for the middle of its level.  The score is the
log10 probability of a text under p(w|v) = LAMBDA * c(vw) / c(v) + (1 - LAMBDA) * (c(w) + 1) / (N + V + 1), or the last
fraction alone if c(v) is 0.

The exact unigram base beside it comes from exact counts: those of the HEAD most frequent tokens are broadcast, those of all
others are joined by a shuffle.

Defined results: a null or empty text is its end token; a null id counts as the text '' for the folds; a very long text is scored whole, by one
task; repeated rows count and are scored each; of tokens with equal counts all or none are in the head, which changes no score; without training
text N and V are 0; an empty table gives an empty result.  Ids keep their type.  Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import base, kernels

HEAD = 200_000
#: Filter bits for each entry, the most bits that are broadcast (256 MB), probes per level, and the most levels.
ENTRY_BITS, MAX_BITS, PROBES, LEVELS = 12, 1 << 31, 4, 40
#: Training tokens per segment, the most segments, tokens whose n-grams are sorted at once, and distinct tokens that a task counts before it sends them.
SEGMENT, MAX_SEGMENTS, BATCH, DISTINCT = 1 << 20, 1 << 16, 1 << 19, 150_000
#: Bytes of text in a chunk, texts longer than LONG times the mean aside, which are put into chunks of fewer; and chunks of a task.
CHUNK, LONG, CHUNKS = 6 << 20, 8, 3
LAMBDA = 0.5
END, START = b"\n", np.uint64(0x9D39247E33776D41)
KEY = np.uint64((1 << 48) - 1)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _count(batches):
    """(token, n): counts of some tokens."""

    def out(n):
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    n: Counter = Counter()
    for whole in batches:
        for batch in kernels.slices(whole, 64):
            for text in kernels.texts(batch.column(0)):
                n.update(tokens(text))
            if len(n) > DISTINCT:
                yield out(n)
                n = Counter()
    if n:
        yield out(n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Head:
    """The frequent tokens: places, log10 of their counts + 1, hashes."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.get = {w: i for i, w in enumerate(words)}.get
        self.logs = np.log10(counts + 1.0)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def hash(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        out = self.hashes[places] if len(self.hashes) else np.zeros(len(words), np.uint64)
        rare = places < 0
        out[rare] = np.fromiter(map(xxhash.xxh3_64_intdigest, compress(words, rare.tolist())), dtype=np.uint64)
        return out


def grams(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the unigrams and the bigrams of a text; the first bigram begins with START."""
    before = np.concatenate([[START], hashes[:-1]])
    return mix(hashes) & KEY, mix(hashes ^ mix(before + np.uint64(1))) & KEY


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> np.uint64(16)) * np.uint64(segments) >> np.uint64(32)


def _send(head, segments: int):
    """(segment, keys, counts): n-gram counts of about BATCH tokens, cut by segment."""

    def run(batches):
        h = Head(*head.value)
        waiting, size = [], 0

        def out():
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            seg = segment_of(keys, segments)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(seg)) + 1])
            ends = np.append(starts[1:], len(keys))
            raw, n = keys.view(np.uint8).reshape(-1, 8)[:, :6], n.astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(seg[starts].astype(np.int64)), pa.array([raw[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["segment", "keys", "counts"])

        for whole in batches:
            for batch in kernels.slices(whole, 64):
                for text in kernels.texts(batch.column(0)):
                    words = tokens(text)
                    waiting += grams(h.hash(words, h.places(words)))
                    size += len(words)
                    if size >= BATCH:
                        yield out()
                        waiting, size = [], 0
        if waiting:
            yield out()

    return run


LOW = np.uint64((1 << 32) - 1)


def halves(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of (n-gram, level)."""
    g = mix(keys + np.uint64(1) + (np.uint64(level) << np.uint64(50)))
    return g & LOW, (g >> np.uint64(32)) | np.uint64(1)


def place(a: np.ndarray, b: np.ndarray, k: int, bits) -> np.ndarray:
    """The k-th bit of an n-gram within its segment, which has so many bits."""
    return (((a + np.uint64(k) * b) & LOW) * bits) >> np.uint64(32)


def totals(parts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a segment, and their counts."""
    blocks = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in parts.column("keys").to_pylist()]
    wide = np.zeros((sum(map(len, blocks)), 8), dtype=np.uint8)
    wide[:, :6] = np.concatenate(blocks)
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in parts.column("counts").to_pylist()])
    keys, where = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
    return keys, np.bincount(where, weights=counts)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, np.floor(np.log2(np.maximum(counts, 0.5))).astype(int) + 1).clip(0)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(level > 0, (3.0 * 2.0 ** (level - 1.0) - 1) / 2, 0.0)


def packed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A segment's part of the filter, in bytes; n-grams counted 0 times set no bit."""
    level = levels(counts)
    bits = max(64, -(-ENTRY_BITS * int(level.sum()) // 8) * 8)
    flags = np.zeros(bits, dtype=np.uint8)
    for j in range(1, level.max() + 1):
        a, b = halves(keys[level >= j], j)
        for k in range(PROBES):
            flags[place(a, b, k, np.uint64(bits))] = 1
    return np.packbits(flags, bitorder="little")


def _fill(key, parts):
    """(segment, bits): a segment's part of the filter."""
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([packed(*totals(parts)).tobytes()], pa.binary())})


class Bloom:
    """The parts of all segments, one behind the other."""

    def __init__(self, parts: dict[int, bytes], segments: int):
        sizes = np.array([len(parts.get(k, b"")) or 8 for k in range(segments)], dtype=np.uint64)
        self.bits, self.first = sizes * np.uint64(8), (np.cumsum(sizes) - sizes) * np.uint64(8)
        self.filter = np.zeros(int(sizes.sum()), dtype=np.uint8)
        for k, part in parts.items():
            at = int(self.first[k]) // 8
            self.filter[at : at + len(part)] = np.frombuffer(part, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        segment = segment_of(keys, len(self.bits)).astype(np.int64)
        return probe(keys, self.filter, self.first[segment], self.bits[segment])


def probe(keys: np.ndarray, filter_: np.ndarray, first: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Levels of distinct n-grams, by probing level after level until one is absent; first, bits: where the segment of each n-gram begins,
    and its size."""
    level, at = np.zeros(len(keys), dtype=np.int8), np.arange(len(keys))
    for j in range(1, LEVELS + 1):
        a, b = halves(keys[at], j)
        for k in range(PROBES):
            p = first[at] + place(a, b, k, bits[at])
            there = (filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at, a, b = at[there], a[there], b[there]
        if not len(at):
            break
        level[at] = j
    return level


def cut(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments that sorted keys belong to, and where the keys of each begin and end."""
    seg = segment_of(keys, segments)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(seg)) + 1])
    return seg[starts].astype(np.int64), starts, np.append(starts[1:], len(keys))


def _ask(head, segments: int):
    """(chunk, segment, keys, counts): the distinct n-grams of a chunk of texts, cut by segment, and how often its training texts have each.

    Keys and counts are sent as the lowest bytes of all, then the next bytes of all, and so on: the high ones compress well, as keys are sorted."""
    kept: dict = {}

    def run(key, rows):
        h = kept.get("head") or kept.setdefault("head", Head(*head.value))
        held = rows.column("held_out").to_pylist()
        found: list = [[], []]
        for at, t in zip(held, kernels.texts(rows.column("text").combine_chunks())):
            words = tokens(t)
            found[at] += grams(h.hash(words, h.places(words)))
        keys, n = np.unique(np.concatenate(found[0] + found[1]), return_counts=True)
        if found[1]:
            other, less = np.unique(np.concatenate(found[1]), return_counts=True)
            n[np.searchsorted(keys, other)] -= less
        seg, starts, ends = cut(keys, segments)
        raw, times = keys.view(np.uint8).reshape(-1, 8)[:, :6], n.astype(np.uint32).view(np.uint8).reshape(-1, 4)
        both = [pa.array([x[a:b].T.tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()) for x in (raw, times)]
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(seg), pa.int64()), "segment": pa.array(seg), "keys": both[0], "counts": both[1]})

    return run


def _answer(key, asked):
    """(chunk, segment, levels): a segment's part of the filter is filled with the counts that came with the questions, and read for each n-gram."""
    blocks, times = ([np.frombuffer(x, np.uint8).reshape(n, -1).T for x in asked.column(c).to_pylist()] for c, n in (("keys", 6), ("counts", 4)))
    ends = np.cumsum([len(x) for x in blocks]).tolist()
    wide = np.zeros((ends[-1], 8), dtype=np.uint8)
    wide[:, :6] = np.concatenate(blocks)
    keys, where = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
    own = packed(keys, np.bincount(where, weights=np.ascontiguousarray(np.concatenate(times)).view(np.uint32).ravel()))
    level = probe(keys, own, np.zeros(len(keys), np.uint64), np.full(len(keys), 8 * len(own), np.uint64))[where]
    return pa.table({"chunk": asked.column("chunk"), "segment": asked.column("segment"), "levels": pa.array([level[a:b].tobytes() for a, b in zip([0, *ends], ends)], pa.binary())})


def _score_asked(head, segments: int, total: int, kinds: int, names: list[str]):
    """Scores of a chunk of texts from the answers to it."""
    kept: dict = {}

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        h = kept.get("head") or kept.setdefault("head", Head(*head.value))
        batches = rows.select(["uid", "doc", "held_out", "text"]).combine_chunks().to_batches()
        # Words of large chunks aren't kept.
        parts = [part for whole in batches for part in _split(h, whole)] if rows.column("text").nbytes <= 2 * CHUNK else None
        split = lambda: iter(parts) if parts else (part for whole in batches for part in _split(h, whole))
        keys, where = np.unique(np.concatenate([x for part in split() for x in part[3:]]), return_inverse=True)
        read = answers.sort_by("segment").column("levels").to_pylist()
        _, starts, ends = cut(keys, segments)
        if [len(x) for x in read] != (ends - starts).tolist():
            raise ValueError("the texts of a chunk changed between two reads of the table")
        counts = middle(np.frombuffer(b"".join(read), np.int8).astype(float))

        def counted():
            at = 0
            for batch, words, places, ones, twos in split():
                end = at + 2 * len(ones)
                yield batch, words, places, *counts[where[at:end]].reshape(2, -1)
                at = end

        return pa.Table.from_batches(_scores(h, total, kinds, names, counted()))

    return run


ROWS = "uid long, doc {0}, held_out boolean, n_tokens long, known long, logs double, score double, token binary, n long"


def _score(head, filter_, total: int, kinds: int, names: list[str]):
    def run(batches):
        h, bloom = Head(*head.value), Bloom({}, 1)
        vars(bloom).update(filter_.value)

        def read(keys):
            """Counts with each distinct n-gram probed once: frequent ones have many levels."""
            kinds, where = np.unique(keys, return_inverse=True)
            return middle(bloom.levels(kinds).astype(float))[where]

        frequent = read(mix(h.hashes) & KEY)

        def counted():
            for whole in batches:
                for batch, words, places, ones, twos in _split(h, whole):
                    flat = np.concatenate(places)
                    seen = flat >= 0
                    one = np.zeros(len(flat))
                    one[seen], one[~seen] = frequent[flat[seen]], read(ones[~seen])
                    yield batch, words, places, one, read(twos)

        yield from _scores(h, total, kinds, names, counted())

    return run


def _split(h: Head, whole: pa.RecordBatch):
    """(rows, their words, places of these in the head, all unigrams, all bigrams) of some texts at a time."""
    for batch in kernels.slices(whole, 384):
        words = [tokens(t) for t in kernels.texts(batch.column(3))]
        places = [h.places(w) for w in words]
        pairs = [grams(h.hash(w, p)) for w, p in zip(words, places)]
        if words:
            yield batch, words, places, *(np.concatenate([p[k] for p in pairs]) for k in (0, 1))


def _scores(h: Head, total: int, kinds: int, names: list[str], parts):
    """A row for each text with what the head and the filter give, and a row for each distinct token outside the head.

    parts: some rows at a time, their words, places of these in the head, counts of all unigrams and of all bigrams."""
    for batch, words, places, one, two in parts:
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size) - size
        flat = np.concatenate(places)
        seen = flat >= 0
        # The count of the word before; texts begin with START, which is counted as often as END.
        before = np.concatenate([[0.0], one[:-1]])
        before[begin] = one[begin + size - 1]
        share = np.where(before > 0, np.minimum(1.0, two / np.maximum(before, 1)), 0.0)
        smooth = (one + 1) / (total + kinds + 1)
        p = np.where(before > 0, LAMBDA * share + (1 - LAMBDA) * smooth, smooth)
        score = np.add.reduceat(np.log10(p), begin)
        logs = np.add.reduceat(np.where(seen, h.logs[flat] if len(h.logs) else 0.0, 0.0), begin)
        known = np.add.reduceat(seen.astype(np.int64), begin)
        null = lambda m, t: pa.nulls(m, t)
        m, kind = len(words), batch.column(1).type
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(size), pa.array(known), pa.array(logs), pa.array(score), null(m, pa.binary()), null(m, pa.int64())], names=names)
        at, rare, times = [], [], []
        for i, (w, p) in enumerate(zip(words, places)):
            n = Counter(compress(w, (p < 0).tolist()))
            at += [i] * len(n)
            rare += n
            times += n.values()
        if at:
            m = len(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), null(m, kind), null(m, pa.bool_()), null(m, pa.int64()), null(m, pa.int64()), null(m, pa.float64()), null(m, pa.float64()), pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=names)


def frequent(counts: DataFrame) -> DataFrame:
    """The most frequent tokens, HEAD at most: those from a count on, found from numbers of tokens by steps of the counts' logarithm."""
    step = F.floor(16 * F.log2("n")).cast("int")
    least, taken = 1 << 30, 0
    for row in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        if (taken := taken + row["count"]) > HEAD:
            break
        least = row["s"]
    return counts.filter(step >= least)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; training: which rows to learn from.

    Computed at once, so that the filter can be taken off the workers again.
    """
    with base.small_batches(docs.sparkSession):
        return _computed(docs, training, id_col, text_col)


def _computed(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(base.quoted(text_col), F.lit(""))
    learn = docs.filter(training).select(text.alias("text"))
    counts = base.checkpoint(learn.mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))
    size = F.col("n") * (F.octet_length("token") + 1)
    total, kinds, most, texts, read = counts.select(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n") + F.sum(F.floor(F.log2("n")) + 1), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("token") == F.lit(END), F.col("n"))), F.lit(0)), F.coalesce(F.sum(size), F.lit(0)),
    ).first()
    top = frequent(counts).toPandas()
    head = sc.broadcast(([bytes(x) for x in top["token"]], top["n"].to_numpy(dtype=np.float64)))
    segments = min(MAX_SEGMENTS, max(1, -(-total // SEGMENT)))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), base.quoted(id_col).alias("doc"), (~training).alias("held_out"), text.alias("text"))
    schema = ROWS.format(base.kind(docs, id_col))
    names = [c.split()[0] for c in ROWS.split(", ")]
    shared = None
    if ENTRY_BITS * most <= MAX_BITS:
        # A filter that is MAX_BITS at most even if no bigram occurs twice; plain values, as broadcasts are unpickled without this package.
        sent = learn.mapInArrow(_send(head, segments), "segment long, keys binary, counts binary").repartition(segments, "segment")
        parts = base.checkpoint(sent.groupBy("segment").applyInArrow(_fill, "segment long, bits binary"))
        shared = sc.broadcast(vars(Bloom({r["segment"]: r["bits"] for r in parts.toLocalIterator()}, segments)))
        rows = rows.mapInArrow(_score(head, shared, total, kinds, names), schema)
    else:
        mean = read / texts
        exponent = min(12, max(0, round(math.log2(CHUNK / mean))))
        finer = F.least(F.lit(exponent), F.greatest(F.lit(0), F.ceil(F.log2((F.octet_length("text") + 1) / (LONG * mean))).cast("int")))
        # Both readers take the same columns, so that there is one exchange of texts.
        chunk = F.expr(f"shiftleft(shiftright(uid, {exponent} - finer), 4) + finer")
        tasks = max(1, -(-read * 7 // (6 * CHUNK * CHUNKS)))
        dealt = rows.withColumn("finer", finer).withColumn("chunk", chunk).drop("finer").repartition(tasks, "chunk").groupBy("chunk")
        asked = dealt.applyInArrow(_ask(head, segments), "chunk long, segment long, keys binary, counts binary").repartition(segments, "segment")
        answers = asked.groupBy("segment").applyInArrow(_answer, "chunk long, segment long, levels binary").repartition(tasks, "chunk")
        rows = dealt.cogroup(answers.groupBy("chunk")).applyInArrow(_score_asked(head, segments, total, kinds, names), schema)
    # Tokens outside the head are joined with their counts; texts' own rows have no token and keep none.
    joined = rows.join(counts.select(F.col("token").alias("__token"), F.col("n").alias("c")), F.col("token") == F.col("__token"), "left")
    done = joined.groupBy("uid").agg(
        F.max("doc").alias("doc"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"),
        (F.sum(F.coalesce("known", F.lit(0))) + F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum(F.coalesce("logs", F.lit(0.0))) + F.sum(F.when(F.col("c").isNotNull(), F.col("n") * F.log10(F.col("c") + 1.0)).otherwise(0.0))).alias("logs"),
    )
    base_score = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))
    out = base.checkpoint(done.select("doc", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score"))
    for broadcast in filter(None, (head, shared)):
        broadcast.destroy()
    return out


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, base.fold(F.col("doc_id"), 7) != 2).withColumnRenamed("doc", "doc_id")
