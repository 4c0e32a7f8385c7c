"""The corpus pipeline: from documents to a training mix.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns their columns, whatever their names; its result is
written as Parquet and read again as the next one's docs.  Each works on whole texts, however long, and gives an empty
table for an empty one.  Columns that a stage needs for itself get names that docs doesn't use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import base, classifier, decontam, jaccard, linededup, mixing, simhash

#: The score from which on a document counts as good.
QUALITY = 0.3
#: Documents from which on lines of over 50 words stay in the first one only.
PASSAGE_DOCS = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects.

    A null text is scored as an empty one; null ids and labels teach nothing; rows that repeat a text get its score each; a score of just
    QUALITY stays; without labels all rows stay.
    """
    (score,) = base.unused(docs.columns, "__score")
    model = classifier.train(docs, base.table(spark, sf_dir, "labels"))
    return classifier.scored(docs, model, into=score).filter(F.col(score) >= QUALITY).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more hold, two for lines of over 50 words, except where they occur first; every document stays.

    First is the smallest id (null before all; ids that aren't integers by their hash), then text hash, then line.  A null or empty text
    stays as it is; a document may lose all its lines and is the empty text then; rows that repeat an id and a text are one document and
    lose the same lines.  n_chars, if it is there, follows the text.
    """
    (into,) = base.unused(docs.columns, "__lines")
    done = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs, keep_first=True, passage_docs=PASSAGE_DOCS), into=into)
    changed = F.col(f"{into}.n_dropped") > 0
    text = F.when(changed, F.col(f"{into}.kept")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(F.col(f"{into}.kept")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*(new[c].alias(c) if c in new else base.quoted(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: similarity of 0.8 or more by sets of five-word shingles.

    That with the smallest id stays (null last, then by text hash; of rows that repeat an id and a text that with the smallest other
    columns).  Null texts, empty ones and those of white space are one class.
    """
    return simhash.representatives(docs, classes=jaccard.near_duplicates)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all words of a shorter one.

    A null or empty text holds none and stays; rows that repeat a text go or stay together; items without words match nothing.
    """
    return decontam.uncontaminated(docs, base.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents, so that sources have their weights.

    A null source is one of its own, last in order; a null or empty text has no words and goes as its source's key says; rows that repeat
    an id and a text, and so tie, are repeated alike.
    """
    (into,) = base.unused(docs.columns, "__mix")
    return mixing.repeated(mixing.mix(docs, into=into), into)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]
#: No SQL has the classifier or the fingerprints; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    folder, last = base.scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            base.remove(spark, last)
        last = path
    return docs
