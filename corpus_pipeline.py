"""From raw documents to packed token sequences: five stages, each over all that the one before kept.

run(spark, sf_dir) gives a row for each piece of each kept document. SQL can't express language identification or
packing by differencing, so there is no ORACLE_SQL; tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.llm import decontamination, jaccard_join, language, line_dedup, packing
from stratavec.llm.common import discard, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of an Arrow batch between Spark and Python: bounds both sides' memory where texts are long.
BATCH_BYTES = 4 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """The columns of documents; batches to Python are kept small from here on.

    The session keeps that setting: Spark reads it when a stage's result is computed, after the stage's function.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in none of the languages that the labelled ones are in (no letters, or unknown n-grams)."""
    docs = bounded(docs)
    return language.accepted(docs, language.fit(language.training_rows(docs)))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that three documents or more share, but in the last of them; n_chars counts what is left."""
    out = line_dedup.line_dedup(bounded(docs), carry=("lang", "source", "n_chars"))
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("rest.n_chars"))
    return out.select("doc_id", "text", "rest.lang", "rest.source", chars.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, Jaccard index of 0.8): the smallest doc_id."""
    return jaccard_join.representatives(bounded(docs), 5, 80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark."""
    return decontamination.decontaminate(bounded(docs), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(bounded(docs))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
