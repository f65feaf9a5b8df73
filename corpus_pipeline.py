"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
Poor documents go, one document of each near-duplicate group stays, documents that hold a benchmark item go, secrets are
masked in place, and the token pieces of what is left are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import decontamination, neardup, packing, quality, secrets
from tagloom.llm.common import durable, table
from tagloom.llm.queries import TOKENIZER


ROWS = 500  # documents that pass between the JVM and Python at a time: five stages share the executors' memory
SLICE = 1 << 20  # bytes of text that a worker encodes at a time, for the same reason


def lean(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts; rows are matched by id and text, so any repeated ids keep their own verdicts."""
    lean(spark)
    return quality.keep_predicted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates; texts without words stay, rows without an id go before those with one."""
    lean(spark)
    return neardup.keep_one(docs, words=5, percent=80)  # the usual law for stages on shingles; op9's contract has its own


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item."""
    lean(spark)
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts masked and n_chars counted anew where a text changed."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece of each row, with its place in a sequence; a null text is one piece with the end id."""
    lean(spark)
    return packing.pack_sum_of_squares(docs, TOKENIZER, slice_bytes=SLICE)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# Trained models and tokenizers are beyond SQL; tests hold every stage against brute force on the smallest tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs, f"stage-{name}")
    return docs
