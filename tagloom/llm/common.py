"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 2000  # rows that pass between the JVM and Python at a time: whole texts may be long


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators read; a null text counts as an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a single machine whose session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tagloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


WRITTEN: list[str] = []  # folders that durable() wrote and nothing has removed yet


def durable(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the frame into the shared folder once and read it from there.

    What was written stays for as long as a result may read it; ``clean`` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Remove the folders written by ``durable`` from the given place of WRITTEN on; call it once their results are stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while len(WRITTEN) > since:
        path = hadoop(WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SAMPLE_BYTES = 64 << 20  # of the texts that a training sample brings to the driver


def that_fit(rows: list, most_bytes: int) -> list:
    """The rows, in their order, whose ``size`` still fits into what those before them left; a row that doesn't fit is passed over."""
    out, left = [], most_bytes
    for row in rows:
        if row["size"] <= left:
            out.append(row)
            left -= row["size"]
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, so that helper columns never clash with its own."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def has_checkable_fold(df: DataFrame, folds: int = 5) -> DataFrame:
    """held_out: crc32 of the id as text leaves no remainder on division by the fold count."""
    return df.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0)


BROADCAST_ROWS = 200_000  # ids beyond this number are shuffled instead


def matching(docs: DataFrame, key: Column, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of the documents, by a key, with a table of one column.

    The ids are counted: few are broadcast, so texts stay where they are; many are shuffled. Columns keep their names.
    """
    mine = unused(docs, "__key")
    theirs = unused(docs, "__id")
    other = ids.toDF(theirs)
    other = F.broadcast(other) if ids.count() <= BROADCAST_ROWS else other
    return docs.withColumn(mine, key).join(other, F.col(mine) == F.col(theirs), how).drop(mine)
