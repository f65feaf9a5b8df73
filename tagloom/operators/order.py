"""The place of every row in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, order: list[Column], folder: str, parts: int | None = None) -> DataFrame:
    """The rows with ``rank``, from 1, by an order in which no two rows are equal.

    Spark samples the rows for splitters and deals them out by ranges; each part is sorted and written with its places in the part.
    What a part's places begin at is the sum of the parts before it: a running sum over as many rows as there are parts.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    number = F.monotonically_increasing_id()  # the part in its upper 31 bits, the place in the part below
    dealt.sortWithinPartitions(*order).withColumn("__at", number).write.parquet(folder)
    placed = spark.read.schema(dealt.withColumn("__at", number).schema).parquet(folder).withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # a row for each part
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), "__part").withColumn("rank", F.col("__before") + place + 1).drop("__at", "__part", "__before")
