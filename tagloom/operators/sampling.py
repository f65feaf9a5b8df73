"""Samples, bucket moves and multi-round selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import natural_key
from tagloom.operators.versions import latest


def caption_of(path: Column) -> Column:
    """The text beside an image."""
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(".txt"))


def random_sample(items: DataFrame, k: int, seed: str) -> DataFrame:
    """k rows by hash of id and seed: the same rows on every run and cluster, found as a distributed top-k."""
    return items.orderBy(F.md5(F.concat(F.col("item_id").cast("string"), F.lit(seed))), "item_id").limit(k)


def sampled_and_rest(items: DataFrame, k: int, seed: str) -> DataFrame:
    """All items with ``sampled``: whether they are among the k of random_sample."""
    drawn = random_sample(items, k, seed).select(F.col("item_id").alias("__d"))
    return items.join(drawn, F.col("item_id") == F.col("__d"), "left").withColumn("sampled", F.col("__d").isNotNull()).drop("__d")


def split(items: DataFrame, kept: DataFrame) -> DataFrame:
    """item_id, bucket: kept by path regardless of case, rest otherwise."""
    marks = kept.select(F.lower("caption_path").alias("p"), F.lit("kept").alias("bucket")).distinct()
    return items.join(marks, F.lower(items.caption_path) == marks.p, "left").select("item_id", F.coalesce("bucket", F.lit("rest")).alias("bucket"))


def dedupe_paths(items: DataFrame) -> DataFrame:
    """The first row of each path regardless of case."""
    return latest(items.withColumn("__p", F.lower("caption_path")), "__p", F.col("item_id")).drop("__p")


def next_round(decisions: DataFrame, round_: int, target: int) -> DataFrame:
    """Candidates of the following round: the kept ones, if they are still more than the target."""
    kept = decisions.where((F.col("round") == round_) & F.col("keep"))
    count = kept.agg(F.count("*").alias("n"))
    return kept.crossJoin(F.broadcast(count)).where(F.col("n") > target).select("item_id", (F.col("round") + 1).alias("round"))  # one row is broadcast


def final_ranking(decisions: DataFrame, target: int) -> DataFrame:
    """Per round the best ``target`` decisions: by score (50 for a kept, 0 for a rejected one without), kept first, name."""
    score = F.coalesce(F.col("score").cast("double"), F.when(F.col("keep"), 50.0).otherwise(0.0))
    order = Window.partitionBy("round").orderBy(F.col("s").desc(), F.col("keep").desc(), natural_key(F.col("file_name")), "item_id")
    return decisions.withColumn("s", score).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= target).select("round", "rank", "item_id", F.col("s").alias("score"), "keep")


def relocations(images: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """images(path, action) with action keep, reject, return or reset; files(path): all that is there, captions too.

    -> path, action, target, caption_target, status. An image takes its caption along (null: it has none). ``blocked``: the
    target is there, or that of the caption; a reset is blocked by any caption at the target. ``same``: already there.
    ``outside``: not below the root, or for return and reset in none of the two buckets. Of several images for one target the
    first moves, those of .selected before those of .rejected, then by path.
    """
    base = re.escape(root.rstrip("/"))
    inner = F.regexp_extract("path", rf"^{base}/(?:\.selected/|\.rejected/)?(.+)$", 1)
    boxed, back = F.col("path").rlike(rf"^{base}/\.(?:selected|rejected)/."), F.col("action").isin("return", "reset")
    folder = F.when(F.col("action") == "keep", ".selected/").when(F.col("action") == "reject", ".rejected/").otherwise("")
    target = F.when((inner != "") & (~back | boxed), F.concat(F.lit(f"{root.rstrip('/')}/"), folder, inner))
    rows = images.withColumn("target", target).withColumn("__own", caption_of(F.col("path"))).withColumn("__new", caption_of(F.col("target")))
    for column, flag in (("target", "__there"), ("__own", "__captioned"), ("__new", "__taken")):
        known = files.select(F.col("path").alias(f"{flag}_path")).distinct()
        rows = rows.join(known, F.coalesce(column, "path") == F.col(f"{flag}_path"), "left").withColumn(flag, F.col(f"{flag}_path").isNotNull()).drop(f"{flag}_path")
    stuck = F.col("__there") | (F.col("__taken") & (F.col("__captioned") | (F.col("action") == "reset")))
    status = F.when(F.col("target").isNull(), "outside").when(F.col("target") == F.col("path"), "same").when(stuck, "blocked").otherwise("moved")
    turn = Window.partitionBy(F.coalesce("target", "path"), F.col("status") == "moved").orderBy(~F.col("path").contains("/.selected/"), "path")
    rows = rows.withColumn("status", status).withColumn("__turn", F.row_number().over(turn))
    late = (F.col("status") == "moved") & (F.col("__turn") > 1)
    return rows.select("path", "action", "target", F.when(F.col("__captioned"), F.col("__new")).alias("caption_target"), F.when(late, "blocked").otherwise(F.col("status")).alias("status"))


def retention_deletions(names: DataFrame, keep: int, group: str) -> DataFrame:
    """Names older than the newest ``keep`` of their group. Only these are ranked: each task keeps ``keep`` names of a group before
    the shuffle, and all rows are compared with one name for each group."""
    newest = F.row_number().over(Window.partitionBy(group).orderBy(F.col("name").desc()))
    top = names.select(group, "name").withColumn("__n", newest).where(F.col("__n") <= keep)
    oldest = top.groupBy(F.col(group).alias("__g")).agg(F.min("name").alias("__oldest"))
    return names.join(oldest, F.col(group).eqNullSafe(F.col("__g"))).where(F.col("name") < F.col("__oldest")).drop("__g", "__oldest")


def retention_plan(names: DataFrame, keep: int, group: str) -> DataFrame:
    """Names beyond the newest ``keep`` of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("name").desc()))
    return names.withColumn("rank", rank.cast("long")).where(F.col("rank") > keep)
