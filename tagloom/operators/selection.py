"""Selection in rounds to the end: buckets, what a round leaves undecided, pauses, and what people decide by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import natural_key
from tagloom.operators.versions import latest

# What stands beside a decision of a person.
KEPT_BY_HAND, REJECTED_BY_HAND, RETURNED = "用户手动决定保留", "用户手动决定筛除", "已退回待分析区"
MOST_ROUNDS = 10


def place_in_ranking(decided: DataFrame, most: int) -> DataFrame:
    """item_id of the best ``most`` decisions: by score as it is (50 for a kept, 0 for a rejected one without), kept first, name."""
    score = F.coalesce(F.col("score").cast("double"), F.when(F.col("keep"), 50.0).otherwise(0.0))
    return decided.orderBy(score.desc(), F.col("keep").desc(), natural_key(F.col("file_name")), "item_id").limit(most).select("item_id")


def open_target(items: DataFrame, kept: DataFrame, target: int) -> int:
    """How many are still to be kept: no more than there are candidates, and none once the target is reached."""
    return max(0, min(target - kept.count(), items.count()))


def run_rounds(items: DataFrame, decisions: DataFrame, target: int, rounds: int, durable: Callable[[DataFrame], DataFrame], kept: DataFrame | None = None) -> DataFrame:
    """item_id, bucket (kept, rejected, uncertain), round of the last look at each item.

    items(item_id, file_name) are the candidates, decisions(item_id, round, keep, score) what each round from 1 on said of them; a
    candidate without a decision stays uncertain. ``kept`` holds what was kept before: it counts for the target. While a round keeps
    more than the target and rounds are left, what it kept is looked at again; the last round keeps its best. Frontiers are written
    by ``durable``; only two counts a round reach the driver.
    """
    goal = open_target(items, kept, target) if kept is not None else min(target, items.count())
    frontier, out = items.select("item_id", "file_name"), None
    for number in range(1, min(max(rounds, 1), MOST_ROUNDS) + 1):
        said = decisions.where(F.col("round") == number).select(F.col("item_id").alias("__i"), "keep", "score")
        looked = durable(frontier.join(said, F.col("item_id") == F.col("__i"), "left").select("item_id", "file_name", "keep", "score"))
        decided = looked.where("keep is not null")
        last = number == min(max(rounds, 1), MOST_ROUNDS) or looked.where("keep").count() <= goal
        if last:
            best = place_in_ranking(decided, goal).withColumn("__best", F.lit(True)).withColumnRenamed("item_id", "__b")
            bucket = F.when(F.col("keep").isNull(), "uncertain").when(F.col("__best"), "kept").otherwise("rejected")
            rows = looked.join(best, F.col("item_id") == F.col("__b"), "left").select("item_id", bucket.alias("bucket"), F.lit(number).alias("round"))
            return rows if out is None else out.unionByName(rows)
        gone = looked.where(~F.coalesce("keep", F.lit(False))).select("item_id", F.when(F.col("keep").isNull(), "uncertain").otherwise("rejected").alias("bucket"), F.lit(number).alias("round"))
        out = gone if out is None else out.unionByName(gone)
        frontier = looked.where("keep").select("item_id", "file_name")
    raise AssertionError("the last round returns")


def resumed(candidates: DataFrame, analyzed: DataFrame) -> DataFrame:
    """What a paused round still has to look at: its candidates without those that came to any end but a cancellation."""
    done = analyzed.where("status <> 'cancelled'").select(F.col("item_id").alias("__i")).distinct()
    return candidates.join(done, F.col("item_id") == F.col("__i"), "left_anti")


def decided_by_hand(decisions: DataFrame, manual: DataFrame) -> DataFrame:
    """decisions(item_id, keep, reason) under manual(item_id, at, keep), the latest for each item: keep, reason, status, by.

    A verdict of null takes an item back: nothing is decided about it then, whatever the model said.
    """
    last = latest(manual, "item_id", F.col("at").desc()).select(F.col("item_id").alias("__i"), F.col("keep").alias("__keep"))
    rows, hand = decisions.join(last, F.col("item_id") == F.col("__i"), "left"), F.col("__i").isNotNull()
    keep = F.when(hand, F.col("__keep")).otherwise(F.col("keep"))
    said = F.when(F.col("__keep").isNull(), RETURNED).when(F.col("__keep"), KEPT_BY_HAND).otherwise(REJECTED_BY_HAND)
    status = F.when(keep.isNull(), "pending").when(keep, "succeeded").otherwise("skipped")
    return rows.select("item_id", keep.alias("keep"), F.when(hand, said).otherwise(F.col("reason")).alias("reason"), status.alias("status"), F.when(hand, "manual").otherwise("model").alias("by"))


def retained(jobs: DataFrame, buckets: DataFrame, keep: tuple[str, ...] = ("kept", "uncertain")) -> DataFrame:
    """The jobs of the buckets that stay, as a new list: with a caption they have succeeded, else they wait; errors and refusals go."""
    from tagloom.functions.text import utrim

    own = buckets.where(F.col("bucket").isin(*keep)).select(F.col("item_id").alias("__i")).distinct()
    rows = jobs.join(own, F.col("item_id") == F.col("__i"), "left_semi").withColumn("status", F.when(utrim(F.col("caption")) != "", "succeeded").otherwise("pending"))
    for column, kind in (("error", "string"), ("error_kind", "string"), ("refusal", dict(jobs.dtypes).get("refusal", "string"))):
        rows = rows.withColumn(column, F.lit(None).cast(kind))
    return rows.withColumn("selected", F.lit(False))


def partition_check(items: DataFrame, buckets: DataFrame) -> DataFrame:
    """One row: items, how many are in each bucket, in none (lost), in several (twice), and bucket rows of no item (foreign)."""
    each = buckets.groupBy(F.col("item_id").alias("__i")).agg(F.countDistinct("bucket").alias("n"), *[F.max((F.col("bucket") == b).cast("int")).alias(b) for b in ("kept", "rejected", "uncertain")])
    own = items.select("item_id").distinct().withColumn("__here", F.lit(True))
    both = own.join(each, F.col("item_id") == F.col("__i"), "full")
    count = lambda c, name: F.count_if(c).alias(name)
    return both.agg(count(F.col("__here"), "total"), *[count(F.col("__here") & (F.col(b) == 1), b) for b in ("kept", "rejected", "uncertain")], count(F.col("__here") & F.col("__i").isNull(), "lost"), count(F.col("n") > 1, "twice"), count(F.col("__here").isNull(), "foreign"))
