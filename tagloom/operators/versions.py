"""Applying previews, guarded writes, undo and restore as joins between snapshots; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(frame: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return frame.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def apply_status(previewed: DataFrame, current: DataFrame) -> DataFrame:
    """caption_path, status, content: error, skipped, conflict (the caption changed meanwhile) or applied."""
    now = current.select(F.col("caption_path").alias("p"), F.col("caption").alias("current"))
    joined = previewed.join(now, F.col("caption_path") == F.col("p"), "left")
    status = F.when(F.col("error").isNotNull(), "error").when(~F.col("changed"), "skipped").when(~F.col("current").eqNullSafe(F.col("before")), "conflict").otherwise("applied")
    return joined.select("caption_path", status.alias("status"), F.when(status == "applied", F.col("after")).otherwise(F.col("current")).alias("content"))


def new_versions(results: DataFrame, done: str, source: str, batch: str | None) -> DataFrame:
    """results(caption_path, status, content, before) -> the version rows that a write leaves: one for each caption it changed."""
    return results.where(F.col("status") == done).select("caption_path", F.col("before").alias("old_content"), F.col("content").alias("new_content"), F.lit(source).alias("source"), F.lit(batch).cast("string").alias("batch_id"))


def apply_edit(previewed: DataFrame, current: DataFrame, batch: str, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statuses, version rows) of a batch; applied(batch_id): a batch that is listed there is not applied again."""
    again = applied.where(F.col("batch_id") == batch).agg((F.count("*") > 0).alias("__done"))
    once = previewed.crossJoin(F.broadcast(again)).where("not __done").drop("__done")  # one row is broadcast
    results = apply_status(once, current).join(once.select("caption_path", "before"), "caption_path")
    return results.drop("before"), new_versions(results, "applied", "batch_edit", batch)


def manual_save(current: DataFrame, saves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """saves(caption_path, before, after, source): (statuses, version rows) of guarded writes; a blank source is manual."""
    results = guarded_write(current, saves)
    rows = results.join(saves, "caption_path").where("status = 'written'")
    source = F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "manual").otherwise(F.col("source"))
    return results, rows.select("caption_path", F.col("before").alias("old_content"), F.col("after").alias("new_content"), source.alias("source"), F.lit(None).cast("string").alias("batch_id"))


def apply_counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("applied", "skipped", "error", "conflict")])


def guarded_write(current: DataFrame, writes: DataFrame) -> DataFrame:
    """writes(caption_path, before, after): rejected where the current text isn't ``before``, no-op where nothing changes."""
    joined = writes.join(current.select("caption_path", "caption"), "caption_path", "left")
    status = F.when(~F.col("caption").eqNullSafe(F.col("before")), "rejected").when(F.col("before") == F.col("after"), "no_op").otherwise("written")
    return joined.select("caption_path", status.alias("status"), F.when(status == "written", F.col("after")).otherwise(F.col("caption")).alias("content"))


def batch_ends(versions: DataFrame, batch: str) -> DataFrame:
    """For each path of a batch its first old and last new content; undo rows don't count."""
    own = versions.where((F.col("batch_id") == batch) & (F.col("source") != "undo"))
    return own.groupBy("caption_path").agg(F.min_by("old_content", "id").alias("first_old"), F.max_by("new_content", "id").alias("last_new"))


def undo_batch(versions: DataFrame, current: DataFrame, batch: str) -> DataFrame:
    """caption_path, status, content: restored where the caption is as the batch left it, skipped where already undone."""
    joined = batch_ends(versions, batch).join(current.select("caption_path", "caption"), "caption_path", "left")
    now = F.col("caption")
    status = F.when(now.isNull(), "error").when(now == F.col("last_new"), F.when(now == F.col("first_old"), "skipped").otherwise("restored")).when(now == F.col("first_old"), "skipped").otherwise("conflict")
    return joined.select("caption_path", status.alias("status"), F.when(status == "restored", F.col("first_old")).otherwise(now).alias("content"))


def restore_version(versions: DataFrame, current: DataFrame, picked: Column) -> DataFrame:
    """Captions after the picked versions' old content is written back; of several for a path the newest counts."""
    targets = latest(versions.where(picked), "caption_path", F.col("id").desc()).select("caption_path", "id", "old_content")
    return current.join(targets, "caption_path").select("caption_path", F.col("id").alias("version_id"), F.col("old_content").alias("content"), (F.col("caption") != F.col("old_content")).alias("changed"))


def undo_rows(versions: DataFrame, current: DataFrame, batch: str) -> DataFrame:
    """The version rows that undoing a batch leaves: one for each restored caption."""
    done = undo_batch(versions, current, batch).join(current.select("caption_path", F.col("caption").alias("before")), "caption_path")
    return new_versions(done, "restored", "undo", batch)


def restore_rows(versions: DataFrame, current: DataFrame, picked: Column) -> DataFrame:
    """The version rows that restoring leaves: one for each caption that changes, of no batch."""
    back = restore_version(versions, current, picked).join(current.select("caption_path", F.col("caption").alias("before")), "caption_path")
    return new_versions(back.withColumn("status", F.when(F.col("changed"), "written")), "written", "undo", None)


def version_history(versions: DataFrame, per_path: int = 200) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("caption_path").orderBy(F.col("id").desc())).cast("long")
    return versions.withColumn("rank", rank).where(F.col("rank") <= per_path)


def newest_versions(versions: DataFrame, most: int = 500) -> DataFrame:
    """The newest rows over all paths; sorting and limit run as one distributed top-k."""
    return versions.orderBy(F.desc("id")).limit(most)


def journal_reconcile(journal: DataFrame, current: DataFrame, versions: DataFrame) -> DataFrame:
    """Pending writes: with their version row the content must be ``after``, without it ``before``; anything else is repaired."""
    known = versions.select(F.col("id").alias("version_id"), F.lit(True).alias("recorded"))
    joined = journal.join(known, "version_id", "left").join(current.select("caption_path", "caption"), "caption_path", "left")
    wanted = F.when(F.col("recorded"), F.col("after_content")).otherwise(F.col("before_content"))
    action = F.when(F.col("caption").eqNullSafe(wanted), "none").when(F.col("recorded"), "reapply").otherwise("roll_back")
    return joined.select("id", "caption_path", action.alias("action"), F.when(F.col("recorded"), "applied").otherwise("rolled_back").alias("state"))


def unreferenced(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Dimension rows that no fact names: only these may be deleted."""
    return dimension.join(facts.select(key).distinct(), key, "left_anti")


def upsert_latest(*frames: DataFrame, key: str, stamp: str) -> DataFrame:
    """Insert or replace by key: the newest row of each key over all frames."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return latest(out, key, F.col(stamp).desc())
