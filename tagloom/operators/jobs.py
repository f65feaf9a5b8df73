"""Filters, scopes and merges over job lists, logs and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import masked, utrim

NO_KEYS = "所有叠加渠道都没有可用 API Key"  # fixed value: what a task without any usable channel says
RETRYABLE = ("failed", "refused", "cancelled")


# What a list shows for states, kinds of error and sources of a version.
STATUS_LABELS = {
    "pending": "等待", "running": "处理中", "succeeded": "已完成", "revised": "已修订",
    "no_response": "无响应", "refused": "疑似拒绝", "failed": "失败", "skipped": "已跳过", "cancelled": "已取消",
}
ERROR_LABELS = {
    "rate_limit": "限流", "auth": "认证失败", "quota": "额度用尽", "transient": "网络错误", "prompt_rejected": "提示词被拒", "truncated": "响应截断", "length_reduced": "长度骤减",
    "empty_reply": "空响应", "write_error": "写入失败", "no_key": "无可用 Key", "download_failed": "模型下载失败", "fatal": "请求失败", "cancelled": "已取消",
}
SOURCE_LABELS = {"manual": "手动编辑", "batch_edit": "批量编辑", "revision": "模型修订", "undo": "撤销恢复"}


def label_of(code: Column, labels: dict[str, str]) -> Column:
    """A code's label, or the code itself where there is none."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def has(needle: str, *columns: str) -> Column:
    """Whether any column holds the trimmed needle, without regard to case; a blank needle is in every row."""
    low = needle.strip().lower()
    found = F.lit(not low)
    for c in columns:
        found = found | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(low)
    return found


def chosen(jobs: DataFrame, selected: Column) -> DataFrame:
    """The selected rows, or all rows if none is selected."""
    some = jobs.agg(F.coalesce(F.bool_or(selected), F.lit(False)).alias("__some"))
    return jobs.crossJoin(F.broadcast(some)).where(~F.col("__some") | selected).drop("__some")  # one row is broadcast


def by_review(jobs: DataFrame, which: str = "all") -> DataFrame:
    return jobs if which == "all" else jobs.where(F.col("reviewed") if which == "reviewed" else ~F.col("reviewed"))


def edit_scope(jobs: DataFrame, scope: str, shown: Column | None = None, paths: DataFrame | None = None, folder: str | None = None, recursive: bool = True) -> DataFrame:
    """The jobs that an edit is for: selected, filtered (those that a list ``shown`` now), all, files (paths(path), regardless of case) or
    those of a folder."""
    if scope == "all":
        return jobs
    if scope == "files":
        own = paths.select(F.lower("path").alias("__p")).distinct()
        return jobs.join(own, F.lower("caption_path") == F.col("__p"), "left_semi")
    if scope == "folder":
        inner = F.substr("caption_path", F.lit(len(folder.rstrip("/")) + 2))
        return jobs.where(F.startswith("caption_path", F.lit(folder.rstrip("/") + "/")) & (F.lit(recursive) | ~inner.contains("/")))
    return jobs.where(F.col("selected") if scope == "selected" else shown)


def by_status(jobs: DataFrame, which: str = "all") -> DataFrame:
    """Jobs of a state; revised are those with any revision, all stands for no filter."""
    return jobs if which == "all" else jobs.where(F.col("revision_count") > 0 if which == "revised" else F.col("status") == which)


def to_revise(jobs: DataFrame, again: bool = False) -> DataFrame:
    """Jobs whose caption can be revised: not blank and, unless asked for again, not reviewed yet."""
    return jobs.where((utrim(F.coalesce("caption", F.lit(""))) != "") & (F.lit(again) | ~F.coalesce("reviewed", F.lit(False))))


def log_rows(logs: DataFrame, level: str = "all", scope: str = "all") -> DataFrame:
    """Log entries of a level and a scope; all stands for no filter."""
    for column, value in (("level", level), ("scope", scope)):
        logs = logs if value == "all" else logs.where(F.col(column) == value)
    return logs


def plain_path(path: Column) -> Column:
    """A path as it is shown: without the prefix of long paths, with two backslashes before a server."""
    return F.when(F.startswith(path, F.lit("\\\\?\\UNC\\")), F.concat(F.lit("\\\\"), F.substr(path, F.lit(9)))).when(F.startswith(path, F.lit("\\\\?\\")), F.substr(path, F.lit(5))).otherwise(path)


def channel_keys(channels: DataFrame, keys: DataFrame, secrets: DataFrame) -> DataFrame:
    """channels(task, channel, connection, model), keys(connection, place, key), secrets(key, secret) -> the keys that each channel can
    use, in their order, masked. A channel without a key that has a secret is left out; a task without any usable channel is an error row."""
    usable = keys.join(secrets.where("secret is not null").select("key", "secret"), "key").select(F.col("connection").alias("__c"), "place", "key", masked(F.col("secret")).alias("masked"))
    rows = channels.join(usable, F.col("connection") == F.col("__c"), "left").drop("__c")
    some = F.max(F.col("key").isNotNull()).over(Window.partitionBy("task"))
    first = F.row_number().over(Window.partitionBy("task").orderBy("channel", "place"))
    told = rows.withColumn("__some", some).withColumn("__first", first).where(F.col("key").isNotNull() | (~F.col("__some") & (F.col("__first") == 1)))
    none = ~F.col("__some")
    return told.select("task", F.when(~none, F.col("channel")).alias("channel"), F.when(~none, F.col("connection")).alias("connection"), F.when(~none, F.col("model")).alias("model"), "place", "key", "masked", F.when(none, NO_KEYS).alias("error"))


def gate(jobs: DataFrame, revising: Column, overwrite: Column) -> Column:
    """skipped where a caption is there and must not be overwritten, failed where there is none to revise, else ready."""
    blank = F.trim(F.coalesce("caption", F.lit(""))) == ""
    return F.when(~revising & ~overwrite & F.col("has_caption"), "skipped").when(revising & blank, "failed").otherwise("ready")


def merged_edits(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with the captions that an edit left behind; results(caption_path, status, content)."""
    done = results.where("status = 'applied'").select(F.col("caption_path").alias("__p"), "content")
    return jobs.join(done, F.col("caption_path") == F.col("__p"), "left").withColumn("caption", F.coalesce("content", "caption")).drop("__p", "content")


def marked(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Jobs of a new run: candidates are pending again, without their old error."""
    own = candidates.select(F.col("item_id").alias("__c")).distinct()
    again = F.col("__c").isNotNull()
    rows = jobs.join(own, F.col("item_id") == F.col("__c"), "left")
    return rows.withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).withColumn("error", F.when(~again, F.col("error"))).drop("__c")


def live(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Jobs after their events; states(item_id, status, revisions, ended): the last status, how often a job was revised and
    whether any event ended it. An end takes the selection away, a revision counts and marks the job as reviewed."""
    now = states.select(F.col("item_id").alias("__i"), F.col("status").alias("__status"), "revisions", "ended")
    rows = jobs.join(now, F.col("item_id") == F.col("__i"), "left")
    more = F.coalesce("revisions", F.lit(0))
    return (
        rows.withColumn("status", F.coalesce("__status", "status")).withColumn("selected", F.col("selected") & ~F.coalesce("ended", F.lit(False)))
        .withColumn("reviewed", F.col("reviewed") | (more > 0)).withColumn("revision_count", F.col("revision_count") + more).drop("__i", "__status", "revisions", "ended")
    )


def moved_into(bucket: DataFrame, more: DataFrame) -> DataFrame:
    """A bucket's paths after others came in, each once."""
    return bucket.unionByName(more).distinct()


def replaced(current: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """A bucket's paths without the known ones, and the new ones."""
    return current.join(known.distinct(), current.columns, "left_anti").unionByName(new)


def channels(presets: DataFrame) -> DataFrame:
    """presets(preset, channels, connection_ids, connection_id, model_id) -> preset, at, connection_id, model_id: the channels
    given, else one for each connection with the preset's model, else its own connection; blank ids go."""
    pair = lambda c, m: F.struct(c.alias("connection_id"), m.alias("model_id"))
    given = F.when(F.size("channels") > 0, F.col("channels"))
    several = F.when(F.size("connection_ids") > 0, F.transform("connection_ids", lambda c: pair(c, F.col("model_id"))))
    every = presets.select("preset", F.posexplode(F.coalesce(given, several, F.array(pair(F.col("connection_id"), F.col("model_id"))))).alias("at", "c"))
    return every.where(F.trim(F.coalesce("c.connection_id", F.lit(""))) != "").select("preset", "at", "c.connection_id", "c.model_id")


def completions(events: DataFrame) -> DataFrame:
    """events(batch_id, type, message): which batches are over, and how loudly to say so."""
    done = F.max(F.when(F.col("type") == "completed", F.coalesce("message", F.lit(""))))
    rows = events.groupBy("batch_id").agg(done.alias("said"))
    return rows.select("batch_id", F.col("said").isNotNull().alias("completed"), F.when(F.col("said").contains("停止"), "warn").when(F.col("said").isNotNull(), "success").alias("level"))


def refusal_plan(images: DataFrame, kept: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """images(path) of a folder's own level -> path, target, action: those not kept go below .refusal, unless a file of their
    name is there. Without any kept path nothing moves."""
    any_kept = kept.agg((F.count("*") > 0).alias("__any"))
    mine = kept.select(F.lower("path").alias("__k")).distinct()
    rest = images.join(mine, F.lower("path") == F.col("__k"), "left_anti").crossJoin(F.broadcast(any_kept)).where("__any").drop("__any")  # one row is broadcast
    target = F.concat(F.lit(f"{root}/.refusal/"), F.regexp_extract("path", r"([^/]+)$", 1))
    there = existing.select(F.col("path").alias("__t"), F.lit(True).alias("there")).distinct()
    return rest.withColumn("target", target).join(there, F.col("target") == F.col("__t"), "left").select("path", "target", F.when(F.col("there"), "skip").otherwise("move").alias("action"))


def progress(events: DataFrame, planned: DataFrame) -> DataFrame:
    """events(batch_id, item, seq, status), planned(batch_id, total) -> total, running, finished of each run: items by their last status."""
    last = events.groupBy("batch_id", "item").agg(F.max_by("status", "seq").alias("status"))
    sums = last.groupBy("batch_id").agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") != "running").alias("finished"))
    return planned.join(sums, "batch_id", "left").select("batch_id", "total", F.coalesce("running", F.lit(0)).alias("running"), F.coalesce("finished", F.lit(0)).alias("finished"))
