"""Live job states, run progress, key health and logs as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import redacted
from tagloom.streaming.sinks import drain

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
TERMINAL = ("succeeded", "revised", "no_response", "refused", "failed", "skipped", "cancelled")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def job_states_batch(events: DataFrame) -> DataFrame:
    """events(item, seq, status): the last status and how often a caption was revised."""
    return events.groupBy("item").agg(F.max_by("status", "seq").alias("status"), F.count_if(F.col("status") == "revised").alias("revisions"), F.count("*").alias("events"))


def job_states(events: DataFrame) -> DataFrame:
    """The same as a stream, in update mode: a job's row comes again whenever it changes. State is one row for each job."""
    return job_states_batch(events)


def job_ends(events: DataFrame) -> DataFrame:
    """events(item_id, seq, status) -> what live() merges into jobs; runs on a stream as well as on a batch."""
    return events.groupBy("item_id").agg(F.max_by("status", "seq").alias("status"), F.count_if(F.col("status") == "revised").alias("revisions"), F.bool_or(F.col("status").isin(*TERMINAL)).alias("ended"))


def run_progress(events: DataFrame) -> DataFrame:
    """Running counts for each batch; in update mode a row comes again whenever it changes."""
    return events.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*TERMINAL)).alias("finished"))


def hourly_counts(once: DataFrame) -> DataFrame:
    return once.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def hourly_batch(events: DataFrame) -> DataFrame:
    """Requests by hour and kind, each event id counted once; rows that repeat an id are the same event."""
    return hourly_counts(events.dropDuplicates(["event_id"]))


def hourly(events: DataFrame, late: str | None = "10 minutes") -> DataFrame:
    """The same as a stream. Append mode leaves out rows that come later than ``late`` and windows that the watermark has not
    passed; with None, in update mode, the last row of each hour and kind is its count over all rows, and all ids stay in state.
    """
    return hourly_counts(events.dropDuplicates(["event_id"]) if late is None else events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]))


# Why a key is out of use.
UNUSABLE = {"auth": "认证失败（401/403），Key 已停用", "quota": "额度用尽（quota/billing），Key 已停用"}


def key_rests(events: DataFrame) -> DataFrame:
    """events(key_id, seq, ts, error, attempt, retry_after): each key's last rest, as long as the service asks for in seconds, or
    5 at a first attempt and 10 later; whether it is out of use, and why. Runs on a stream too, in update mode."""
    rests, dead = F.col("error") == "rate_limit", F.col("error").isin(*UNUSABLE)
    wait = F.coalesce(F.col("retry_after").cast("double"), F.when(F.col("attempt") == 0, 5.0).otherwise(10.0))
    until = F.max_by(F.col("ts") + F.make_dt_interval(secs=wait), F.when(rests, F.col("seq")))
    reason = F.max_by("error", F.when(dead, F.col("seq")))
    why = F.lit(None).cast("string")
    for kind, text in UNUSABLE.items():
        why = F.when(reason == kind, text).otherwise(why)
    return events.groupBy("key_id").agg(until.alias("cooldown_until"), F.coalesce(F.bool_or(dead), F.lit(False)).alias("disabled"), why.alias("disable_reason"))


def log_stream(events: DataFrame) -> DataFrame:
    """Log events alone, with a default level and without secrets in their messages."""
    return events.where("type = 'log'").select("batch_id", F.coalesce("level", F.lit("info")).alias("level"), redacted(F.col("message")).alias("message"))


def drained(frame: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now, and give what it wrote, each micro-batch once."""
    return drain(frame, f"{checkpoint}/{name}", lambda rows: {"rows": rows}, mode).read("rows", frame.schema)
