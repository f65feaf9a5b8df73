"""Queries over keyed state and exactly-once sinks; each reads its tables as a stream of several files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.catalogue import _LIVE, ORACLE, query, reply_lines, scratch
from tagloom.operators import responses, versions
from tagloom.plans.views import Views
from tagloom.streaming import sinks, state


def as_stream(v: Views, rows: DataFrame, folder: str, key: str, part: object, parts: int) -> DataFrame:
    """The rows as a stream: they are written in ``parts`` turns, by the number that ``part`` gives each row, all of a key in one
    file of a turn, and read in the order in which they were written, about a turn at a time."""
    numbered = rows.withColumn("__turn", part)
    for turn in range(parts):
        numbered.where(F.col("__turn") == turn).drop("__turn").repartition(4, key).write.mode("append").parquet(folder)
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)


@query("live_jobs_stream", _LIVE, "jobs")
def _(v: Views) -> DataFrame:
    """Events come in no order: files hold them by hash of their numbers."""
    folder = scratch(v)
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "signup", "revised").when(F.col("event_type") == "error", "no_response").otherwise("running")
    rows = v.table("events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), status.alias("status"))
    jobs = v.jobs().withColumn("selected", F.col("item_id") % 2 == 0).select("item_id", "status", "selected", "reviewed", "revision_count")
    with state.keyed_state(v.spark):
        stream = state.job_machine(as_stream(v, rows, f"{folder}/in", "item_id", F.pmod(F.xxhash64("seq"), F.lit(3)), 3), jobs)
        out = sinks.drain(stream, f"{folder}/out", lambda r: {"jobs": r}).read("jobs", stream.schema)
    last = versions.latest(out, "item_id", F.col("__batch").desc()).drop("__batch", "seq")
    known = jobs.join(last.select("item_id"), "item_id", "left_anti")
    return known.unionByName(last.join(jobs.select("item_id"), "item_id", "left_semi"))


@query("response_stream", ORACLE["response_reassembly"])
def _(v: Views) -> DataFrame:
    """Lines of a reply come in three micro-batches at least, a value over several lines in two of them."""
    folder, lines = scratch(v), reply_lines(v)
    turn = F.when(F.col("seq") < 4, 0).when(F.col("seq") < 100_001, 1).otherwise(2)
    with state.keyed_state(v.spark):
        stream = state.reply_values(as_stream(v, lines, f"{folder}/in", "request_id", turn, 3))
        out = sinks.drain(stream, f"{folder}/out", lambda r: {"values": r}, "append").read("values", stream.schema)
    ended = out.where("kind = 'end'").select("request_id").distinct().withColumn("ended", F.lit(True))
    marks = lines.select("request_id").distinct().join(ended, "request_id", "left").select("request_id", F.coalesce("ended", F.lit(False)).alias("ended"))
    values = out.where("kind = 'value'").select(F.col("request_id").alias("__r"), "provider", "seq", "json")
    every = marks.join(values, F.col("request_id") == F.col("__r"), "left").drop("__r")
    return responses.put_together(responses.split_arrays(every)).drop("caption")


@query("batch_stream", """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS batch_id, event_id, event_id % 97 = 0 AS done, event_id % 2 = 0 AS loud FROM events WHERE user_id % 5 <> 0),
    c AS (SELECT batch_id, min(event_id) FILTER (done) AS ends FROM e GROUP BY 1)
    SELECT batch_id, event_id, CASE WHEN ends IS NULL OR event_id < ends THEN 'taken' WHEN event_id = ends THEN 'completed' ELSE 'late' END AS verdict, CASE WHEN event_id = ends THEN CASE WHEN loud THEN 'warn' ELSE 'success' END END AS level FROM e JOIN c USING (batch_id)""")
def _(v: Views) -> DataFrame:
    """Completed batches get more events in later micro-batches: these are late. Events of a foreign scope are in no batch."""
    folder, n = scratch(v), F.col("event_id")
    rows = v.table("events").select(F.date_format("ts", "yyyy-MM-dd").alias("batch_id"), "event_id", F.when(n % 97 == 0, "completed").otherwise("progress").alias("type"), F.when(n % 2 == 0, "任务已停止").otherwise("done").alias("message"), F.when(F.col("user_id") % 5 == 0, "ai_sample").otherwise("main").alias("scope"))
    third = F.least(F.floor(n * 3 / F.lit(rows.agg(F.max("event_id")).first()[0] or 1)), F.lit(2))
    with state.keyed_state(v.spark):
        stream = state.batch_machine(as_stream(v, rows, f"{folder}/in", "batch_id", third, 3))
        return sinks.drain(stream, f"{folder}/out", lambda r: {"events": r}, "append").read("events", stream.schema).drop("__batch")


@query("key_rest_stream", ORACLE["key_rests"].replace("SELECT key_id, cooldown_until, why IS NOT NULL", "SELECT key_id, cooldown_until, why IS NULL AND cooldown_until IS NOT NULL AND cooldown_until <= (SELECT max(created_at) FROM e) AS free, why IS NOT NULL"))
def _(v: Views) -> DataFrame:
    """By the events' own clock: a rest is over when the watermark has passed its end."""
    folder, n = scratch(v), F.col("id")
    error = F.when(F.col("kind") == "click", "rate_limit").when(F.col("kind") == "error", F.when(n % 4 == 0, "auth").when(n % 4 == 1, "quota").otherwise("transient"))
    rows = v.attempts().where("key_id is not null").select("key_id", n.alias("seq"), F.col("created_at").alias("ts"), error.alias("error"), "attempt", F.when(n % 3 == 0, n % 50 + 0.5).cast("double").alias("retry_after"))
    span = rows.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b")).first()
    third = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - (span["a"] or 0)) * 3 / ((span["b"] or 1) - (span["a"] or 0) + 1)), F.lit(2))
    with state.keyed_state(v.spark):
        stream = state.key_machine(as_stream(v, rows, f"{folder}/in", "key_id", third, 3).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds"), "eventTime")
        out = sinks.drain(stream, f"{folder}/out", lambda r: {"keys": r}).read("keys", stream.schema)
    told = versions.latest(out.where("not free"), "key_id", F.col("__batch").desc())
    freed = out.where("free").select(F.col("key_id").alias("__k"), F.col("cooldown_until").alias("__until")).distinct()
    same = (F.col("key_id") == F.col("__k")) & (F.col("cooldown_until") == F.col("__until"))
    until = F.col("cooldown_until").cast("timestamp_ntz") if dict(v.table("events").dtypes)["ts"] == "timestamp_ntz" else F.col("cooldown_until")
    return told.join(freed, same, "left").select("key_id", until.alias("cooldown_until"), F.col("__k").isNotNull().alias("free"), "disabled", "disable_reason")


@query("task_tables", """WITH r AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS run, event_type FROM events)
    SELECT 'items' AS name, count(*) AS n, count(DISTINCT event_id) AS keys FROM r UNION ALL SELECT 'metrics', count(*), count(DISTINCT event_id) FROM r WHERE event_type <> 'error'
    UNION ALL SELECT 'versions', count(*), count(DISTINCT event_id) FROM r WHERE event_type = 'signup' UNION ALL SELECT 'runs', count(DISTINCT run), count(DISTINCT run) FROM r""")
def _(v: Views) -> DataFrame:
    """Four tables that grow together, each micro-batch once: the stream is run twice, and each batch is offered to the sink again."""
    folder = scratch(v)
    rows = v.table("events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("run"), "event_type")
    stream = as_stream(v, rows, f"{folder}/in", "run", F.pmod(F.xxhash64("run"), F.lit(3)), 3)

    def tables(some: DataFrame) -> dict[str, DataFrame]:
        return {"items": some, "metrics": some.where("event_type <> 'error'"), "versions": some.where("event_type = 'signup'"), "runs": some.select("run").distinct()}

    for _ in range(2):
        ledger = sinks.drain(stream, folder, tables, "append")
    for batch in ledger.batches():
        ledger.commit(batch, tables(rows))
    out = None
    for name, key in (("items", "event_id"), ("metrics", "event_id"), ("versions", "event_id"), ("runs", "run")):
        schema = rows.select("run").schema if name == "runs" else rows.schema
        more = ledger.read(name, schema).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct(key).alias("keys"))
        out = more if out is None else out.unionByName(more)
    return out
