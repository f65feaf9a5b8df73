"""Keyed state and the exactly-once sink, over several files and tries."""

import time

import pytest
from pyspark.sql import functions as F

from tagloom.streaming import jobs as streams
from tagloom.streaming import sinks, state


def files(spark, folder, schema, *turns):
    for rows in turns:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_batch_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "n int")
    ledger = sinks.Ledger(spark, f"file://{tmp_path}/t")
    assert ledger.read("items", rows.schema).count() == 0
    assert ledger.commit(0, {"items": rows, "runs": rows.limit(1)}) and not ledger.commit(0, {"items": rows})
    rows.write.parquet(f"file://{tmp_path}/t/items/{1:020d}-{'a' * 32}")  # a writer that died before its marker
    assert [ledger.read(name, rows.schema).count() for name in ("items", "runs", "none")] == [2, 1, 0]
    assert ledger.commit(1, {"items": rows}) and ledger.read("items", rows.schema).groupBy("__batch").count().orderBy("__batch").collect() == [(0, 2), (1, 2)]
    assert not ledger._created(ledger._marker(1), "b" * 32)  # of two tries one counts


def test_drained_streams_go_on_where_they_ended(spark, tmp_path):
    stream = files(spark, tmp_path / "in", "n int", [(1,), (2,)], [(3,)])
    assert streams.drained(stream, "a", "append", f"file://{tmp_path}/o").count() == 3
    files(spark, tmp_path / "in", "n int", [(4,)])
    again = streams.drained(stream, "a", "append", f"file://{tmp_path}/o")
    assert sorted(r["n"] for r in again.collect()) == [1, 2, 3, 4] and again.select("__batch").distinct().count() == 3


def test_jobs_keep_their_state_over_files(spark, tmp_path):
    stream = files(spark, tmp_path / "in", "item_id long, seq long, status string", [(1, 3, "revised"), (2, 1, "running")], [(1, 2, "failed"), (2, 5, "revised"), (2, 4, "revised")], [(1, 9, "running")])
    jobs = spark.createDataFrame([(1, "pending", True, False, 1), (2, "pending", True, False, 0), (4, "x", True, True, 5)], "item_id long, status string, selected boolean, reviewed boolean, revision_count long")
    with state.keyed_state(spark):
        machine = state.job_machine(stream, jobs)
        out = sinks.drain(machine, f"file://{tmp_path}/o", lambda r: {"jobs": r}).read("jobs", machine.schema)
    last = out.groupBy("item_id").agg(F.max_by(F.struct("status", "selected", "reviewed", "revision_count"), "__batch").alias("j")).select("item_id", "j.*").orderBy("item_id").collect()
    assert [tuple(r) for r in last] == [(1, "running", False, True, 2), (2, "revised", False, True, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != state.PROVIDER


def test_job_states_are_aggregates_without_python(spark, tmp_path):
    stream = files(spark, tmp_path / "in", "item_id long, seq long, status string", [(1, 2, "running"), (3, 1, None)])
    jobs = spark.createDataFrame([(1, "pending", True, None, 1), (3, "pending", True, False, 0)], "item_id long, status string, selected boolean, reviewed boolean, revision_count long")
    machine = state.job_machine(stream, jobs)
    assert "State" not in machine._jdf.queryExecution().logical().toString()  # no processor that is called for each job
    out = sinks.drain(machine, f"file://{tmp_path}/o", lambda r: {"jobs": r}).read("jobs", machine.schema).drop("__batch").orderBy("item_id").collect()
    assert [tuple(r) for r in out] == [(1, 2, "running", True, False, 1), (3, 1, None, True, False, 0)]


def test_only_open_values_are_state():
    from pyspark.sql import Row

    class Kept:
        value, writes = None, 0

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value, self.writes = value, self.writes + 1

        def clear(self):
            self.value = None

    machine, kept = state.ReplyMachine(0), Kept()
    machine.reply = kept
    rows = lambda *lines: iter([Row(provider="openai", seq=n, line=line) for n, line in lines])
    said = lambda *lines: [(r["seq"], r["kind"], r["json"]) for r in machine.handleInputRows(("a",), rows(*lines), None)]
    assert said((1, "data: [DONE]"), (0, "data: {}")) == [(0, "value", "{}"), (1, "end", None)] and kept.writes == 0
    assert said((2, 'data: {"x":')) == [] and kept.value[0] == '{"x":'
    assert said((3, "1}")) == [(3, "value", '{"x":\n1}')] and kept.value is None and kept.writes == 1


def test_silent_replies_end_and_open_values_are_dropped(spark, tmp_path):
    schema = "request_id string, provider string, seq long, line string"
    long = "[" + "1," * 40_000
    stream = files(spark, tmp_path / "in", schema, [("a", "openai", 0, 'data: {"x":'), ("b", "openai", 0, long), ("c", "gemini", 0, "{}")], [("a", "openai", 1, "1}"), ("b", "openai", 1, "1]"), ("b", "openai", 2, "{}"), ("c", "gemini", 1, "data: [DONE]"), ("d", "openai", 0, "nonsense}")])
    with state.keyed_state(spark):
        rows = state.reply_values(stream, idle_ms=1500)
        query = rows.writeStream.outputMode("append").format("memory").queryName("replies").trigger(processingTime="500 milliseconds").option("checkpointLocation", f"file://{tmp_path}/state").start()
        try:
            began = time.time()
            while spark.table("replies").where("kind = 'silent'").count() < 3 and time.time() - began < 90:
                time.sleep(1)
        finally:
            query.stop()
    got = sorted((r["request_id"], r["kind"], r["json"]) for r in spark.table("replies").collect() if r["kind"] != "silent")
    assert got == [("a", "value", '{"x":\n1}'), ("b", "value", "{}"), ("c", "end", None), ("c", "value", "{}")]
    assert sorted(r["request_id"] for r in spark.table("replies").where("kind = 'silent'").collect()) == ["a", "b", "d"]


def test_late_and_foreign_events(spark, tmp_path):
    schema = "batch_id string, event_id long, type string, message string, scope string"
    stream = files(spark, tmp_path / "in", schema, [("x", 1, "log", None, "main"), ("y", 2, "log", None, None), ("x", 3, "completed", "已停止", "main"), ("x", 4, "log", None, "main")], [("x", 5, "log", None, "main"), ("y", 6, "completed", None, "main"), ("y", 7, "log", None, "ai_sample")])
    with state.keyed_state(spark):
        machine = state.batch_machine(stream)
        rows = sinks.drain(machine, f"file://{tmp_path}/o", lambda r: {"e": r}, "append").read("e", machine.schema).orderBy("event_id").collect()
    assert [(r["event_id"], r["verdict"], r["level"]) for r in rows] == [(1, "taken", None), (2, "taken", None), (3, "completed", "warn"), (4, "late", None), (5, "late", None), (6, "completed", "success")]
    assert state.own_events(spark.createDataFrame([("x", "main"), ("z", "main")], "batch_id string, scope string"), batch="x").count() == 1


@pytest.mark.parametrize("clock", ["processingTime"])
def test_rests_end_by_timer(spark, tmp_path, clock):
    schema = "key_id string, seq long, ts timestamp, error string, attempt long, retry_after double"
    now = spark.sql("select current_timestamp() as t").first()["t"]
    stream = files(spark, tmp_path / "in", schema, [("a", 1, now, "rate_limit", 0, 1.0), ("b", 2, now, "rate_limit", 0, 600.0), ("c", 3, now, "rate_limit", 1, 0.5), ("c", 4, now, "auth", 0, None), ("d", 5, now, None, 0, None)])
    with state.keyed_state(spark):
        query = state.key_machine(stream, clock).writeStream.outputMode("update").format("memory").queryName("rests").trigger(processingTime="500 milliseconds").option("checkpointLocation", f"file://{tmp_path}/state").start()
        try:
            began = time.time()
            while not spark.table("rests").where("free").count() and time.time() - began < 90:
                time.sleep(1)
        finally:
            query.stop()
    assert [r["key_id"] for r in spark.table("rests").where("free").collect()] == ["a"]
    dead = spark.table("rests").where("disabled").collect()
    assert [(r["key_id"], r["disable_reason"]) for r in dead] == [("c", streams.UNUSABLE["auth"])]
