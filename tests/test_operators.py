import hashlib
import json

from pyspark.sql import functions as F

from tagloom import catalogue
from tagloom.operators import jobs, metrics, responses, rules, sampling, scores, versions
from tagloom.sources import files
from tagloom.streaming import jobs as streams


def test_undo_conflicts_and_restores(spark):
    v = spark.createDataFrame([(1, "a", "x", "y", "rule", "b"), (2, "c", "m", "n", "rule", "b"), (3, "d", "p", "q", "rule", "b"), (4, "a", "y", "z", "rule", "b")], "id long, caption_path string, old_content string, new_content string, source string, batch_id string")
    now = spark.createDataFrame([("a", "z"), ("c", "other"), ("d", "p")], "caption_path string, caption string")
    got = {r["caption_path"]: (r["status"], r["content"]) for r in versions.undo_batch(v, now, "b").collect()}
    assert got == {"a": ("restored", "x"), "c": ("conflict", "other"), "d": ("skipped", "p")}


def test_tag_frequency_counts_images_and_occurrences(spark):
    rows = metrics.tag_frequency(spark.createDataFrame([(1, "1girl, blue eyes, 1GIRL"), (2, "1girl"), (3, "")], "item_id long, caption string")).collect()
    got = {r["tag"]: (r["label"], r["images"], r["occurrences"], r["percent"]) for r in rows}
    assert got == {"1girl": ("1girl", 2, 3, 66.666667), "blue eyes": ("blue eyes", 1, 1, 33.333333)}


ATTEMPT = "item string, batch_id string, attempt long, job_kind string, error string, refused boolean, structured boolean, text string, original string, review_ok boolean, write_error string, key_id string, input_tokens long, output_tokens long"


def attempts_of(spark, items):
    usual = {"error": None, "refused": False, "structured": False, "text": "a good caption", "original": "", "ok": False, "write": None}
    rows = []
    for item, (kind, *steps) in items.items():
        for n, step in enumerate(steps):
            s = usual | step
            rows.append((item, "d", n, kind, s["error"], s["refused"], s["structured"], s["text"], s["original"], s["ok"], s["write"], "k", 10, 2))
    return spark.createDataFrame(rows, ATTEMPT)


def test_outcomes(spark):
    no, ok = {"refused": True}, {}
    err = lambda e: {"error": e}
    items = {
        "retried": ("caption", no, no, ok, err("fatal")), "refused": ("revision", no, no, no, no), "rate": ("caption", *[err("rate_limit")] * 4), "fatal": ("caption", err("fatal"), ok), "lost": ("caption", *[err("transient")] * 7),
        "cut": ("caption", *[err("cut")] * 6), "length": ("caption", err("length"), ok), "cancelled": ("caption", no, err("cancelled")), "blank": ("caption", {"text": "  "}), "sample": ("ai_sample", {"refused": True, "text": "REJECT"}),
        "held": ("ai_sample", {"structured": True, "text": "KEEP"}), "odd": ("ai_sample", {"text": "perhaps"}), "short": ("revision", {"text": "a", "original": "abcdef"}), "reviewed": ("revision", {"text": "a", "original": "abcdef", "ok": True}), "conflict": ("caption", {"write": "write_conflict"}),
    }
    a = attempts_of(spark, items)
    got = {r["item"]: tuple(r)[2:] for r in metrics.attempt_outcome(a).collect()}
    assert got == {
        "retried": ("succeeded", None, 2, 30, 6), "refused": ("refused", None, 2, 30, 6), "rate": ("failed", "rate_limit", 0, 0, 0), "fatal": ("failed", "fatal", 0, 0, 0), "lost": ("no_response", "no_response", 0, 0, 0),
        "cut": ("failed", "truncated", 0, 0, 0), "length": ("failed", "truncated", 0, 0, 0), "cancelled": ("cancelled", None, 0, 10, 2), "blank": ("failed", "empty_reply", 0, 10, 2), "sample": ("skipped", None, 0, 10, 2),
        "held": ("refused", None, 0, 10, 2), "odd": ("failed", "invalid_decision", 0, 10, 2), "short": ("failed", "length_reduced", 0, 10, 2), "reviewed": ("revised", None, 0, 10, 2), "conflict": ("failed", "write_conflict", 0, 10, 2),
    }
    rows: dict = {}
    for r in metrics.attempt_metrics(a).collect():
        rows.setdefault(r["item"], []).append((r["retries"], r["status"], r["key_id"]))
    assert sorted(rows["retried"]) == [(0, "refused", "k"), (1, "refused", "k"), (2, "succeeded", "k")]
    assert rows["rate"] == [(0, "failed", None)] and "lost" not in rows and rows["cancelled"] == [(0, "refused", "k")]


def test_score_tags(spark):
    s = spark.createDataFrame([(1, [0.9, 0.2, 0.8, 0.9]), (2, [5.0, -5.0, 0.0, 1.0])], "item_id long, scores array<double>")
    names = spark.createDataFrame([(0, "a_b"), (1, "c"), (2, "d"), (3, None)], "index int, name string")
    assert {r["item_id"]: r["tags"] for r in scores.score_tags(s, names, 0.5, 2).collect()} == {1: "a b, d", 2: "a b, d"}


def test_training_grid(spark):
    groups = spark.createDataFrame([("g", 60, "style", 1, "balanced"), ("h", 0, "pose", 100, "strong")], "grp string, images long, kind string, batch int, strength string")
    got = {r["grp"]: r for r in scores.training_grid(groups).collect()}
    assert (got["g"]["repeats"], got["g"]["epochs"], got["g"]["steps"], got["g"]["target_steps"]) == (1, 25, 1500, 1500)
    assert got["h"]["images"] == 1 and got["h"]["target_steps"] == 750


def test_sample_is_stable_and_partitions(spark):
    items = spark.range(100).select(F.col("id").alias("item_id"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("caption_path"))
    first, again = (sorted(r["item_id"] for r in sampling.random_sample(items.repartition(n), 10, "s").collect()) for n in (1, 7))
    assert first == again and len(first) == 10
    parts = sampling.split(items, items.where("item_id < 3")).groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in parts} == {"kept": 3, "rest": 97}


def test_headers(spark):
    tensor = '{"dtype":"F32","shape":[2, 3],"data_offsets":[0,24]}'
    rows = [("a", f'{{"__metadata__":{{"ss_x":"1","SS_a":"2"}},"t.\\"w\\"":{tensor}}}'), ("b", f'{{"t":{tensor}}}'), ("c", "oops"), ("d", '{"t":1}'), ("e", '{"t":{"dtype":"F32","shape":[2],"data_offsets":[0,-1]}}'), ("f", None)]
    h = spark.createDataFrame([(*r, bytearray(b"123")) for r in rows], "path string, header string, payload binary")
    got = {r["path"]: r for r in files.stripped(h).collect()}
    assert {k: (r["status"], r["verified"]) for k, r in got.items()} == {"a": ("sanitized", True), "b": ("already_clean", True), "c": ("error", False), "d": ("error", False), "e": ("error", False), "f": ("error", False)}
    assert json.loads(got["a"]["header"]) == {'t."w"': json.loads(tensor)} and got["a"]["removed"] == 2 and got["a"]["payload_sha256"] == hashlib.sha256(b"123").hexdigest()
    told = {r["path"]: (r["metadata_present"], r["keys"], r["tensors"], r["error"]) for r in files.metadata_report(h).collect()}
    assert told["a"] == (True, "SS_a,ss_x", 1, None) and told["b"] == (False, "", 1, None) and told["d"][3] == told["e"][3] == "not a tensor" and told["c"][3] == "malformed header"


def test_folders(spark, tmp_path):
    (tmp_path / "x" / ".refusal").mkdir(parents=True)
    for name in ("x/1.png", "x/2.TIFF", "x/.refusal/3.png", "x/4.gif", "x/1.PNG"):
        (tmp_path / name).write_bytes(b"i")
    (tmp_path / "x/1.txt").write_bytes(b"\xef\xbb\xbfa, b")
    (tmp_path / "x/5.TXT").write_bytes("你好".encode("gb18030"))
    pairs = files.paired(files.image_paths(spark, str(tmp_path)), files.sidecars(spark, str(tmp_path))).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["caption"], r["status"]) for r in pairs) == [("1.PNG", "a, b", "succeeded"), ("2.TIFF", "", "pending")]
    assert {r["caption_path"].rsplit("/", 1)[1]: r["caption"] for r in files.sidecars(spark, str(tmp_path)).collect()}["5.TXT"] == "你好"
    assert files.image_paths(spark, str(tmp_path), recursive=False).count() == 0 and files.text_paths(spark, f"{tmp_path}/x").count() == 2
    (tmp_path / "labels.csv").write_text('tag_id,name,category,count\n1,safe,9,5\n2,"a,b",0,5\n\n3,general,4,5\n')
    labels = files.label_table(spark, str(tmp_path / "labels.csv"))
    assert [tuple(r)[:2] for r in labels.orderBy("index").collect()] == [(0, None), (1, "a,b"), (2, "general")] and files.rating_count(labels).first()[0] == 1
    files.export_captions(spark.createDataFrame([("p", "c")], "caption_path string, caption string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_scanned_drops_repeated_paths_and_hidden_folders(spark):
    names = ["d/a.png", "d/A.PNG", "d/.h/b.png", "d/s/.c.jpg", "d/s/c.JPEG", "d/x.gif", "other/d.png"]
    frame = spark.createDataFrame([(n,) for n in names], "path string")
    assert sorted(r["path"] for r in files.scanned(frame, "d").collect()) == ["d/A.PNG", "d/s/c.JPEG"]
    assert [r["path"] for r in files.scanned(frame, "d/", recursive=False).collect()] == ["d/A.PNG"]


def test_replies_over_several_lines(spark):
    lines = ['data: {"choices":[{"delta":', '"x"}]}', "", ": c", "nonsense", '[{"choices":[{"delta":{"content":["a",{"text":"b"}]}}]},', '{"choices":[{"delta":{"content":{"content":"c"}}}]}]', 'data: {"choices":[{"message":{"content":"again"}}]}', "data: [DONE]"]
    frame = spark.createDataFrame([("r", "openai", n, x) for n, x in enumerate(lines)] + [("q", "openai", 0, '{"choices":[{"message":{"content":"whole"}}]}'), ("q", "openai", 1, "data: [DONE]"), ("t", "openai", 0, '{"choices":[{"delta":{"reasoning":"hm"}}]}'), ("t", "openai", 1, "[DONE]"), ("e", "gemini", 0, '{"error":"bad"}'), ("z", "openai", 0, "data: [DONE]")], "request_id string, provider string, seq long, line string")
    got = {r["request_id"]: (r["text"], r["outcome"]) for r in responses.reassembled(frame).collect()}
    assert got == {"r": ("abc", "ok"), "q": ("whole", "ok"), "t": ("", "reasoning_only"), "e": ("", "failed"), "z": ("", "empty")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"u{n % 3}", n, ("revised", "failed", "running")[n % 4 % 3]) for n in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], "item string, seq long, status string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item string, seq long, status string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = versions.latest(streams.drained(streams.job_states(stream), "jobs", "update", f"file://{tmp_path}/state"), "item", F.col("__batch").desc())
    twin = streams.job_states_batch(spark.read.parquet(str(tmp_path / "in")))
    key = lambda frame: sorted((r["item"], r["status"], r["revisions"], r["events"]) for r in frame.collect())
    assert key(out) == key(twin)


def test_hourly_stream_over_unordered_files_equals_the_batch(spark, tmp_path):
    at = ["2026-01-02 12:05:00", "2026-01-01 03:10:00", "2026-01-02 12:59:59", "2026-01-01 03:50:00"]
    for n, ts in enumerate(at):  # one file a trigger, the later hours first; every file repeats event 0
        rows = [(k, t, 1, "view", 1.0, "") for k, t in ((n, ts), (0, at[0]))]
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream, batch = (sorted((str(r["hour"]), r["event_type"], r["n"]) for r in catalogue.QUERIES[q](spark, str(tmp_path)).collect()) for q in ("hourly_stream", "hourly_batch"))
    assert stream == batch == [("2026-01-01 03:00:00", "view", 2), ("2026-01-02 12:00:00", "view", 2)]


def test_relocations(spark):
    there = ["d/a.png", "d/a.txt", "d/.selected/b.png", "d/.rejected/b.png", "d/.rejected/c.png", "d/c.txt", "d/.selected/a.png", "e/x.png", "d/f.png", "d/.selected/s/g.png", "d/.selected/s/g.txt", "d/h.png", "d/.rejected/h.txt"]
    files_ = spark.createDataFrame([(p,) for p in there], "path string")
    wanted = [("d/a.png", "reject"), ("d/a.png", "keep"), ("d/.selected/b.png", "reset"), ("d/.rejected/b.png", "reset"), ("d/.rejected/c.png", "reset"), ("d/.rejected/c.png", "return"), ("e/x.png", "keep"), ("d/f.png", "return"), ("d/.selected/s/g.png", "keep"), ("d/.selected/s/g.png", "reject"), ("d/h.png", "reject"), ("d/.selected/a.png", "reset")]
    got = {(r["path"], r["action"]): (r["target"], r["caption_target"], r["status"]) for r in sampling.relocations(spark.createDataFrame(wanted, "path string, action string"), files_, "d/").collect()}
    assert got == {
        ("d/a.png", "reject"): ("d/.rejected/a.png", "d/.rejected/a.txt", "moved"), ("d/a.png", "keep"): ("d/.selected/a.png", "d/.selected/a.txt", "blocked"), ("d/.selected/b.png", "reset"): ("d/b.png", None, "moved"),
        ("d/.rejected/b.png", "reset"): ("d/b.png", None, "blocked"), ("d/.rejected/c.png", "reset"): ("d/c.png", None, "blocked"), ("d/.rejected/c.png", "return"): ("d/c.png", None, "moved"), ("e/x.png", "keep"): (None, None, "outside"),
        ("d/f.png", "return"): (None, None, "outside"), ("d/.selected/s/g.png", "keep"): ("d/.selected/s/g.png", "d/.selected/s/g.txt", "same"), ("d/.selected/s/g.png", "reject"): ("d/.rejected/s/g.png", "d/.rejected/s/g.txt", "moved"),
        ("d/h.png", "reject"): ("d/.rejected/h.png", None, "moved"), ("d/.selected/a.png", "reset"): ("d/a.png", None, "blocked"),
    }


def test_keys_rest_and_fail(spark):
    at = "2026-01-01 00:00:00"
    rows = [("a", 1, at, "rate_limit", 0, None), ("a", 2, at, "rate_limit", 1, None), ("b", 1, at, "rate_limit", 1, 2.5), ("b", 2, at, "auth", 0, None), ("b", 3, at, "quota", 0, None), ("c", 1, at, None, 0, None)]
    events = spark.createDataFrame(rows, "key_id string, seq long, ts string, error string, attempt long, retry_after double").withColumn("ts", F.to_timestamp("ts"))
    got = {r["key_id"]: (str(r["cooldown_until"])[11:], r["disabled"], r["disable_reason"]) for r in streams.key_rests(events).collect()}
    assert got == {"a": ("00:00:10", False, None), "b": ("00:00:02.500000", True, "额度用尽（quota/billing），Key 已停用"), "c": ("", False, None)}


def test_live_jobs(spark):
    own = spark.createDataFrame([(1, "pending", True, False, 2), (2, "pending", True, False, 0), (3, "failed", True, True, 1)], "item_id long, status string, selected boolean, reviewed boolean, revision_count long")
    events = spark.createDataFrame([(1, 1, "revised"), (1, 2, "running"), (1, 3, "revised"), (2, 1, "running"), (9, 1, "failed")], "item_id long, seq long, status string")
    got = {r["item_id"]: tuple(r)[1:] for r in jobs.live(own, streams.job_ends(events)).collect()}
    assert got == {1: ("revised", False, True, 4), 2: ("running", True, False, 0), 3: ("failed", True, True, 1)}


def test_label_shift(spark):
    labels = spark.createDataFrame([(0, None, "9"), (1, None, "9"), (2, "a_b", "0"), (3, "c", "4")], "index int, name string, category string")
    vectors = spark.createDataFrame([(1, [0.9, 0.8]), (2, [0.9, 0.9, 0.1, 0.8])], "item_id long, scores array<double>")
    got = {r["item_id"]: r["tags"] for r in scores.score_tags(scores.shifted(vectors, labels), labels.select("index", "name"), 0.5, 0, underscores=True).collect()}
    assert got == {1: "a_b, c", 2: "c"}


def test_changed_captions_and_unreadable_texts(spark):
    before, after = (spark.createDataFrame(x, "caption_path string, caption string") for x in ([("a", "1"), ("b", "2"), ("c", None)], [("a", "1"), ("b", "3"), ("c", None), ("d", "4")]))
    assert sorted(r["caption_path"] for r in files.changed_captions(before, after).collect()) == ["b", "d"]
    texts = files.read_texts(spark.createDataFrame([("a.txt", b"x, token"), ("b.txt", b"x\x00"), ("c.md", b"x"), ("d.txt", None)], "caption_path string, content binary"))
    got = {r["caption_path"]: (r["before"], r["after"], r["error"]) for r in rules.preview(texts, rules.EditRule(action="delete", content="token")).collect()}
    assert got == {"a.txt": ("x, token", "x", None), "b.txt": ("", "", "binary content"), "c.md": ("", "", "not a .txt file"), "d.txt": ("", "", "missing")}


def test_retention_keeps_the_newest_of_each_group(spark):
    names = spark.createDataFrame([("a", n) for n in "dcba"] + [("b", "x")] + [(None, n) for n in "qpo"], "grp string, name string")
    assert sorted((r["grp"] or "", r["name"]) for r in sampling.retention_deletions(names, 2, "grp").collect()) == [("", "o"), ("a", "a"), ("a", "b")]


def test_version_rows_of_undo_and_restore(spark):
    v = spark.createDataFrame([(1, "a", "x", "y", "rule", "b"), (2, "c", "m", "n", "rule", "b"), (3, "e", "p", "p", "rule", "b")], "id long, caption_path string, old_content string, new_content string, source string, batch_id string")
    now = spark.createDataFrame([("a", "y"), ("c", "other"), ("e", "p")], "caption_path string, caption string")
    assert [tuple(r) for r in versions.undo_rows(v, now, "b").collect()] == [("a", "y", "x", "undo", "b")]
    assert sorted(tuple(r) for r in versions.restore_rows(v, now, F.lit(True)).collect()) == [("a", "y", "x", "undo", None), ("c", "other", "m", "undo", None)]
