"""Full order, rule tables, rounds, folders, merged settings and schema versions on small tables."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tagloom.functions import merge
from tagloom.operators import jobs, metrics, migrations, order, refusals, selection
from tagloom.sources import folders


def test_ranks_over_many_parts(spark, tmp_path):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id")
    got = order.ranked(rows, [F.col("k").desc(), F.col("id")], f"file://{tmp_path}/r", parts=7)
    want = sorted(((r["k"], r["id"]) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r["k"], r["id"]) for r in got.orderBy("rank").collect()] == want
    assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, 1001))
    assert order.ranked(rows.limit(0), [F.col("id")], f"file://{tmp_path}/e").count() == 0


def test_jobs_in_both_directions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "img10.png", 2, "ab"), (2, "img9.png", 2, "a"), (3, "IMG9.png", None, "abc"), (4, "a.png", 5, "")], "item_id long, file_name string, revision_count long, caption string")
    names = lambda *a, **k: [r["item_id"] for r in metrics.ranked_jobs(rows, *a, **k).orderBy("rank").collect()]
    assert names("name", f"file://{tmp_path}/1") == [4, 2, 3, 1] and names("name", f"file://{tmp_path}/2", ascending=False) == [1, 2, 3, 4]
    assert names("revision", f"file://{tmp_path}/3") == [4, 2, 1, 3] and names("revision", f"file://{tmp_path}/4", ascending=True) == [3, 2, 1, 4]
    assert names("length", f"file://{tmp_path}/5") == [3, 1, 2, 4]


RULES = "owner string, number long, pattern string, regex boolean, case_sensitive boolean"


def test_first_rule_by_order_wins(spark):
    rules = spark.createDataFrame([
        ("a", 5, "no way", False, False), ("a", 3, "No  Way", False, True), ("a", 4, "w[aA]y!?", True, None), ("a", 1, "(", True, False), ("a", 2, "  ", False, False), ("a", 0, None, False, False),
        ("b", 1, "İx", False, False), ("b", 2, "x", False, False),
    ], RULES)
    texts = [(1, "a", "well, NO WAY!", None), (2, "a", "well, No Way!", None), (3, "a", "no", None), (4, "c", "no way", None), (5, "a", None, None), (6, "a", "no way", "told"), (7, "b", "aİx", None), (8, "a", "I must decline, no way", None), (9, "a", "no wäy", None), (10, None, "no way", None)]
    frame = spark.createDataFrame(texts, "id long, owner string, text string, structured string")
    for most in (20_000, 2):
        got = {r["id"]: (r["rule"], r["excerpt"], r["structured"]) for r in refusals.refusals(frame, rules, most).collect()}
        assert len(got) == 10 and got[1] == ("w[aA]y!?", "well, NO WAY!", False) and got[2][0] == "No  Way" and got[3][0] is got[4][0] is got[5][0] is got[9][0] is got[10][0] is None
        assert got[6] == ("told", "told", True) and got[7][0] == "İx" and "decline" in got[8][0]


def test_ten_thousand_rules(spark):
    rules = spark.range(10_000).select(F.lit("a").alias("owner"), F.col("id").alias("number"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" x")).alias("pattern"), F.lit(False).alias("regex"), (F.col("id") % 2 == 0).alias("case_sensitive"))
    texts = spark.range(3000).select("id", F.lit("a").alias("owner"), F.concat(F.lit("some text before "), F.when(F.col("id") % 3 > 0, F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" x, word1 x"))).otherwise("")).alias("flat"))
    began = time.time()
    got = {r["id"]: r["rule"] for r in refusals.own_rules(texts, rules).collect()}
    assert len(got) == 2000 and set(got.values()) == {"word1 x"} and time.time() - began < 30


def test_silent_rules_need_no_passes_and_live_ones_are_joined(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value, own=type(spark.sparkContext).broadcast: passes.append(sum(map(len, value.values()))) or own(self, value))
    n, text = F.col("id"), lambda c: c.cast("string")
    silent = spark.range(100_000).select(F.lit("a").alias("owner"), (-n).alias("number"), F.concat(F.lit("zq "), text(n + 10_000)).alias("pattern"), F.lit(False).alias("regex"), F.lit(True).alias("case_sensitive"))
    live = spark.range(3000).select(F.lit("a").alias("owner"), n.alias("number"), F.concat(F.lit("Word"), text(n), F.lit("  x")).alias("pattern"), F.lit(False).alias("regex"), (n % 2 == 0).alias("case_sensitive"))
    odd = spark.createDataFrame([("a", 5000, "ΟΔΟΣ", False, False), ("a", 5001, "d", False, False), ("a", 5002, "t[o]+", True, False), (None, 1, "some", False, False)], RULES)
    texts = spark.range(600).select("id", F.lit("a").alias("owner"), F.concat(F.lit("some "), F.when(n % 3 == 0, F.lit("ΟΔΟΣ")).when(n % 3 == 1, F.concat(F.lit("word"), text(n + 9), F.lit(" x, Word"), text(n + 7), F.lit(" x"))).otherwise("too")).alias("flat"))
    want = {k: "ΟΔΟΣ" if k % 3 == 0 else f"Word{k + 7}  x" if k % 3 == 1 else "t[o]+" for k in range(600)}
    rules = silent.unionByName(live).unionByName(odd)
    for most in (5000, 100):
        passes.clear()
        got = {r["id"]: (r["rule"], r["at"]) for r in refusals.own_rules(texts, rules, most).collect()}
        assert {k: r for k, (r, _) in got.items()} == want and got[1][1] == len("some word10 x, ")
        assert len(passes) == 1 and passes[0] <= most


def first_by_hand(texts, rules):
    """id: rule, place, length and excerpt of the first rule by number that fires, each rule tried on each text."""
    out, tried = {}, {}
    for number, owner, pattern, regex, sensitive in sorted((r[1], r[0], *r[2:]) for r in rules):
        try:
            tried.setdefault(owner, []).append((pattern, sensitive, re.compile(pattern, 0 if sensitive else re.I) if regex else None, " ".join(pattern.split())))
        except re.error:
            continue
    for i, owner, text in texts:
        low = refusals.lowered(text)
        for pattern, sensitive, regex, word in tried.get(owner, []):
            at, end = m.span() if regex and (m := regex.search(text)) else (-1, -1) if regex or not word else (k := (text if sensitive else low).find(word if sensitive else refusals.lowered(word)), k + len(word))
            if at >= 0:
                out[i] = (pattern, at, end - at, text[max(at - 24, 0) : end + 48])
                break
    return out


def test_rules_leave_little_on_disk(spark, monkeypatch):
    def on_disk():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(k).length() for k in range(files.size()))

    pick = random.Random(7)
    words = ["".join(pick.choice("aeiou") + pick.choice("bcdfglmnprst") for _ in range(pick.randint(2, 5))) for _ in range(6000)]
    texts = [(k, f"o{k % 4}", " ".join(pick.choices(words, k=pick.choice([0, 1, 2, 60])) + pick.choices(["KeLvin \u212aelvin", "wi\u017fhful", "D\u0130sTant d\u0131stant", "Größe", ""], k=1))) for k in range(6000)]
    live = [(f"o{k % 3}", k - 400, pick.choice([w, w.upper(), w + "[a-z]+", w[:3] + "?" + w[3:], "(" + w, w + " ", f"{w}|{w}s", "sel" + w]), k % 5 in (2, 3), k % 2 == 0) for k, w in enumerate(pick.choices(words, k=4000))]
    live += [("o0", 9000, "kelvin", True, False), ("o1", 9001, "wishful+", True, False), ("o2", 9002, "distant", True, False), ("o2", 9003, "GRÖSSE", False, False), ("o1", 9004, "größ", False, False)]
    silent = spark.range(200_000).select(F.concat(F.lit("o"), (F.col("id") % 3).cast("string")).alias("owner"), (-F.col("id") - 1000).alias("number"), F.concat(F.lit("zq "), F.col("id").cast("string")).alias("pattern"), F.lit(False).alias("regex"), (F.col("id") % 2 == 0).alias("case_sensitive"))
    rules, frame = silent.unionByName(spark.createDataFrame(live, RULES)), spark.createDataFrame(texts, "id long, owner string, flat string").repartition(4)
    want = first_by_hand(texts, live)
    for few in (2000, 0, 10_000):  # the last texts are joined, none are, most are
        monkeypatch.setattr(refusals, "FEW", few, raising=False)
        before = on_disk()
        got = {r["id"]: r for r in refusals.own_rules(frame, rules, 500).collect()}
        assert few > 2000 or on_disk() - before < 12_000_000, on_disk() - before
        assert {k: (r["rule"], r["at"], r["length"], r["excerpt"]) for k, r in got.items()} == want


def test_what_patterns_begin_with():
    assert [refusals.needed(p) for p in ("that[a-z]+", "that+", "that*", "that?x", "that{0,2}", "tha|t", "(?i)that", "no way\\b", "größe", "")] == ["that", "that", "tha", "tha", "tha", "", "", "no way", "gr", ""]
    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ":
        assert {refusals.form(m, False) for m in re.findall(c, every, re.I)} == {refusals.form(c, False)}


def test_rounds_to_the_end(spark):
    items = spark.createDataFrame([(n, f"f{n}.png") for n in range(1, 9)], "item_id long, file_name string")
    said = [(n, 1, n != 8, None) for n in range(1, 8)] + [(8, 1, False, None)] + [(1, 2, True, 85.1), (2, 2, True, 85.9), (3, 2, False, 99.0), (4, 2, True, None), (5, 2, False, None), (6, 2, True, 10.0)]  # round 2 says nothing of 7
    decisions = spark.createDataFrame(said, "item_id long, round int, keep boolean, score double")
    kept = spark.createDataFrame([(100,)], "item_id long")
    run = lambda target, rounds, before=None: {r["item_id"]: r["bucket"] for r in selection.run_rounds(items, decisions, target, rounds, lambda x: x, before).collect()}
    assert run(4, 2, kept) == {1: "kept", 2: "kept", 3: "kept", 4: "rejected", 5: "rejected", 6: "rejected", 7: "uncertain", 8: "rejected"}
    assert run(1, 2) == {1: "rejected", 2: "rejected", 3: "kept", 4: "rejected", 5: "rejected", 6: "rejected", 7: "uncertain", 8: "rejected"}
    assert sorted(set(run(7, 10).values())) == ["kept", "rejected"] and list(run(1, 1, kept).values()).count("kept") == 0
    assert run(100, 1) == {n: "kept" for n in range(1, 9)}  # every candidate, rejected ones last


def test_hand_beats_model_and_null_takes_back(spark):
    d = spark.createDataFrame([(1, True, "m"), (2, True, "m"), (3, False, "m"), (4, None, "m")], "item_id long, keep boolean, reason string")
    hand = spark.createDataFrame([(1, 1, False), (1, 2, None), (3, 1, True)], "item_id long, at long, keep boolean")
    got = {r["item_id"]: (r["keep"], r["status"], r["by"]) for r in selection.decided_by_hand(d, hand).collect()}
    assert got == {1: (None, "pending", "manual"), 2: (True, "succeeded", "model"), 3: (True, "succeeded", "manual"), 4: (None, "pending", "model")}


def test_partition_check_can_fail(spark):
    items, boxes = spark.range(4).withColumnRenamed("id", "item_id"), spark.createDataFrame([(0, "kept"), (0, "kept"), (1, "kept"), (1, "rejected"), (9, "kept")], "item_id long, bucket string")
    assert tuple(selection.partition_check(items, boxes).first()) == (4, 2, 1, 0, 2, 1, 1)


def test_folder_source(spark, tmp_path):
    (tmp_path / "a" / ".hidden" / "deep").mkdir(parents=True)
    (tmp_path / "_odd").mkdir()
    for name in ("1.txt", "a/2.TXT", "a/.hidden/3.txt", "a/.hidden/deep/4.txt", "_odd/_5.txt", "a/6.png"):
        (tmp_path / name).write_bytes(b"text")
    (tmp_path / "bin.txt").write_bytes(b"a\x00b")
    (tmp_path / "odd.txt").write_bytes(b"\xff\xff\xff")
    (tmp_path / "locked.txt").write_bytes(b"text")
    os.chmod(tmp_path / "locked.txt", 0o444)
    (tmp_path / "folder.txt").mkdir()
    rows = {r["path"].removeprefix(f"{tmp_path}/"): r for r in folders.folder(spark, str(tmp_path)).collect()}
    assert {"1.txt", "a/2.TXT", "a/.hidden/3.txt", "a/.hidden/deep/4.txt", "_odd/_5.txt", "a/6.png", "folder.txt", "a", "_odd"} <= set(rows) and len([p for p in rows if p.endswith("4.txt")]) == 1
    assert rows["locked.txt"]["readonly"] and not rows["1.txt"]["readonly"] and rows["1.txt"]["size"] == 4 and rows["1.txt"]["content"] is None
    assert {r["path"].rsplit("/", 1)[1] for r in folders.folder(spark, str(tmp_path), recursive=False).where("kind = 'file'").collect()} == {"1.txt", "bin.txt", "odd.txt", "locked.txt"}
    wanted = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("1.txt", "locked.txt", "bin.txt", "odd.txt", "gone.txt", "folder.txt", "a/6.png")], "path string")
    told = {r["path"].rsplit("/", 1)[1]: r["error"] for r in folders.checked_texts(spark, str(tmp_path), wanted).collect()}
    assert told == {"1.txt": None, "locked.txt": "read-only", "bin.txt": "binary content", "odd.txt": "unknown encoding", "gone.txt": "missing", "folder.txt": "not a file", "6.png": "not a .txt file"}


def test_merged_settings(spark):
    deep = lambda n, x: '{"k":' * n + x + "}" * n
    rows = [('{"a":1,"b":{"c":[1,2],"d":{"e":null,"f":"x"}}}', '{"b":{"c":[3],"d":{"f":null,"g":2.5}},"z":"q"}', '{"a":1,"b":{"c":[3],"d":{"e":null,"f":null,"g":2.5}},"z":"q"}'), ('{"a":{"b":1}}', '{"a":5}', '{"a":5}'), ('{"a":5}', '{"a":{"b":1}}', '{"a":{"b":1}}'), (None, '{"a":1}', '{"a":1}'), ('{"a":1}', None, '{"a":1}'), (None, None, None), ("[1]", "2", "2"), (deep(6, '{"x":1}'), deep(6, '{"y":"2"}'), deep(6, '{"x":1,"y":"2"}'))]
    frame = spark.createDataFrame(rows, "a string, b string, want string")
    for r in frame.select(merge.merged(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert r["got"] == r["want"]
    with pytest.raises(Exception, match="too deep"):
        spark.createDataFrame([(deep(9, "{}"), deep(9, "{}"))], "a string, b string").select(merge.merged(F.col("a"), F.col("b"))).collect()


def test_schema_chain(spark):
    chain = migrations.Chain((migrations.Step(2, {"old": "new"}, {"n": ("int", 3)}), migrations.Step(3, added={"m": ("string", "d")}, change=lambda x: x.withColumn("n", F.col("n") + 1))))
    first, last = spark.createDataFrame([("x",)], "old string"), spark.createDataFrame([("y", 9, None)], "new string, n int, m string")
    assert chain.version == 3 and sorted(tuple(r) for r in chain.union({1: first, 3: last}, ["new", "n"]).collect()) == [("x", 4), ("y", 9)]
    assert chain.migrate(first, 1).first()["m"] == "d"
    for bad in (0, 4):
        with pytest.raises(ValueError):
            chain.migrate(first, bad)
    with pytest.raises(ValueError):
        migrations.Chain((migrations.Step(2), migrations.Step(4)))


def test_channels_without_keys(spark):
    channels = spark.createDataFrame([(1, 0, "c1", "m"), (1, 1, "c2", "m"), (2, 0, "c3", "m"), (2, 1, "c4", "m")], "task long, channel long, connection string, model string")
    keys = spark.createDataFrame([("c1", 0, "k1"), ("c1", 1, "k2"), ("c3", 0, "k3")], "connection string, place long, key string")
    secrets = spark.createDataFrame([("k2", "sk-12345678"), ("k3", None)], "key string, secret string")
    got = [(r["task"], r["key"], r["masked"], r["error"]) for r in jobs.channel_keys(channels, keys, secrets).orderBy("task").collect()]
    assert got == [(1, "k2", "••••5678", None), (2, None, None, jobs.NO_KEYS)]
