"""Expected values on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from tagloom import catalogue
from tagloom.functions import text as t
from tagloom.operators import rules
from tagloom.operators.rules import EditRule


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "caption string").select(column(F.col("caption")).alias("x")).first()["x"]


RULES = [
    ("bad, good, bad", EditRule(action="delete", content="bad", all_matches=False), "good, bad"),
    ("bad, good, bad", EditRule(action="delete", content="bad"), "good"),
    ("long hair, eyes", EditRule(action="delete", content="hair"), "eyes"),
    ("long hair, eyes", EditRule(action="delete", content="^hair$", regex=True), "long hair, eyes"),
    ("a, b", EditRule(action="replace", content="a", replacement="x, y"), "x, y, b"),
    ("a, b", EditRule(action="replace", content="a", replacement=""), "b"),
    ("a, b", EditRule(position="start", content="n"), "n, a, b"),
    ("a, b", EditRule(position="index", index=2, content="n"), "a, n, b"),
    ("a, b", EditRule(position="index", index=99, content="n"), "a, b, n"),
    ("a, b, a", EditRule(position="after", anchor="a", content="n", all_matches=False), "a, n, b, a"),
    ("a, b, a", EditRule(position="before", anchor="a", content="n"), "n, a, b, n, a"),
    ("a,b", EditRule(position="end", content="B", only_if_missing=True), "a,b"),
    ("a,b", EditRule(position="end", content="c, B", only_if_missing=True), "a, b, c"),
    ("1girl, solo, 1GIRL", EditRule(position="end", content="smile", deduplicate=True), "1girl, solo, smile"),
    ("cost $5 (now)", EditRule(mode="text", action="replace", content="$5 (now)", replacement=r"\$1"), r"cost \$1"),
    ("aXbxc", EditRule(mode="text", action="delete", content="x", all_matches=False), "abxc"),
    ("a b c", EditRule(mode="text", action="delete", content="c", anchor="a"), "a b "),
    ("aXbxc", EditRule(mode="text", action="delete", content="x", case_sensitive=True), "aXbc"),
    ("k12", EditRule(mode="text", action="replace", content=r"([a-z])(\d+)", replacement="$2$1", regex=True, all_matches=False), "12k"),
    ("héllo", EditRule(mode="text", position="index", index=2, content="|"), "hé|llo"),
    ("a\nb\n", EditRule(mode="text", position="line", index=2, content="n"), "a\nn\nb"),
    ("one two two", EditRule(mode="text", position="after", anchor="two", content="!"), "one two! two!"),
    ("Has It", EditRule(mode="text", content="it", only_if_missing=True), "Has It"),
]


@pytest.mark.parametrize("before, rule, after", RULES)
def test_edit_rules(spark, before, rule, after):
    row = rules.preview(spark.createDataFrame([("p", before)], "caption_path string, caption string"), rule).first()
    assert (row["after"], row["changed"], row["error"]) == (after, before != after, None)


def test_a_bad_pattern_is_an_error_row(spark):
    row = rules.preview(spark.createDataFrame([("p", "a")], "caption_path string, caption string"), EditRule(action="delete", content="(?P<n>a)", regex=True)).first()
    assert row["error"] == "invalid pattern" and not row["changed"]


def test_texts(spark):
    assert one(spark, "　a ", t.utrim) == "a"
    assert one(spark, " a ,, b,a ", t.tags) == ["a", "b", "a"]
    assert one(spark, "no comma ", t.normalized) == "no comma "
    assert one(spark, "<think>x</think>```text\n\"1girl,solo\"```", t.cleaned) == "1girl, solo"
    assert one(spark, "keep <think>open", t.without_think) == "keep"
    secrets = "key: abcd1234, x-goog-api-key=zzzz; bearer abcdefgh12 http://h/?apikey=s3&token=t1&signature=q"
    assert one(spark, secrets, t.redacted) == "key: ••••, x-goog-api-key=••••; bearer •••• http://h/?apikey=••••"
    assert one(spark, "http://h/?x=1&access_token=t1&signature=q", t.redacted) == "http://h/?x=1&access_token=••••"
    assert one(spark, "http://h/?x=1&signature=q&y=2", t.redacted) == "http://h/?x=1&signature=••••&y=2"
    assert one(spark, "monkey bars, keys, http://h/?sig=1", t.redacted) == "monkey ••••, keys, http://h/?sig=1"  # "key " counts, as in the tables
    assert one(spark, "img10_2", t.natural_key) > one(spark, "img9_30", t.natural_key)
    assert one(spark, "abcdef1234", t.masked) == "••••1234"


def test_decisions_and_refusals(spark):
    d = one(spark, "**DECISION：REJECT**\n**REASON：blurred**\nSCORE: 40", t.decision)
    assert (d["keep"], d["reason"], d["score"], d["error"]) == (False, "blurred", 40.0, False)
    assert one(spark, "maybe", t.decision)["error"]
    refused = lambda s: one(spark, s, lambda c: t.refusal(c, F.lit(None).cast("string")))
    for no in ("I am unable to help with this", "I must decline this request", "我必须拒绝", "不便提供", "Ｉ　ｃａｎｎｏｔ　ｈｅｌｐ", "I'm sorry, I can't", "抱歉，我无法协助完成这个请求。"):
        assert refused(no)["rule"] and not refused(no)["structured"]
    assert refused("x" * 40 + " I cannot help you")["excerpt"] == "x" * 23 + " I cannot help you"
    own = one(spark, "Nope (sorry not)", lambda c: t.refusal(c, F.lit(None).cast("string"), (t.RefusalRule("(", regex=True), t.RefusalRule("nope (sorry"))))
    assert own["rule"] == "nope (sorry"
    assert one(spark, "fine", lambda c: t.refusal(c, F.lit("SAFETY")))["structured"]
    d = one(spark, "KEEP\nScore:\nx: 85.5", t.decision)
    assert (d["keep"], d["reason"], d["score"]) == (True, t.KEPT, 85.5)
    assert refused("不能错过的夕阳，城市天际线") is None
    d = spark.createDataFrame([("foo 12 bar", "foo N bar")], "a string, b string").select(t.diff_parts(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert tuple(d) == ("foo ", "12", "N", " bar")


def brute_parts(a, b):
    n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    p, q = a[n:], b[n:]
    m = next((k for k, (x, y) in enumerate(zip(reversed(p), reversed(q))) if x != y), min(len(p), len(q)))
    return a[:n], p[: len(p) - m], q[: len(q) - m], p[len(p) - m :]


def test_diff_parts_of_whole_captions(spark):
    pairs = [("", ""), ("", "a"), ("a", ""), ("aaa", "aa"), ("x\ny 😀 z", "x\ny 😁 z"), ("ab" * 30_000 + "c", "ab" * 29_000 + "d" + "ab" * 900 + "c"), ("same", "same"), ("0123456789<>tail", "0123456789<>tail")]
    got = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n long, a string, b string").select("n", t.diff_parts(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r["n"]: tuple(r["d"]) for r in got} == {n: brute_parts(*p) for n, p in enumerate(pairs)}
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r["item_id"]: tuple(r)[1:] for r in catalogue.QUERIES["diff_parts_whole"](spark, sf).collect()}
    assert rows == {k: brute_parts(x, x[:10] + "<>" + x[12:]) if x is not None else (None,) * 4 for k, x in texts.items()}


@pytest.mark.parametrize("text, tags", [("a, B, b, A, c", "a, B, c"), ("", ""), ("b, a, b, a", "b, a"), (", ".join(f"t{n % 700}" for n in range(3000)), ", ".join(f"t{n}" for n in range(700)))])
def test_deduplicated_keeps_first_spellings_in_order(spark, text, tags):
    assert one(spark, text, lambda c: F.array_join(t.deduplicated(t.tags(c)), ", ")) == tags


def test_refusals_as_shown(spark):
    told = lambda text, given=None: one(spark, text, lambda c: t.shown_refusal(c, F.lit(given).cast("string")))
    assert told("所以该请求暂时无法处理。")["rule"] == t.SHOWN_REFUSALS[5] and told("This request cannot be done")["rule"] == t.SHOWN_REFUSALS[2]
    assert told("x" * 40 + " i must refuse " + "y" * 90)["excerpt"] == "x" * 23 + " i must refuse" + " " + "y" * 47
    assert told("不能错过的夕阳，城市天际线") is None and told("fine", "safety")["structured"] and told(None) is None
