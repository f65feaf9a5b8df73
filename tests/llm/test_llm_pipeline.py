import re

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tagloom.llm import decontamination, quality, secrets
from tagloom.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


def shingles(text: str) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept_ids(rows: list) -> set:
    """The smallest id of each component under links of 80 % of the union, by comparing all pairs."""
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k for k in sets if root(k) == k}


def leaks(text: str, items: list[str]) -> bool:
    """Whether any item aligns with the whole text at the threshold. Only texts whose best stretch of common words scores less
    than that, with 2 for each and -1 for any other word, are ruled out before."""
    numbers: dict = {}
    words = [np.array([numbers.setdefault(b, len(numbers)) for w in t.split() if (b := decontamination.bare(w))], np.int64) for t in (text, *items)]
    for item in words[1:]:
        least = max(2 * min(5, len(item)), 0.4 * 2 * len(item))
        sums = np.concatenate(([0], np.cumsum(np.where(np.isin(words[0], item), 2, -1))))
        if len(item) and (sums - np.minimum.accumulate(sums)).max() >= least and decontamination.align(item, words[0])[0] >= least:
            return True
    return False


def masked(text: str) -> str:
    patterns = ((r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))
    spans = sorted((m.start(), n, m.end()) for n, (p, g, least) in enumerate(patterns) for m in re.finditer(p, text) if len(m[g]) >= least)
    out, at = "", 0
    for a, _, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fold = {r["doc_id"]: r["held_out"] for r in quality.has_checkable_fold(docs.select("doc_id")).collect()}
    rows = docs.collect()
    x = {r["doc_id"]: np.array(quality.text_statistics(r["text"] or "")) for r in rows}
    train = [np.array([x[d] for d, y in labels.items() if y == k and d in x and not fold[d]]) for k in (0, 1)]
    model = quality.Discriminant.fit(np.array([len(t) for t in train], float), np.array([t.sum(axis=0) for t in train]), np.array([t.T @ t for t in train]))
    want = [r for r in rows if model.score(x[r["doc_id"]][None])[0] >= 0.3]
    steps = [lambda some: want, lambda some: [r for r in some if r["doc_id"] in kept_ids(some)], lambda some: [r for r in some if not leaks(r["text"] or "", items)], None]
    for (name, stage), step in zip(corpus_pipeline.STAGES[:-1], steps):
        after = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert after.columns == docs.columns
        got = {r["doc_id"]: r for r in after.collect()}
        if step:
            rows = step(rows)
            assert set(got) == {r["doc_id"] for r in rows}, name
            assert all(got[r["doc_id"]] == r for r in rows)
        else:
            assert {d: r["text"] for d, r in got.items()} == {r["doc_id"]: masked(r["text"]) for r in rows}
            assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] != docs.where(f"doc_id = {r['doc_id']}").first()["text"])
        docs = after
    whole = Tokenizer.from_file(TOKENIZER)
    sizes: dict = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {r["doc_id"]: len(whole.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()


def test_registered():
    assert {"pipeline"} | {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in __spark_entry__.queries()}
    assert secrets.RULES


def test_a_chain_over_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and blank texts, repeated rows and columns with clashing names pass through all stages."""
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(6).collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, blob string, key string"
    texts = [(1, good[0]), (1, good[1]), (2, good[0]), (2, good[0]), (None, good[2]), (None, good[2]), (None, None), (3, None), (4, ""), (5, " \n "), (6, good[3] + " token = abcdefghijkl1234"), (7, good[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "b", "k") for i, t in texts], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")] and docs.count() <= before, name
        assert {(r["row"], r["blob"], r["key"]) for r in docs.collect()} <= {("r", "b", "k")}
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len([x for x in left if x[1] == good[0]]) <= 1 and len([x for x in left if x[1] == good[2]]) <= 1  # one of each group of copies
    assert not any("abcdefghijkl1234" in (t or "") for _, t in left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) >= len(left)
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
