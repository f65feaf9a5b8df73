"""Incremental secret scan over a blob ledger, in DataFrame operations only.

Every version of a text is addressed by its SHA-256. The ledger lists the (blob, rule, rule version) triples that were
scanned, with their findings; a scan runs only the rules that the ledger lacks for a blob, and findings are joined back to
every path that holds the blob. Copies of a text are scanned once.

Positions come from splitting the text at the pattern: a match begins where all pieces and matches before it end. They
count code points; the end is exclusive.

Defined results: a null or empty text has no findings; repeated rows and paths that share a text get the same findings;
null ids keep their rows; an empty table gives no rows; columns beyond id and text are never read. A text may hold any number of
matches: a hundred thousand of them take seconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import let
from tagloom.llm.common import durable, unused

SPAN = "struct<start:int,end:int,kind:string>"


@dataclass(frozen=True)
class Rule:
    """A pattern; matches count only if their ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


# Fixed values of the contract: leftmost non-overlapping patterns and the lengths below which a match is dropped.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a run of hex digits of the least length is the whole run
)


def in_blocks(items: Column) -> Column:
    """An array as blocks of as many items as there are blocks. What grows in a loop, and is copied at each step, then grows within a
    block: a text with n matches costs n times the root of n copies, and not the square of n."""
    def cut(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a), width), lambda at: F.slice(a, at, width))).otherwise(F.slice(F.array(a), 1, 0))

    return let(items, cut)


def spans_of(text: Column, rule: Rule) -> Column:
    """Start, end and kind of a rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)
    empty = F.array().cast(f"array<{SPAN}>")
    sizes = F.zip_with(hits, parts, lambda hit, part: F.struct(F.length(hit).alias("len"), F.length(part).alias("part")))
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), sizes, lambda gap, m: F.struct(F.length(gap).alias("gap"), m["len"].alias("len"), m["part"].alias("part")))

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")).cast(SPAN)

    def walked(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        return F.struct((start + m["len"]).alias("at"), F.when(m["part"] >= rule.least, F.concat(acc["spans"], F.array(span(start, start + m["len"])))).otherwise(acc["spans"]).alias("spans"))

    inner = F.transform(in_blocks(steps), lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("spans")), walked))
    begins = lambda blocks: F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
    moved = let(inner, lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks), lambda b, at: F.transform(b["spans"], lambda s: span(s["start"] + at, s["end"] + at)))))
    return F.when(text.rlike(rule.pattern), moved).otherwise(empty)


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """texts(blob, text, missing) -> a ledger row (blob, kind, version, spans) for each rule of ``missing``; others don't run."""
    one = lambda n, r: F.when(F.array_contains("missing", n), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")))
    found = F.array(*[one(n, r) for n, r in enumerate(rules)])
    return texts.select("blob", F.explode(found).alias("f")).where("f is not null").select("blob", "f.kind", "f.version", "f.spans")


def addressed(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """path, blob, text: every row with its content address."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, path, missing): one path for each blob, and the places of the rules whose present version the ledger lacks for it."""
    blobs = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs.withColumn("missing", F.array(*map(F.lit, range(len(rules)))))
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))  # a row for each rule version
    lacks = [F.when(F.col("done").isNull() | ~F.array_contains("done", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.lit(n)) for n, r in enumerate(rules)]
    return blobs.join(done, "blob", "left").select("blob", "path", F.array_compact(F.array(*lacks)).alias("missing"))


FEW_NEW = 10_000  # an addition of so few blobs is sent to the texts
FEW_ROWS, FEW_SPANS = 50_000, 500_000  # more findings than this are shuffled instead of broadcast


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for addressed versions; append them to the ledger to make the next scan incremental.

    One version stands for all with its content; it is found again by its path, so texts move once and copies not at all. A
    small addition to a ledger (counted first) leaves even these where they are. A row that repeats both path and text may
    give its ledger rows again; whatever reads a ledger takes it as a set.
    """
    todo = unseen(versions.select("path", "blob"), ledger, rules).where(F.size("missing") > 0).select(F.col("blob").alias("m_blob"), F.col("path").alias("m_path"), "missing")
    if ledger is not None:
        todo = durable(todo, "unseen")
        todo = F.broadcast(todo) if todo.limit(FEW_NEW + 1).count() <= FEW_NEW else todo
    chosen = versions.join(todo, F.col("path").eqNullSafe(F.col("m_path")) & (F.col("blob") == F.col("m_blob")))
    return scan(chosen.select("blob", "text", "missing"), rules)


def all_spans(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans: the spans of a blob's ledger rows by start, then in the rules' order; blobs without any are left out."""
    some = rows.where(F.size("spans") > 0).groupBy("blob").agg(F.collect_list(F.struct("kind", "spans")).alias("found"))  # a row for each rule, or a few
    keyed = lambda n, r: F.transform(F.get(F.filter("found", lambda f: f["kind"] == r.kind), F.lit(0))["spans"], lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    own = [F.coalesce(keyed(n, r), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")) for n, r in enumerate(rules)]
    return some.select("blob", F.array_sort(F.concat(*own)).alias("spans"))


def joined_back(rows: DataFrame, blob: str, found: DataFrame, spans: str) -> DataFrame:
    """The rows with the spans of their blob. Few findings are counted and broadcast, so a blob with many paths isn't one task."""
    found = durable(found.select(F.col("blob").alias(unused(rows, "f_blob")), F.col("spans").alias(spans)), "findings")
    there = found.columns[0]
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(spans)), F.lit(0)).alias("spans")).first()
    few = size["n"] <= FEW_ROWS and size["spans"] <= FEW_SPANS
    return rows.join(F.broadcast(found) if few else found, F.col(blob) == F.col(there), "left").drop(there)


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans (null if none) for every row: ledger rows, old and new, joined back to all paths."""
    versions = addressed(docs)
    rows = scan_versions(versions, ledger, rules)
    if ledger is not None:
        now = [F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules]
        rows = rows.unionByName(ledger.where(F.struct("kind", "version").isin(*now)).select("blob", "kind", "version", "spans"))
    return joined_back(versions.select(F.col("path").alias("doc_id"), "blob"), "blob", all_spans(rows, rules), "spans")


def mask(text: Column, spans: Column, with_: str = "[secret]") -> Column:
    """The text with its spans, which may overlap, replaced.

    A substring is found by counting from the start of its text; so a block of spans is masked in the piece of the text that it covers.
    """
    def one(acc: Column, s: Column, piece: Column, base: Column) -> Column:
        here = acc["at"] - base
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(piece, here + 1, s["start"] - acc["at"]), F.lit(with_)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    def block(acc: Column, some: Column) -> Column:
        last = F.greatest(acc["at"], F.array_max(F.transform(some, lambda s: s["end"])))
        piece = F.struct(F.substr(text, acc["at"] + 1, last - acc["at"]).alias("text"), acc["at"].alias("base"))
        done = let(piece, lambda p: F.aggregate(some, F.struct(p["base"].alias("at"), F.lit("").alias("out")), lambda inner, s: one(inner, s, p["text"], p["base"])))
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(in_blocks(spans), begin, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every finding masked and n_chars, if there is one, counted anew where a text changed.

    Every row stays, with all its columns, whatever their names; null and empty texts stay as they are.
    """
    found = all_spans(scan_versions(addressed(docs), None, rules), rules)
    blob, spans = unused(docs, "__blob"), unused(docs, "__spans")
    address = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    marked = joined_back(docs.withColumn(blob, address), blob, found, spans)
    hit = F.col(spans).isNotNull()
    masked = marked.withColumn("text", F.when(hit, mask(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)
