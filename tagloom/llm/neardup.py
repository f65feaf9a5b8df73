"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification, connected components.

1. A document is an id and a text. Each text's shingle set is hashed; equal sets form one class, which one of its documents
   stands for from here on: the one with the smallest id, of several the one with the smallest hash of id and text.
2. Signatures are cut into bands. Texts that share a band are candidates.
3. In each band bucket all members are compared with one hub. Of a pair, batches of signature values are compared one after
   the other; as soon as the posterior probability of a similarity at or above the threshold (uniform prior) falls below the
   chosen miss probability, the pair is dropped. Survivors are verified on full sets.
4. Buckets whose members are not all connected yet are split by the size of the sets: sizes are put in steps so wide that two
   sets that are similar lie in one step or in neighbouring ones, and a part holds a step and, as guests, the next one. In
   each part, members outside its largest component are compared with all others, guests with guests in the next part only,
   in tiles of a bounded number of rows, inside tasks. Only links leave them. So no pair that a bucket offers is left out
   unless its ends are connected already or their sizes alone keep them apart, and no group's pairs are ever written out.
5. Components of all links give the smallest id that can be reached; the first of a component's documents in the order of
   step 1 is kept.

Defined results: an empty or null text has no shingles and is linked with nothing; one with fewer words than a shingle is one
shingle; rows without an id are compared as others are and are never kept beside an id, and of near-duplicates that all have
none one document stays, with a null component; rows that repeat an id with another text are documents of their own; rows that
repeat both are one document; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import durable, id_and_text, matching, unused
from tagloom.llm.graph import components
from tagloom.llm.shingles import mixed, shingle_sets
from tagloom.llm.tokens import slices

BANDS, ROWS = 28, 5
BATCH = 35  # signature values compared at a time
TILE = 256  # rows of a side in a tile of step 4


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (a[:, None] * low[None, at : at + 2048] + b[:, None]).min(axis=1), out=out)
    return out


def least_matches(compared: int, threshold: float, miss: float) -> int:
    """The fewest matches among so many values that leave P(similarity >= threshold) at ``miss`` or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    tail = 0.0
    for m in range(compared + 1):
        tail += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if tail >= miss:
            return m
    return compared


def may_be_similar(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Indexes of the row pairs of two signature matrices that no batch's posterior rules out."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n in range(BATCH, left.shape[1] + 1, BATCH):
        matches[alive] += (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(n, threshold, miss)]
    return alive


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of ascending distinct arrays."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def named_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: a hash of id and text."""
    return id_and_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row, n_shingles, key1 and key2 (of the set), sig."""
    a, b = hash_functions(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                count, key1, key2, sig = [], [], [], []
                for s in shingle_sets(part.column("text"), words):
                    count.append(len(s))
                    key1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    key2.append(int(np.bitwise_xor.reduce(mixed(s)).view(np.int64)) if len(s) else 0)
                    sig.append(signature(s, a, b).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(count, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "row", "n_shingles", "key1", "key2", "sig"])

    return named_rows(docs).mapInArrow(run, "doc_id long, row long, n_shingles long, key1 long, key2 long, sig binary")


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, sig, shingles (little-endian bytes, ascending) of the documents whose row hash is among these ids, each once."""
    a, b = hash_functions(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = list(shingle_sets(part.column("text"), words))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([signature(s, a, b).tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "sig", "shingles"])

    sets = durable(matching(named_rows(docs), F.col("row"), ids, "left_semi").mapInArrow(run, "id long, sig binary, shingles binary"), "sets")
    return sets if sets.count() == ids.count() else durable(sets.dropDuplicates(["id"]), "sets")


def size_step(n: Column, percent: int) -> Column:
    """The step of a set's size: of two similar sets neither lies more than one step above the other.

    A step spans a factor of 100 / percent and a little more, so that rounding never puts two steps between such sets.
    """
    width = max(log(100 / percent), 1e-6) * (1 + 1e-9)
    return F.floor(F.log(n) / width).cast("int")


def band_rows(reps: DataFrame) -> DataFrame:
    """bucket, id, step: a row for each band of each class representative; a bucket's number hashes the band and its values."""
    width = 4 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substr(F.col("sig"), k * width + 1, F.lit(width))))
    return reps.select("id", "step", F.explode(bands).alias("bucket"))


def hub_links(pairs: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that are similar: signatures are sent to all pairs first, full sets only to those that are left."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("xa", "xb"))
                yield batch.select(["a", "b"]).take(pa.array(may_be_similar(left, right, percent / 100, miss), pa.int64()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "xb", 16 << 20):
                good = [k for k in range(batch.num_rows) if similar(*(np.frombuffer(batch.column(c)[k].as_py(), "<u8") for c in ("xa", "xb")), percent)]
                yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    def with_both(some: DataFrame, what: str) -> DataFrame:
        first, second = (sets.select(F.col("id").alias(k), F.col(what).alias("x" + k)) for k in "ab")
        return some.join(second, "b").join(first, "a").select("a", "b", "xa", "xb")

    close = durable(with_both(pairs, "sig").mapInArrow(prune, "a long, b long"), "close-pairs")
    return with_both(close, "shingles").mapInArrow(verify, "a long, b long")


def open_links(members: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) between components that share a bucket and have similar members. members: bucket, id, step, component.

    One link joins two components; further pairs of theirs are not compared within a tile.

    A part of a bucket holds a step of sizes and the next one's members as guests. Its largest component asks nothing: every
    open pair has an end outside it. A part without members of its own step is none.
    """
    parts = F.array(F.struct(F.col("step").alias("part"), F.lit(False).alias("guest")), F.struct((F.col("step") - 1).alias("part"), F.lit(True).alias("guest")))
    placed = members.select("bucket", "id", "component", F.explode(parts).alias("p")).select("bucket", "id", "component", "p.*")
    sizes = placed.groupBy("bucket", "part", "component").agg(F.count("*").alias("n"), F.count_if(~F.col("guest")).alias("own"))
    buckets = durable(
        sizes.groupBy("bucket", "part").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("most")).where("components > 1 and own > 0")
        .select("bucket", "part", F.col("most.component").alias("largest"), F.ceil((F.col("n") - F.col("most.n")) / TILE).alias("asking"), F.ceil(F.col("n") / TILE).alias("asked")), "open")
    some = placed.join(buckets, ["bucket", "part"])
    tile = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    asks = some.where("component <> largest").select("bucket", "part", (tile % F.col("asking")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asked") - 1)).alias("j"), "id", "component", "guest", F.lit(True).alias("asks"))
    others = some.select("bucket", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).alias("i"), (tile % F.col("asked")).alias("j"), "id", "component", "guest", F.lit(False).alias("asks"))
    rows = asks.unionByName(others).join(sets, "id")

    def compare(group: list[tuple]) -> set[tuple[int, int]]:
        mine, theirs = ([r for r in group if r[3] == side] for side in (True, False))
        if not mine or not theirs:
            return set()
        sigs = [np.frombuffer(b"".join(r[4] for r in side), "<u4").reshape(len(side), -1) for side in (mine, theirs)]
        found: set[tuple[int, int]] = set()
        above = np.array([r[2] for r in theirs], np.int64)  # the component as merged so far in this tile
        at_home = np.array([not r[1] for r in theirs])
        for k, (_, guest, component, _, _, shingles) in enumerate(mine):
            own = next((int(above[n]) for n, r in enumerate(theirs) if r[2] == component), component)
            open_ = np.flatnonzero((above != own) & (at_home | (not guest)))
            if len(open_):
                alive = may_be_similar(np.broadcast_to(sigs[0][k], (len(open_), sigs[0].shape[1])), sigs[1][open_], percent / 100, miss)
                for n in open_[alive].tolist():
                    if above[n] != own and similar(np.frombuffer(shingles, "<u8"), np.frombuffer(theirs[n][5], "<u8"), percent):
                        found.add((min(component, theirs[n][2]), max(component, theirs[n][2])))
                        above[above == above[n]] = own
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        def out() -> pa.RecordBatch:
            links = sorted(compare(group))
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], pa.int64()) for n in (0, 1)], ["a", "b"])

        for batch in batches:
            for *place, id_, guest, component, asks, sig, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if key != place:
                    if group:
                        yield out()
                    key, group = place, []
                group.append((id_, guest, component, asks, sig, shingles))
        if group:
            yield out()

    keys = ["bucket", "part", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "id", "guest", "component", "asks", "sig", "shingles").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return judged(docs, words, percent, miss).drop("row")


def judged(docs: DataFrame, words: int, percent: int, miss: float = 1e-6) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept for every row."""
    signed = durable(signatures(docs, words), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    classes = durable(signed.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min(order).alias("best")).select("key1", "key2", "best", F.col("best.row").alias("id")), "classes")
    reps = signed.join(classes.select("id"), signed.row == F.col("id"), "left_semi").select(F.col("row").alias("id"), "sig", size_step(F.col("n_shingles"), percent).alias("step")).dropDuplicates(["id"])
    bands = band_rows(reps)
    turn = F.xxhash64("bucket", "id")  # buckets that share members choose different hubs among them
    buckets = durable(bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(turn.alias("turn"), "id"))["id"].alias("hub")).where("n > 1").select("bucket", "hub"), "buckets")
    members = durable(bands.join(buckets, "bucket"), "members")
    sets = sets_of(docs, durable(members.select("id").distinct(), "member-ids"), words)
    pairs = members.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = durable(hub_links(pairs, sets, percent, miss), "hub-links")
    first = components(links).withColumnRenamed("id", "of")
    placed = members.join(first, members.id == first.of, "left").select("bucket", "id", "step", F.coalesce("component", "id").alias("component"))
    found = durable(open_links(durable(placed, "placed"), sets, percent, miss), "open-links")
    last = components(found).withColumnRenamed("id", "of").withColumnRenamed("component", "beyond")
    early = classes.join(first, classes.id == first.of, "left").select("key1", "key2", "best", F.coalesce("component", "id").alias("near"))
    named = durable(early.join(last, early.near == last.of, "left").select("key1", "key2", "best", F.coalesce("beyond", "near").alias("component")), "named")
    heads = durable(named.groupBy("component").agg(F.min("best").alias("head"), F.count("*").alias("n")).where("n > 1").select(F.col("component").alias("of"), "head"), "heads")
    named = named.join(heads, named.component == heads.of, "left").select("key1", "key2", F.coalesce("head", "best").alias("head"))
    named = named.select("key1", "key2", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("head"))
    some = signed.where("n_shingles > 0").select("doc_id", "row", "n_shingles", "key1", "key2").join(named, ["key1", "key2"], "left")
    some = some.select("doc_id", "row", "n_shingles", "component_id", (F.col("row") == F.col("head")).alias("kept"))
    # rows without shingles are linked with nothing and stay where they are: together they would be one key of the join
    none = signed.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(none)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that another one of their component stands for; of rows that repeat id and text, one stays.

    Rows without an id and without words stay.
    """
    rows = durable(judged(docs, words, percent).where("n_shingles > 0 or doc_id is not null").select("row", "kept"), "judged")
    gone = rows.where("not kept").select("row").distinct()
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    left = matching(docs, row, durable(gone, "gone"), "left_anti")
    repeated = durable(rows.where("kept").groupBy("row").count().where("count > 1").select("row"), "repeated")
    if repeated.count():
        mark = unused(docs, "__row")
        some = matching(left, row, repeated, "left_semi").withColumn(mark, row).dropDuplicates([mark]).drop(mark)
        left = some.unionByName(matching(left, row, repeated, "left_anti"))
    return left
