"""Hard negatives by exact inner products: matrix products modulo small primes, then selection within windows of scores.

1. Components become whole numbers floor(scale * x). A block of anchors and a batch of rows are reduced modulo several primes
   below 1,024 to residues around zero and multiplied in float32, at most 64 components at a time: each partial sum is below
   2**24 and so exact. The Chinese remainder theorem, by mixed radix digits, gives the signed score; there are as many primes as
   the largest possible score asks for, which follows from the largest norms of the whole table.
2. A first pass over the rows keeps each anchor's best rows of its own label, its positives. A second pass keeps, for each
   anchor and positive, the best rows of other labels whose score lies within the window that the positive's score sets.
3. Anchors go to the tasks in slices of at most ``slice_bytes``; tasks read rows in place, one batch at a time, and emit top lists
   only, which are merged within groups of tasks and then over all. So what moves grows with the anchors, never with the rows,
   and no label's rows are ever brought together.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part; rows that repeat
an id are rows of their own, anchors among them too (``anchor_row`` tells them apart); ties go to the smaller id; rows with
another vector length than an anchor's are left out for it; an anchor without another row of its label, or a positive without
a row in its window, has no rows in the result; an empty table gives none; other columns are never read. Beyond 62 bits the
digits are put together as numbers of any size, which is slow; a returned score that does not fit 64 bits ends the job with
an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import durable, parts_for

STEP = 64  # components whose products are summed in float32 before they are reduced
BLOCK = 128  # anchors multiplied with a batch of rows at a time
ROWS = 2048  # rows of a batch
# the largest primes below 1024: 64 * 511**2 < 2**24
PRIMES = [p for p in range(1023, 2, -2) if all(p % d for d in range(3, 32, 2))]
LISTS = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score decimal(38,0), row long, id long, score decimal(38,0), task long"


def taking_part(vectors: DataFrame, is_anchor: Column, label: Column) -> DataFrame:
    """id, row (a number of its own), label, anchor, x (doubles as little-endian bytes), norm: the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            packed = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
            norms = [float(np.abs(x).max(initial=0.0) * np.sqrt(len(x))) for x in packed]  # no less than the norm, and never infinite before it has to be
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row", "label", "anchor")), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(norms)], ["id", "row", "label", "anchor", "x", "norm"])

    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    chosen = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & e.isNotNull() & ~odd)
    rows = chosen.select(F.col("vec_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), e.cast("array<double>").alias("e"))
    return rows.mapInArrow(run, "id long, row long, label long, anchor boolean, x binary, norm double")


def primes_for(bound: int) -> list[int]:
    """So many primes that their product exceeds the number of scores between -bound and bound."""
    chosen, product = [], 1
    for p in PRIMES:
        if product > 2 * bound + 1:
            return chosen or [p]
        chosen.append(p)
        product *= p
    raise ValueError("components are too large for the primes below 1024")


def residues(x: np.ndarray, scale: int, primes: list[int]) -> list[np.ndarray]:
    """floor(scale * x) modulo each prime, between -(p - 1) / 2 and (p - 1) / 2, as float32."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * x)
    out = []
    for p in primes:
        # a double of 2**53 or more is a whole number: it is reduced first where the product would be infinite
        r = np.where(np.isfinite(whole), np.fmod(whole, p), np.fmod(np.fmod(x, p) * scale, p))
        r = np.where(r > p // 2, r - p, np.where(r < -(p // 2), r + p, r))
        out.append(r.astype(np.float32))
    return out


def product_mod(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """left @ right.T modulo p, from 0 to p - 1, in float32 products of at most STEP components."""
    out = np.zeros((len(left), len(right)), np.int32)
    for at in range(0, left.shape[1], STEP):
        out += (left[:, at : at + STEP] @ right[:, at : at + STEP].T).astype(np.int32) % p
    return out % p


def scores_of(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed scores from the products modulo each prime; numbers of any size where 62 bits don't hold them."""
    product = 1
    for p in primes:
        product *= p
    kind = np.int64 if product < 1 << 62 else object
    total, weight = None, 1
    for x, y, p in zip(left, right, primes):
        r = product_mod(x, y, p)
        if total is None:
            total = r.astype(kind)
        else:  # the next digit is what is missing modulo p, divided by the primes before
            total += weight * ((r - total) % p * pow(weight, -1, p) % p).astype(kind)
        weight *= p
    return np.where(total > product // 2, total - product, total)


class Best:
    """The best k rows so far for each of many lists: by score, then smaller id, then row."""

    def __init__(self, lists: int, k: int):
        self.k, self.kept = k, [[] for _ in range(lists)]
        self.full = np.zeros(lists, bool)
        self.least = np.zeros(lists, object)

    def take(self, first: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores: lists from ``first`` on, by candidates."""
        part = slice(first, first + len(scores))
        full = self.full[part]
        if full.any():
            allowed = allowed & (~full[:, None] | (scores >= np.where(full, self.least[part], 0).astype(scores.dtype)[:, None]))
        for n in np.flatnonzero(allowed.any(axis=1)).tolist():
            at = np.flatnonzero(allowed[n])
            if len(at) > self.k and scores.dtype != object:  # ties with the last one stay
                at = at[scores[n, at] >= np.partition(scores[n, at], len(at) - self.k)[len(at) - self.k]]
            some = self.kept[first + n] + [(-int(scores[n, c]), int(ids[c]), int(rows[c])) for c in at]
            some.sort()
            self.kept[first + n] = some[: self.k]
            if len(some) >= self.k:
                self.full[first + n], self.least[first + n] = True, -self.kept[first + n][-1][0]


def searched(ready: DataFrame, shared, scale: int, primes: list[int], k: int, window: tuple[Fraction, Fraction] | None) -> DataFrame:
    """Top lists of each task. shared: (row, id, label, vector, positives) of the anchors, positives as (row, id, score).

    Without a window, an anchor's list holds other rows of its label; with one, there is a list for each positive, of rows of other
    labels whose score lies between the two shares of the positive's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple] = {}
        for size in sorted({len(a[3]) for a in shared.value}):
            own = [a for a in shared.value if len(a[3]) == size]
            matrix = np.frombuffer(b"".join(a[3] for a in own), "<f8").reshape(len(own), size // 8)
            many = [len(a[4]) if window else 1 for a in own]
            first = np.concatenate(([0], np.cumsum(many)))
            asked[size] = (own, residues(matrix, scale, primes), first, Best(int(first[-1]), k))
        for batch in batches:
            vectors = batch.column("x").to_pylist()
            sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
            ids, rows, labels = (batch.column(c).to_numpy() for c in ("id", "row", "label"))
            for size, (own, left, first, best) in asked.items():
                same = np.flatnonzero(sizes == size)
                for at in range(0, len(same), ROWS):
                    some = same[at : at + ROWS]
                    right = residues(np.frombuffer(b"".join(vectors[n] for n in some), "<f8").reshape(len(some), size // 8), scale, primes)
                    for begin in range(0, len(own), BLOCK):
                        block = own[begin : begin + BLOCK]
                        found = scores_of([x[begin : begin + BLOCK] for x in left], right, primes)
                        like = np.array([a[2] for a in block], np.int64)[:, None] == labels[some][None, :]
                        if window is None:
                            best.take(begin, found, like & (np.array([a[0] for a in block], np.int64)[:, None] != rows[some][None, :]), ids[some], rows[some])
                            continue
                        of = np.repeat(np.arange(len(block)), np.diff(first[begin : begin + len(block) + 1]))
                        given = [p[2] for a in block for p in a[4]]
                        low, high = (np.array([f(s) for s in given], found.dtype)[:, None] for f in (lambda s: -(-window[0].numerator * s // window[0].denominator), lambda s: window[1].numerator * s // window[1].denominator))
                        for a in range(0, len(of), BLOCK):
                            part = of[a : a + BLOCK]
                            spread = found[part]
                            best.take(int(first[begin]) + a, spread, ~like[part] & (spread >= low[a : a + BLOCK]) & (spread <= high[a : a + BLOCK]), ids[some], rows[some])
        for own, _, first, best in asked.values():
            heads = [(a[0], a[1], *p) for a in own for p in (a[4] if window else [(None, None, None)])]
            out = [(*head, row, id_, -negative) for head, kept in zip(heads, best.kept) for negative, id_, row in kept]
            for at in range(0, len(out), 10_000):
                columns = list(zip(*out[at : at + 10_000]))
                kinds = [pa.int64()] * 4 + [pa.decimal128(38, 0), pa.int64(), pa.int64(), pa.decimal128(38, 0)]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.array([TaskContext.get().partitionId()] * len(columns[0]), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in LISTS.split(", ")])

    return ready.select("id", "row", "label", "x").mapInArrow(run, LISTS)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each list, with their ranks: within groups of 64 tasks first, then over all."""
    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    own = ["anchor_row", "positive_row"]
    near = Window.partitionBy(*own, F.floor(F.col("task") / 64)).orderBy(*order)
    some = lists.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where(F.col("rank") <= k).drop("task")


def mine_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, window: tuple[str, str] = ("0.5", "0.95"), scale: int = 256, slice_bytes: int = 8 << 20) -> DataFrame:
    """anchor_id, anchor_row, positive_id, positive_row, rank, negative_id, positive_score, negative_score for each anchor and positive."""
    ready = durable(taking_part(vectors, is_anchor, label), "vectors")
    norms = ready.agg(F.coalesce(F.max("norm"), F.lit(0.0)).alias("all"), F.coalesce(F.max(F.when(F.col("anchor"), F.col("norm"))), F.lit(0.0)).alias("anchors"), F.coalesce(F.max(F.octet_length("x")), F.lit(0)).alias("x"), F.coalesce(F.sum(F.when(F.col("anchor"), F.octet_length("x") + 64)), F.lit(0)).alias("bytes")).first()
    root = 1 + int(np.sqrt(norms["x"] / 8))  # floor adds at most one to a component
    primes = primes_for((scale * (int(norms["all"]) + 1) + root) * (scale * (int(norms["anchors"]) + 1) + root))
    shares = tuple(Fraction(s) for s in window)
    anchors, out = ready.where("anchor"), None
    turns = parts_for(norms["bytes"], slice_bytes)
    for turn in range(turns):
        some = [(r["row"], r["id"], r["label"], bytes(r["x"])) for r in anchors.where(F.pmod(F.xxhash64("row"), F.lit(turns)) == turn).select("row", "id", "label", "x").collect()]  # about slice_bytes
        some.sort()
        context = ready.sparkSession.sparkContext
        best: dict[int, list] = {}
        for r in merged(searched(ready, context.broadcast([(*a, []) for a in some]), scale, primes, positives, None), positives).orderBy("rank").collect():  # k for each anchor of the slice
            best.setdefault(r["anchor_row"], []).append((r["row"], r["id"], int(r["score"])))
        found = merged(searched(ready, context.broadcast([(*a, best[a[0]]) for a in some if a[0] in best]), scale, primes, negatives, shares), negatives)
        found = found if turns == 1 else durable(found, "negatives")  # or every slice would be searched in one job
        out = found if out is None else out.unionByName(found)
    fits = lambda c: F.when(F.abs(c) <= F.lit(str((1 << 63) - 1)).cast("decimal(38,0)"), c).otherwise(F.raise_error("a score does not fit 64 bits")).cast("long")
    return out.select("anchor_id", "anchor_row", "positive_id", "positive_row", "rank", F.col("id").alias("negative_id"), fits(F.col("positive_score")).alias("positive_score"), fits(F.col("score")).alias("negative_score"))
