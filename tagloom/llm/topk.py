"""Exact top-k search by inner product: tiled matrix products of queries and vectors, then merged top lists.

Queries are taken in slices of at most ``slice_bytes``. A slice is sent to all tasks; each task multiplies it, block by block,
with the vectors that it reads in place, keeps the k best of each query and emits only these lists. Lists of a query are
merged in a tree, first within groups of tasks and then over all. So what moves grows with queries times k, never with the
vectors, and no task holds more than a slice, a batch of vectors and the product of a block of queries with that batch.

Defined results: a vector that is null, or holds a null or a component that isn't finite, takes no part, neither does a null
id; every row is a candidate of every query but itself, so rows that repeat an id are separate candidates and, if they are
queries, each has a list of its own (``query_row`` tells them apart); ties go to the smaller id; an empty table gives no
rows; vectors of another length than the query's are left out for that query; other columns are never read. Scores are
exact: where a product could pass 2**53 all work is done on whole numbers of any size, which is slow, and a returned score
that does not fit 64 bits ends the job with an error; no row is left out silently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import durable, parts_for

TOP = "query_row long, query_id long, vec_id long, vec_row long, score long, task long"
NONE = np.iinfo(np.int64).min  # no candidate yet
LOW, HIGH = NONE + 1, np.iinfo(np.int64).max  # stand for scores that don't fit 64 bits


def taking_part(vectors: DataFrame, is_query: Column) -> DataFrame:
    """vec_id, row (a number of its own), query, x (doubles as little-endian bytes), norm: the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            packed = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
            with np.errstate(over="ignore"):
                norms = [float(np.sqrt((x * x).sum())) for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("row"), batch.column("query"), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(norms)], ["vec_id", "row", "query", "x", "norm"])

    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    chosen = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~odd)
    rows = chosen.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(is_query, F.lit(False)).alias("query"), e.cast("array<double>").alias("e"))
    return rows.mapInArrow(run, "vec_id long, row long, query boolean, x binary, norm double")


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as numbers of any size; a large double is a whole number already."""
    return np.array([int(v) * scale if abs(v) > 1 << 53 else int(np.floor(scale * v)) for v in x.ravel().tolist()], object).reshape(x.shape)


class TopLists:
    """The k best candidates of each query so far: by score, then smaller id, then row."""

    def __init__(self, rows: np.ndarray, k: int):
        self.rows, self.k = rows, k
        self.score, self.id, self.at = (np.full((len(rows), k), NONE, np.int64) for _ in range(3))

    def merge(self, begin: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in a block of scores: queries from ``begin`` on, by candidates."""
        own = self.rows[begin : begin + len(scores)]
        n = min(self.k, scores.shape[1])
        scores[own[:, None] == rows[None, :]] = NONE
        least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
        least = np.maximum(least, self.score[begin : begin + len(own), -1])
        q, c = np.nonzero((scores >= least[:, None]) & (scores > NONE))
        there = np.repeat(np.arange(len(own)), self.k)
        part = slice(begin, begin + len(own))
        everyone = np.concatenate((there, q))
        score = np.concatenate((self.score[part].ravel(), scores[q, c]))
        who = np.concatenate((self.id[part].ravel(), ids[c]))
        row = np.concatenate((self.at[part].ravel(), rows[c]))
        order = np.lexsort((row, who, -score, score == NONE, everyone))
        rank = np.arange(len(order)) - np.searchsorted(everyone[order], np.arange(len(own)))[everyone[order]]
        keep = order[rank < self.k]
        for target, values in ((self.score, score), (self.id, who), (self.at, row)):
            target[part] = values[keep].reshape(len(own), self.k)


def slow_merge(lists: TopLists, queries: np.ndarray, found: np.ndarray, ids: np.ndarray, rows: np.ndarray, scale: int) -> None:
    """As TopLists.merge, on numbers of any size."""
    theirs = whole_numbers(found, scale)
    for q, x in enumerate(whole_numbers(queries, scale)):
        score = theirs @ x
        best = [(-int(s), int(i), int(r)) for s, i, r in zip(score, ids, rows) if r != lists.rows[q]]
        best += [(-int(s), int(i), int(r)) for s, i, r in zip(lists.score[q], lists.id[q], lists.at[q]) if s != NONE]
        for n, (s, i, r) in enumerate(sorted(best)[: lists.k]):
            lists.score[q, n], lists.id[q, n], lists.at[q, n] = min(max(-s, LOW), HIGH), i, r


def search_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = 512, slice_bytes: int = 32 << 20) -> DataFrame:
    """query_id, query_row, rank, vec_id, score: the k best candidates of each query row, itself left out."""
    ready = durable(taking_part(vectors, is_query), "vectors")
    queries = ready.where("query")
    size = queries.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0)).alias("bytes"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("norm")).first()
    largest = ready.agg(F.coalesce(F.max("norm"), F.lit(0.0)).alias("norm")).first()["norm"]
    exact = scale * scale * (size["norm"] + 1) * (largest + 1) < 1 << 52  # bounds every product and all partial sums of it
    slices, out = parts_for(size["bytes"], slice_bytes), None
    for turn in range(slices):
        part = queries.where(F.pmod(F.xxhash64("row"), F.lit(slices)) == turn).select("row", "vec_id", "x").collect()  # about slice_bytes
        found = searched(ready, sorted((len(r["x"]), r["row"], r["vec_id"], bytes(r["x"])) for r in part), k, scale, block, exact)
        found = merged(found, k)
        found = found if slices == 1 else durable(found, "top-lists")  # or every slice would be searched in one job
        out = found if out is None else out.unionByName(found)
    score = F.when(F.col("score").isin(int(LOW), int(HIGH)), F.raise_error("a score does not fit 64 bits")).otherwise(F.col("score"))
    return out.select("query_id", "query_row", "rank", "vec_id", score.cast("long").alias("score"))


def searched(ready: DataFrame, part: list[tuple], k: int, scale: int, block: int, exact: bool) -> DataFrame:
    """The top lists of one slice of queries in each task."""
    shared = ready.sparkSession.sparkContext.broadcast(part)  # one slice of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple] = {}
        for size in sorted({q[0] for q in shared.value}):
            own = [q for q in shared.value if q[0] == size]
            matrix = np.frombuffer(b"".join(q[3] for q in own), "<f8").reshape(len(own), size // 8)
            asked[size] = (np.floor(scale * matrix) if exact else matrix, np.array([q[2] for q in own], np.int64), TopLists(np.array([q[1] for q in own], np.int64), k))
        for batch in batches:
            vectors = batch.column("x").to_pylist()
            sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
            ids, rows = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
            for size, (matrix, _, lists) in asked.items():
                same = np.flatnonzero(sizes == size)
                for at in range(0, len(same), 4096):
                    some = same[at : at + 4096]
                    found = np.frombuffer(b"".join(vectors[n] for n in some), "<f8").reshape(len(some), size // 8)
                    if not exact:
                        slow_merge(lists, matrix, found, ids[some], rows[some], scale)
                        continue
                    right = np.floor(scale * found).T
                    for begin in range(0, len(matrix), block):
                        lists.merge(begin, (matrix[begin : begin + block] @ right).astype(np.int64), ids[some], rows[some])
        for _, names, lists in asked.values():
            for begin in range(0, len(names), 4096):
                end = min(begin + 4096, len(names))
                real = lists.score[begin:end].ravel() > NONE
                each = [np.repeat(lists.rows[begin:end], k), np.repeat(names[begin:end], k), lists.id[begin:end].ravel(), lists.at[begin:end].ravel(), lists.score[begin:end].ravel()]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[real]) for x in each), pa.array(np.full(int(real.sum()), TaskContext.get().partitionId(), np.int64))], ["query_row", "query_id", "vec_id", "vec_row", "score", "task"])

    return ready.select("vec_id", "row", "x").mapInArrow(run, TOP)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each query row, with their ranks: within groups of 64 tasks first, then over all."""
    order = [F.desc("score"), F.asc("vec_id"), F.asc("vec_row")]
    near = Window.partitionBy("query_row", F.floor(F.col("task") / 64)).orderBy(*order)
    some = lists.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).drop("rank")
    last = Window.partitionBy("query_row").orderBy(*order)
    return some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
