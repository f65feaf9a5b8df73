"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each class is a Gaussian whose covariance is shrunk towards the pooled one and towards its own mean variance. The score is
the logistic of the difference of log densities plus log prior odds, taken over a temperature; densities come from
Mahalanobis distances by Cholesky factors that are computed once and sent with the task.

The fit uses all labelled rows of the training folds: Spark sums counts, first and second moments, so only one row of sums
for each class reaches the driver.

Defined results: a null or empty text has the statistics of an empty text and is scored with them; null ids and repeated
rows are scored like any; labels that are null are not used; with an empty or one-sided training set every score is the
share of label 1 there (0.5 where there is none); an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import durable, has_checkable_fold, id_and_text, matching
from tagloom.llm.tokens import slices

STATISTICS = ("chars", "words", "word_length", "upper", "digit", "stop", "comma", "mark", "pipe", "symbol", "wide", "lines", "line_words", "distinct_words", "top_word", "distinct_lines", "marked_words")
N = len(STATISTICS)
TEMPERATURE = 4.0


def text_statistics(text: str) -> list[float]:
    """Counts as logarithms, shares as log odds with half a count added."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, w, m = len(text), len(words), len(lines)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.bincount(np.minimum(code, 256), minlength=257)
    upper, digit = int(kind[65:91].sum()), int(kind[48:58].sum())
    stop, comma, pipe = int(kind[46]), int(kind[44]), int(kind[124])
    mark = int(kind[33] + kind[63])
    symbol = int(kind[35:39].sum() + kind[42] + kind[43] + kind[60:63].sum() + kind[64] + kind[92] + kind[94:97].sum() + kind[123] + kind[125:127].sum())
    seen: dict[str, int] = {}
    marked = 0
    for x in words:
        seen[x] = seen.get(x, 0) + 1
        marked += not x[-1].isalpha()

    def odds(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))

    return [
        np.log1p(n), np.log1p(w), np.log((n - w + 1) / (w + 1)), odds(upper, n), odds(digit, n), odds(stop, w), odds(comma, w), odds(mark, w), odds(pipe, w), odds(symbol, n),
        odds(int(kind[256]), n), np.log1p(m), np.log((w + 1) / (m + 1)), odds(len(seen), w), odds(max(seen.values(), default=0), w), odds(len(set(lines)), m), odds(marked, w),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [np.array(text_statistics(t), "<f8").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "x"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, x binary")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverted Cholesky factors of the covariances and log weights (prior less half the log determinant) of both classes."""

    mean: np.ndarray
    inverse: np.ndarray  # of the lower factor: a Mahalanobis distance is the length of its product with what is left of the mean
    weight: np.ndarray
    share: float

    @staticmethod
    def fit(count: np.ndarray, total: np.ndarray, square: np.ndarray, pooled: float = 0.3, ridge: float = 0.02) -> Discriminant:
        """From each class's number of rows, sums and sums of outer products."""
        share = float(count[1] / count.sum()) if count.sum() else 0.5
        if count.min() < 2:
            return Discriminant(np.zeros((2, 0)), np.zeros((2, 0, 0)), np.zeros(2), share)
        mean = total / count[:, None]
        own = square / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
        together = (own * count[:, None, None]).sum(axis=0) / count.sum()
        inverses, weights = [], []
        for k in (0, 1):
            mixed = (1 - pooled) * own[k] + pooled * together
            mixed = (1 - ridge) * mixed + ridge * np.eye(len(mixed)) * np.trace(mixed) / len(mixed)
            factor = np.linalg.cholesky(mixed)
            inverses.append(np.linalg.inv(factor))
            weights.append(np.log(count[k] / count.sum()) - np.log(np.diag(factor)).sum())
        return Discriminant(mean, np.array(inverses), np.array(weights), share)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean.shape[1]:
            return np.full(len(x), self.share)
        density = [self.weight[k] - 0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -30, 30)))


def moments(labelled: DataFrame) -> DataFrame:
    """labelled(y, x) -> y, n, sums: count, sums and sums of products for each class and task, as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(2), np.zeros((2, N + N * N))
        for batch in batches:
            if batch.num_rows:
                x, y = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f8").reshape(-1, N), batch.column("y").to_numpy()
                for k in (0, 1):
                    own = x[y == k]
                    n[k] += len(own)
                    sums[k] += np.concatenate((own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n), pa.array(list(sums), pa.list_(pa.float64()))], ["y", "n", "sums"])

    parts = labelled.mapInArrow(run, "y int, n double, sums array<double>")
    each = parts.select("y", "n", F.posexplode("sums").alias("at", "value"))
    return each.groupBy("y", "at").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def training_labels(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id, y of the training folds (fold 0 of 5 by crc32 is held out)."""
    return has_checkable_fold(labels.select("doc_id", F.col(column).cast("int").alias("y"))).where("y in (0, 1) and not held_out").select("doc_id", "y")


def fit(statistics: DataFrame, known: DataFrame) -> Discriminant:
    """From the statistics of every labelled row."""
    rows = moments(statistics.join(known, "doc_id").select("y", "x")).collect()  # 2 x (N + N * N) rows, whatever the input
    count, sums = np.zeros(2), np.zeros((2, N + N * N))
    for r in rows:
        count[r["y"]], sums[r["y"], r["at"]] = r["n"], r["value"]
    return Discriminant.fit(count, sums[:, :N], sums[:, N:].reshape(2, N, N))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    statistics = durable(with_statistics(docs), "statistics")
    model = fit(statistics, training_labels(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f8").reshape(-1, N))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = has_checkable_fold(statistics.mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose own text scores at least the threshold, with all their columns.

    Rows that repeat an id are judged by their own texts; null and empty texts by the statistics of an empty one. Statistics
    for the fit are computed for the labelled documents alone.
    """
    known = durable(training_labels(labels), "known")
    some = matching(docs.select("doc_id", "text"), F.col("doc_id").cast("long"), known.select(F.col("doc_id").cast("long")).distinct(), "left_semi")
    model = fit(with_statistics(some), known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([text_statistics(t or "") for t in part.column("text").to_pylist()]).reshape(-1, N)
                yield part.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
