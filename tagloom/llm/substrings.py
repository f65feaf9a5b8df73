"""Passages that repeat anywhere in the corpus, found by anchors at the positions of a difference cover.

1. A difference cover D of a period v has, for any two positions, a common shift below v that brings both into D. So two equal
   windows of n words, wherever they begin, hold two equal runs of n - v + 1 words that both begin at cover positions: only
   these runs, the anchors, are hashed. With v = 21 five positions in 21 are in the cover, and anchors have 15 of 35 words.
2. Anchors are shuffled by hash. A slice of texts sends each hash once, so a passage that stands in a third of all documents
   comes once from each slice and not once from each document; those of its places that a slice already knows to be repeated
   travel apart, dealt evenly. Anchors without an equal one go.
3. Around each anchor that is left, the windows that hold it in its place are hashed (96 bits) and shuffled in the same way.
   A window with an equal one is repeated; its words go. No pairs are made, whatever the size of a group.
4. Texts with equal words are known before: each of their windows is repeated. Their windows are compared with others' but no
   places are collected for them, so the places of a text are as many as its words at most.

Texts move only where they have anchors or windows to join, and not even then while these are few (counted first).

Defined results: null and empty texts have no words; nothing goes from a text with fewer words than a window; a window that
overlaps its own repetition counts; repeated rows are documents of their own, so all of a repeated long text goes; null ids keep
their rows; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import durable, id_and_text, matching
from tagloom.llm.shingles import hashed_words, mixed
from tagloom.llm.tokens import slices

PERIOD, COVER = 21, (3, 6, 7, 12, 14)  # every difference modulo 21 is one of two members of the cover
PROBES = "hash long, more int, key long, place int, alone boolean"
NOWHERE = -1  # the place of a probe that only tells others that it is there
FEW_KEYS, FEW_RUNS = 200_000, 1_000_000  # more texts or runs than this are shuffled instead of broadcast

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def run_hashes(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash for each run of n words, put together from runs of powers of two."""
    out, done = np.zeros(max(0, len(words) - n + 1), np.uint64), 0
    part, size, power = words, 1, base
    while size <= n:
        if n & size:
            out = out * power + part[done : done + len(out)]
            done += size
        part, size, power = part[:-size] * power + part[size:], 2 * size, np.uint64(int(power) ** 2 % (1 << 64))
    return mixed(out)


def named_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, key: 64 bits of the text; rows with equal texts share it."""
    return id_and_text(docs).withColumn("key", F.xxhash64(F.lit(1), "text"))


def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and for each the place in its text, its text's place in the slice, and the words that follow there."""
    hashes, bounds = hashed_words(part.column("text"), lower=False)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes)) - bounds[:-1][text]
    return hashes, place, text, sizes[text] - place


def dealt(hash_: np.ndarray, more: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows of PROBES for the runs of a slice: one for each hash.

    If a hash is there once its row carries the place; else one row without a place stands for all, and their places are known to
    be repeated: these get rows that are not compared (``alone`` is false) and a hash of their own that deals them evenly.
    """
    order = np.lexsort((more, hash_))
    hash_, more, key, place = hash_[order], more[order], key[order], place[order]
    new = np.ones(len(hash_), bool)
    new[1:] = (hash_[1:] != hash_[:-1]) | (more[1:] != more[:-1])
    last = np.append(new[1:], True) if len(new) else new
    single, first = new & last, new & ~last
    known = ~single & (place > NOWHERE)
    spread = mixed(key[known].view(np.uint64) + place[known].astype(np.uint64)).view(np.int64)
    columns = (
        np.concatenate((hash_[single], hash_[first], spread)),
        np.concatenate((more[single], more[first], np.zeros(len(spread), np.int32))),
        np.concatenate((key[single], np.zeros(int(first.sum()), np.int64), key[known])),
        np.concatenate((place[single], np.full(int(first.sum()), NOWHERE, np.int32), place[known])),
        np.arange(int(single.sum()) + int(first.sum()) + len(spread)) < int(single.sum()) + int(first.sum()),
    )
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["hash", "more", "key", "place", "alone"])


def repeated(probes: DataFrame) -> DataFrame:
    """key, place of the runs that have an equal one: sorted by hash, neighbours are compared as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, equal = None, False  # the last row, and whether it equals the one before
        def out(hit: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
            keep = (hit | ~columns[4]) & (columns[3] > NOWHERE)
            return pa.RecordBatch.from_arrays([pa.array(columns[2][keep]), pa.array(columns[3][keep])], ["key", "place"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            if not len(columns[0]):
                continue
            hash_, more, _, _, alone = columns
            same = (hash_[1:] == hash_[:-1]) & (more[1:] == more[:-1]) & alone[1:] & alone[:-1]
            hit = np.concatenate(([equal], same)) | np.concatenate((same, [False]))
            held, equal = [c[-1:] for c in columns], bool(hit[-1])
            yield out(hit[:-1], [c[:-1] for c in columns])
        if held is not None:
            yield out(np.array([equal]), held)

    keys = ["alone", "hash", "more"]
    return probes.repartition("hash", "more").sortWithinPartitions(*keys).mapInArrow(run, "key long, place int")


def runs_by_key(places: DataFrame, before: int, after: int) -> DataFrame:
    """key, runs: [begin, end, begin, end, ...] of what lies from so many words before to so many behind any of a key's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for found in batch.column("places").to_pylist():
                at = np.unique(np.array(found, np.int64))
                begin, end = np.maximum(at - before, 0), at + after
                new = np.append(True, begin[1:] > end[:-1])
                runs.append(np.column_stack((begin[new], end[np.append(new[1:], True)])).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(runs, pa.list_(pa.int64()))], ["key", "runs"])

    return places.groupBy("key").agg(F.collect_list("place").alias("places")).mapInArrow(run, "key long, runs array<long>")


def with_runs(texts: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """The texts with the runs of their key. Few runs are counted and broadcast, so texts stay where they are."""
    size = runs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("runs")).first()
    few = size["n"] <= FEW_KEYS and size["runs"] <= FEW_RUNS
    return texts.join(F.broadcast(runs) if few else runs, "key", how)


def inside(bounds: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """For each word of a slice, how many of its text's runs it lies in."""
    flat, own = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    text = np.repeat(np.arange(len(lists)), np.diff(own) // 2)
    change = np.zeros(bounds[-1] + 1, np.int64)
    for k, step in ((0, 1), (1, -1)):
        np.add.at(change, np.minimum(bounds[text] + flat[k::2], bounds[text + 1]), step)
    return np.cumsum(change[:-1])


def anchors(texts: DataFrame, window: int) -> DataFrame:
    length = window - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, place, text, left = words_of(part)
                at = np.flatnonzero(in_cover[place % PERIOD] & (left >= length) & (left + place >= window))
                found = run_hashes(hashes, length, _BASES[0])[at].view(np.int64)
                yield dealt(found, np.zeros(len(at), np.int32), part.column("key").to_numpy()[text[at]], place[at].astype(np.int32))

    return texts.select("key", "text").mapInArrow(run, PROBES)


def windows(texts: DataFrame, window: int) -> DataFrame:
    """texts(key, text, runs): the windows that begin in the runs; where these are null, all windows, without their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, place, text, left = words_of(part)
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                whole = part.column("runs").is_null().to_numpy(zero_copy_only=False)
                at = np.flatnonzero((left >= window) & (whole[text] | (inside(bounds, part.column("runs")) > 0)))
                one = run_hashes(hashes, window, _BASES[0])[at].view(np.int64)
                two = (run_hashes(mixed(hashes), window, _BASES[1])[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield dealt(one, two, part.column("key").to_numpy()[text[at]], np.where(whole[text[at]], NOWHERE, place[at]).astype(np.int32))

    return texts.select("key", "text", "runs").mapInArrow(run, PROBES)


REST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def rest(texts: DataFrame, window: int, written: bool) -> DataFrame:
    """What is left of texts(doc_id, text, runs, copied) without the words in their runs; of a copied text nothing, if it has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows: tuple[list, ...] = ([], [], [], [])
                columns = (batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("runs").to_pylist(), batch.column("copied").to_pylist())
                for text, runs, copied in zip(*columns):
                    words = text.split()  # bytes are split at the six characters of the contract
                    n, kept = len(words), words
                    if copied and n >= window:
                        kept = []
                    elif runs:
                        ends = [0, *runs, n]
                        kept = [w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]]
                    left = b" ".join(kept)
                    for column, value in zip(rows, (n, n - len(kept), hashlib.sha256(left).hexdigest(), left)):
                        column.append(value)
                out = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string())))]
                out += [pa.array(rows[3], pa.binary()).cast(pa.string())] if written else []
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(out)])

    return texts.select("doc_id", "text", "runs", "copied").mapInArrow(run, REST + (", kept string" if written else ""))


def drop_repeated_passages(docs: DataFrame, window: int = 35, written: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; ``written`` adds the kept words, joined by one blank."""
    if window < 2 * PERIOD // 3 + PERIOD:
        raise ValueError("a window must be longer than the period by two thirds of it, or anchors are too short to tell texts apart")
    texts = named_texts(docs)
    many = texts.groupBy("key", F.xxhash64(F.lit(2), "text").alias("check")).count().where("count > 1")
    copied = durable(many.select("key").distinct(), "copied")
    everywhere = copied.select("key", F.lit(None).cast("array<long>").alias("runs"))
    near = matching(repeated(anchors(texts, window)), F.col("key"), copied, "left_anti")
    todo = durable(runs_by_key(near, PERIOD - 1, 1).unionByName(everywhere), "todo")
    gone = runs_by_key(repeated(windows(with_runs(texts, todo, "inner"), window)), 0, window)
    marks = durable(gone.withColumn("copied", F.lit(False)).unionByName(everywhere.withColumn("copied", F.lit(True))), "repeated")
    return rest(with_runs(texts, marks, "left"), window, written)
