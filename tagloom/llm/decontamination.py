"""Benchmark decontamination: rare n-gram seeds join training passages to test items, local alignment scores them.

1. Words are lower-cased and stripped of marks at their ends. The n-grams of all items are counted over the whole corpus. Those
   that occur, and at most ``common`` times, are seeds. More frequent ones are thinned: of each ``thin`` neighbouring n-grams of
   an item the rarest is a seed, by powers of two of its count and, among like counts, by hash. So every run of n + thin - 1 words
   that a document shares with an item holds a seed of it. ``thin=1`` keeps every n-gram: the exact form.
2. Around each seed in a document a passage is taken that is long enough for every alignment that holds the seed and reaches
   the threshold. Three upper bounds of its score (equal words, the best stretch of them, equal words as often as the item has
   them), taken for all passages of a slice at once, drop only passages that can't reach it.
3. Smith-Waterman alignment of the passage gives the score: 2 for equal words, -1 for a replaced, an added or a missing one,
   over the score of the whole item. Many passages, of any items, are aligned at a time.

An item with fewer words than an n-gram is a seed as a whole. Copies edited so densely that no n-gram is left are not found.

Test items are few beside the corpus and are sent to all tasks. Their number of n-grams is checked: beyond ``most_grams`` they
are taken in slices of bounded size, each with its own passes over the documents.

Defined results: null and empty texts match nothing, neither do items without words or without an id; an item with fewer words
than ``least_words`` is found only where all its words stand in a row; null ids are carried, and all rows without one count as
one document, whose leaks are reported once for each item; repeated rows are reported once for each id and item; items with
equal texts are all reported; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import durable, id_and_text, matching, parts_for
from tagloom.llm.shingles import mixed
from tagloom.llm.tokens import slices

PASSAGES = 2000  # passages that one task aligns
CELLS = 50_000  # words of the passages that are aligned at a time, unless one alone is longer
MATCHES = "doc_id long, item_id long, score double, first_word long, last_word long"


def bare(word: str) -> str:
    """Lower case, without marks at the ends."""
    word = word.lower()
    if word.isalnum():
        return word
    keep = [n for n, c in enumerate(word) if c.isalnum()]
    return word[keep[0] : keep[-1] + 1] if keep else ""


@dataclass
class Seeds:
    """Word runs of one length in ascending order of their numbers, with the items that hold them."""

    size: int
    grams: np.ndarray  # one for each distinct run
    owners: np.ndarray  # item places, run after run
    bounds: np.ndarray  # where each run's items begin


@dataclass
class Items:
    """Test items as word numbers, and their seeds: runs of ``size`` words, and whole items that are shorter."""

    vocabulary: dict[str, int]
    ids: np.ndarray
    words: list[np.ndarray]
    seeds: list[Seeds]

    @staticmethod
    def of(rows: list[tuple[int, str]], size: int) -> Items:
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in map(bare, text.split()) if w], np.int64) for _, text in rows]
        seeds = []
        for n in range(1, size + 1):
            own = [(w, k) for k, w in enumerate(words) if (len(w) == n if n < size else len(w) >= n)]
            ordered = np.array(sorted({(g, k) for w, k in own for g in gram_numbers(w, n, len(vocabulary)).tolist()}), np.int64).reshape(-1, 2)
            if len(ordered):
                grams, first = np.unique(ordered[:, 0], return_index=True)
                seeds.append(Seeds(n, grams, ordered[:, 1], np.append(first, len(ordered))))
        return Items(vocabulary, np.array([i for i, _ in rows], np.int64), words, seeds)


def gram_numbers(words: np.ndarray, size: int, vocabulary: int) -> np.ndarray:
    """A number for each run of so many words; -1 where one isn't in the vocabulary."""
    n = max(0, len(words) - size + 1)
    out, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(size):
        part = words[k : k + n]
        known &= part >= 0
        out = out * (vocabulary + 1) + np.maximum(part, 0)
    return np.where(known, out, -1)


def numbered(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row (-1 for words of no item; words without letters or digits are left out), bounds."""
    lists = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    words = lists.flatten().dictionary_encode()
    known = np.array([items.vocabulary.get(b, -1) if (b := bare(w)) else -2 for w in words.dictionary.to_pylist()], np.int64)
    codes, bounds = known[words.indices.to_numpy()], lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = codes > -2
    return codes[real], np.concatenate(([0], np.cumsum(real)))[bounds]


def places(codes: np.ndarray, bounds: np.ndarray, items: Items, seeds: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in all words, place among the seeds) of every seed of one length."""
    grams = gram_numbers(codes, seeds.size, len(items.vocabulary))
    at = np.flatnonzero(grams >= 0)
    place = np.minimum(np.searchsorted(seeds.grams, grams[at]), len(seeds.grams) - 1)
    found = seeds.grams[place] == grams[at] if len(seeds.grams) else np.zeros(len(at), bool)
    at, place = at[found], place[found]
    doc = np.searchsorted(bounds, at, "right") - 1
    inside = at + seeds.size <= bounds[doc + 1]
    return doc[inside], at[inside], place[inside]


def hits(codes: np.ndarray, bounds: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in all words, item, seed length) of every seed of every item."""
    parts = []
    for seeds in items.seeds:
        doc, at, place = places(codes, bounds, items, seeds)
        each = np.diff(seeds.bounds)[place]
        ends = np.cumsum(each)
        item = seeds.owners[np.repeat(seeds.bounds[place] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        parts.append((np.repeat(doc, each), np.repeat(at, each), item, np.full(len(item), seeds.size)))
    return tuple(np.concatenate([p[n] for p in parts] or [np.empty(0, np.int64)]).astype(np.int64) for n in range(4))


def counted(docs: DataFrame, shared) -> list[np.ndarray]:
    """How often each seed of each length occurs in the documents; no more numbers than the items have seeds reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for part in slices(batch):
                codes, bounds = numbered(part.column("text"), items)
                for n, seeds in enumerate(items.seeds):
                    _, _, place = places(codes, bounds, items, seeds)
                    found, many = np.unique(place, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n, np.int64)), pa.array(found), pa.array(many.astype(np.int64))], ["length", "place", "n"])

    sums = docs.mapInArrow(run, "length long, place long, n long").groupBy("length", "place").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(len(seeds.grams), np.int64) for seeds in shared.value.seeds]
    length, place, n = (sums.column(c).to_numpy() for c in ("length", "place", "n"))
    for k, counts in enumerate(out):
        counts[place[length == k]] = n[length == k]
    return out


def rare(items: Items, counts: list[np.ndarray], size: int, common: int, thin: int) -> Items:
    """The items with their rare seeds alone."""
    kept = []
    for seeds, many in zip(items.seeds, counts):
        keep = np.zeros(len(seeds.owners), bool)
        if seeds.size < size or thin <= 1:  # whole short items, or the exact form
            keep[:] = np.repeat(many > 0, np.diff(seeds.bounds))
        else:
            rank = np.where(many == 0, np.iinfo(np.int64).max, (np.log2(np.maximum(many, 1)).astype(np.int64) << 40) + (mixed(seeds.grams.astype(np.uint64)) >> np.uint64(24)).astype(np.int64))
            for k, words in enumerate(items.words):
                grams = gram_numbers(words, size, len(items.vocabulary))
                if not len(grams):
                    continue
                at = np.searchsorted(seeds.grams, grams)
                chosen = set(at[many[at] <= common].tolist())
                for begin in range(max(1, len(at) - thin + 1)):
                    some = at[begin : begin + thin]
                    chosen.add(int(some[rank[some].argmin()]))
                for place in chosen:
                    if many[place]:
                        own = slice(int(seeds.bounds[place]), int(seeds.bounds[place + 1]))
                        keep[own] |= seeds.owners[own] == k
        each = np.add.reduceat(keep, seeds.bounds[:-1].astype(np.int64)) if len(seeds.grams) else np.zeros(0, np.int64)
        some = each > 0
        kept.append(Seeds(seeds.size, seeds.grams[some], seeds.owners[keep], np.concatenate(([0], np.cumsum(each[some])))))
    return Items(items.vocabulary, items.ids, items.words, kept)


def least_score(words: int, threshold: float, least_words: int) -> float:
    """The score that an item of so many words has to reach."""
    return max(2 * min(least_words, words), threshold * 2 * words)


def may_reach(item: np.ndarray, lo: np.ndarray, hi: np.ndarray, codes: np.ndarray, least: np.ndarray, keys: np.ndarray, many: np.ndarray, vocabulary: int, most: int = 1_000_000) -> np.ndarray:
    """Which passages [lo, hi) no bound rules out. keys: item and word as one number, ascending; many: how often the item has it.

    Matches are 2 each and every other word of the text costs 1. Passages are taken so many words at a time.
    """
    out = np.zeros(len(item), bool)
    sizes = hi - lo
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(item):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + most, "right")))
        own = slice(begin, end)
        first = np.concatenate(([0], np.cumsum(sizes[own])))
        group = np.repeat(np.arange(end - begin), sizes[own])
        words = codes[np.arange(first[-1]) - first[:-1][group] + lo[own][group]]
        wanted = item[own][group] * (vocabulary + 1) + np.maximum(words, 0)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        equal = (words >= 0) & (keys[place] == wanted)
        # running sums less the least one so far; a passage begins below all before it, so the least starts anew there
        apart = 3 * int(sizes[own].max(initial=0)) + 3
        sums = np.cumsum(np.where(equal, 2, -1))
        start = np.concatenate(([0], sums[first[1:-1] - 1]))
        inner = sums - start[group] - group * apart
        before = np.where(np.arange(first[-1]) == first[:-1][group], -group * apart, np.concatenate(([0], inner[:-1])))
        best = np.maximum.reduceat(inner - np.minimum.accumulate(before), first[:-1]) if first[-1] else np.zeros(0)
        alive = np.flatnonzero((2 * np.add.reduceat(equal, first[:-1]) >= least[own]) & (best >= least[own]))
        # of those left: equal words count as often as the item has them
        left = np.isin(group, alive) & equal
        pair, n = np.unique(group[left] * np.int64(len(keys)) + place[left], return_counts=True)
        sums = np.bincount(pair // len(keys), np.minimum(n, many[pair % len(keys)]), minlength=end - begin)
        out[begin + alive] = 2 * sums[alive] >= least[own][alive]
        begin = end
    return out


def padded(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and items as matrices, filled up with numbers that are equal to nothing, and the items' lengths."""
    steps = np.array([len(w) for w in items])
    text = np.full((len(items), max(map(len, texts), default=0)), -2, np.int32)
    item = np.full((len(items), int(steps.max(initial=0))), -3, np.int32)
    for k, (w, t) in enumerate(zip(items, texts)):
        item[k, : len(w)], text[k, : len(t)] = w, t
    return text, item, steps


def best_scores(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """The score of the best local alignment of each item and its text, without its place."""
    text, item, steps = padded(items, texts)
    width = text.shape[1]
    kind = np.int16 if 2 * item.shape[1] + width < 30_000 else np.int32
    place, score, best = np.arange(1, width + 1).astype(kind), np.zeros((len(items), width + 1), kind), np.zeros(len(items), np.int64)
    for n in range(item.shape[1]):
        new = np.maximum(score[:, :-1] + np.where(text == item[:, n : n + 1], kind(2), kind(-1)), score[:, 1:] - kind(1))
        new += place
        np.maximum.accumulate(new, axis=1, out=new)  # words added in the text cost 1 each
        new -= place
        np.maximum(new, 0, out=score[:, 1:])
        best = np.where(n < steps, np.maximum(best, score.max(axis=1)), best)
    return best


def align_many(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Best local alignment of each item and its text: score, and the first and last place in the text."""
    text, item, steps = padded(items, texts)
    rows, width = text.shape
    place = np.arange(width + 1)
    score, begin = np.zeros((rows, width + 1), np.int64), np.tile(place, (rows, 1))
    best = np.zeros((rows, 3), np.int64)
    for n in range(item.shape[1]):
        step = np.where(text == item[:, n : n + 1], 2, -1)
        new, came = np.zeros_like(score), np.tile(place, (rows, 1))
        for value, origin in ((score[:, :-1] + step, begin[:, :-1]), (score[:, 1:] - 1, begin[:, 1:])):
            better = value > new[:, 1:]
            new[:, 1:], came[:, 1:] = np.where(better, value, new[:, 1:]), np.where(better, origin, came[:, 1:])
        # words added in the text: the best score further left, less 1 for each of them
        reach = np.maximum.accumulate(new + place, axis=1)
        last = np.maximum.accumulate(np.where(new + place == reach, place, 0), axis=1)
        longer = reach - place > new
        score, begin = np.where(longer, reach - place, new), np.where(longer, np.take_along_axis(came, last, axis=1), came)
        top = score.argmax(axis=1)
        high = score[np.arange(rows), top]
        up = (high > best[:, 0]) & (n < steps)
        best[up] = np.column_stack((high, begin[np.arange(rows), top], top - 1))[up]
    return list(map(tuple, best.tolist()))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    return align_many([item], [text])[0]


def passages(docs: DataFrame, shared, threshold: float, least_words: int) -> DataFrame:
    """doc_id, item (its place), at, words: passages around seeds.

    An alignment of m matches and e edits covers at most m + e words of the text, and 2 m - e is at least the least score, so
    three times the item's length less that score is as far as it can reach from a seed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        least = np.array([least_score(len(w), threshold, least_words) for w in items.words])
        reach = np.array([max(0, int(3 * len(w) - x) + 1) for w, x in zip(items.words, least)], np.int64)
        flat = np.concatenate([k * (len(items.vocabulary) + 1) + w for k, w in enumerate(items.words)] or [np.empty(0, np.int64)])
        keys, many = np.unique(flat, return_counts=True)
        for batch in batches:
            for part in slices(batch):
                codes, bounds = numbered(part.column("text"), items)
                doc, at, item, size = hits(codes, bounds, items)
                order = np.lexsort((at, item, doc))
                doc, at, item, size = doc[order], at[order], item[order], size[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * reach[item[1:]])  # nearer ones would overlap
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(doc))[: len(first)] - 1
                doc, item = doc[first], item[first]
                lo, hi = np.maximum(bounds[doc], at[first] - reach[item]), np.minimum(bounds[doc + 1], at[last] + size[last] + reach[item])
                good = np.flatnonzero(may_reach(item, lo, hi, codes, least[item], keys, many, len(items.vocabulary))) if len(first) else first
                for some in np.array_split(good, max(1, -(-int((hi - lo)[good].sum()) // 2_000_000))):
                    sizes = (hi - lo)[some]
                    ends = np.concatenate(([0], np.cumsum(sizes)))
                    words = codes[np.arange(ends[-1]) + np.repeat(lo[some] - ends[:-1], sizes)].astype("<i4")
                    packed = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(words.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc[some])), pa.array(item[some]), pa.array(lo[some] - bounds[doc[some]]), packed], ["doc_id", "item", "at", "words"])

    return docs.mapInArrow(run, "doc_id long, item long, at long, words binary")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 3, threshold: float = 0.4, least_words: int = 5, most_grams: int = 2_000_000, common: int = 1000, thin: int = 3) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: the best alignment of each document and item at or above the threshold."""
    texts = id_and_text(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    words = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    rounds, out = parts_for(words, most_grams), None
    for turn in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == turn)
        send = docs.sparkSession.sparkContext.broadcast
        whole = Items.of(sorted((r["item_id"], r["text"]) for r in part.collect()), size)  # a slice of about most_grams words
        shared = send(rare(whole, counted(texts, send(whole)), size, common, thin))
        found = aligned(durable(passages(texts, shared, threshold, least_words), "passages"), shared, threshold, least_words)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "last_word")).alias("m"))
    return best.select("doc_id", "item_id", "m.score", "m.first_word", "m.last_word")


def aligned(found: DataFrame, shared, threshold: float, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "item", "at", "words")]
            order = sorted(range(batch.num_rows), key=lambda n: (len(columns[3][n]), len(items.words[columns[1][n]])))
            begin = 0
            while begin < len(order):
                many = max(1, min(256, CELLS // (len(columns[3][order[min(len(order), begin + 256) - 1]]) // 4 + 1)))
                some = order[begin : begin + many]
                begin += many
                own, texts = [items.words[columns[1][n]] for n in some], [np.frombuffer(columns[3][n], "<i4") for n in some]
                high = [k for k, (score, item) in enumerate(zip(best_scores(own, texts), own)) if score >= least_score(len(item), threshold, least_words)]
                for k, (score, first, last) in zip(high, align_many([own[k] for k in high], [texts[k] for k in high])):
                    doc, item, at, _ = (c[some[k]] for c in columns)
                    for column, value in zip(rows, (doc, int(items.ids[item]), score / (2 * len(own[k])), at + first, at + last)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "last_word"])

    keys = ["doc_id", "item", "at", "words"]
    spread = found.repartition(parts_for(found.count(), PASSAGES), *keys).dropDuplicates(keys)  # repeated rows; one shuffle for both
    return spread.mapInArrow(run, MATCHES)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no test item, with all their columns.

    Each row is judged by its own text: a leaking row goes whether or not it has an id, and rows that repeat the id of a
    leaking one stay if their own text is clean. Null and empty texts stay; empty tables give or leave all rows.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    bad = durable(leaks(docs.select(text.alias("doc_id"), "text"), benchmark).select("doc_id").distinct(), "leaked")
    return matching(docs, text, bad, "left_anti")
