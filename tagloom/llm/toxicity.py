"""Toxicity by a subsequence string kernel: a support vector machine on Nyström landmarks, trained on labelled sentences.

The kernel counts common subsequences of three characters, with gaps discounted by DECAY for each character spanned, so an
insult with inserted or missing characters stays close to the plain one. It compares words (with their ends marked) and
windows of long words; marks inside words are dropped and runs of single characters are read as one word too.

Only documents carry labels, so training is by sentences of documents as bags: in each sentence of a toxic document the word
that scores highest is its witness, clean documents give their words as negatives, and the machine is trained again with the
new witnesses. The first witnesses are words that, or whose stems, stand in toxic documents far more often than chance
allows; all witnesses stand there LIFT times as often as in clean ones. After the first rounds every clean word of the sample
is scored, and those that score highest become negatives too. A logistic curve over a document's highest word scores and their
number turns them into a score; beyond SHORT words the length of a text has no part in it.

A machine on landmarks is a sum of kernels, each a product of subsequence counts, so the trained machine is one weight for
each of 64**3 subsequences. Tasks get this table (1 MB) and remember the scores of words.

Fit: on at most ``sample`` labelled documents of each class, taken by hash from the training folds, and on at most
``candidates`` distinct words of each class in them: of toxic documents those with the strongest evidence, of clean ones the
most frequent half, an even share of the rest and, after each of the MINED rounds, a quarter as many more. Both bounds are
parameters; scoring has none.
Defined results: null and empty texts are scored as texts without words; null ids and repeated rows are scored like any;
null labels are not used; with a one-sided or empty training set, or one without a letter or digit, every score is the share of
toxic ones (0.5 for none); an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SAMPLE_BYTES, has_checkable_fold, id_and_text, that_fit
from tagloom.llm.tokens import slices

SYMBOLS, DECAY, WINDOW = 64, 0.6, 14
STEM = 5  # the mark before a word and its first letters, which first witnesses may share
SIGNIFICANT = 4.5  # a first witness is commoner in toxic documents by so many standard deviations
LIFT = 3.0  # and a witness at all times by this factor: among thousands of frequent stems, some pass any bar of chance alone
MINED = (0, 1)  # after these rounds the clean words that score highest, of all there are, become negatives too
MAX_WORDS = 200_000  # how many word scores a Python worker remembers
FEATURES = 5
SHORT = 64  # a text of fewer words is short: one insult weighs more there, while no longer text makes any weigh less
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)|\n")


def symbol(char: str) -> int:
    """0 marks the ends; letters a-z, digits, and 36 classes for all other letters: neighbours in an alphabet never share one."""
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 if char.isdigit() else 28 + ord(char) % 36


def windows(word: str) -> list[tuple[int, ...]]:
    """The symbols of a word between end marks, or of overlapping windows of a longer one; none without letters or digits."""
    codes = [symbol(c) for c in word.lower() if c.isalnum()]
    if not codes:
        return []
    codes = [0, *codes, 0]
    size = WINDOW + 2
    return [tuple(codes[at : at + size]) for at in range(0, max(1, len(codes) - size + WINDOW // 2), WINDOW // 2)]


def by_length(units: list[tuple[int, ...]], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and symbol matrices of units of one length, at most so many at a time."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    for n in np.unique(sizes):
        every = np.flatnonzero(sizes == n)
        for begin in range(0, len(every), most):
            at = every[begin : begin + most]
            yield at, np.array([units[k] for k in at], np.int64)


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself."""
    rows, n = codes.shape
    same = (DECAY**2 * (codes[:, :, None] == codes[:, None, :])).transpose(1, 2, 0)
    level = same.copy()
    for _ in range(2):
        # sums of the level before over all earlier places of both, discounted by the gaps
        before = np.zeros_like(level)
        for i in range(1, n):
            for j in range(1, n):
                before[i, j] = DECAY * (before[i - 1, j] + before[i, j - 1]) - DECAY**2 * before[i - 1, j - 1] + level[i - 1, j - 1]
        level = same * before
    return level.sum(axis=(0, 1)).reshape(rows)


def subsequences(code: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Table places and weights of the subsequences of a unit."""
    places = list(combinations(range(len(code)), 3))
    at = np.array([(code[i] * SYMBOLS + code[j]) * SYMBOLS + code[k] for i, j, k in places], np.int64)
    return at, np.array([DECAY ** (k - i + 1) for i, _, k in places])


def table_scores(units: list[tuple[int, ...]], tables: np.ndarray) -> np.ndarray:
    """Rows of normalised kernel sums: for each unit the tables' weights of its subsequences, over its own length."""
    out = np.zeros((len(units), len(tables)))
    for at, codes in by_length(units):
        total = np.zeros((len(at), len(tables)))
        pairs = codes[:, :, None] * SYMBOLS + codes[:, None, :]
        for i, j, k in combinations(range(codes.shape[1]), 3):
            total += DECAY ** (k - i + 1) * tables[:, pairs[:, i, j] * SYMBOLS + codes[:, k]].T
        norm = np.sqrt(self_kernel(codes))[:, None]
        out[at] = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
    return out


def landmark_tables(units: list[tuple[int, ...]]) -> np.ndarray:
    """A row of subsequence weights for each unit, of length 1."""
    tables = np.zeros((len(units), SYMBOLS**3), np.float32)
    for row, unit in zip(tables, units):
        at, weight = subsequences(unit)
        np.add.at(row, at, weight)
        row /= np.sqrt((row.astype(np.float64) ** 2).sum())
    return tables


def evidence_of(seen: np.ndarray, total: list[int]) -> np.ndarray:
    """By how many standard deviations something stands in more toxic documents than chance allows (signed root of the
    likelihood ratio, which holds for rare things too). seen: numbers of clean and of toxic documents that have it."""
    both = seen.sum(axis=0)
    out = np.zeros(seen.shape[1])
    for k in (0, 1):
        expected = both * total[k] / max(sum(total), 1)
        out += np.where(seen[k] > 0, seen[k] * np.log(np.maximum(seen[k], 1e-9) / np.maximum(expected, 1e-9)), 0)
        missing, rest = total[k] - seen[k], total[k] - expected
        out += np.where(missing > 0, missing * np.log(np.maximum(missing, 1e-9) / np.maximum(rest, 1e-9)), 0)
    more = seen[1] * total[0] > seen[0] * total[1]
    return np.where(more, 1, -1) * np.sqrt(2 * np.maximum(out, 0))


def lifted(seen: np.ndarray, total: list[int]) -> np.ndarray:
    """Evidence as above; none where toxic documents don't have something LIFT times as often as clean ones."""
    often = (seen[1] * max(total[0], 1)) > LIFT * (seen[0] * max(total[1], 1))
    return np.where(often, evidence_of(seen, total), -np.inf)


def stem_evidence(units: list[tuple[int, ...]], bags: list[np.ndarray], toxic: np.ndarray, total: list[int]) -> np.ndarray:
    """For each unit the evidence of its stem, if that is lifted: insults come in many forms of one stem. Parts of long words
    have none."""
    number: dict[tuple[int, ...], int] = {}
    stem = np.array([number.setdefault(u[:STEM], len(number)) if u[0] == 0 else -1 for u in units], np.int64)
    seen = np.zeros((2, len(number)))
    for bag, label in zip(bags, toxic):
        own = np.unique(stem[bag])
        seen[label, own[own >= 0]] += 1
    return np.where(stem >= 0, np.append(lifted(seen, total), -np.inf)[stem], -np.inf)


def linear_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 30) -> np.ndarray:
    """Weights (the last is the offset) of a support vector machine with squared hinge loss, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, eye = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        hit = y * (x @ w) < 1
        own = x[hit] * (c * weight[hit])[:, None]
        new = np.linalg.solve(eye + own.T @ x[hit], own.T @ y[hit])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    x = np.hstack((x, np.ones((len(x), 1))))
    w, eye = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(eye + (x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p) - eye @ w)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def summary(scores: np.ndarray) -> np.ndarray:
    """What the scores of a document's words come down to: the highest, how many are high, and how short a short text is.
    Words of a long text never outweigh its insults."""
    few = np.log(SHORT / (1 + min(len(scores), SHORT)))
    if not len(scores):
        return np.array([-2.0, -2.0, 0.0, 0.0, few])
    top = -np.sort(-scores) if len(scores) <= 4 else -np.sort(np.partition(-scores, 3)[:4])
    sure, likely = int((scores > 0.5).sum()), int((scores > 0).sum())
    return np.array([np.clip(top[0], -2, 2), np.clip(top, -2, 2).mean(), np.log1p(sure), np.log1p(likely), few])


@dataclass
class Machine:
    table: np.ndarray
    offset: float
    curve: np.ndarray
    share: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The highest score among a word's windows; NaN for words without letters or digits."""
        units, owner = [], []
        for k, word in enumerate(words):
            own = windows(word)
            units += own
            owner += [k] * len(own)
        out = np.full(len(words), -np.inf)
        if units:
            np.maximum.at(out, owner, table_scores(units, self.table[None])[:, 0] + self.offset)
        return np.where(np.isfinite(out), out, np.nan)

    def document_scores(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summaries @ self.curve[:-1] + self.curve[-1], -30, 30)))


def joined_singles(words: list[str]) -> list[str]:
    """Words spelt out: runs of at least three single characters, put together."""
    return [x.replace(" ", "") for x in re.findall(r"(?<!\S)\S(?: \S){2,}(?!\S)", " ".join(words))]


def train(texts: list[str], labels: list[int], landmarks: int = 320, candidates: int = 7_500, rounds: int = 4, cost: float = 3.0) -> Machine:
    y = np.array(labels)
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < y.sum() < len(y) or not any(c.isalnum() for t in texts for c in t):
        return Machine(np.zeros(SYMBOLS**3, np.float32), -1.0, np.append(np.zeros(FEATURES), np.log((share + 1e-9) / (1 - share + 1e-9)) if len(y) else 0.0), share)
    number: dict[tuple[int, ...], int] = {}
    bags: list[list[np.ndarray]] = []
    for text in texts:
        bag = []
        for sentence in _SENTENCE.split(text):
            words = sentence.split()
            own = {u for w in {*words, *joined_singles(words)} for u in windows(w)}
            if own:
                bag.append(np.array([number.setdefault(u, len(number)) for u in sorted(own)], np.int64))
        bags.append(bag)
    fitted = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3 > 0 for t in texts])  # a third of the documents only shape the curve, on scores that they did not train
    units = list(number)
    used = [np.unique(np.concatenate(bag)) if bag else np.empty(0, np.int64) for bag, f in zip(bags, fitted) if f]
    side_of = y[fitted]
    seen = np.zeros((2, len(units)))
    for bag, label in zip(used, side_of):
        seen[label, bag] += 1
    total = [int((side_of == k).sum()) for k in (0, 1)]
    evidence = np.maximum(lifted(seen, total), stem_evidence(units, used, side_of, total)) if units else np.empty(0)
    evidence[seen[1] == 0] = -np.inf
    order = np.argsort(-evidence, kind="stable")[: int((seen[1] > 0).sum())]
    common = np.argsort(-seen[0], kind="stable")
    marks = np.unique(np.concatenate((order[: landmarks // 2], common[: landmarks // 2])))
    clean = np.flatnonzero(seen[0] > 0)
    clean = clean[np.argsort(-seen[0][clean], kind="stable")]
    clean = np.concatenate((clean[: candidates // 2], clean[candidates // 2 :: max(1, len(clean) // max(1, candidates // 2))]))
    asked = np.unique(np.concatenate((clean, order[:candidates], marks)))
    place = np.full(len(units), -1)
    place[asked] = np.arange(len(asked))

    def landmark_slices() -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(marks), 32):  # 1 MB each, so a few at a time
            yield at, landmark_tables([units[k] for k in marks[at : at + 32]])

    def kernel_of(some: np.ndarray) -> np.ndarray:
        return np.hstack([table_scores([units[k] for k in some], own) for _, own in landmark_slices()])

    def collapsed(w: np.ndarray) -> np.ndarray:
        table, turned = np.zeros(SYMBOLS**3, np.float32), half @ w[:-1]
        for at, own in landmark_slices():
            table += (turned[at : at + 32] @ own).astype(np.float32)
        return table

    kernel = kernel_of(asked)
    values, vectors = np.linalg.eigh((kernel[place[marks]] + kernel[place[marks]].T) / 2)
    keep = values > 1e-6
    half = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ half
    score = np.where(place >= 0, evidence, -np.inf) - SIGNIFICANT
    w = np.zeros(z.shape[1] + 1)
    for turn in range(rounds):
        witness: Counter[int] = Counter()
        for bag, label, f in zip(bags, y, fitted):
            if label and f:
                best = [int(sentence[score[sentence].argmax()]) for sentence in bag]
                witness.update(k for k in best if score[k] > 0 and evidence[k] > SIGNIFICANT / 2)
        if not witness:
            break
        positive = np.array(list(witness), np.int64)
        negative = clean[~np.isin(clean, positive)]
        x = np.concatenate((z[place[positive]], z[place[negative]]))
        side = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        weight = np.concatenate((np.log1p(np.array(list(witness.values()), float)), np.log1p(seen[0][negative])))
        weight[side > 0] *= 0.5 * weight[side < 0].sum() / weight[side > 0].sum()
        w = linear_machine(x, side, weight / weight.mean(), cost)
        if turn in MINED:
            rest = np.flatnonzero((seen[0] > 0) & (place < 0))
            hard = rest[np.argsort(-table_scores([units[k] for k in rest], collapsed(w)[None])[:, 0], kind="stable")[: candidates // 4]]
            place[hard] = np.arange(len(asked), len(asked) + len(hard))
            asked, clean = np.concatenate((asked, hard)), np.concatenate((clean, hard))
            z = np.concatenate((z, kernel_of(hard) @ half))
        score = np.full(len(units), -np.inf)
        score[asked] = z @ w[:-1] + w[-1]
    machine = Machine(collapsed(w), float(w[-1]), np.zeros(FEATURES + 1), share)
    held = [k for k in range(len(bags)) if not fitted[k]]
    if not 0 < y[held].sum() < len(held):
        held = list(range(len(bags)))
    own = np.unique(np.concatenate([np.concatenate(bags[k]) for k in held if bags[k]] or [np.zeros(0, np.int64)]))
    every = np.full(len(units), np.nan)
    every[own] = table_scores([units[k] for k in own], machine.table[None])[:, 0] + machine.offset
    machine.curve = logistic(np.array([summary(every[np.concatenate(bags[k])] if bags[k] else np.empty(0)) for k in held]), y[held])
    return machine


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sample: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """At most so many labelled training documents of each class, those with the smallest hashes of their ids; where ids repeat,
    at most 2 x sample rows in all, of rows that repeat all one. Sizes reach the driver first, then the texts that fit."""
    known = has_checkable_fold(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))).where("y in (0, 1) and not held_out")
    chosen = known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    found = id_and_text(docs).join(F.broadcast(chosen.select("doc_id", "y")), "doc_id").select("doc_id", "text", "y")
    key = ["doc_id", "hash", "y"]
    hashed = found.withColumn("hash", F.xxhash64("text"))
    sizes = hashed.select(*key, F.octet_length("text").alias("size")).dropDuplicates(key)
    fit = that_fit(sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "hash", "y").limit(2 * sample).collect(), most_bytes)
    few = docs.sparkSession.createDataFrame([tuple(r[c] for c in key) for r in fit], "doc_id long, hash long, y int")  # at most 2 x sample rows
    rows = hashed.join(F.broadcast(few), key, "left_semi").dropDuplicates(key).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["y"]))
    return [r["text"] for r in rows], [r["y"] for r in rows]


_SCORES: dict[bytes, dict[str, float]] = {}


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 1500, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    machine = train(*labelled_sample(docs, labels, "toxic", sample))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # one table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        key = own.table.tobytes()[:4096] + own.curve.tobytes()
        if key not in _SCORES:
            _SCORES.clear()
            _SCORES[key] = {}
        known = _SCORES[key]

        def scores_of(words: list[str]) -> np.ndarray:
            new = [w for w in words if w not in known]
            fresh = dict(zip(new, own.word_scores(new).tolist())) if new else {}
            if len(known) < MAX_WORDS:
                known.update(fresh)
            return np.array([known[w] if w in known else fresh[w] for w in words], np.float64)

        for batch in batches:
            for part in slices(batch):
                lists = pc.utf8_split_whitespace(part.column("text").cast(pa.large_string()))
                words = lists.flatten().dictionary_encode()
                each, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
                bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                score = scores_of(each)[codes]
                single = np.fromiter((len(w) == 1 for w in each), bool, len(each))[codes]
                runs = np.concatenate(([0], np.cumsum(single[2:] & single[1:-1] & single[:-2]))) if len(single) > 2 else np.zeros(1, np.int64)
                rows = np.empty((part.num_rows, FEATURES))
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    mine = score[a:b]
                    if b - a > 2 and runs[min(b - 2, len(runs) - 1)] > runs[min(a, len(runs) - 1)]:
                        mine = np.concatenate((mine, scores_of(joined_singles([each[c] for c in codes[a:b]]))))
                    rows[k] = summary(mine[~np.isnan(mine)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.document_scores(rows))], ["doc_id", "score"])

    scored = has_checkable_fold(id_and_text(docs).mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
