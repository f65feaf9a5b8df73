"""Refusal rules from a table: any number of patterns of many owners, tried on each text in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from hashlib import blake2b
from heapq import merge

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tagloom.functions.text import BLANK, folded, refusal, utrim

GRAM = 4  # characters of a run of which a literal's ends and its middle must stand in a text before the literal is sought
PLACES = ("first", "middle", "last")
SLOTS = 2**18  # of 64 bits each, in a sketch of runs; its size is the same whatever the texts hold
MOST_RUNS = 500_000  # that are placed at a time
ORDER = ("number", "owner", "word", "regex", "sensitive")  # no two rules of ready_rules are alike in all of them
FEW = 2_000  # texts that are left for a join with the rules that are left
MOST_TURNS = 500  # passes; where more are left and the last one decided less than an eighth of the texts, a join follows, which takes far more disk
SAME = {0x130: "i", 0x131: "i", 0x17F: "s"}  # in lower case still other characters than those for which patterns take them
FOUND = "id long, rule string, at long, length long, excerpt string, number long"


def flat(text):
    """Folded, with single blanks, trimmed: what patterns are tried on."""
    return utrim(F.regexp_replace(folded(text), BLANK, " "))


class Rules:
    """The rules of one owner in their order: literals, and what patterns must begin with, in two automata, one for each way to treat case."""

    def __init__(self, rows: list[tuple[int, str, bool, bool]]):
        import ahocorasick

        self.pattern, self.trees = {n: p for n, p, _, _ in rows}, []
        self.regexes = [(n, p, own) for n, p, regex, own in sorted(rows) if regex and not needed(p)]  # tried on every text
        self.compiled: dict[tuple[str, bool], re.Pattern | None] = {}
        for sensitive in (True, False):
            first: dict[str, int] = {}
            behind: dict[str, list] = {}
            for n, p, regex, own in sorted(rows):
                if own == sensitive:
                    word = needed(p) if regex else " ".join(p.split())
                    word = word if own else lowered(word)
                    if word and regex:
                        behind.setdefault(word, []).append((n, p, own))
                    elif word:
                        first.setdefault(word, n)  # of equal ones the first counts
            if first or behind:
                tree = ahocorasick.Automaton()
                for word in first.keys() | behind.keys():
                    tree.add_word(word, (first.get(word), len(word), behind.get(word, ())))
                tree.make_automaton()
                self.trees.append((sensitive, tree))

    def first(self, text: str) -> tuple[int, int, int] | None:
        """(rule, place, length) of the first rule by order that is in the text, at its first place."""
        best, likely = None, set()
        for sensitive, tree in self.trees:
            form = text if sensitive else lowered(text)
            for end, (n, length, behind) in tree.iter(form):
                likely.update(behind)
                if n is not None:
                    hit = (n, end - length + 1, length)
                    best = hit if best is None or hit < best else best
            if not sensitive and (other := form.translate(SAME)) != form:
                for _, (_, _, behind) in tree.iter(other):
                    likely.update(behind)
        for n, p, own in merge(self.regexes, sorted(likely)):
            if best is not None and n > best[0]:
                break
            if (p, own) not in self.compiled:  # most are never reached
                self.compiled[p, own] = compiled(p, own)
            pattern = self.compiled[p, own]
            match = pattern.search(text) if pattern else None
            if match:
                return n, match.start(), match.end() - match.start()
        return best


def needed(pattern: str) -> str:
    """Plain letters, digits and blanks with which all that a pattern finds begins; none if it has alternatives or begins otherwise."""
    run = re.match("[A-Za-z0-9 ]*", pattern)[0]
    return "" if "|" in pattern else run[:-1] if pattern[len(run) : len(run) + 1] in ("*", "?", "{") else run


def compiled(pattern: str, sensitive: bool) -> re.Pattern | None:
    try:
        return re.compile(pattern, 0 if sensitive else re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None  # passed over


def lowered(text: str) -> str:
    """Lower case of each character that has one of a single character: places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def form(text: str, sensitive: bool) -> str:
    """Equal characters for all that a rule without regard to case takes for equal, be it a literal or a pattern."""
    return text if sensitive else lowered(text).translate(SAME)


@lru_cache(10_000)
def salt(owner: str, sensitive: bool) -> int:
    return int.from_bytes(blake2b(f"{sensitive} {owner}".encode(), digest_size=8).digest(), "little")


def codes_of(texts: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def keys_at(codes: np.ndarray, places: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Hashes of the runs of GRAM characters that begin at these places. Equal runs of other owners or other case have other ones."""
    keys = salts.copy()
    for k in range(GRAM):
        keys = (keys ^ codes[places + k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys * np.uint64(0xD6E8FEB86659FD93)


def text_keys(owners: Iterable[str | None], texts: Iterable[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers of some texts, each once as it is and once in lower case, how many runs each has, and the keys of these runs."""
    rows: list[tuple[int, str, int]] = []
    size = 0
    for i, (owner, text) in enumerate(zip(owners, texts)):
        if owner is not None and text is not None and len(text) >= GRAM:
            rows += [(i, text, salt(owner, True)), (i, form(text, False), salt(owner, False))]
            size += 2 * len(text)
        if size > MOST_RUNS:
            yield placed(rows)
            rows, size = [], 0
    if rows:
        yield placed(rows)


def placed(rows: list[tuple[int, str, int]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    sizes = np.array([len(text) for _, text, _ in rows], np.int64)
    runs = sizes - GRAM + 1
    places = np.arange(runs.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(runs) - runs), runs)
    return [i for i, _, _ in rows], runs, keys_at(codes_of(text for _, text, _ in rows), places, np.repeat(np.array([x for _, _, x in rows], np.uint64), runs))


def slot(key: Column) -> Column:
    return F.shiftrightunsigned(key, 46).cast("int")


def bit(key: Column) -> Column:
    return F.shiftrightunsigned(key, 40).bitwiseAND(F.lit(63)).cast("int")


def holds(bits: Column, key: Column) -> Column:
    return F.call_function("shiftright", bits, bit(key)).bitwiseAND(F.lit(1)) == 1


def held_runs(texts: DataFrame) -> DataFrame:
    """slot, bits, n: a sketch of all runs of GRAM characters in the texts, and how many stand in each slot. It may hold a run that no
    text does, never the other way round."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.zeros(64 * SLOTS, bool), np.zeros(SLOTS, np.int64)
        for chunk in chunks:
            for _, _, keys in text_keys(chunk["owner"], chunk["flat"]):
                at = (keys >> np.uint64(40)).astype(np.int64)
                held[at] = True
                n += np.bincount(at >> 6, minlength=SLOTS)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"slot": some.astype(np.int32), "bits": np.packbits(held, bitorder="little").view("<i8")[some], "n": n[some]})

    return texts.select("owner", "flat").mapInPandas(run, "slot int, bits long, n long").groupBy("slot").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def ready_rules(rules: DataFrame, held: DataFrame) -> DataFrame:
    """owner, word, regex, sensitive, number, pattern, anchor: of equal rules of an owner the first, literals as they are sought, without
    those that never fire. A literal, or what a pattern must begin with, has three runs, the first, middle and last one; if no text holds
    one of them, the rule is put aside before anything is shuffled. The anchor is the rarest of the three; below GRAM characters there is none."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            rows = []
            for owner, number, pattern, regex, own in chunk.itertuples(index=False):
                word = pattern if regex else " ".join(pattern.split()) if own else lowered(" ".join(pattern.split()))
                if compiled(pattern, own) if regex else word:
                    rows.append((owner, word, regex, own, number, pattern))
            sought = [form(needed(word) if regex else word, own) for _, word, regex, own, _, _ in rows]
            out = pd.DataFrame(rows, columns=["owner", "word", "regex", "sensitive", "number", "pattern"])
            out["short"] = short = np.array([len(x) < GRAM for x in sought], bool)
            long = [(x, salt(r[0], r[3])) for x, r in zip(sought, rows) if len(x) >= GRAM]
            sizes, salts = np.array([len(x) for x, _ in long], np.int64), np.array([x for _, x in long], np.uint64)
            codes, begin = codes_of(x for x, _ in long), np.cumsum(sizes) - sizes
            for name, at in zip(PLACES, (0, (sizes - GRAM) // 2, sizes - GRAM)):
                keys = np.zeros(len(rows), np.int64)
                keys[~short] = keys_at(codes, begin + at, salts).view(np.int64)
                out[name] = keys
            yield out

    known = rules.where("pattern is not null and owner is not null and number is not null").select("owner", F.col("number").cast("long").alias("number"), "pattern", F.coalesce("regex", F.lit(False)).alias("regex"), F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"))
    live = known.mapInPandas(run, "owner string, word string, regex boolean, sensitive boolean, number long, pattern string, short boolean, first long, middle long, last long")
    for name in PLACES:
        sketch = held.select(F.col("slot").alias(f"slot_{name}"), F.col("bits").alias(f"bits_{name}"), F.col("n").alias(f"n_{name}"))
        live = live.join(F.broadcast(sketch), slot(F.col(name)) == F.col(f"slot_{name}"), "left").where(F.col("short") | holds(F.col(f"bits_{name}"), F.col(name)))
    rarest = F.array_min(F.array(*[F.struct(F.col(f"n_{name}").alias("n"), F.col(name).alias("key")) for name in PLACES]))["key"]
    best = live.withColumn("anchor", F.when(~F.col("short"), rarest)).groupBy("owner", "word", "regex", "sensitive").agg(F.min(F.struct("number", "pattern", "anchor")).alias("b"))
    return best.select("owner", "word", "regex", "sensitive", "b.*")


def around(text: str, at: int, length: int) -> str:
    """The hit with 24 characters before and 48 after."""
    return text[max(at - 24, 0) : at + length + 48]


def tried(texts: DataFrame, rules: list[Row], cut: int | None) -> DataFrame:
    """texts(id, owner, flat) -> FOUND, owner, flat: what the first of these rules is that fires on each text. Rules that are not among
    them have the number ``cut`` or a higher one: where they may come first, owner and flat are not null."""
    own: dict[str, list] = {}
    for r in rules:
        own.setdefault(r["owner"], []).append((r["number"], r["pattern"], r["regex"], r["sensitive"]))
    shared = texts.sparkSession.sparkContext.broadcast(own)

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Rules] = {}
        for chunk in chunks:
            rows = []
            for id_, owner, text in chunk.itertuples(index=False):
                if owner is None or text is None:
                    continue
                if owner not in made and owner in shared.value:
                    made[owner] = Rules(shared.value[owner])
                hit = made[owner].first(text) if owner in made else None
                left = (owner, text) if cut is not None and (hit is None or hit[0] >= cut) else (None, None)
                if hit:
                    rows.append((id_, made[owner].pattern[hit[0]], hit[1], hit[2], around(text, *hit[1:]), hit[0], *left))
                elif left[0] is not None:
                    rows.append((id_, None, None, None, None, None, *left))
            yield pd.DataFrame(rows, columns=["id", "rule", "at", "length", "excerpt", "number", "owner", "flat"], dtype=object)

    return texts.select("id", "owner", "flat").mapInPandas(run, FOUND + ", owner string, flat string")


def joined_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """texts(id, owner, flat), rules with an anchor -> FOUND of each rule that fires on each text: a text meets only rules whose anchor it
    holds, and runs that are no anchor stay where they are."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            ids = chunk["id"].to_numpy()
            for of, runs, keys in text_keys(chunk["owner"], chunk["flat"]):
                own = [np.unique(part) for part in np.split(keys.view(np.int64), np.cumsum(runs)[:-1])]
                yield pd.DataFrame({"id": np.repeat(ids[of], [len(part) for part in own]), "anchor": np.concatenate(own)})

    def check(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(10_000)(compiled)
        for chunk in chunks:
            rows = []
            for id_, text, word, regex, sensitive, pattern, number in chunk.itertuples(index=False):
                if regex:
                    match = known(pattern, sensitive).search(text)
                    at, length = match.span() if match else (-1, 0)
                    length -= at
                else:
                    at, length = (text if sensitive else lowered(text)).find(word), len(word)
                if at >= 0:
                    rows.append((id_, pattern, at, length, around(text, at, length), number))
            yield pd.DataFrame(rows, columns=["id", "rule", "at", "length", "excerpt", "number"])

    anchor = F.col("anchor")
    sketch = rules.groupBy(slot(anchor).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(anchor))).alias("bits"))
    held = texts.mapInPandas(run, "id long, anchor long").join(F.broadcast(sketch), slot(anchor) == F.col("slot")).where(holds(F.col("bits"), anchor)).select("id", "anchor")
    columns = ["word", "regex", "sensitive", "pattern", "number"]
    meet = held.join(rules, "anchor").select("id", *columns)
    return meet.join(texts.select("id", "flat"), "id").select("id", "flat", *columns).mapInPandas(check, FOUND)


def lowest(rules: DataFrame, n: int) -> tuple[list[Row], Column]:
    """The first n rules by number, and what holds for the others."""
    if not n:
        return [], F.lit(True)
    taken = rules.orderBy(*ORDER).limit(n).collect()
    return taken, F.struct(*ORDER) > F.struct(*[F.lit(taken[-1][c]).cast(rules.schema[c].dataType) for c in ORDER])


def own_rules(texts: DataFrame, rules: DataFrame, most: int = 20_000) -> DataFrame:
    """texts(id, owner, flat), rules(owner, number, pattern, regex, case_sensitive) -> id, rule, at, length, excerpt: for each text that any
    rule of its owner fires on, the first by number.

    Rules are put aside if the ends or the middle of their literal, or of what their pattern must begin with, stand in no text of their
    owner's. Of the others at most ``most`` at a time, those of the lowest numbers, go to the tasks in one pass over the texts; only texts on
    which a later rule may come first go on. The last FEW texts, or those that very many rules leave as they are, meet the rules by a join.
    """
    ready = ready_rules(rules, held_runs(texts)).persist(StorageLevel.DISK_ONLY)
    short, long = ready.where("anchor is null"), ready.where("anchor is not null")
    n_short, n_long = short.count(), long.count()
    columns = [c.split()[0] for c in FOUND.split(", ")]
    if not n_short + n_long:
        return texts.sparkSession.createDataFrame([], FOUND).drop("number")
    if n_short + n_long <= most:
        return tried(texts, ready.collect(), None).select(columns).drop("number")
    parts, last, open_before = [], None, 0
    later_short = later_long = F.lit(True)
    while True:
        a = min(n_short, max(-(-most // 2), most - n_long))
        b = min(n_long, most - a)
        (first, then_short), (more, then_long) = lowest(short.where(later_short), a), lowest(long.where(later_long), b)
        later_short, later_long = then_short if a else later_short, then_long if b else later_long
        n_short, n_long = n_short - a, n_long - b
        cut = min((taken[-1]["number"] if taken else -(2**63) for taken, n in ((first, n_short), (more, n_long)) if n), default=None)
        turn = tried(texts, first + more, cut).persist(StorageLevel.DISK_ONLY)
        left = turn.where("flat is not null").count()
        parts.append(turn.where("rule is not null").select(columns).persist(StorageLevel.DISK_ONLY))
        parts[-1].count()
        if last is not None:
            last.unpersist()  # its texts; what was found in them stays
        texts, last = turn.where("flat is not null").select("id", "owner", "flat"), turn
        if not left:
            break
        if not n_short and (left <= FEW or n_long > MOST_TURNS * most and left > open_before * 7 // 8 > 0):
            parts.append(joined_rules(texts, long.where(later_long)))
            break
        open_before = left
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("id").agg(F.min_by(F.struct(*columns[1:-1]), F.struct("number", "at")).alias("f")).select("id", "f.*")


def refusals(replies: DataFrame, rules: DataFrame, most: int = 20_000) -> DataFrame:
    """replies(id, owner, text, structured) -> id, rule, excerpt, structured for every row: what the service says, the library's own
    patterns, apology and inability, and then the owner's rules. The excerpt of a rule reaches from 24 characters before to 48 after."""
    rows = replies.withColumn("__own", refusal(F.col("text"), F.col("structured"))).withColumn("flat", flat(F.col("text")))
    hits = own_rules(rows.where("__own is null").select("id", "owner", "flat"), rules, most).select(F.col("id").alias("__id"), F.col("rule").alias("__rule"), F.col("excerpt").alias("__excerpt"))
    both = rows.select("id", "__own").join(hits, F.col("id") == F.col("__id"), "left")
    return both.select("id", F.coalesce("__own.rule", "__rule").alias("rule"), F.when(F.col("__own").isNotNull(), F.col("__own.excerpt")).otherwise(F.col("__excerpt")).alias("excerpt"), F.coalesce("__own.structured", F.lit(False)).alias("structured"))
