"""Cross-tokenizer alignment: groups of tokens of two vocabularies between byte offsets where tokens of both end.

1. Texts are cut into chunks at single blanks between other characters. Neither vocabulary joins bytes across such a blank, so
   tokens of both end there, and a chunk has the same tokens wherever it stands. Each Python worker remembers the groups of
   chunks; its cache has a fixed size, and what is beyond it is aligned again.
2. Over the tokens of all new chunks of a slice in a row, every token points to its farthest-right overlapping token. The
   successor of the successor, taken for all tokens at once until nothing changes, is the token that ends its group: the chain
   to it halves with each step, so a group of n tokens takes log n steps.
3. A group's last tokens end together and are linked; no other two tokens do, so there is one link for each group. Links of all
   documents are counted by pair of ids.
4. The counts are sent to the documents in slices of at most ``most_pairs`` pairs, whatever their number, and each document
   sums up those of its links. Texts are read once, and only counts are shuffled.

Defined results: null and empty texts have no tokens, neither have texts whose joined token bytes differ from a blank and the
text (a text that holds U+2581, which the second vocabulary reads as a blank); strings of special tokens are plain text; null
and repeated ids keep their rows, and each row counts; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import durable, id_and_text, parts_for
from tagloom.llm.shingles import forget_words
from tagloom.llm.tokens import _printable_bytes, slices

# All that any of the two libraries takes for white space, and a little more: chunks only get longer by that.
SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEAR_SPACES = f"^[{SPACES}]| [{SPACES}]|[{SPACES}] |[{SPACES}]$"
CUT = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")
# Fixed value: how the first vocabulary's file splits a text before it merges bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 20_000  # characters of a chunk beyond which the recursive splitter isn't used

_LOADED: dict[tuple[str, str], Vocabularies] = {}


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of both rows, given by the byte offsets where tokens end, the place of the second row's token that ends its group.

    Both rows must end at the same offset.
    """
    a, b = np.arange(len(ends_a)), np.arange(len(ends_b))
    over_a = len(a) + np.searchsorted(ends_b, ends_a)  # the first token of the other row that ends no sooner overlaps the last byte
    over_b = np.searchsorted(ends_a, ends_b)
    next_ = np.concatenate((over_a, np.where(ends_a[over_b] > ends_b, over_b, len(a) + b)))
    while not np.array_equal(twice := next_[next_], next_):
        next_ = twice
    return next_[: len(a)] - len(a), next_[len(a) :] - len(a)


class Vocabularies:
    """Two vocabularies and the groups of chunks seen so far."""

    def __init__(self, a_path: str, b_path: str, chunks: int = 100_000):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in _printable_bytes().items()}
        ids = {bytes(map(byte_of.__getitem__, token)): n for token, n in spec["model"]["vocab"].items() if not any(t["content"] == token for t in spec["added_tokens"])}
        merged = [bytes(map(byte_of.__getitem__, "".join(m) if isinstance(m, list) else m.replace(" ", ""))) for m in spec["model"]["merges"]]
        ranks = list(map(ids.__getitem__, merged))
        if ranks != sorted(ranks):
            raise ValueError("ids of merged tokens must be in the order of the merges")
        self.a_path, self.whole = a_path, None
        self.encode_a = tiktoken.Encoding("first", pat_str=SPLIT, mergeable_ranks=ids, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size_b = self.b.get_piece_size()
        self.bytes_a: list[bytes] = [b""] * (max(ids.values()) + 1)
        for token, n in ids.items():
            self.bytes_a[n] = token
        pieces = map(self.b.id_to_piece, range(size_b))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.size_b, self.most = size_b, max(len(self.bytes_a), size_b)
        self.written = [b"%d%c" % (n, mark) for mark in b",|;" for n in range(self.most)]
        self.known: dict[str, tuple | None] = {}
        self.chunks = chunks

    def ids_a(self, chunk: str) -> list[int]:
        if len(chunk) < LONG:
            return self.encode_a(" " + chunk)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.a_path)
            self.whole.encode_special_tokens = True
        return self.whole.encode(" " + chunk, add_special_tokens=False).ids

    def groups(self, chunks: list[str]) -> list[tuple | None]:
        """(tokens of a, of b, groups, links as little-endian 64-bit numbers, the groups written out) of each chunk; None if bytes differ."""
        a, b = list(map(self.ids_a, chunks)), self.b.encode(chunks, num_threads=1)
        out: list[tuple | None] = [None] * len(chunks)
        good = [k for k, (x, y, chunk) in enumerate(zip(a, b, chunks)) if b"".join(map(self.bytes_a.__getitem__, x)) == (own := b" " + chunk.encode()) and b"".join(map(self.bytes_b.__getitem__, y)) == own]
        if not good:
            return out
        flat, bounds = [], []
        for ids in (a, b):
            sizes = np.fromiter((len(ids[k]) for k in good), np.int64, len(good))
            bounds.append(np.concatenate(([0], np.cumsum(sizes))))
            flat.append(np.fromiter((n for k in good for n in ids[k]), np.int64, bounds[-1][-1]))
        end_of_a, end_of_b = group_ends(np.cumsum(self.len_a[flat[0]]), np.cumsum(self.len_b[flat[1]]))
        lasts = np.flatnonzero(end_of_b == np.arange(len(end_of_b)))  # the second row's token that ends each group
        group_a, group_b = np.searchsorted(lasts, end_of_a), np.searchsorted(lasts, end_of_b)
        until_a = np.searchsorted(group_a, np.arange(len(lasts)), "right")  # tokens of the first row up to the end of each group
        links = (flat[0][until_a - 1] * self.size_b + flat[1][lasts]).astype("<i8")
        # groups written out: tokens of the first row, then of the second, with the mark that follows each
        text = np.empty(len(flat[0]) + len(flat[1]), np.int64)
        last_a = np.zeros(len(flat[0]), np.int64)
        last_a[until_a - 1] = 1
        text[np.arange(len(flat[0])) + np.concatenate(([0], lasts + 1))[group_a]] = last_a * self.most + flat[0]
        text[np.arange(len(flat[1])) + until_a[group_b]] = 2 * (end_of_b == np.arange(len(end_of_b))) * self.most + flat[1]
        written = list(map(self.written.__getitem__, text.tolist()))
        first = np.searchsorted(lasts, bounds[1]).tolist()
        raw, (of_a, of_b) = links.tobytes(), (x.tolist() for x in bounds)
        for n, k in enumerate(good):
            begin, end = of_a[n] + of_b[n], of_a[n + 1] + of_b[n + 1]
            out[k] = (of_a[n + 1] - of_a[n], of_b[n + 1] - of_b[n], first[n + 1] - first[n], raw[8 * first[n] : 8 * first[n + 1]], b"".join(written[begin:end])[:-1])
        return out

    def of(self, chunks: list[str]) -> list[tuple | None]:
        """As ``groups``, from the cache where a chunk is there."""
        there = self.known
        fresh = [c for c in chunks if c not in there]
        learnt = dict(zip(fresh, self.groups(fresh))) if fresh else {}
        out = [there[c] if c in there else learnt[c] for c in chunks]
        there.update(islice(((c, g) for c, g in learnt.items() if len(c) < 64), max(0, self.chunks - len(there))))
        return out


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One pair for each Python worker and pair of files."""
    if (a_path, b_path) not in _LOADED:
        forget_words()
        _LOADED[a_path, b_path] = Vocabularies(a_path, b_path)
    return _LOADED[a_path, b_path]


def chunked(texts: pa.Array) -> list[tuple[np.ndarray, pa.ListArray]]:
    """Places of texts, and their chunks. Most texts have blanks between other characters only and are split as they are."""
    odd = pc.fill_null(pc.match_substring_regex(texts, NEAR_SPACES), False).to_numpy(zero_copy_only=False)
    some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(some & ~odd), np.flatnonzero(some & odd)
    out = []
    if len(plain):
        out.append((plain, pc.split_pattern(texts.take(pa.array(plain)), " ")))
    if len(rest):
        out.append((rest, pa.array([CUT.split(t) for t in texts.take(pa.array(rest)).to_pylist()], pa.large_list(pa.large_string()))))
    return out


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, links array<long>, groups_sha256 string"


def aligned(docs: DataFrame, a_path: str, b_path: str, written: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, links (id of a * size of b + id of b, in order), groups_sha256 for every row.

    ``written`` adds the groups themselves: ids of a, then of b, as ``a1,a2|b1;a3|b2,b3``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(a_path, b_path)
        for batch in batches:
            for part in slices(batch):
                rows = part.num_rows
                count, links, said, texts = np.zeros((rows, 3), np.int64), [b""] * rows, [""] * rows, [""] * rows
                for places, lists in chunked(part.column("text").cast(pa.large_string())):
                    words = lists.flatten().dictionary_encode()
                    codes, bounds = words.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                    found = both.of(words.dictionary.to_pylist())
                    bad = np.fromiter((f is None for f in found), bool, len(found))
                    found = [f or (0, 0, 0, b"", b"") for f in found]
                    sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(np.column_stack((np.array([f[:3] for f in found], np.int64), bad))[codes], axis=0)))
                    each = sums[bounds[1:]] - sums[bounds[:-1]]
                    own_links, own_text = [f[3] for f in found], [f[4] for f in found]
                    codes = codes.tolist()
                    for place, a, b, row in zip(places.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), each):
                        if not row[3]:
                            count[place] = row[:3]
                            links[place] = b"".join(map(own_links.__getitem__, codes[a:b]))
                            text = b";".join(map(own_text.__getitem__, codes[a:b]))
                            said[place] = hashlib.sha256(text).hexdigest()
                            if written:
                                texts[place] = text.decode()
                ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, links), np.int64, rows) // 8)))
                lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(links), "<i8"))).cast(pa.list_(pa.int64()))
                columns = [part.column("doc_id"), *(pa.array(count[:, k]) for k in range(3)), lists, pa.array(said, pa.string())] + ([pa.array(texts, pa.string())] if written else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256", "groups"][: len(columns)])

    return id_and_text(docs).mapInArrow(run, ALIGNED + (", groups string" if written else ""))


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """link, n, best: how many links of all documents hold each pair of ids, and whether no other pair with the same id of b has more."""
    counts = durable(rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")), "pair-counts")
    b = (F.col("link") % size_b).alias("b")
    top = counts.groupBy(b).agg(F.max("n").alias("top")).withColumnRenamed("b", "of")
    return counts.select("link", "n", b).join(top, F.col("b") == F.col("of")).select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, written: bool = False, most_pairs: int = 2_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups) for every row."""
    rows = durable(aligned(docs, a_path, b_path, written), "aligned").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    pairs = durable(pair_counts(rows, _size_b(b_path)), "pairs")
    turns = parts_for(pairs.count(), most_pairs)
    for turn in range(turns):
        some = pairs.where(F.pmod(F.xxhash64("link"), F.lit(turns)) == turn).toArrow()  # about most_pairs rows of 17 bytes
        rows = summed(rows, some)
        rows = rows if turn == turns - 1 else durable(rows, "summed")  # or every slice would be summed in one task after the other
    return rows.withColumn("n_links", F.size("links").cast("long")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if written else []))


def _size_b(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def summed(rows: DataFrame, pairs: pa.Table) -> DataFrame:
    """The rows with n_best and count_sum raised by those of their links that are among these pairs."""
    order = np.argsort(pairs.column("link").to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast([pairs.column(c).to_numpy(zero_copy_only=False)[order] for c in ("link", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            lists = batch.column("links")
            flat, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = np.searchsorted(keys, flat)
            at[at == len(keys)] = 0
            here = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            for name, values in (("n_best", best), ("count_sum", counts)):
                own = np.where(here, values[at], 0).astype(np.int64) if len(keys) else np.zeros(len(flat), np.int64)
                sums = np.concatenate(([0], np.cumsum(own)))
                added = pc.add(batch.column(name), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]))
                batch = batch.set_column(batch.schema.get_field_index(name), name, added)
            yield batch

    return rows.mapInArrow(run, rows.schema)
