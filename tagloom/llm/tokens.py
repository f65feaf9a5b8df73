"""Token ids of whole texts from a public vocabulary file, remembered word by word.

The vocabulary's own splitting never joins characters across a blank, so encoding blank-separated chunks one by one gives
exactly the ids of the whole text. Each Python worker remembers the ids of chunks and of letter runs; the caches have a
fixed size and rare words beyond it are simply encoded again.
"""

from __future__ import annotations

import ctypes
import gc
import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tagloom.llm.shingles import forget_words

MARKS = ".,;:!?"
SLICE_BYTES = 2 << 20  # texts are encoded in slices of about this size
_LOADED: dict[str, "ChunkTokenizer"] = {}


def tokenizer_for(path: str) -> ChunkTokenizer:
    """One tokenizer for each file and Python worker, which keeps the caches of one stage at a time."""
    if path not in _LOADED:
        forget_words()
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]


def _printable_bytes() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it is printable, the others from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkTokenizer:
    def __init__(self, path: str, chunks: int = 100_000, runs: int = 120_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.runs_of = regex.compile(split["pattern"]["Regex"]).findall
        self.bare = Tokenizer(self.whole.model)  # the model alone, on runs with blanks between them
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.letters = _printable_bytes()
        suffix = spec["model"]["end_of_word_suffix"]
        self.is_end = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.is_end[[n for t, n in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.chunks, self.runs = {}, {}
        self.max_chunks, self.max_runs = chunks, runs
        del spec
        gc.collect()

    def _runs(self, low: str) -> list[str]:
        """Most chunks are letters alone, or letters and one mark: these need no pattern."""
        if low.isalpha():
            return [low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.runs_of(low)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs in one call, and where each run's ids end; every run ends with the one token of it that has the suffix."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        assert len(ends) == len(words), "the vocabulary must mark the end of every run"
        return ids, ends

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of distinct runs."""
        ids, ends = self._encoded([r if r.isascii() else "".join(map(self.letters.__getitem__, r.encode())) for r in runs])
        flat, ends = ids.tobytes(), (4 * ends).tolist()
        return dict(zip(runs, (flat[x:y] for x, y in zip([0, *ends], ends))))

    def chunk_ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of distinct texts without blanks or line feeds."""
        out: list = list(map(self.chunks.get, texts))
        words_at: list[int] = []  # chunks that are one run
        words: list[str] = []
        mixed_at: list[int] = []
        mixed: list[list[str]] = []
        for k in [k for k, known in enumerate(out) if known is None]:
            text = texts[k]
            low = text.lower()
            if low.isascii() and low.isalpha():
                words_at.append(k)
                words.append(low)
            elif text.isprintable() and "<|" not in text and (text.isascii() or (max(text) < "ɐ" and "İ" not in text and unicodedata.is_normalized("NFC", text))):
                mixed_at.append(k)
                mixed.append(self._runs(low) if text else [])
            else:
                out[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        fresh = [r for r in dict.fromkeys(chain(words, chain.from_iterable(mixed))) if r not in self.runs]
        learnt = self._learn(fresh) if fresh else {}
        for k, run in zip(words_at, words):
            out[k] = learnt.get(run) or self.runs[run]
        for k, runs in zip(mixed_at, mixed):
            out[k] = b"".join([learnt.get(r) or self.runs[r] for r in runs])
        self.runs.update(islice(learnt.items(), max(0, self.max_runs - len(self.runs))))
        short = ((texts[k], out[k]) for k in chain(words_at, mixed_at) if len(texts[k]) < 64)
        self.chunks.update(islice(short, max(0, self.max_chunks - len(self.chunks))))
        return out

    def distinct_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks in one array, how many each has, and where they begin. Most chunks are letters of ASCII, with a mark
        or without: Python sees each run of their letters once, whatever its case and mark; the others are taken one by one."""
        plain = pc.match_substring_regex(words, f"^[A-Za-z]+[{MARKS}]?$")
        is_plain = plain.to_numpy(zero_copy_only=False)
        easy, sizes = pc.ascii_lower(words.filter(plain)), np.zeros(len(words), np.int64)
        fast = np.empty(0, "<u4")
        if len(easy):
            marked = ~pc.ascii_is_alpha(easy).to_numpy(zero_copy_only=False)
            letters = pc.ascii_rtrim(easy, MARKS).dictionary_encode()
            runs = letters.dictionary.to_pylist() + list(MARKS)
            known = list(map(self.runs.get, runs))
            fresh = [r for r, k in zip(runs, known) if k is None]
            ids, ends = self._encoded(fresh) if fresh else (np.empty(0, "<u4"), np.empty(0, np.int64))
            old = [k for k in known if k is not None]
            is_old, size = np.fromiter((k is not None for k in known), bool, len(known)), np.empty(len(known), np.int64)
            size[is_old], size[~is_old] = np.fromiter(map(len, old), np.int64, len(old)) // 4, np.diff(ends, prepend=0)
            at = np.empty(len(known), np.int64)
            at[~is_old] = ends - size[~is_old]
            at[is_old] = len(ids) + np.cumsum(size[is_old]) - size[is_old]
            pool = np.concatenate((ids, np.frombuffer(b"".join(old), "<u4")))
            for k in range(min(len(fresh), max(0, self.max_runs - len(self.runs)))):
                self.runs[fresh[k]] = ids[ends[k - 1] if k else 0 : ends[k]].tobytes()
            begin = np.cumsum(1 + marked) - 1 - marked
            order = np.empty(len(easy) + marked.sum(), np.int64)
            order[begin] = letters.indices.to_numpy()
            order[begin[marked] + 1] = len(runs) - len(MARKS) + pc.index_in(pc.utf8_slice_codeunits(easy.filter(pa.array(marked)), -1), pa.array(list(MARKS), easy.type)).to_numpy()
            each, ends = size[order], np.cumsum(size[order])
            fast = pool[np.repeat(at[order] - ends + each, each) + np.arange(ends[-1])]
            sizes[is_plain] = np.add.reduceat(each, begin)
        packed = self.chunk_ids(words.filter(pc.invert(plain)).to_pylist())
        sizes[~is_plain] = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        first = np.empty(len(words), np.int64)
        first[is_plain] = np.cumsum(sizes[is_plain]) - sizes[is_plain]
        first[~is_plain] = len(fast) + np.cumsum(sizes[~is_plain]) - sizes[~is_plain]
        return np.concatenate((fast, np.frombuffer(b"".join(packed), "<u4"))), sizes, first

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and end in it."""
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        codes, bounds = words.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        pool, sizes, first = self.distinct_ids(words.dictionary)
        del lists, words
        each = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(each)))
        at = np.repeat((first[codes] - ends[:-1]).astype(np.int32), each)  # a slice has far fewer than 2**31 ids
        at += np.arange(ends[-1], dtype=np.int32)
        return pool[at], ends[bounds]


def give_back() -> None:
    """Return freed memory to the system: Python workers share an executor's memory with its JVM and live through many stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has more text than the limit, unless one text alone is longer."""
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, base = 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.take(pa.array(range(begin, end), pa.int64()))  # a copy: ascii_lower misreads arrays that begin inside a buffer
        begin, base = end, int(size[end - 1])
    give_back()


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the last may be shorter than the capacity."""
    return [(s, min(capacity, length - s)) for s in range(0, length, capacity)]


def with_end(ids: np.ndarray, end_id: int) -> np.ndarray:
    return np.concatenate((ids, np.array([end_id], "<u4"))).astype("<u4", copy=False)
