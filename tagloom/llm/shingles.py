"""Word shingles of whole texts as 64-bit hashes, for batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORDS: dict[bytes, int] = {}
MAX_WORDS = 100_000  # how many word hashes a Python worker remembers


def word_hash(word: bytes) -> int:
    known = _WORDS.get(word)
    if known is None:
        known = xxhash.xxh3_64_intdigest(word)
        if len(_WORDS) < MAX_WORDS:
            _WORDS[word] = known
    return known


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between blanks and control spaces, A-Z in lower case if asked for, and each text's bounds among them."""
    texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten().dictionary_encode()
    known = np.fromiter(map(word_hash, words.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.dictionary))
    codes, bounds = words.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    empty = pc.index(words.dictionary, "").as_py()
    if empty >= 0:
        real = codes != empty
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        codes = codes[real]
    return known[codes], bounds


def forget_words() -> None:
    """Drop the remembered hashes; later words are hashed anew."""
    _WORDS.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def joined(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash for each run of so many neighbouring words."""
    n = max(0, len(hashes) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = out * _STEP + hashes[k : k + n]
    return mixed(out)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, ascending; a text with fewer words is one shingle, one without words has none."""
    hashes, bounds = hashed_words(texts)
    runs = joined(hashes, words)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            yield np.unique(runs[a : b - words + 1])
        elif b > a:
            yield joined(hashes[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)
