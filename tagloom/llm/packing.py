"""Packing of token pieces into sequences of one fixed length.

Two rules. ``pack_sum_of_squares`` moves only lengths: pieces are dealt out evenly, and each task places its own pieces,
longest first, where the squared counts of open sequences per free length become smallest. ``pack_matrices`` never
shuffles: each task encodes its own documents and packs them by best-fit decreasing, with a segment tree over free lengths,
into id matrices. Both keep every token: documents longer than a sequence are cut, shorter ones never are.

Defined results: a null or empty text is one piece that holds only the end id; a null doc_id is kept as null; repeated rows
are packed as often as they occur; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tagloom.llm.common import durable, id_and_text, parts_for
from tagloom.llm.tokens import SLICE_BYTES, cut, slices, tokenizer_for, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"
MATRIX = "sequence_id long, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, n_tokens int, input_ids binary, position_ids binary"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for each piece of each document: where it starts, how long it is, and a checksum of its ids.

    Texts are encoded in slices of about ``slice_bytes``: smaller ones take less of a worker's memory and some more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(tokenizer_path)
        for batch in batches:
            for part in slices(batch, most=slice_bytes):
                ids, bounds = tokenizer.encode(part.column("text"))
                rows: tuple[list, ...] = ([], [], [], [], [])
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = with_end(ids[bounds[k] : bounds[k + 1]], end_id)
                    for n, (start, length) in enumerate(cut(len(own), capacity)):
                        for column, value in zip(rows, (doc, n, start, length, zlib.crc32(own[start : start + length]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(run, PIECES)


def place_sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken in the order given.

    With n(g) open sequences of free length g, putting a piece of length s into one of them changes the sum of squares by
    2 (n(g - s) - n(g)) + 2, or by 1 less where the sequence becomes full. The smallest change wins, the tightest at a tie;
    a new sequence is opened only where no open one has room.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: dict[int, list[int]] = defaultdict(list)
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        room = np.flatnonzero(count[s:capacity])
        if len(room):
            change = 2 * (count[room] - count[room + s])
            change[0] -= int(room[0] == 0)
            left = int(room[change.argmin()])
            n = open_at[left + s].pop()
            count[left + s] -= 1
        else:
            left, n, used = capacity - s, used, used + 1
        sequence[k], offset[k] = n, capacity - left - s
        if left:
            count[left] += 1
            open_at[left].append(n)
    return sequence, offset


def pack_sum_of_squares(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, pieces_per_task: int = 16_384, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    The pieces are written once, without their ids, because their count decides into how many tasks they are dealt.
    """
    pieces = durable(token_pieces(docs, tokenizer_path, capacity, slice_bytes=slice_bytes), "pieces")
    groups = parts_for(pieces.count(), pieces_per_task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            rows = pa.Table.from_batches(own).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            sequence, offset = place_sum_of_squares(rows.column("length").to_numpy(), capacity)
            sequence += TaskContext.get().partitionId() << 32
            yield from rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    return pieces.repartition(groups).mapInArrow(run, PLACED)  # dealt evenly, whatever ids repeat or are null


class FreeLengths:
    """Segment tree over free lengths 0..capacity: how many open sequences have each; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open_at: dict[int, list[int]] = defaultdict(list)

    def add(self, free: int, sequence: int, step: int = 1) -> None:
        if step > 0:
            self.open_at[free].append(sequence)
        node = free + self.leaves
        while node:
            self.tree[node] += step
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (free length, sequence) of the smallest free length of at least ``need``."""
        node = need + self.leaves
        while not self.tree[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (self.tree[2 * node] == 0)
        free = node - self.leaves
        sequence = self.open_at[free].pop()
        self.add(free, sequence, -1)
        return free, sequence


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the lengths in each sequence, in the order in which they lie there."""
    free, sequences = FreeLengths(capacity), []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = free.take(lengths[k])
        if found is None:
            found = (capacity, len(sequences))
            sequences.append([])
        sequences[found[1]].append(k)
        if found[0] > lengths[k]:
            free.add(found[0] - lengths[k], found[1])
    return sequences


def pack_matrices(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, block_tokens: int = 4_000_000) -> DataFrame:
    """A row for each sequence: ids and positions as little-endian 32- and 16-bit matrices rows, and segment bounds.

    ``cu_seqlens`` runs from 0 to the number of tokens; positions begin at 0 again in each segment; the rest of a row is
    filled with the end id and positions 0. A task packs blocks of at most ``block_tokens`` tokens (more only if one
    document alone has more), so its memory doesn't grow with its input.
    """

    def emit(block: list[tuple[int, int, np.ndarray]], number: int) -> Iterator[pa.RecordBatch]:
        packed = best_fit_decreasing([len(x[2]) for x in block], capacity)
        for at in range(0, len(packed), 256):
            columns: tuple[list, ...] = ([], [], [], [], [], [], [])
            for n, members in enumerate(packed[at : at + 256], at):
                sizes = [len(block[k][2]) for k in members]
                ids, positions = np.full(capacity, end_id, "<u4"), np.zeros(capacity, "<u2")
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                ids[: bounds[-1]] = np.concatenate([block[k][2] for k in members])
                positions[: bounds[-1]] = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
                row = ((TaskContext.get().partitionId() << 40) + number + n, [block[k][0] for k in members], [block[k][1] for k in members], bounds.astype(np.int32), int(bounds[-1]), ids.tobytes(), positions.tobytes())
                for column, value in zip(columns, row):
                    column.append(value)
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in MATRIX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, block, tokens, number = tokenizer_for(tokenizer_path), [], 0, 0
        for batch in batches:
            for part in slices(batch):
                ids, bounds = tokenizer.encode(part.column("text"))
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = with_end(ids[bounds[k] : bounds[k + 1]], end_id)
                    block += [(doc, n, own[s : s + m]) for n, (s, m) in enumerate(cut(len(own), capacity))]
                    tokens += len(own)
                if tokens >= block_tokens:
                    for out in emit(block, number):
                        number += out.num_rows
                        yield out
                    block, tokens = [], 0
        if block:
            yield from emit(block, number)

    return id_and_text(docs).mapInArrow(run, MATRIX)


def write_matrices(packed: DataFrame, path: str) -> DataFrame:
    """Write the packed sequences to a new folder and give them back as they lie there; a lost task writes its part again.

    Ids and positions are fixed-width binary rows, so ``matrix`` reads a file's rows as one array without copying tokens.
    """
    packed.write.parquet(path)
    return packed.sparkSession.read.schema(MATRIX).parquet(path)


def matrix(rows: list[bytes], dtype: str, capacity: int) -> np.ndarray:
    """Written rows of ids (``<u4``) or positions (``<u2``) as a matrix of one row for each sequence."""
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), capacity)
