"""Packing of tokenised documents into fixed-length sequences by bounded-space online best fit.

Pieces are dealt to tasks by a hash, in numbers that follow their total; each task keeps at most ``OPEN`` open bins in a
bitset keyed by free space. A piece goes to the open bin with the least room that holds it; when a new bin is needed and
all are open, the fullest closes. Pieces arrive in blocks of at most ``BLOCK``, the longest of a block first, so short ones fill
what long ones leave. Only pieces' lengths move, never their tokens.

Null and empty texts are one piece that holds only the end id. Rows with null or repeated ids are packed as documents of their own;
texts of any length are cut into pieces whole. Empty tables give empty results, and other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.shared import TEXTS, stored
from wirechart.llm.tokens import cached

SEQUENCE, END, OPEN = 4096, 1, 2048
#: Pieces for each packing task, and pieces that are put in order of length before they are packed.
DEALT, BLOCK = 100_000, 1 << 14


@K.frugal
def _pieces(batches: Iterator[pa.RecordBatch], name: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    cache, last = cached(name, False), np.array([end], "<u4").tobytes()
    for batch in batches:
        for begin in range(0, len(batch), 256):
            part = batch.slice(begin, 256)
            cut = [cache.library.pieces(x or "") for x in part.column(1).to_pylist()]
            cache.learn(cut)
            get = cache.__getitem__
            rows, number, length, crc = [], [], [], []
            for i, x in enumerate(cut):
                ids = b"".join([*map(get, x), last])
                for j, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    rows.append(i)
                    number.append(j)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "length", "ids_crc32"])
    cache.clear()  # a worker that waits for its next task holds little


class Bins:
    """Open bins of one task: bit f of the set is on where a bin with f free places is open."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.bits, self.n, self.made = size, most, 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        self.n -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of that length."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.made, self.size
            self.made += 1
        if left := free - length:
            self.at[left].append(bin_)
            self.bits |= 1 << left
            self.n += 1
        return bin_, self.size - free


@K.frugal
def _pack(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    bins, base = Bins(size, most), TaskContext.get().partitionId() << 40
    held, n = [], 0

    def packed():
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        length = block.column("length").to_numpy()
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for i in np.argsort(-length, kind="stable").tolist():
            sequence[i], offset[i] = bins.put(int(length[i]))
        return pa.RecordBatch.from_arrays([*block.columns, pa.array(base + sequence), pa.array(offset)], names=[*block.schema.names, "sequence_id", "offset"])

    for batch in batches:
        if n + len(batch) > BLOCK and n:
            yield packed()
            held, n = [], 0
        if len(batch):
            held.append(batch)
            n += len(batch)
    if n:
        yield packed()


def pack(documents: DataFrame, name: str, size: int = SEQUENCE, end: int = END, most_open: int = OPEN, dealt: int = DEALT) -> DataFrame:
    """Per piece of documents(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = dict(documents.dtypes)["doc_id"]
    cut = documents.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, name, size, end), f"doc_id {kind}, piece int, length bigint, ids_crc32 bigint")
    cut = stored(cut, "pieces", TEXTS)
    tasks = max(1, round(cut.count() / dealt))
    # the order within a task is a hash's, so it is the same when a task runs again and mixes long and short pieces
    order = [F.xxhash64("doc_id", "piece", "ids_crc32"), *cut.columns]
    rows = cut.repartition(tasks, F.xxhash64("doc_id", "piece", "length", "ids_crc32")).sortWithinPartitions(*order)
    out = rows.mapInArrow(lambda it: _pack(it, size, most_open), f"doc_id {kind}, piece int, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.select("doc_id", "piece", (F.col("piece").cast("bigint") * size).alias("start"), "length", "ids_crc32", "sequence_id", "offset")
