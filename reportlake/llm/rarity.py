"""Classes of document frequency for hashed shingles, in a table of fixed size.

Shingles that occur once are told from the others exactly where the table is not full, and are never taken for rarer
than they are: a class is the smallest of four cells, each of which holds the largest class of its shingles. The table serves to *order* shingles,
so a full one costs time and no results. It is counted by Spark: shingles are dealt by their leading bits to
2,048 buckets, to more once a bucket would hold more than some 10 million of them. A task sends its shingles in large blocks, a row a block and bucket, so that
rows grow with the input and not with the number of buckets too; only the finished table of 32 MB reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^20 blocks of 64 cells of 4 bits; a shingle's four cells are in one block.
BLOCK_BITS = 20
BLOCK_BYTES = 32
#: Blocks in one row of the table on its way to the driver.
ROW_BITS = 10
#: Bits that are sent of a shingle beside its bucket, shingles in a bucket at most, about, and bits of the least number of buckets.
SENT_BITS = 40
BUCKET = 1 << 23
BUCKET_BITS = 11
#: Shingles that are sent together, about.
BLOCK = 1 << 20
#: A chunk of texts sends a shingle so often at most; enough to order shingles by frequency.
REPEATS = 4


def _cells(value: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(block, four cells) of the leading ``bits`` bits of a hash."""
    block = (value >> np.uint64(bits - BLOCK_BITS)).astype(np.int64)
    inside = (value >> np.uint64(bits - BLOCK_BITS - 24)).astype(np.int64)
    return block, [block * 64 + ((inside >> (6 * i)) & 63) for i in range(4)]


def classes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Class of each hash: 0 for one occurrence, else about the logarithm of its count, 15 at most."""
    _, cells = _cells(hashes, 64)
    low = np.full(len(hashes), 15, np.uint8)
    for c in cells:
        np.minimum(low, (table[c >> 1] >> ((c & 1) << 2).astype(np.uint8)) & np.uint8(15), out=low)
    return low


def _blocks(source: Callable, bucket_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Sorted leading bits of the shingles of about ``BLOCK`` rows, of several chunks of texts."""
    held, size = [], 0
    for hashes in source(batches):
        u, n = np.unique(hashes, return_counts=True)
        held.append(np.repeat(u, np.minimum(n, REPEATS)) >> np.uint64(64 - bucket_bits - SENT_BITS))
        size += len(held[-1])
        if size >= BLOCK:
            yield np.sort(np.concatenate(held))
            held, size = [], 0
    if size:
        yield np.sort(np.concatenate(held))


def _packed(source: Callable, bucket_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, 5 bytes a shingle) of each block of shingles."""
    for value in _blocks(source, bucket_bits, batches):
        bucket = (value >> np.uint64(SENT_BITS)).astype(np.int64)
        keys, at = np.unique(bucket, return_index=True)
        raw = np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, : SENT_BITS // 8])
        offsets = np.append(at, len(value)).astype(np.int32) * (SENT_BITS // 8)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])], names=["bucket", "packed"])


def _tables(bucket_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the table of rows that are sorted by bucket."""
    bits = bucket_bits + SENT_BITS
    current, parts = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, SENT_BITS // 8)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, : raw.shape[1]] = raw
        u, n = np.unique(wide.reshape(-1).view(np.uint64), return_counts=True)
        u, n = u[n > 1] | np.uint64(current << SENT_BITS), n[n > 1]
        if not len(u):
            return
        klass = np.minimum(15, np.log2(n)).astype(np.uint8)
        by = np.argsort(klass, kind="stable")
        block, cells = _cells(u[by], bits)
        first = current << (BLOCK_BITS - bucket_bits) if bucket_bits <= BLOCK_BITS else current >> (bucket_bits - BLOCK_BITS)
        part = np.zeros(64 << max(0, BLOCK_BITS - bucket_bits), np.uint8)
        for c in cells:
            # of equal places the last one counts, the largest class
            place = c - first * 64
            seen = part[place]
            part[place] = np.maximum(seen, klass[by])
        bytes_ = part[0::2] | (part[1::2] << 4)
        step = min(len(bytes_), BLOCK_BYTES << ROW_BITS)
        at = first * BLOCK_BYTES + np.arange(0, len(bytes_), step)
        size = BLOCK_BYTES << ROW_BITS
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32()), pa.array([bytes_[i : i + step].tobytes() for i in range(0, len(bytes_), step)], pa.binary())],
            names=["row", "at", "cells"])

    for b in batches:
        for bucket, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != current:
                if parts:
                    yield from flush()
                current, parts = bucket, []
            parts.append(packed)
    if parts:
        yield from flush()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[int, np.ndarray] = {}
    for b in batches:
        for row, at, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = rows.setdefault(row, np.zeros(BLOCK_BYTES << ROW_BITS, np.uint8))
            new, old = np.frombuffer(cells, np.uint8), own[at : at + len(cells)]
            own[at : at + len(cells)] = np.maximum(old & 15, new & 15) | np.maximum(old & 240, new & 240)
    for row, cells in rows.items():
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["row", "cells"])


def frequency_table(texts: DataFrame, source: Callable, n_bytes: int) -> np.ndarray:
    """The table of all hashes that ``source`` yields for the batches of ``texts``, one array a chunk, each hash once a document.

    ``n_bytes``: bytes of all texts, which the number of buckets follows.
    """
    bucket_bits = max(BUCKET_BITS, (n_bytes // (5 * BUCKET)).bit_length())
    packed = texts.mapInArrow(partial(_packed, source, bucket_bits), "bucket long, packed binary")
    parts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_tables, bucket_bits), "row int, at int, cells binary")
    table = np.zeros(BLOCK_BYTES << BLOCK_BITS, np.uint8)
    size = BLOCK_BYTES << ROW_BITS
    for r in parts.repartition("row").mapInArrow(_merged, "row int, cells binary").toLocalIterator():
        table[r.row * size : (r.row + 1) * size] = np.frombuffer(r.cells, np.uint8)
    return table


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
