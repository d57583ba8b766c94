"""Bulk-synchronous best-fit packing of documents into sequences of a fixed number of tokens.

Documents and the gaps of sequences are range-sorted by size, which numbers the rows of each size. In a round one
sweep goes from the largest size to the smallest: each document takes the smallest gap of the round that holds it.
Rows of one size are interchangeable, so the sweep needs the counts of sizes alone, at most ``capacity`` of documents
and of gaps; which row gets which is settled by rank: the r-th documents of a size meet the r-th gaps of theirs.
Gaps are updated as rows, sorted again and swept again until all documents have a place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, stage
from .textnum import chunks
from .vocab import SLICE, public_path, word_ids

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Id that ends each document.
END = (0).to_bytes(4, "little")
#: Tokens of equal small documents that a gap takes in the first round; twice as many in each later one.
BUNDLE = 64
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_OUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(buffer: bytes, width: int, last: bool) -> tuple[list[bytes], bytes]:
    """Whole pieces of ``width`` bytes and what is left; of the last buffer that is a piece too."""
    n = len(buffer) // width * width
    parts = [buffer[i : i + width] for i in range(0, n, width)]
    return (parts + [buffer[n:]], b"") if last and n < len(buffer) else (parts, buffer[n:])


def _pieces(path: str | None, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each text's ids; ``row`` numbers them within the table that is written."""
    encoder = word_ids(path or public_path(VOCABULARY))
    row, width, out = TaskContext.get().partitionId() << 40, 4 * capacity, []

    def flush():
        columns = list(zip(*out, strict=True)) or [[]] * len(_OUT)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)
        out.clear()
        return batch

    for rows, data, offsets in chunks(batches, limit=4 * SLICE):
        ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
        raw, at = data.tobytes(), offsets.tolist()
        texts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        found = [[t] for t in encoder.encode(texts)] if len(raw) <= 4 * SLICE else [encoder.stream(t) for t in texts]
        for doc_id, parts in zip(ids, found, strict=True):
            left, piece = b"", 0
            for part, last in ((p, last) for last, group in ((False, parts), (True, [END])) for p in group):
                done, left = _cut(left + part, width, last)
                for d in done:
                    out.append((row, doc_id, piece, piece * capacity, len(d) // 4, zlib.crc32(d)))
                    row, piece = row + 1, piece + 1
                if len(out) >= 1 << 14:
                    yield flush()
    yield flush()


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """row, doc_id, piece, start, length and ids_crc32 of each piece of at most ``capacity`` ids; a document ends with id 0."""
    docs = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(docs.mapInArrow(partial(_pieces, path, capacity), PIECES))


def _number(by: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each size within a sorted partition."""
    part, size, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        x = np.asarray(b.column(b.schema.get_field_index(by)))
        if not len(x):
            continue
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        n = np.arange(len(x)) - np.repeat(first, np.diff(np.concatenate([first, [len(x)]])))
        if x[0] == size:
            n[: first[1] if len(first) > 1 else len(x)] += at
        size, at = x[-1], int(n[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), part, np.int32)), pa.array(n)], names=[*b.schema.names, "part", "at"])


def range_sorted(df: DataFrame, by: str, tie: str) -> tuple[DataFrame, dict[tuple[int, int], int], np.ndarray]:
    """``df`` in ranges of ``by`` with part and number within part and size; the first rank of each (part, size); rows of each size.

    What reaches the driver is bounded by the number of sizes and of partitions.
    """
    schema = T.StructType([*df.schema, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    out = stage(df.repartitionByRange(by, tie).sortWithinPartitions(by, tie).mapInArrow(partial(_number, by), schema))
    before, total = {}, {}
    for r in sorted(out.groupBy("part", by).count().collect(), key=lambda r: (r[by], r["part"])):
        before[r["part"], r[by]] = total.get(r[by], 0)
        total[r[by]] = before[r["part"], r[by]] + r["count"]
    counts = np.zeros(max(total, default=0) + 1, np.int64)
    counts[list(total)] = list(total.values())
    return out, before, counts


def sweep(sizes: np.ndarray, gaps: np.ndarray, first: np.ndarray, bundle: int) -> list[tuple[int, int, int, int, int, int]]:
    """(gap, its first rank, gaps, size, first rank, documents) of one round; gaps take documents / gaps each, rounded up, the last one what is left.

    ``sizes`` and ``gaps``: counts by size; ``first``: documents of each size that have their place already. Gaps that wait are a stack, the smallest on top.
    """
    stack, out = [], []
    for s in range(max(len(sizes), len(gaps)) - 1, 0, -1):
        if s < len(gaps) and gaps[s]:
            stack.append([s, 0, int(gaps[s])])
        n, at = (int(sizes[s]), int(first[s])) if s < len(sizes) else (0, 0)
        while n and stack:
            gap, rank, left = stack[-1]
            each = max(1, min(gap, bundle) // s)
            used = min(left, -(-n // each))
            placed = min(n, used * each)
            out.append((gap, rank, used, s, at, placed))
            n, at = n - placed, at + placed
            stack[-1][1:] = rank + used, left - used
            if used == left:
                stack.pop()
    return out


def _matched(shared, explode: bool, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gaps after a round, or the places (size, rank, sequence_id, offset) that they gave in it."""
    before, moves = shared.value
    keys = np.array([g << 40 | rank for g, rank, *_ in moves], np.int64)
    _, _, used, size, first, placed = (np.array(c, np.int64) for c in zip(*moves, strict=True))
    each = -(-placed // used)
    for b in batches:
        sequence, gap, part, at = (np.asarray(b.column(i)).astype(np.int64) for i in range(4))
        pairs, where = np.unique(part << 20 | gap, return_inverse=True)
        rank = at + np.array([before[int(p >> 20), int(p & 0xFFFFF)] for p in pairs], np.int64)[where] if len(pairs) else at
        key = gap << 40 | rank
        m = np.maximum(np.searchsorted(keys, key, side="right") - 1, 0)
        nth = key - keys[m]
        # past the gaps of its range: waits
        n = np.where((nth >= 0) & (nth < used[m]), np.minimum(each[m], placed[m] - nth * each[m]), 0)
        if not explode:
            left = gap - n * size[m]
            yield pa.RecordBatch.from_arrays([pa.array(sequence[left > 0]), pa.array(left[left > 0].astype(np.int32))], names=["sequence_id", "gap"])
            continue
        row = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        s = size[m[row]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.astype(np.int32)), pa.array(first[m[row]] + nth[row] * each[m[row]] + i), pa.array(sequence[row]), pa.array(capacity - gap[row] + i * s)],
            names=["size", "rank", "sequence_id", "offset"])


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` with sequence_id and offset; ``items``: row (unique), size (int, 1 to ``capacity`` - 1), and columns that are carried along.

    Ties of size are taken by range order of ``row``. An empty table gives no rows.
    """
    spark = items.sparkSession
    docs, before, sizes = range_sorted(items, "size", "row")
    first, opened, turn, places = np.zeros_like(sizes), 0, 0, []
    gaps = spark.createDataFrame([], "sequence_id long, gap int")
    counts = np.zeros(capacity + 1, np.int64)
    while (sizes - first).any():
        left = sizes - first
        least = int(np.flatnonzero(left)[0])
        need = int((left * np.arange(len(left))).sum())
        room = int((counts * np.arange(capacity + 1))[least:].sum())
        moves = sweep(left, counts, first, BUNDLE << min(turn, 20))
        if need > room or not moves:
            # as many new sequences as the tokens without room fill, in the first round one for each document above a half, too
            n = max(1, -(-(need - room if moves else need) // capacity), 0 if turn else int(left[capacity // 2 + 1 :].sum()))
            gaps = gaps.unionByName(spark.range(opened, opened + n).select(F.col("id").alias("sequence_id"), F.lit(capacity).alias("gap")))
            opened, counts[capacity] = opened + n, counts[capacity] + n
            moves = sweep(left, counts, first, BUNDLE << min(turn, 20))
        ranked, own, _ = range_sorted(gaps, "gap", "sequence_id")
        shared = spark.sparkContext.broadcast((own, sorted(moves)))
        places.append(ranked.mapInArrow(partial(_matched, shared, True, capacity), "size int, rank long, sequence_id long, offset long"))
        gaps = ranked.mapInArrow(partial(_matched, shared, False, capacity), "sequence_id long, gap int")
        for gap, _, used, size, _, placed in moves:
            first[size] += placed
            each = -(-placed // used)
            full = placed // each
            counts[gap] -= used
            counts[gap - each * size] += full
            if full < used:
                counts[gap - (placed - full * each) * size] += 1
        counts[0] = 0
        turn += 1
    offsets = spark.createDataFrame([(p, s, n) for (p, s), n in before.items()], "part int, size int, before long")
    given = reduce(DataFrame.unionByName, places) if places else spark.createDataFrame([], "size int, rank long, sequence_id long, offset long")
    return docs.join(F.broadcast(offsets), ["part", "size"]).withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before").join(given, ["size", "rank"]).drop("rank")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    ``docs``: doc_id (null: left out), text (null: empty, its end alone); other columns are ignored; repeated rows are packed as documents of their own. Only
    documents above ``capacity`` are cut. A piece that fills its sequence gets a negative sequence_id. ``path``: a vocabulary whose tokenizer drops white space. An empty table gives no rows.
    """
    pieces = token_pieces(docs, path, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    rest = best_fit(pieces.filter(F.col("length") < capacity).withColumn("size", F.col("length").cast("int")), capacity)
    return full.select(*columns).unionByName(rest.select(*columns))
