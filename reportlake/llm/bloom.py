"""A membership filter of fixed size for 64-bit hashes, built by Spark and broadcast.

Its size does not depend on the data; more keys only let more other rows pass, and
every user joins what has passed with the exact keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import mix, signed

#: 2^20 longs of 64 bits: 8 MB.
SLOTS = 1 << 20


def _bits(keys: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(((h >> np.uint64(6)) % np.uint64(slots)).astype(np.int64), h & np.uint64(63)) for h in (mix(keys), mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]


def _masks(slots: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One mask a task as blocks of 1024 longs."""
    mask = np.zeros(slots, np.uint64)
    for b in batches:
        for slot, bit in _bits(np.asarray(b.column(0)).view(np.uint64), slots):
            np.bitwise_or.at(mask, slot, np.uint64(1) << bit)
    at = np.flatnonzero(mask)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(signed(mask[part]))], names=["slot", "bits"])


def build(keys: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """The filter of a DataFrame of one long column without nulls; at most ``slots`` rows reach the driver."""
    rows = keys.mapInArrow(partial(_masks, slots), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    mask = np.zeros(slots, np.uint64)
    if len(rows):
        mask[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return mask


def test(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for slot, bit in _bits(keys, len(mask)):
        hit &= (mask[slot] >> bit) & np.uint64(1) == 1
    return hit
