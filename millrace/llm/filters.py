"""Bit sets of keys: supersets of bounded size that tasks look rows up in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 27


def bitset(keys: DataFrame, n: int, most: int = MOST_BITS) -> np.ndarray:
    """Bits of the keys' hashes, 16 to a key but `most` (a power of 2, 8 bits a byte) at most: a superset of the keys, whatever their number."""
    size = 1 << 15
    while size < 16 * n and size < most:
        size *= 2
    block = 1 << 15

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(block, bool)
        bits[table.column("key").to_numpy().view(np.uint64) % np.uint64(block)] = True
        return pa.table({"at": table.column("at").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    packed = keys.select("key", F.call_function("shiftrightunsigned", "key", F.lit(15)).bitwiseAND(F.lit(size // block - 1)).alias("at")).groupBy("at").applyInArrow(pack, "at long, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in packed.collect():  # 16 MB at most, in one job
        out[r["at"] * block // 8 : (r["at"] + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(15) & np.uint64(len(bits) * 8 // (1 << 15) - 1)) * np.uint64(1 << 15) + keys % np.uint64(1 << 15)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
