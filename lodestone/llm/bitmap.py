"""A bitmap of hashes, of one size at every input: it saves work where it is sparse and never decides a result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^27 bits are 16 MB, which is all that is ever collected and broadcast.
BITS = 27


#: Words of a segment: what one group of the last step holds, and one row of what is collected.
SEGMENT = 1 << 13


def _segment(words: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT, dtype=np.uint64)
    bits[words.column("word").to_numpy() % SEGMENT] = words.column("bits").to_numpy().view(np.uint64)
    return pa.table({"segment": words.column("segment").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def collect(hashes: DataFrame, column: str = "h", bits: int = BITS) -> np.ndarray:
    """The bitmap of a long column. Spark sets the bits of each word and puts words together in segments, so what comes
    to the driver are at most 2^(bits - 6) / SEGMENT rows: the bitmap itself and no more."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).withColumn("segment", F.shiftright("word", 13))
    found = words.groupBy("segment").applyInArrow(_segment, "segment long, bits binary").collect()
    out = np.zeros(max(SEGMENT, 1 << (bits - 6)), dtype=np.uint64)
    for row in found:
        out[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(row["bits"], dtype=np.uint64)
    return out


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be among those collected; never false for one that is."""
    at = hashes & np.uint64((len(bitmap) << 6) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
