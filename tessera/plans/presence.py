"""Rows whose hash may be among some wanted ones, found without moving the rows.

One row of bits, of bounded size, is broadcast; a wanted hash always has its bit, so what lacks it is
surely not wanted. The others still have to be joined, but are few where few are wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each wanted hash, and at most: 8 MB. Above that, more rows pass that are not wanted.
BITS_A_HASH, MOST_BITS = 16, 1 << 26


def bits_of(wanted: DataFrame) -> tuple[DataFrame, int]:
    """One row ``(bits)`` of 64-bit words for the hashes in the only column (a long) of ``wanted``, and the number of bits."""
    hashes = wanted.toDF("h")
    size = min(MOST_BITS, max(1 << 12, 1 << (BITS_A_HASH * hashes.count()).bit_length()))
    at = hashes.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    row = pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits))
    return wanted.sparkSession.createDataFrame(pa.table({"bits": row}), "bits array<long>"), size


def split(rows: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of ``rows`` whose hash ``column`` (a long, not null) may be in ``wanted``, and those for which it surely is not."""
    bits, size = bits_of(wanted)
    has = F.expr(f"getbit(bits[cast(shiftright(`{column}` & {size - 1}L, 6) as int)], cast(`{column}` & 63 as int)) = 1")
    return rows.join(F.broadcast(bits), has, "left_semi"), rows.join(F.broadcast(bits), has, "left_anti")
