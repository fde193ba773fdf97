"""A set of numbers as a bit table of fixed size, to leave out rows early that can't be wanted.

A number's bit is given by its low bits, so a set bit says perhaps, a clear one says no. The table has 2^BITS bits
(8 MB) whatever the input's size: at most 2^(BITS - 6) rows go to the driver, and what goes to the executors is
bounded. With very many numbers it lets more through, never less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def bit_table(df: DataFrame, column: str) -> np.ndarray:
    """Table of the column's numbers (long); nulls are left out."""
    slot = F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))
    words = df.where(F.col(column).isNotNull()).select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return table


def maybe(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each number may be in the set."""
    n = numbers.astype(np.int64, copy=False)
    words = table[(n & ((1 << BITS) - 1)) >> 6]
    return (words >> (n & 63).astype(np.uint64)) & np.uint64(1) > 0
