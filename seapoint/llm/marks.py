"""Rows of a table of texts that a table of keys may name, told without moving any text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BITS = 16
MOST_BITS = 1 << 27


def marks(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes that is true for each ``key`` of ``keys`` and for few others.

    The bits behind it are broadcast: ``KEY_BITS`` to twice as many for a key, ``MOST_BITS`` in all. Beyond these it is true for more of the others, so
    what it marks is still to be joined.
    """
    bits = min(MOST_BITS, max(1 << 10, 1 << (KEY_BITS * keys.count()).bit_length()))
    place = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("mask")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    shared = keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    @F.pandas_udf("boolean")
    def marked(key: pd.Series) -> pd.Series:
        place = key.to_numpy(np.int64).view(np.uint64) & np.uint64(bits - 1)
        return pd.Series((shared.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool))

    return marked


def without(rows: DataFrame, key: Column, met: Column, names: DataFrame, named_key: Column) -> DataFrame:
    """``rows`` for which nothing of ``names`` is ``met``; ``key`` and ``named_key`` are equal hashes of what is met.

    Only the rows that are marked go through the join, so the others' texts are not moved.
    """
    marked = marks(names.select(named_key.alias("key")))(key)
    return rows.filter(~marked).unionByName(rows.filter(marked).join(names, met, "left_anti"))
