"""An equi-join whose hot keys are cut into parts.

A key asked for by very many rows would end up in one task. Such keys are counted first; their
rows are spread over numbered parts, and the few rows they meet on the other side are repeated
once per part. Other keys stay in part 0 and are not repeated. No row is dropped or doubled:
each row of the crowded side belongs to exactly one part.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is cut.
HOT_ROWS = 250_000
# The list of hot keys is broadcast, so it has a fixed ceiling: the most crowded keys. Any other key holds less
# than 1 / MOST_HOT of the rows and is left to adaptive skew splitting. The ceiling changes the plan, not the rows.
MOST_HOT = 20_000

_PARTS = "n_parts"
PART = "part"


def hot_keys(rows: DataFrame, keys: list[str], weight: Column, hot_rows: int) -> DataFrame:
    """Keys that carry more than ``hot_rows`` rows, and into how many parts to cut each."""
    counted = rows.groupBy(*keys).agg(F.sum(weight).alias("n_rows"))
    return most_crowded(counted, keys, "n_rows", hot_rows)


def most_crowded(counted: DataFrame, keys: list[str], n_rows: str, hot_rows: int) -> DataFrame:
    """The keys with over ``hot_rows`` rows and their parts: at most ``MOST_HOT`` entries, whatever the row count."""
    return (
        counted.where(F.col(n_rows) > hot_rows)
        .orderBy(F.desc(n_rows), *keys)
        .limit(MOST_HOT)
        .select(*keys, F.ceil(F.col(n_rows) / hot_rows).alias(_PARTS))
    )


def split_join(
    crowded: DataFrame,
    other: DataFrame,
    keys: list[str],
    spread_by: list[str],
    hot: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Join on ``keys``; rows of ``crowded`` with a hot key are spread by a hash of ``spread_by``.

    ``how`` may be ``inner`` or ``left`` (every row of ``crowded`` kept). The result keeps the
    number of the ``part``, so that a later grouping can stay within the partitions of the join.
    """
    parts = F.coalesce(F.col(_PARTS), F.lit(1))
    spread = (
        crowded.join(F.broadcast(hot), keys, "left")
        .withColumn(PART, F.pmod(F.xxhash64(*spread_by), parts))
        .drop(_PARTS)
    )
    repeated = (
        other.join(F.broadcast(hot), keys, "left")
        .withColumn(PART, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        .drop(_PARTS)
    )
    return spread.join(repeated, [*keys, PART], how)
