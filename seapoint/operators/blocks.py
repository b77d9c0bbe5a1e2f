"""Maxima of any time range from dyadic blocks: a question meets the blocks that cover its window and not all instants in it.

The table has, per cell, the highest valid value and its first instant of every hour, of every second hour and so on up to blocks of
``2^LEVELS`` hours. A window is cut into whole hours and at most two partial ones. Whole hours are covered by at most
two blocks of each size (and by blocks of the largest one); a partial hour is looked up among its own instants. Each instant of the
window is in exactly one of these pieces, so the least of their tops is the top of the window.

The table depends on the observations alone: written once beside an archive (``land_blocks``), it serves every later question.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seapoint.functions.geo import (
    HALF_WIDTH_DEG,
    TILE_DEG,
    haversine_km,
    in_box,
    tile_of,
    tiles_of_box,
)
from seapoint.plans.completion import first_by
from seapoint.plans.skew import HOT_ROWS, PART, hot_keys, split_join
from seapoint.sources.observations import of_product
from seapoint.sources.products import Product
from seapoint.sources.requests import POINT_AND_HOURS

#: The largest block has ``2^LEVELS`` hours.
LEVELS = 5
_INSTANTS = -1
_TILE = ("tile_lat", "tile_lon")
_PIECE = ["level", "block"]
_CELL = ("cell_lat", "cell_lon")


def _hours(time_utc: Column) -> Column:
    """Hours since 1970, exact to the microsecond."""
    since = time_utc - F.lit("1970-01-01").cast("timestamp_ntz")
    return since.cast("interval second").cast("decimal(18,6)") / F.lit(3600)


def block_table(observations: DataFrame, product: Product, levels: int = LEVELS) -> DataFrame:
    """``tile_lat, tile_lon, level, block, cell_lat, cell_lon, top``: hours (level 0), blocks, and single instants (level -1, by hour)."""
    valid = (
        of_product(observations, product)
        .where(F.col("value").isNotNull())
        .select(
            tile_of(F.col("cell_lat")).alias("tile_lat"),
            tile_of(F.col("cell_lon")).alias("tile_lon"),
            *_CELL,
            F.floor(_hours(F.col("time_utc"))).alias("hour"),
            (-F.col("value")).alias("minus_value"),
            "time_utc",
        )
    )
    instants = valid.select(
        *_TILE,
        F.lit(_INSTANTS).alias("level"),
        F.col("hour").alias("block"),
        *_CELL,
        F.struct("minus_value", "time_utc").alias("top"),
    )
    order = [F.col("minus_value"), F.col("time_utc")]
    hourly = first_by(valid, (*_TILE, *_CELL, "hour"), order, "top")
    blocks = hourly.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn(
        "block", F.call_function("shiftright", F.col("hour"), F.col("level"))
    )
    blocks = blocks.groupBy(*_TILE, *_PIECE, *_CELL).agg(F.min("top").alias("top"))
    return instants.unionByName(blocks)


def land_blocks(observations: DataFrame, product: Product, path: str, levels: int = LEVELS) -> None:
    """Write the table, by level and then by tile, so that a scan prunes both."""
    table = block_table(observations, product, levels)
    table.repartitionByRange("level", *_TILE, "block").sortWithinPartitions(
        "level", *_TILE, "block"
    ).write.partitionBy("level").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pieces(first_utc: Column, last_utc: Column, levels: int = LEVELS) -> Column:
    """The pieces of a closed window, as an array of ``(level, block)``."""
    start = _hours(first_utc)
    # Times are whole microseconds, so the window ends before the next one.
    stop = _hours(last_utc + F.make_dt_interval(secs=F.lit(0.000001)))
    low, high = F.ceil(start).cast("bigint"), F.floor(stop).cast("bigint")

    def piece(level: int, block: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), block.cast("bigint").alias("block"))

    def where(condition: Column, found: Column) -> Column:
        return F.when(condition, found)

    found = [
        where(start < low, piece(_INSTANTS, low - 1)),
        # A window inside one hour has this piece only.
        where((stop > high) & ((start >= low) | (high != low - 1)), piece(_INSTANTS, high)),
    ]
    for level in range(levels):
        size = F.lit(1 << level)
        a, b = F.ceil(low / size), F.floor(high / size)
        found.append(where((a < b) & (F.pmod(a, F.lit(2)) == 1), piece(level, a)))
        found.append(where((a < b) & (F.pmod(b, F.lit(2)) == 1), piece(level, b - 1)))
    size = F.lit(1 << levels)
    a, b = F.ceil(low / size), F.floor(high / size)
    largest = F.when(a < b, F.transform(F.sequence(a, b - 1), lambda block: piece(levels, block)))
    single = F.filter(F.array(*found), lambda p: p.isNotNull())
    return F.concat(single, F.coalesce(largest, F.array().cast("array<struct<level:int,block:bigint>>")))


def matched_blocks(
    asked: DataFrame,
    blocks: DataFrame,
    question: tuple[str, ...],
    levels: int = LEVELS,
    half_width: float = HALF_WIDTH_DEG,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each question with the tops of its pieces in the cells of its box."""
    keys = [*_TILE, *_PIECE]
    placed = (
        asked.select(*question, "first_utc", "last_utc")
        .withColumn("piece", F.explode(pieces(F.col("first_utc"), F.col("last_utc"), levels)))
        .withColumn("tile_lat", F.explode(tiles_of_box(F.col("lat"), half_width, TILE_DEG)))
        .withColumn("tile_lon", F.explode(tiles_of_box(F.col("lon"), half_width, TILE_DEG)))
        .withColumns({name: F.col(f"piece.{name}") for name in _PIECE})
        .drop("piece")
    )
    hot = hot_keys(placed, keys, F.lit(1), hot_rows)
    return (
        split_join(placed, blocks.select(*keys, *_CELL, "top"), keys, list(question), hot)
        .where(
            in_box(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"), half_width)
            # True for every block, by construction.
            & F.col("top.time_utc").between(F.col("first_utc"), F.col("last_utc"))
        )
        .drop(*keys, PART)
    )


def maxima_by_blocks(
    asked: DataFrame,
    observations: DataFrame,
    product: Product,
    blocks: DataFrame | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """Per question and admissible cell: the highest valid value in the window and its first instant.

    ``blocks`` is a table of ``block_table`` with the same ``levels``; without one it is made from the observations.
    """
    if blocks is None:
        blocks = block_table(observations, product, levels)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
    near = (
        matched_blocks(asked, blocks, POINT_AND_HOURS, levels)
        .withColumn("distance_km", km)
        .where(F.col("distance_km") <= product.max_cell_km)
    )
    tops = near.groupBy(*POINT_AND_HOURS, *_CELL).agg(F.min(F.struct("top", "distance_km")).alias("best"))
    return tops.select(
        *POINT_AND_HOURS,
        *_CELL,
        "best.distance_km",
        (-F.col("best.top.minus_value")).alias("max_value"),
        F.col("best.top.time_utc").alias("max_time_utc"),
    )
