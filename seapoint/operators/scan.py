"""As-of answers by union and scan: the latest value before an instant without pairs of question and instant.

The pairs of the plain way grow with the questions of a cell times its instants within the age limit. Here the
cells near a question are found first, on cells alone, and what is asked comes down to distinct (cell, instant)
rows. These and the values of the cell are sorted once, and a window carries the last valid value on to
what is asked after it.

Time is cut into stretches of the age limit. A value stands in its own stretch and in the next one, so whatever is
not too old is in the stretch of the question, and a window holds two stretches of one cell at most and never its history.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seapoint.functions.geo import HALF_WIDTH_DEG, TILE_DEG, haversine_km, in_box, tile_of, tiles_of_box
from seapoint.functions.instants import hours_interval
from seapoint.plans.skew import HOT_ROWS, PART, hot_keys, split_join
from seapoint.sources.observations import of_product
from seapoint.sources.products import Product
from seapoint.sources.requests import POINT_AND_DAY

_CELL = ["cell_lat", "cell_lon"]
_TILE = ["tile_lat", "tile_lon"]


def near_cells(
    asked: DataFrame,
    cells: DataFrame,
    question: tuple[str, ...],
    max_km: float,
    half_width: float = HALF_WIDTH_DEG,
    tile: float = TILE_DEG,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each question with the cells of its box within ``max_km``, whatever they hold and when."""
    placed = asked.withColumn(
        "tile_lat", F.explode(tiles_of_box(F.col("lat"), half_width, tile))
    ).withColumn("tile_lon", F.explode(tiles_of_box(F.col("lon"), half_width, tile)))
    gridded = cells.withColumns(
        {
            "tile_lat": tile_of(F.col("cell_lat"), tile),
            "tile_lon": tile_of(F.col("cell_lon"), tile),
        }
    )
    hot = hot_keys(placed, _TILE, F.lit(1), hot_rows)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
    return (
        split_join(placed, gridded, _TILE, list(question), hot)
        .where(in_box(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"), half_width))
        .withColumn("distance_km", km)
        .where(F.col("distance_km") <= max_km)
        .drop(*_TILE, PART)
    )


def stretch_of(time_utc: Column, reach_hours: float) -> Column:
    """The number of the stretch of ``reach_hours`` that an instant lies in."""
    since = time_utc - F.lit("1970-01-01").cast("timestamp_ntz")
    return F.floor(since.cast("interval second").cast("decimal(18,6)") / F.lit(reach_hours * 3600.0))


def carried(wanted: DataFrame, values: DataFrame, keys: list[str], reach_hours: float) -> DataFrame:
    """The rows of ``wanted(keys, time_utc)``, which are distinct, with ``seen``: the last ``(time_utc, value)`` of their key, not after them
    and at most ``reach_hours`` old, or NULL. Of several values at one instant the smallest one counts.
    """
    own = stretch_of(F.col("time_utc"), reach_hours)
    seen = values.select(
        *keys,
        "time_utc",
        F.explode(F.array(own, own + 1)).alias("stretch"),
        F.lit(False).alias("is_asked"),
        F.struct("time_utc", "value").alias("seen"),
    )
    asks = wanted.select(
        *keys,
        "time_utc",
        own.alias("stretch"),
        F.lit(True).alias("is_asked"),
        F.lit(None).cast(seen.schema["seen"].dataType).alias("seen"),
    )
    order = (
        Window.partitionBy(*keys, "stretch")
        # A value at the very instant asked for counts.
        .orderBy("time_utc", "is_asked", F.desc("seen.value"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    young = F.col("time_utc") - F.col("last.time_utc") <= hours_interval(reach_hours)
    return (
        seen.unionByName(asks)
        .withColumn("last", F.last("seen", ignorenulls=True).over(order))
        .where("is_asked")
        .select(*keys, "time_utc", F.when(young, F.col("last")).alias("seen"))
    )


def latest_by_scan(
    asked: DataFrame, observations: DataFrame, product: Product, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per question and cell within the distance limit: the latest valid value and its ``age``, where there is one.

    A drop-in for the pairs of ``admissible_values``: with at most one row per question and cell, those
    of the latest instants, from which the newest and nearest is the same.
    """
    valid = (
        of_product(observations, product)
        .where(F.col("value").isNotNull())
        .select(*_CELL, "time_utc", "value")
    )
    pairs = near_cells(
        asked.select(*POINT_AND_DAY, "last_utc"),
        valid.select(*_CELL).distinct(),
        POINT_AND_DAY,
        product.max_cell_km,
        hot_rows=hot_rows,
    )
    wanted = pairs.select(*_CELL, F.col("last_utc").alias("time_utc")).distinct()
    found = (
        carried(wanted, valid, _CELL, product.max_age_h)
        .where(F.col("seen").isNotNull())
        .withColumnRenamed("time_utc", "last_utc")
    )
    keys = [*_CELL, "last_utc"]
    # A cell and day that very many questions share is cut into parts.
    hot = hot_keys(pairs, keys, F.lit(1), hot_rows)
    return (
        split_join(pairs, found, keys, list(POINT_AND_DAY), hot)
        .select(
            *POINT_AND_DAY,
            *keys,
            "distance_km",
            F.col("seen.time_utc").alias("time_utc"),
            F.col("seen.value").alias("value"),
        )
        .withColumn("age", F.col("last_utc") - F.col("time_utc"))
    )
