"""Point-by-grid join: each question with every observation of its box and its time range.

A join on the bare ranges has no equality and would compare every pair. Here both sides carry a
tile of the plane and a UTC date, so Spark hashes them: a question names the few tiles and dates
its range touches, an observation has exactly one, and the exact closed ranges are checked on the
pairs that meet. No pair is found twice, so nothing has to be made distinct afterwards.

A question side that Spark knows to be small is broadcast by its own size check and the
observations are then streamed without a shuffle; otherwise both sides are shuffled on the keys.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.functions.geo import HALF_WIDTH_DEG, TILE_DEG, in_box, tiles_of_box
from seapoint.plans.skew import HOT_ROWS, PART, hot_keys, split_join
from seapoint.sources.observations import TILE_KEYS, with_tiles

# A question, a cell and an instant meet on exactly one combination of these.
JOIN_KEYS = (*TILE_KEYS, PART)


def match(
    asked: DataFrame,
    observations: DataFrame,
    question: tuple[str, ...],
    half_width: float = HALF_WIDTH_DEG,
    tile: float = TILE_DEG,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs of a question and an observation inside its closed box and time range.

    The result has the ``question`` columns, ``first_utc`` and ``last_utc``, the observation's
    ``time_utc, depth_m, cell_lat, cell_lon, value``, and the ``JOIN_KEYS`` the pair met on.
    """
    keys = list(TILE_KEYS)
    placed = (
        asked.select(*question, "first_utc", "last_utc")
        .withColumn("tile_lat", F.explode(tiles_of_box(F.col("lat"), half_width, tile)))
        .withColumn("tile_lon", F.explode(tiles_of_box(F.col("lon"), half_width, tile)))
        .withColumn(
            "obs_date",
            F.explode(F.sequence(F.to_date("first_utc"), F.to_date("last_utc"))),
        )
    )
    gridded = with_tiles(observations, tile).select(
        *keys, "time_utc", "depth_m", "cell_lat", "cell_lon", "value"
    )
    hot = hot_keys(placed, keys, F.lit(1), hot_rows)
    return split_join(placed, gridded, keys, list(question), hot).where(
        in_box(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"), half_width)
        & F.col("time_utc").between(F.col("first_utc"), F.col("last_utc"))
    )
