"""An archive to which deliveries are only ever added, and which can be asked what it held at any time.

Every delivery is a folder of its own, named by its time, and is never written again. A delivery counts
once its folder is marked as complete, so one that fails midway, or is still being written, changes
no reading, and writers do not meet. Of the values that a coordinate was delivered with, the one of
the latest delivery at or before the time asked for is known then; a missing value is known as missing.
"""

import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seapoint.schemas import STORED_OBSERVATIONS
from seapoint.sources.observations import (
    COORDINATES,
    TILE_KEYS,
    laid_out,
    unique_coordinates,
    with_tiles,
    within_extent,
)
from seapoint.sources.products import Product

DELIVERED = "delivered_us"
_STORED = T.StructType(
    STORED_OBSERVATIONS.fields + [T.StructField(DELIVERED, T.LongType()), T.StructField("writer", T.StringType())]
)


def _micros(moment: datetime) -> int:
    """Microseconds since 1970; a time without a zone is UTC."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    return (aware - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def deliver_observations(rows: DataFrame, path: str, delivered_at: datetime, files: int | None = None) -> None:
    """Add one delivery, laid out as by ``land_observations``. Nothing that is stored is read or touched."""
    folder = f"{path}/{DELIVERED}={_micros(delivered_at)}/writer={uuid.uuid4().hex}"
    laid_out(with_tiles(unique_coordinates(rows)), files).mode("errorifexists").parquet(folder)


def _complete(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder by time of every delivery that is through: one name for each, whatever it holds."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{DELIVERED}=*/writer=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    folders: dict[int, str] = {}
    for status in found:
        folder = status.getPath().getParent()
        moment = int(folder.getParent().getName().split("=")[1])
        if moment in folders:
            raise ValueError(f"two deliveries of one time, neither of which is later: {folder.getParent()}")
        folders[moment] = folder.toString()
    return folders


def as_known(deliveries: DataFrame, known_at, order: str = "delivered_at") -> DataFrame:
    """One row per coordinate of rows that carry the time of their delivery: what was known at ``known_at``.

    Filters on coordinates, tiles and dates are pushed below the aggregate, which holds one number and
    one time per coordinate and combines before the shuffle. A delivery holds a coordinate once.
    """
    known = deliveries.where(F.col(order) <= known_at)
    stored = [name for name in TILE_KEYS if name in deliveries.columns]
    return known.groupBy(*COORDINATES, *stored).agg(F.max_by("value", order).alias("value"))


def read_deliveries(
    spark: SparkSession, path: str, product: Product, known_at: datetime | None = None, extent: dict | None = None
) -> DataFrame:
    """The observations of ``product`` as known at a time (by default: all that is there), for any reading.

    Later deliveries are not opened. ``extent`` only prunes, as in ``read_observations``.
    """
    folders = _complete(spark, path)
    chosen = [folder for moment, folder in sorted(folders.items()) if known_at is None or moment <= _micros(known_at)]
    if not chosen:
        return spark.createDataFrame([], STORED_OBSERVATIONS)
    stored = spark.read.schema(_STORED).option("basePath", path).parquet(*chosen)
    needed = within_extent(stored, product, extent)
    return as_known(needed, F.lit(2**63 - 1), DELIVERED).select(*STORED_OBSERVATIONS.names)
