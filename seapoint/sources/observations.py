"""Observation tables: cubes to rows, landing, and subset scans.

One row per coordinate (dataset, variable, time, depth, cell). A missing value is a row with a
NULL (or NaN) value, never an absent row: instants on the time axis count even where a cell has
no value.
"""

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from seapoint.functions.geo import HALF_WIDTH_DEG, TILE_DEG, tile_of
from seapoint.functions.readings import native_value
from seapoint.schemas import OBSERVATIONS, STORED_OBSERVATIONS
from seapoint.sources.products import Product

COORDINATES = ("dataset_id", "variable", "time_utc", "depth_m", "cell_lat", "cell_lon")
TILE_KEYS = ("tile_lat", "tile_lon", "obs_date")


def cube_to_rows(
    cubes: DataFrame, values: str, axes: dict[str, Column], keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per coordinate of dense blocks held as row-major arrays.

    ``axes`` maps each output column to its coordinate array, slowest axis first. A block may be
    any piece of a cube (one instant, one level, one region), so no task needs a whole cube. The
    coordinates are looked up before the array is unfolded; the axis arrays are not copied
    to every row.
    """
    sizes = [F.size(axis) for axis in axes.values()]

    def place(value: Column, position: Column) -> Column:
        fields = []
        for n, (name, axis) in enumerate(axes.items()):
            stride = reduce(lambda a, b: a * b, sizes[n + 1 :], F.lit(1))
            index = F.floor(position / stride).cast("int") % sizes[n]
            fields.append(F.get(axis, index).alias(name))
        return F.struct(*fields, value.alias("value"))

    return cubes.select(*keep, F.inline(F.transform(F.col(values), place)))


def as_observations(rows: DataFrame) -> DataFrame:
    """Bring a table to the observation layout, with NaN as NULL and no row dropped."""
    depth = F.col("depth_m") if "depth_m" in rows.columns else F.lit(None)
    stored = [name for name in TILE_KEYS if name in rows.columns]
    return rows.select(
        "dataset_id",
        "variable",
        F.col("time_utc").cast("timestamp_ntz").alias("time_utc"),
        depth.cast("double").alias("depth_m"),
        F.col("cell_lat").cast("double").alias("cell_lat"),
        F.col("cell_lon").cast("double").alias("cell_lon"),
        native_value(F.col("value").cast("double")).alias("value"),
        *stored,
    )


def with_tiles(observations: DataFrame, tile: float = TILE_DEG) -> DataFrame:
    """Add the join keys unless the table was landed with them (at the default tile)."""
    if tile == TILE_DEG and set(TILE_KEYS) <= set(observations.columns):
        return observations
    return observations.withColumns(
        {
            "tile_lat": tile_of(F.col("cell_lat"), tile),
            "tile_lon": tile_of(F.col("cell_lon"), tile),
            "obs_date": F.to_date("time_utc"),
        }
    )


def unique_coordinates(rows: DataFrame) -> DataFrame:
    """One row per coordinate: copies collapse (map-side first), contradictions fail the job.

    A coordinate delivered both with and without a value keeps the value it was delivered with.
    """
    merged = (
        as_observations(rows)
        .groupBy(*COORDINATES)
        .agg(F.max("value").alias("value"), F.min("value").alias("lowest"))
    )
    complaint = F.concat(
        F.lit("two values for one coordinate: "),
        F.to_json(F.struct("variable", F.col("time_utc").cast("string"), "cell_lat", "cell_lon")),
    )
    agreed = F.when(
        F.col("lowest").isNull() | (F.col("lowest") == F.col("value")), F.col("value")
    ).otherwise(F.raise_error(complaint).cast("double"))
    return merged.select(*COORDINATES, agreed.alias("value"))


def land_observations(
    rows: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists"
) -> None:
    """Write an observation table laid out for ``read_observations`` and for the tile join.

    ``append`` is refused: it would not see what is stored. Use ``redeliver_observations``.

    Directories per dataset and UTC date; inside, rows ranged and sorted by tile, so row-group
    statistics prune by place. The range ends in the cell and the instant: a date or tile that
    holds a third of all rows is cut over many tasks and files.
    """
    if mode == "append":
        raise ValueError("append could store two values for one coordinate: redeliver_observations")
    laid_out(with_tiles(unique_coordinates(rows)), files).mode(mode).parquet(path)


def redeliver_observations(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Merge a later delivery into a landed table: its values replace those stored.

    What it delivers as missing is missing afterwards; coordinates that it does not name stay. Only
    directories of a dataset and date that it touches are read and written again (dynamic partition
    overwrite, committed at the end). Two deliveries into one table must not run at once.
    """
    spark = rows.sparkSession
    delivered = with_tiles(unique_coordinates(rows)).select(*STORED_OBSERVATIONS.names)
    touched = delivered.select("dataset_id", "obs_date").distinct()
    # Two dates: literals that prune the listing before the exact semi join.
    span = touched.agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("last")).first()
    if span["first"] is None:
        return
    stored = (
        spark.read.schema(STORED_OBSERVATIONS)
        .parquet(path)
        .where(F.col("obs_date").between(F.lit(span["first"]), F.lit(span["last"])))
        .join(touched, ["dataset_id", "obs_date"], "left_semi")
    )
    both = stored.select(*STORED_OBSERVATIONS.names, F.lit(0).alias("delivery")).unionByName(
        delivered.withColumn("delivery", F.lit(1))
    )
    merged = both.groupBy(*COORDINATES).agg(F.max_by("value", "delivery").alias("value"))
    writer = laid_out(with_tiles(merged), files)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def laid_out(rows: DataFrame, files: int | None) -> DataFrameWriter:
    order = ("dataset_id", "obs_date", "tile_lat", "tile_lon", "cell_lat", "cell_lon", "time_utc")
    stored = rows.select(*STORED_OBSERVATIONS.names)
    ranged = (
        stored.repartitionByRange(files, *order) if files else stored.repartitionByRange(*order)
    )
    return ranged.sortWithinPartitions(*order).write.partitionBy("dataset_id", "obs_date")


def subset(
    observations: DataFrame,
    product: Product | None = None,
    lat: tuple[float, float] | None = None,
    lon: tuple[float, float] | None = None,
    period: tuple | None = None,
    max_depth_m: float | None = None,
) -> DataFrame:
    """Literal filters, closed on every side: one variable, a box, a period, a depth ceiling.

    On a landed table they prune directories and reach the Parquet reader.
    """
    kept = observations
    if product is not None:
        kept = kept.where(
            (F.col("dataset_id") == product.dataset_id) & (F.col("variable") == product.variable)
        )
    if lat is not None:
        kept = kept.where(F.col("cell_lat").between(*lat))
    if lon is not None:
        kept = kept.where(F.col("cell_lon").between(*lon))
    if period is not None:
        first, last = (F.lit(edge).cast("timestamp_ntz") for edge in period)
        kept = kept.where(F.col("time_utc").between(first, last))
        if "obs_date" in kept.columns:
            kept = kept.where(F.col("obs_date").between(F.to_date(first), F.to_date(last)))
    if max_depth_m is not None:
        kept = kept.where(F.col("depth_m") <= max_depth_m)
    return kept


def read_observations(
    spark: SparkSession, path: str, product: Product, extent: dict | None = None
) -> DataFrame:
    """Scan the part of a landed table that requests within ``extent`` can need.

    ``extent`` comes from ``request_extent``; it only prunes, and changes no reading.
    """
    return within_extent(spark.read.schema(STORED_OBSERVATIONS).parquet(path), product, extent)


def within_extent(stored: DataFrame, product: Product, extent: dict | None) -> DataFrame:
    """The rows of ``product`` that requests within ``extent`` can need, down to its depth ceiling."""
    if extent is None or None in extent.values():
        return subset(stored, product, max_depth_m=product.max_depth_m)
    back_days = 2 + int(-(-(product.max_age_h or 0) // 24))

    def day(value: date, shift: int) -> str:
        return str(value + timedelta(days=shift))

    return subset(
        stored,
        product,
        lat=(extent["min_lat"] - HALF_WIDTH_DEG, extent["max_lat"] + HALF_WIDTH_DEG),
        lon=(extent["min_lon"] - HALF_WIDTH_DEG, extent["max_lon"] + HALF_WIDTH_DEG),
        period=(day(extent["first_date"], -back_days), day(extent["last_date"], 3)),
        max_depth_m=product.max_depth_m,
    )


def of_product(observations: DataFrame, product: Product) -> DataFrame:
    """Normalised rows of one product, down to its depth ceiling."""
    return as_observations(subset(observations, product, max_depth_m=product.max_depth_m))


__all__ = [
    "OBSERVATIONS",
    "as_observations",
    "cube_to_rows",
    "land_observations",
    "of_product",
    "read_observations",
    "subset",
    "unique_coordinates",
    "with_tiles",
]
