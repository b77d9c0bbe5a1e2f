"""Request and observation tables derived by Spark from the given star-schema tables.

Orders become requests spread around a coastal grid, events become native observations; both
grow with the given tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seapoint.sources.products import Product, catalogue

# Grid origin and step of the derived tables, in degrees.
LAT0, LON0, CELLS_PER_DEG = -13.0, -77.5, 12

# Cadence in hours, divisor and offset of the derived values, per family.
RECIPES = {
    "waves": (3, 40.0, 0),
    "temperature": (6, 50.0, 15),
    "salinity": (6, 200.0, 34),
    "chlorophyll": (24, 100.0, 0),
}

# Depth levels (m); the last lies below the ceiling. Each level adds 10 to the value.
LEVELS = (0.494025, 1.541375, 2.645669, 3.819495, 5.078224)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    return _table(spark, sf_dir, "orders").select(
        order.alias("request_id"),
        (
            F.lit(LAT0)
            + (customer % 12) / F.lit(float(CELLS_PER_DEG))
            + ((order % 9) - 4) * F.lit(0.01)
        ).alias("lat"),
        (
            F.lit(LON0)
            + F.floor((customer % 150) / 12) / F.lit(float(CELLS_PER_DEG))
            + ((order % 7) - 3) * F.lit(0.012)
        ).alias("lon"),
        F.date_add(F.lit("2024-01-01").cast("date"), (order % 30).cast("int")).alias("date"),
        (order % 12).cast("int").alias("hour_start"),
        ((order % 12) * 2).cast("int").alias("hour_end"),
    )


def flawed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests, some unusable for each of the reasons there are."""
    mark = F.col("request_id") % 50
    return requests_from_orders(spark, sf_dir).withColumns(
        {
            "lat": F.when(mark == 1, 100.0).when(mark == 2, float("nan")).otherwise(F.col("lat")),
            "lon": F.when(mark == 3, 500.0).otherwise(F.col("lon")),
            "date": F.when(mark != 4, F.col("date")),
            "hour_start": F.when(mark == 0, 10.0)
            .when(mark == 5, -0.9)
            .otherwise(F.col("hour_start").cast("double")),
            "hour_end": F.when(mark == 0, 5).otherwise(F.col("hour_end")),
        }
    )


def observations_from_events(
    spark: SparkSession, sf_dir: str, family: str, product: Product | None = None
) -> DataFrame:
    """Native observations on the grid; cells and instants with errors only have no value.

    Missing values are NaN in even grid rows and NULL in odd ones.
    """
    step, divisor, base = RECIPES[family]
    product = product or catalogue()[family]
    row = F.col("user_id") % 12
    instant = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(
        hours=(F.floor(F.hour("ts") / step) * step).cast("int")
    )
    value = F.lit(base) + F.col("highest") / F.lit(divisor)
    return (
        _table(spark, sf_dir, "events")
        .groupBy(
            row.alias("grid_row"),
            F.floor(F.col("user_id") / 12).alias("grid_column"),
            instant.alias("time_utc"),
        )
        .agg(F.max(F.when(F.col("event_type") != "error", F.col("value"))).alias("highest"))
        .select(
            F.lit(product.dataset_id).alias("dataset_id"),
            F.lit(product.variable).alias("variable"),
            "time_utc",
            F.lit(None).cast("double").alias("depth_m"),
            (F.lit(LAT0) + F.col("grid_row") / F.lit(float(CELLS_PER_DEG))).alias("cell_lat"),
            (F.lit(LON0) + F.col("grid_column") / F.lit(float(CELLS_PER_DEG))).alias("cell_lon"),
            F.when(
                value.isNull() & (F.col("grid_row") % 2 == 0), F.lit(float("nan"))
            )
            .otherwise(value)
            .alias("value"),
        )
    )


def with_levels(observations: DataFrame) -> DataFrame:
    """Repeat every observation on each depth level."""
    levels = F.array(
        *[
            F.struct(F.lit(10 * k).alias("added"), F.lit(depth).alias("depth_m"))
            for k, depth in enumerate(LEVELS)
        ]
    )
    return (
        observations.drop("depth_m")
        .withColumn("level", F.explode(levels))
        .select(
            "dataset_id",
            "variable",
            "time_utc",
            "level.depth_m",
            "cell_lat",
            "cell_lon",
            (F.col("value") + F.col("level.added")).alias("value"),
        )
    )


def observations(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """The observation table of a family, with depth levels where the product has them."""
    rows = observations_from_events(spark, sf_dir, family)
    return with_levels(rows) if family in ("temperature", "salinity") else rows


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wave observations in three deliveries: all, every third day corrected, every second day withdrawn."""
    rows = observations_from_events(spark, sf_dir, "waves")
    day = F.dayofmonth("time_utc")

    def delivery(moment: str, value: Column, when: Column) -> Column:
        of = F.struct(F.lit(moment).cast("timestamp_ntz").alias("delivered_at"), value.alias("value"))
        return F.when(when, of)

    made = F.array(
        delivery("2024-02-01", F.col("value"), F.lit(True)),
        delivery("2024-02-05", F.col("value") * 1.25, day % 3 == 0),
        delivery("2024-02-09", F.lit(None).cast("double"), day % 2 == 0),
    )
    return rows.withColumn("d", F.explode(F.array_compact(made))).select(
        *[c for c in rows.columns if c != "value"], "d.value", "d.delivered_at"
    )
