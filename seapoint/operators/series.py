"""Temperature and salinity: the best covered cell in the window, else one nearby instant.

Rules, per question:
  * the level is the shallowest one among ALL returned rows, valid or not, near or far;
  * native instants in the window are counted over all returned rows, valid or not;
  * the series comes from ONE cell: most valid instants in the window, then the nearest;
  * without any, one valid instant outside the window, at most the offset limit away: smallest
    offset, before rather than after, then the nearest cell.

All of it comes from one match and four aggregates. The first two fold depth levels, the next the
rows of a question by level and cell: that is at most the instants of a day and a few hours. The
third picks among the cells of one box by struct minimum, with the level in front, so that only the shallowest level
can win, and "nothing usable here" right behind it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seapoint.functions.geo import haversine_km
from seapoint.functions.instants import (
    as_hours,
    hours_interval,
    local_hour_window,
    time_outside,
    to_local,
)
from seapoint.functions.readings import coverage_fraction, series_status
from seapoint.plans.completion import per_request
from seapoint.plans.match import JOIN_KEYS, match
from seapoint.schemas import series_readings
from seapoint.sources.observations import of_product
from seapoint.sources.products import DEPTH_REQUESTED_M, SALINITY, TEMPERATURE, Product
from seapoint.sources.requests import POINT_AND_HOURS, checked_requests, questions


def window_of(product: Product) -> tuple[Column, Column]:
    return local_hour_window(F.col("date"), F.col("hour_start"), F.col("hour_end"), product.tz)


def widened_questions(requests: DataFrame, product: Product) -> DataFrame:
    """The distinct questions, to be searched in their window widened by the offset limit."""
    start, end = window_of(product)
    reach = hours_interval(product.max_offset_h)
    return questions(requests, POINT_AND_HOURS, start - reach, end + reach)


def classified(asked: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """All rows of the widened window, missing ones too, with ``offset`` and ``is_inside``.

    Levels are folded first: per question, cell and instant only the shallowest can ever be used
    (a row on the level that wins has no level above it), and the instant itself stays. The
    grouping names the join keys as well, which changes no group but lets Spark do it inside
    the partitions of a shuffled match, without another shuffle.
    """
    reach = hours_interval(product.max_offset_h)
    start, end = F.col("first_utc") + reach, F.col("last_utc") - reach
    instant = (*JOIN_KEYS, *POINT_AND_HOURS, "first_utc", "last_utc", "time_utc", "cell_lat", "cell_lon")
    # The smaller of two values on one coordinate first: then a level has one value, and plain
    # numbers are all that either buffer holds, so both steps are hash aggregates.
    shallowest = (
        match(asked, of_product(observations, product), POINT_AND_HOURS)
        .groupBy(*instant, "depth_m")
        .agg(F.min("value").alias("value"))
        .groupBy(*instant)
        .agg(F.min_by("value", "depth_m").alias("value"), F.min("depth_m").alias("depth_m"))
    )
    return (
        shallowest.withColumn("offset", time_outside(F.col("time_utc"), start, end))
        .withColumn("is_inside", F.col("time_utc").between(start, end))
        .withColumn("is_after", F.col("time_utc") > end)
    )


def by_level_and_cell(rows: DataFrame, product: Product) -> DataFrame:
    """Per question, level and cell: native instants, valid samples, best instant outside."""
    is_valid = F.col("value").isNotNull()
    return (
        rows.groupBy(*POINT_AND_HOURS, "depth_m", "cell_lat", "cell_lon")
        .agg(
            F.collect_set(F.when(F.col("is_inside"), F.struct("time_utc", "value"))).alias("native"),
            F.min(
                F.when(
                    ~F.col("is_inside") & is_valid,
                    F.struct("offset", "is_after", "time_utc", "value"),
                )
            ).alias("outside"),
        )
        .withColumn("samples", F.filter("native", lambda s: s["value"].isNotNull()))
        .withColumn(
            "distance_km",
            haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon")),
        )
        .withColumn("is_near", F.col("distance_km") <= product.max_cell_km)
    )


def by_question(cells: DataFrame) -> DataFrame:
    """Per question: number of native instants, the winning cell inside, the winner outside."""
    inside = F.struct(
        "depth_m",
        (~F.col("is_near") | (F.size("samples") == 0)).alias("is_void"),
        (-F.size("samples")).alias("minus_count"),
        "distance_km",
        "cell_lat",
        "cell_lon",
        "samples",
    )
    outside = F.struct(
        "depth_m",
        (~F.col("is_near") | F.col("outside").isNull()).alias("is_void"),
        F.col("outside.offset").alias("offset"),
        F.col("outside.is_after").alias("is_after"),
        F.col("outside.time_utc").alias("time_utc"),
        "distance_km",
        "cell_lat",
        "cell_lon",
        F.col("outside.value").alias("value"),
    )
    instants = F.collect_list(F.transform("native", lambda s: s["time_utc"]))
    return cells.groupBy(*POINT_AND_HOURS).agg(
        F.size(F.array_distinct(F.flatten(instants))).cast("bigint").alias("n_native"),
        F.min(inside).alias("inside"),
        F.min(outside).alias("outside"),
    )


def surface_series(
    requests: DataFrame,
    observations: DataFrame,
    product: Product,
    on_invalid: str = "raise",
    check_point: bool = False,
) -> DataFrame:
    """One series reading per request, for any product of this rule."""
    usable = checked_requests(requests, hours=True, point=check_point, on_invalid=on_invalid)
    asked = widened_questions(usable, product)
    answers = by_question(by_level_and_cell(classified(asked, observations, product), product))
    start, end = window_of(product)

    has_inside = F.coalesce(~F.col("inside.is_void"), F.lit(False))
    has_nearby = ~has_inside & F.coalesce(~F.col("outside.is_void"), F.lit(False))

    def chosen(field: str) -> Column:
        return (
            F.when(has_inside, F.col(f"inside.{field}"))
            .when(has_nearby, F.col(f"outside.{field}"))
            .alias("depth_m_actual" if field == "depth_m" else field)
        )

    def sample(time_utc: Column, value: Column, inside: bool, offset_hours: Column) -> Column:
        return F.struct(
            time_utc.alias("time_utc"),
            to_local(time_utc, product.tz).alias("time_local"),
            value.alias(product.value_name),
            F.lit(inside).alias("inside_requested_window"),
            offset_hours.alias("temporal_offset_hours"),
        )

    series = F.transform(
        F.array_sort("inside.samples"),
        lambda s: sample(s["time_utc"], s["value"], True, F.lit(0.0)),
    )
    single = F.array(
        sample(
            F.col("outside.time_utc"), F.col("outside.value"), False, as_hours(F.col("outside.offset"))
        )
    )
    n_native = F.coalesce(F.col("n_native"), F.lit(0).cast("bigint"))
    n_covered = F.when(has_inside, -F.col("inside.minus_count")).otherwise(0)
    names = ["dataset_id", "variable", "units", "data_scope", "scope_warning"]
    if product.units is None:
        names.remove("units")

    return per_request(usable, asked, answers, POINT_AND_HOURS).select(
        "request_id",
        "lat",
        "lon",
        "date",
        F.col("hour_start").alias("hour_start_local"),
        F.col("hour_end").alias("hour_end_local"),
        start.alias("window_start_utc"),
        end.alias("window_end_utc"),
        F.when(has_inside, series).when(has_nearby, single).otherwise(F.array()).alias("samples"),
        n_native.alias("n_native_times_in_window"),
        F.when(has_nearby, 1).otherwise(n_covered).cast("bigint").alias("n_samples"),
        (n_native - n_covered).alias("n_missing_samples"),
        coverage_fraction(n_covered, n_native).alias("coverage_fraction"),
        F.lit(DEPTH_REQUESTED_M).alias("depth_m_requested"),
        chosen("depth_m"),
        chosen("cell_lat"),
        chosen("cell_lon"),
        chosen("distance_km"),
        *product.provenance(*names),
        series_status(has_inside, has_nearby).alias("status"),
    ).to(series_readings(product.value_name, product.units is not None))


def temperature_series(
    requests: DataFrame,
    observations: DataFrame,
    product: Product = TEMPERATURE,
    on_invalid: str = "raise",
    check_point: bool = False,
) -> DataFrame:
    """Temperature reading per request, for its local hour range."""
    return surface_series(requests, observations, product, on_invalid, check_point)


def sst_full_day(
    requests: DataFrame,
    observations: DataFrame,
    product: Product = TEMPERATURE,
    on_invalid: str = "raise",
    check_point: bool = False,
) -> DataFrame:
    """Surface temperature per request; requests without hours cover their whole local day."""
    return temperature_series(requests, observations, product, on_invalid, check_point)


def salinity_series(
    requests: DataFrame,
    observations: DataFrame,
    product: Product = SALINITY,
    on_invalid: str = "raise",
    check_point: bool = False,
) -> DataFrame:
    """Salinity reading per request, in the native unit, for its local hour range."""
    return surface_series(requests, observations, product, on_invalid, check_point)
