"""The single decisions behind the readings, each as a DataFrame of its own.

They share the match, the filters and the orders with the readings, and serve to look into a
reading: which cells were admissible, which instants counted, what was outside the window.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seapoint.functions.geo import haversine_km
from seapoint.functions.instants import (
    as_hours,
    hours_interval,
    local_day_end,
    local_hour_window,
    to_local,
)
from seapoint.operators.latest import admissible_values, day_questions, newest_then_nearest
from seapoint.operators.series import (
    by_level_and_cell,
    by_question,
    classified,
    widened_questions,
)
from seapoint.operators.waves import admissible_heights, hour_questions
from seapoint.plans.completion import first_by, per_request
from seapoint.plans.match import match
from seapoint.sources.observations import of_product
from seapoint.sources.products import Product, products
from seapoint.sources.requests import (
    POINT_AND_DAY,
    POINT_AND_HOURS,
    as_requests,
    usage_error,
)

_CELL = ("cell_lat", "cell_lon")


# ---- requests and windows ----------------------------------------------------------------


def request_validation(requests: DataFrame) -> DataFrame:
    """Every request with ``is_valid`` and the ``reason`` it is unusable."""
    return as_requests(requests).select(
        "request_id", usage_error().isNull().alias("is_valid"), usage_error().alias("reason")
    )


def local_windows(requests: DataFrame, product: Product) -> DataFrame:
    """The local hour window in UTC, and the window widened by the offset limit."""
    start, end = local_hour_window(
        F.col("date"), F.col("hour_start"), F.col("hour_end"), product.tz
    )
    reach = hours_interval(product.max_offset_h)
    return as_requests(requests).select(
        "request_id",
        start.alias("window_start_utc"),
        end.alias("window_end_utc"),
        (start - reach).alias("query_start_utc"),
        (end + reach).alias("query_end_utc"),
    )


def lookback_windows(requests: DataFrame, product: Product) -> DataFrame:
    """End of the local day in UTC, and the start of the look-back (age limit plus margin)."""
    end = local_day_end(F.col("date"), product.tz)
    return as_requests(requests).select(
        "request_id",
        (end - hours_interval(product.max_age_h + product.margin_h)).alias("query_start_utc"),
        end.alias("query_end_utc"),
    )


# ---- observations ------------------------------------------------------------------------


def local_times(observations: DataFrame, product: Product) -> DataFrame:
    """Local wall time and local date of every observation."""
    local = to_local(F.col("time_utc"), product.tz)
    return observations.select(
        "time_utc",
        *_CELL,
        local.alias("time_local"),
        F.to_date(local).alias("local_date"),
    )


def missing_by_cell(observations: DataFrame) -> DataFrame:
    """Per cell: rows with a value, rows with NULL, rows with NaN. Reads raw values."""
    value = F.col("value")
    return observations.groupBy(*_CELL).agg(
        F.count_if(value.isNotNull() & ~F.isnan(value)).alias("n_valid"),
        F.count_if(value.isNull()).alias("n_null"),
        F.count_if(F.isnan(value)).alias("n_nan"),
    )


def rows_by_product(observations: DataFrame) -> DataFrame:
    """Row and value counts of each product, with its provenance."""
    known = products(observations.sparkSession).select(
        "dataset_id", "variable", "units", "data_scope", "rule"
    )
    counts = observations.groupBy("dataset_id", "variable").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.nanvl("value", F.lit(None).cast("double"))).alias("n_valid"),
    )
    # One row per product: the dimension cannot grow with the data.
    # Rows of other products are counted too, without provenance.
    return counts.join(F.broadcast(known), ["dataset_id", "variable"], "left")


# ---- matching and cells ------------------------------------------------------------------


def matched_rows(
    requests: DataFrame, observations: DataFrame, product: Product, matched=match
) -> DataFrame:
    """How many observations, missing ones included, each request's box and window hold.

    ``matched`` finds the pairs: ``match``, or ``match_by_tree`` for crowded archives.
    """
    requests = as_requests(requests)
    asked = hour_questions(requests, product)
    found = (
        matched(asked, of_product(observations, product), POINT_AND_HOURS)
        .groupBy(*POINT_AND_HOURS)
        .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("valid"))
    )
    return per_request(requests, asked, found, POINT_AND_HOURS).select(
        "request_id",
        F.coalesce("n", F.lit(0)).alias("n_matched"),
        F.coalesce("valid", F.lit(0)).alias("n_valid"),
    )


def candidate_cells(requests: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """Cells within the distance limit per request, ranked by distance, whatever their values."""
    requests = as_requests(requests)
    asked = widened_questions(requests, product)
    cells = (
        classified(asked, observations, product)
        .select(*POINT_AND_HOURS, *_CELL)
        .distinct()
        .withColumn(
            "distance_km",
            haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon")),
        )
        .where(F.col("distance_km") <= product.max_cell_km)
    )
    order = Window.partitionBy(*POINT_AND_HOURS).orderBy("distance_km", *_CELL)
    ranked = cells.withColumn("distance_rank", F.row_number().over(order))
    return per_request(requests, asked, ranked, POINT_AND_HOURS, "inner").select(
        "request_id", *_CELL, "distance_km", "distance_rank"
    )


def cell_distances(requests: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """Distance from each request to every cell of its box that has a row in the window."""
    requests = as_requests(requests)
    asked = hour_questions(requests, product)
    cells = (
        match(asked, of_product(observations, product), POINT_AND_HOURS)
        .select(*POINT_AND_HOURS, *_CELL)
        .distinct()
    )
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
    return (
        per_request(requests, asked, cells, POINT_AND_HOURS, "inner")
        .withColumn("distance_km", km)
        .select(
            "request_id",
            *_CELL,
            "distance_km",
            (F.col("distance_km") <= product.max_cell_km).alias("is_admissible"),
        )
    )


# ---- conservative maximum ----------------------------------------------------------------


def _question_maxima(asked: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """Per question and admissible cell: the highest valid value and its first instant."""
    maxima = first_by(
        admissible_heights(asked, observations, product),
        (*POINT_AND_HOURS, *_CELL),
        [(-F.col("value")).alias("minus_value"), F.col("time_utc"), F.col("distance_km")],
        "top",
    )
    return maxima.select(
        *POINT_AND_HOURS,
        *_CELL,
        "top.distance_km",
        (-F.col("top.minus_value")).alias("max_value"),
        F.col("top.time_utc").alias("max_time_utc"),
    )


def cell_maxima(
    requests: DataFrame, observations: DataFrame, product: Product, maxima=_question_maxima
) -> DataFrame:
    """Per request and admissible cell: the highest valid value and its first instant.

    ``maxima`` works them out per question: from the instants, or ``maxima_by_blocks``.
    """
    requests = as_requests(requests)
    asked = hour_questions(requests, product)
    found = maxima(asked, observations, product)
    return per_request(requests, asked, found, POINT_AND_HOURS, "inner").select(
        "request_id", *_CELL, "distance_km", "max_value", "max_time_utc"
    )


def ranked_maxima(requests: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """The admissible cells of each request, ranked as the conservative rule ranks them.

    The ranking is the question's, so it is worked out before it is handed to the requests.
    """
    requests = as_requests(requests)
    asked = hour_questions(requests, product)
    order = Window.partitionBy(*POINT_AND_HOURS).orderBy(
        F.col("max_value").desc(), "distance_km", *_CELL
    )
    ranked = _question_maxima(asked, observations, product).withColumn(
        "cell_rank", F.row_number().over(order)
    )
    return per_request(requests, asked, ranked, POINT_AND_HOURS, "inner").select(
        "request_id", *_CELL, "distance_km", "max_value", "max_time_utc", "cell_rank"
    )


# ---- coverage, then nearby time ----------------------------------------------------------


def surface_levels(requests: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """The shallowest level among all rows of the box and the widened window."""
    requests = as_requests(requests)
    asked = widened_questions(requests, product)
    levels = (
        classified(asked, observations, product)
        .groupBy(*POINT_AND_HOURS)
        .agg(F.min("depth_m").alias("depth_m_actual"))
    )
    return per_request(requests, asked, levels, POINT_AND_HOURS).select(
        "request_id", "depth_m_actual"
    )


def instants_by_window(requests: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """Distinct native instants inside the window, and outside it within the offset limit."""
    requests = as_requests(requests)
    asked = widened_questions(requests, product)
    counts = (
        classified(asked, observations, product)
        .groupBy(*POINT_AND_HOURS, "time_utc")
        .agg(F.first("is_inside").alias("is_inside"), F.first("offset").alias("offset"))
        .groupBy(*POINT_AND_HOURS)
        .agg(
            F.count_if("is_inside").alias("n_in"),
            F.count_if(~F.col("is_inside")).alias("n_out"),
            as_hours(F.max("offset")).alias("max_offset_hours"),
        )
    )
    return per_request(requests, asked, counts, POINT_AND_HOURS).select(
        "request_id",
        F.coalesce("n_in", F.lit(0)).alias("n_in"),
        F.coalesce("n_out", F.lit(0)).alias("n_out"),
        "max_offset_hours",
    )


def _question_answers(asked: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    return by_question(by_level_and_cell(classified(asked, observations, product), product))


def _answers(
    requests: DataFrame, observations: DataFrame, product: Product, answers: Callable
) -> DataFrame:
    asked = widened_questions(requests, product)
    found = answers(asked, observations, product)
    return per_request(requests, asked, found, POINT_AND_HOURS, "inner")


def best_covered_cell(
    requests: DataFrame, observations: DataFrame, product: Product, answers=_question_answers
) -> DataFrame:
    """The cell with most valid in-window instants (then nearest), where a request has one.

    ``answers`` works it out per question: from the pairs, or ``answers_by_scan``.
    """
    return (
        _answers(as_requests(requests), observations, product, answers)
        .where(~F.col("inside.is_void"))
        .select(
            "request_id",
            "inside.cell_lat",
            "inside.cell_lon",
            "inside.distance_km",
            (-F.col("inside.minus_count")).cast("bigint").alias("n_valid"),
        )
    )


def nearest_outside(
    requests: DataFrame, observations: DataFrame, product: Product, answers=_question_answers
) -> DataFrame:
    """The valid sample outside the window with the smallest offset, where a request has one.

    ``answers`` works it out per question: from the pairs, or ``answers_by_scan``.
    """
    return (
        _answers(as_requests(requests), observations, product, answers)
        .where(~F.col("outside.is_void"))
        .select(
            "request_id",
            "outside.time_utc",
            as_hours(F.col("outside.offset")).alias("temporal_offset_hours"),
            "outside.cell_lat",
            "outside.cell_lon",
            "outside.distance_km",
            "outside.value",
        )
    )


# ---- latest, then nearest ----------------------------------------------------------------


def nearest_cells(requests: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """Per request and instant within the age limit: the nearest valid cell."""
    requests = as_requests(requests)
    asked = day_questions(requests, product)
    nearest = newest_then_nearest(
        admissible_values(asked, observations, product), (*POINT_AND_DAY, "time_utc")
    ).drop("time_utc")
    return per_request(requests, asked, nearest, POINT_AND_DAY, "inner").select(
        "request_id",
        "top.time_utc",
        "top.cell_lat",
        "top.cell_lon",
        "top.distance_km",
        "top.value",
    )


def latest_instants(
    requests: DataFrame, observations: DataFrame, product: Product, values=admissible_values
) -> DataFrame:
    """The newest instant per request that has an admissible cell, and its age.

    ``values`` gives the values to choose from: ``admissible_values``, or ``latest_by_scan``.
    """
    requests = as_requests(requests)
    asked = day_questions(requests, product)
    newest = (
        values(asked, observations, product)
        .groupBy(*POINT_AND_DAY)
        .agg(F.min("age").alias("age"), F.max("time_utc").alias("time_utc"))
    )
    return per_request(requests, asked, newest, POINT_AND_DAY, "inner").select(
        "request_id", "time_utc", as_hours(F.col("age")).alias("temporal_age_hours")
    )


# ---- summary -----------------------------------------------------------------------------


def count_statuses(readings: dict[str, DataFrame]) -> DataFrame:
    """Number of readings per family and status."""
    counted = None
    for family, rows in readings.items():
        part = (
            rows.groupBy("status")
            .agg(F.count(F.lit(1)).alias("n_readings"))
            .select(F.lit(family).alias("family"), "status", "n_readings")
        )
        counted = part if counted is None else counted.unionByName(part)
    return counted
