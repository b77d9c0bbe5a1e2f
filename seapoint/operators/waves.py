"""Wave height: the conservative maximum, and the safety gate built on it.

Among the admissible cells the one with the highest value in the window wins, not the nearest;
ties go to the nearer cell, then the smaller latitude, then the smaller longitude. The row that
comes first in the order (highest value, distance, latitude, longitude, time) is that cell's row
at the first instant of its maximum, so one aggregate finds cell, value and instant together.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.functions.geo import haversine_km
from seapoint.functions.instants import local_hour_window, to_local
from seapoint.functions.readings import kill_switch, wave_status
from seapoint.plans.completion import first_by, per_request
from seapoint.plans.match import match
from seapoint.schemas import WAVE_MEASUREMENTS, WAVE_READINGS
from seapoint.sources.observations import of_product
from seapoint.sources.products import WAVES, Product
from seapoint.sources.requests import POINT_AND_HOURS, checked_requests, questions


def admissible_heights(asked: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """Valid in-window values within the distance limit, one row per question and observation."""
    valid = of_product(observations, product).where(F.col("value").isNotNull())
    return (
        match(asked, valid, POINT_AND_HOURS)
        .withColumn(
            "distance_km",
            haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon")),
        )
        .where(F.col("distance_km") <= product.max_cell_km)
    )


def hour_questions(requests: DataFrame, product: Product) -> DataFrame:
    """The distinct questions, to be searched in their local hour window."""
    window = local_hour_window(
        F.col("date"), F.col("hour_start"), F.col("hour_end"), product.tz
    )
    return questions(requests, POINT_AND_HOURS, *window)


def _highest(requests: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """Every request with the struct ``top`` of its winning row, or NULL."""
    asked = hour_questions(requests, product)
    top = first_by(
        admissible_heights(asked, observations, product),
        POINT_AND_HOURS,
        [
            (-F.col("value")).alias("minus_value"),
            F.col("distance_km"),
            F.col("cell_lat"),
            F.col("cell_lon"),
            F.col("time_utc"),
        ],
        "top",
    )
    return per_request(requests, asked, top, POINT_AND_HOURS)


def wave_measurement(
    requests: DataFrame,
    observations: DataFrame,
    product: Product = WAVES,
    on_invalid: str = "raise",
    check_point: bool = False,
) -> DataFrame:
    """Highest in-window value per request with its instant, cell and distance; NULL without one."""
    usable = checked_requests(requests, hours=True, point=check_point, on_invalid=on_invalid)
    return _highest(usable, observations, product).select(
        "request_id",
        (-F.col("top.minus_value")).alias("value_m"),
        "top.time_utc",
        "top.cell_lat",
        "top.cell_lon",
        "top.distance_km",
    ).to(WAVE_MEASUREMENTS)


def wave_gate(
    requests: DataFrame,
    observations: DataFrame,
    product: Product = WAVES,
    on_invalid: str = "raise",
    check_point: bool = False,
) -> DataFrame:
    """One wave reading per request, with status and kill switch.

    A switch that is off authorises nothing: the limits are provisional and the waves regional.
    """
    usable = checked_requests(requests, hours=True, point=check_point, on_invalid=on_invalid)
    readings = _highest(usable, observations, product).select(
        "request_id",
        "lat",
        "lon",
        "date",
        (-F.col("top.minus_value")).alias("significant_wave_height_m"),
        F.col("top.time_utc").alias("max_time_utc"),
        to_local(F.col("top.time_utc"), product.tz).alias("max_time_local"),
        "top.cell_lat",
        "top.cell_lon",
        "top.distance_km",
        *product.provenance("dataset_id", "variable", "data_scope", "scope_warning"),
        wave_status(-F.col("top.minus_value"), product.threshold).alias("status"),
    )
    return with_kill_switch(readings).to(WAVE_READINGS)


def with_kill_switch(readings: DataFrame) -> DataFrame:
    """Add ``kill_switch``: TRUE over the threshold and TRUE without data."""
    return readings.withColumn("kill_switch", kill_switch(F.col("status")))
