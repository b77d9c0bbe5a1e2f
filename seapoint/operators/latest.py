"""Chlorophyll: the latest admissible instant, then its nearest valid cell.

The reference time is the end of the requested local day. Later instants never count, and
instants older than the age limit do not either. Among the rest, the newest one that HAS a valid
cell within the distance limit wins.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.functions.geo import haversine_km
from seapoint.functions.instants import as_hours, hours_interval, local_day_end, to_local
from seapoint.functions.readings import latest_status
from seapoint.operators.scan import latest_by_scan
from seapoint.plans.completion import first_by, per_request
from seapoint.plans.match import match
from seapoint.schemas import CHLOROPHYLL_READINGS
from seapoint.sources.observations import of_product
from seapoint.sources.products import CHLOROPHYLL, Product
from seapoint.sources.requests import POINT_AND_DAY, checked_requests, questions


def day_questions(requests: DataFrame, product: Product) -> DataFrame:
    """The distinct questions, to be searched from the end of the local day back to the age limit.

    The look-back window of the product is longer by a margin. What lies in that margin is too
    old to be used, so the search does not reach into it.
    """
    end = local_day_end(F.col("date"), product.tz)
    return questions(requests, POINT_AND_DAY, end - hours_interval(product.max_age_h), end)


def admissible_values(asked: DataFrame, observations: DataFrame, product: Product) -> DataFrame:
    """Valid values within the distance and age limits, with their ``age``."""
    valid = of_product(observations, product).where(F.col("value").isNotNull())
    return (
        match(asked, valid, POINT_AND_DAY)
        .withColumn("age", F.col("last_utc") - F.col("time_utc"))
        .withColumn(
            "distance_km",
            haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon")),
        )
        .where(F.col("distance_km") <= product.max_cell_km)
    )


def newest_then_nearest(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per group the newest instant, then its nearest cell (ties: latitude, longitude)."""
    return first_by(
        values,
        keys,
        [F.col(c) for c in ("age", "distance_km", "cell_lat", "cell_lon", "value", "time_utc")],
        "top",
    )


def latest_reading(
    requests: DataFrame,
    observations: DataFrame,
    product: Product = CHLOROPHYLL,
    on_invalid: str = "raise",
    by_scan: bool = False,
) -> DataFrame:
    """One latest-value reading per request; ``by_scan`` sorts values and questions of a cell together
    and pairs no question with an instant, which pays where cells have many instants within the age limit.
    """
    usable = checked_requests(requests, hours=False, point=True, on_invalid=on_invalid)
    asked = day_questions(usable, product)
    values = (latest_by_scan if by_scan else admissible_values)(asked, observations, product)
    top = newest_then_nearest(values, POINT_AND_DAY)
    time_local = to_local(F.col("top.time_utc"), product.tz)
    same_date = F.to_date(time_local) == F.col("date")
    return per_request(usable, asked, top, POINT_AND_DAY).select(
        "request_id",
        "lat",
        "lon",
        "date",
        F.col("top.value").alias("value_mg_m3"),
        "top.time_utc",
        time_local.alias("time_local"),
        as_hours(F.col("top.age")).alias("temporal_age_hours"),
        same_date.alias("inside_requested_local_date"),
        "top.cell_lat",
        "top.cell_lon",
        "top.distance_km",
        *product.provenance("dataset_id", "variable", "units", "data_scope", "scope_warning"),
        latest_status(same_date).alias("status"),
    ).to(CHLOROPHYLL_READINGS)


def chlorophyll_latest(
    requests: DataFrame,
    observations: DataFrame,
    product: Product = CHLOROPHYLL,
    on_invalid: str = "raise",
    by_scan: bool = False,
) -> DataFrame:
    """Latest chlorophyll reading per request."""
    return latest_reading(requests, observations, product, on_invalid, by_scan)
