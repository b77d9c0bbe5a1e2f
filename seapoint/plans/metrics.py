"""Figures that come with a job: rejected requests by reason, readings by status.

They are gathered while the rows pass (``DataFrame.observe``), so no second scan is made for them. They are there
once an action on the returned rows is through, for all rows that it read: a ``limit`` on top stops them short,
and tasks that are run again may be counted again. They are for monitoring; ``request_validation``
and ``count_statuses`` count exactly, as queries.
"""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seapoint.functions.readings import NO_DATA
from seapoint.sources.requests import as_requests, usage_error

REASONS = ("date", "hours", "lat", "lon")


def observed_requests(rows: DataFrame, hours: bool = True, point: bool = True) -> tuple[DataFrame, Observation]:
    """Usable requests, and ``requests`` with ``rejected_<reason>`` for each reason."""
    reason = F.col("reason")
    seen = Observation()
    judged = as_requests(rows).withColumn("reason", usage_error(hours, point))
    counted = judged.observe(
        seen,
        F.count(F.lit(1)).alias("requests"),
        *[F.count_if(F.coalesce(reason == name, F.lit(False))).alias(f"rejected_{name}") for name in REASONS],
    )
    return counted.where(reason.isNull()).drop("reason"), seen


def observed_readings(readings: DataFrame) -> tuple[DataFrame, Observation]:
    """The readings as they are, and ``readings`` with ``no_data``, the number of those without data."""
    seen = Observation()
    counted = readings.observe(
        seen,
        F.count(F.lit(1)).alias("readings"),
        F.count_if(F.col("status") == NO_DATA).alias("no_data"),
    )
    return counted, seen
