"""Request tables: defaults, usage checks and the distinct questions behind the requests."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seapoint.schemas import REQUESTS

FIRST_HOUR, LAST_HOUR = 0, 23
NO_HOUR = -1

POINT_AND_DAY = ("lat", "lon", "date")
POINT_AND_HOURS = ("lat", "lon", "date", "hour_start", "hour_end")


def as_requests(rows: DataFrame) -> DataFrame:
    """Bring a table to the request layout; absent or NULL hours mean the whole local day.

    Hours that are not whole are kept as ``NO_HOUR``, so that they are rejected and not cut off.

    Latitude and longitude must be numeric and the date a DATE. A text or boolean column there
    is a usage error of the whole table, so it raises at once.
    """
    types = {field.name: field.dataType for field in rows.schema}
    for name in ("lat", "lon"):
        if not isinstance(types[name], T.NumericType):
            raise ValueError(f"{name} must be numeric, not {types[name].simpleString()}")
    if not isinstance(types["date"], T.DateType):
        raise ValueError(f"date must be a DATE, not {types['date'].simpleString()}")

    def hour(name: str, default: int) -> Column:
        if name not in types:
            return F.lit(default).alias(name)
        if isinstance(types[name], (T.ByteType, T.ShortType, T.IntegerType)):
            return F.coalesce(F.col(name).cast("int"), F.lit(default)).alias(name)
        # What is no whole hour, or beyond an INT, becomes an hour that the check turns away.
        given = F.col(name).try_cast("double")
        whole = F.coalesce((given == F.floor(given)) & given.between(-(2.0**31), 2.0**31 - 1), F.lit(False))
        return (
            F.when(F.col(name).isNull(), F.lit(default)).when(whole, given.cast("int")).otherwise(F.lit(NO_HOUR)).alias(name)
        )

    return rows.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
        "date",
        hour("hour_start", FIRST_HOUR),
        hour("hour_end", LAST_HOUR),
    ).to(REQUESTS)


def _within(value: Column, limit: float) -> Column:
    # NaN sorts above every number in Spark, so the closed range turns it away as well.
    return F.coalesce(value.between(-limit, limit), F.lit(False))


def usage_error(hours: bool = True, point: bool = True) -> Column:
    """Why a request is unusable, or NULL. A date is always needed."""
    reason = F.when(F.col("date").isNull(), "date")
    if hours:
        ordered = (
            (F.col("hour_start") >= FIRST_HOUR)
            & (F.col("hour_start") <= F.col("hour_end"))
            & (F.col("hour_end") <= LAST_HOUR)
        )
        reason = reason.when(~F.coalesce(ordered, F.lit(False)), "hours")
    if point:
        reason = reason.when(~_within(F.col("lat"), 90.0), "lat")
        reason = reason.when(~_within(F.col("lon"), 180.0), "lon")
    return reason


def split_requests(
    rows: DataFrame, hours: bool = True, point: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Usable requests, and the rejected ones with their ``reason``."""
    judged = as_requests(rows).withColumn("reason", usage_error(hours, point))
    return (
        judged.where(F.col("reason").isNull()).drop("reason"),
        judged.where(F.col("reason").isNotNull()),
    )


def checked_requests(
    rows: DataFrame, hours: bool, point: bool, on_invalid: str = "raise"
) -> DataFrame:
    """Usable requests only. An unusable one fails the job, or is left out with ``"exclude"``.

    Either way it never becomes a no-data reading.
    """
    if on_invalid == "exclude":
        return split_requests(rows, hours, point)[0]
    if on_invalid != "raise":
        raise ValueError(f"on_invalid must be 'raise' or 'exclude', not {on_invalid!r}")
    reason = usage_error(hours, point)
    complaint = F.concat(
        F.lit("unusable request "), F.col("request_id").cast("string"), F.lit(": "), reason
    )
    return as_requests(rows).where(
        F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
    )


def questions(
    requests: DataFrame, keys: tuple[str, ...], first: Column, last: Column
) -> DataFrame:
    """The distinct questions asked: their ``keys``, the time range to search, ``n_copies``.

    Copies collapse before the first shuffle, so a question that a third of all requests repeat
    is matched once. ``first`` and ``last`` are worked out here, once per question, as
    ``first_utc`` and ``last_utc``.

    The plan below the questions is the same wherever they are used, so Spark runs their shuffle
    once and reuses it. For that, points and dates that cannot match are left out explicitly (not
    only where a join would infer it), the range is marked as never NULL (else the zone
    conversion would be pushed down to every single request), and ``n_copies`` is always needed.
    """
    never = F.lit("1970-01-01").cast("timestamp_ntz")
    return (
        requests.where(
            F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("date").isNotNull()
        )
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_copies"))
        .withColumns(
            {"first_utc": F.coalesce(first, never), "last_utc": F.coalesce(last, never)}
        )
        .where(F.col("n_copies") > 0)
    )


def request_extent(rows: DataFrame) -> dict:
    """Outer bounds of a request table (six numbers) for ``read_observations``. Runs a job."""
    return (
        as_requests(rows)
        .agg(
            F.min("lat").alias("min_lat"),
            F.max("lat").alias("max_lat"),
            F.min("lon").alias("min_lon"),
            F.max("lon").alias("max_lon"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
        .first()
        .asDict()
    )
