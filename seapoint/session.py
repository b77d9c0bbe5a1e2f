"""A session with the settings the plans count on. Any other session works as well."""

from pyspark.sql import SparkSession


def session(app: str = "seapoint", master: str | None = None, **settings) -> SparkSession:
    """Adaptive execution (coalescing, skewed joins, broadcast by measured size), UTC."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A grouping that stays within the partitions of a match must not keep a skewed one whole.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # A question row fans out over its tiles and dates and over their observations, so
        # shuffled questions must not be gathered into few tasks because they look small.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        # Plans are built from many small expressions; no call site is recorded for each.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
