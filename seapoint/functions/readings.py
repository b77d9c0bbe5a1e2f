"""Missing values, statuses and coverage figures of a reading."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed status domains, one per family.
NO_DATA = "sin_datos"
WAVE_BELOW = "bajo_umbral_regional"
WAVE_ABOVE = "sobre_umbral_regional"
SERIES_IN_WINDOW = "valida_en_ventana"
SERIES_NEARBY = "valida_cercana_en_tiempo"
LATEST_SAME_DATE = "valida_en_fecha_local"
LATEST_RECENT = "valida_reciente"

WAVE_STATUSES = (WAVE_BELOW, WAVE_ABOVE, NO_DATA)
SERIES_STATUSES = (SERIES_IN_WINDOW, SERIES_NEARBY, NO_DATA)
LATEST_STATUSES = (LATEST_SAME_DATE, LATEST_RECENT, NO_DATA)


def native_value(value: Column) -> Column:
    """NaN and NULL both become NULL; every other value stays as delivered."""
    return F.nanvl(value, F.lit(None).cast("double"))


def wave_status(height_m: Column, threshold_m: float) -> Column:
    return (
        F.when(height_m.isNull(), NO_DATA)
        .when(height_m >= F.lit(threshold_m), WAVE_ABOVE)
        .otherwise(WAVE_BELOW)
    )


def kill_switch(status: Column) -> Column:
    """TRUE blocks. No data, an unknown status and a missing one block too: fail safe."""
    return ~F.coalesce(status == WAVE_BELOW, F.lit(False))


def series_status(has_inside: Column, has_nearby: Column) -> Column:
    return (
        F.when(has_inside, SERIES_IN_WINDOW).when(has_nearby, SERIES_NEARBY).otherwise(NO_DATA)
    )


def latest_status(same_local_date: Column) -> Column:
    return (
        F.when(same_local_date.isNull(), NO_DATA)
        .when(same_local_date, LATEST_SAME_DATE)
        .otherwise(LATEST_RECENT)
    )


def coverage_fraction(n_covered: Column, n_native: Column) -> Column:
    """Covered share of the native instants; NULL where the window holds none."""
    return F.when(n_native > 0, n_covered / n_native)
