"""Table layouts of the public contract."""

from pyspark.sql import types as T

OBSERVATIONS = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("time_utc", T.TimestampNTZType()),
        T.StructField("depth_m", T.DoubleType()),
        T.StructField("cell_lat", T.DoubleType()),
        T.StructField("cell_lon", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# As stored: with the join keys, the last two being the partition columns.
STORED_OBSERVATIONS = T.StructType(
    [f for f in OBSERVATIONS if f.name != "dataset_id"]
    + [
        T.StructField("tile_lat", T.LongType()),
        T.StructField("tile_lon", T.LongType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("obs_date", T.DateType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("date", T.DateType()),
        T.StructField("hour_start", T.IntegerType()),
        T.StructField("hour_end", T.IntegerType()),
    ]
)

_PROVENANCE = [
    T.StructField("dataset_id", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("data_scope", T.StringType()),
    T.StructField("scope_warning", T.StringType()),
    T.StructField("status", T.StringType()),
]
_PROVENANCE_WITH_UNITS = _PROVENANCE[:2] + [T.StructField("units", T.StringType())] + _PROVENANCE[2:]
_POINT = list(REQUESTS.fields[:4])
_CELL = [
    T.StructField("cell_lat", T.DoubleType()),
    T.StructField("cell_lon", T.DoubleType()),
    T.StructField("distance_km", T.DoubleType()),
]

WAVE_MEASUREMENTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("value_m", T.DoubleType()),
        T.StructField("time_utc", T.TimestampNTZType()),
    ]
    + _CELL
)

WAVE_READINGS = T.StructType(
    _POINT
    + [
        T.StructField("significant_wave_height_m", T.DoubleType()),
        T.StructField("max_time_utc", T.TimestampNTZType()),
        T.StructField("max_time_local", T.TimestampNTZType()),
    ]
    + _CELL
    + _PROVENANCE
    + [T.StructField("kill_switch", T.BooleanType())]
)


def series_readings(value_name: str, with_units: bool) -> T.StructType:
    """Layout of a temperature or salinity reading."""
    sample = T.StructType(
        [
            T.StructField("time_utc", T.TimestampNTZType()),
            T.StructField("time_local", T.TimestampNTZType()),
            T.StructField(value_name, T.DoubleType()),
            T.StructField("inside_requested_window", T.BooleanType()),
            T.StructField("temporal_offset_hours", T.DoubleType()),
        ]
    )
    return T.StructType(
        _POINT
        + [
            T.StructField("hour_start_local", T.IntegerType()),
            T.StructField("hour_end_local", T.IntegerType()),
            T.StructField("window_start_utc", T.TimestampNTZType()),
            T.StructField("window_end_utc", T.TimestampNTZType()),
            T.StructField("samples", T.ArrayType(sample)),
            T.StructField("n_native_times_in_window", T.LongType()),
            T.StructField("n_samples", T.LongType()),
            T.StructField("n_missing_samples", T.LongType()),
            T.StructField("coverage_fraction", T.DoubleType()),
            T.StructField("depth_m_requested", T.DoubleType()),
            T.StructField("depth_m_actual", T.DoubleType()),
        ]
        + _CELL
        + (_PROVENANCE_WITH_UNITS if with_units else _PROVENANCE)
    )


TEMPERATURE_READINGS = series_readings("value_celsius", with_units=False)
SALINITY_READINGS = series_readings("value_salinity", with_units=True)

CHLOROPHYLL_READINGS = T.StructType(
    _POINT
    + [
        T.StructField("value_mg_m3", T.DoubleType()),
        T.StructField("time_utc", T.TimestampNTZType()),
        T.StructField("time_local", T.TimestampNTZType()),
        T.StructField("temporal_age_hours", T.DoubleType()),
        T.StructField("inside_requested_local_date", T.BooleanType()),
    ]
    + _CELL
    + _PROVENANCE_WITH_UNITS
)

PRODUCTS = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("units", T.StringType()),
        T.StructField("standard_name", T.StringType()),
        T.StructField("data_scope", T.StringType()),
        T.StructField("scope_warning", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("max_cell_km", T.DoubleType()),
        T.StructField("max_offset_h", T.DoubleType()),
        T.StructField("max_age_h", T.DoubleType()),
        T.StructField("margin_h", T.DoubleType()),
        T.StructField("max_depth_m", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("tz", T.StringType()),
    ]
)
