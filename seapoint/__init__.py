"""seapoint: many point lookups at once against gridded ocean products, on Spark."""

from seapoint.operators.latest import chlorophyll_latest, latest_reading
from seapoint.operators.series import (
    salinity_series,
    sst_full_day,
    surface_series,
    temperature_series,
)
from seapoint.operators.waves import wave_gate, wave_measurement, with_kill_switch
from seapoint.session import session
from seapoint.sources.deliveries import as_known, deliver_observations, read_deliveries
from seapoint.sources.observations import (
    as_observations,
    cube_to_rows,
    land_observations,
    read_observations,
    redeliver_observations,
    subset,
    unique_coordinates,
)
from seapoint.sources.products import (
    CHLOROPHYLL,
    SALINITY,
    TEMPERATURE,
    WAVES,
    Product,
    catalogue,
    products,
)
from seapoint.sources.requests import as_requests, request_extent, split_requests

__all__ = [
    "CHLOROPHYLL",
    "SALINITY",
    "TEMPERATURE",
    "WAVES",
    "Product",
    "as_known",
    "as_observations",
    "as_requests",
    "catalogue",
    "chlorophyll_latest",
    "cube_to_rows",
    "deliver_observations",
    "land_observations",
    "latest_reading",
    "products",
    "read_deliveries",
    "read_observations",
    "redeliver_observations",
    "request_extent",
    "salinity_series",
    "session",
    "split_requests",
    "sst_full_day",
    "subset",
    "surface_series",
    "temperature_series",
    "unique_coordinates",
    "wave_gate",
    "wave_measurement",
    "with_kill_switch",
]
