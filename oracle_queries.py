"""The same results as plain SQL for DuckDB, written without tiles, parts or shared questions.

Every query starts from the given tables. A request is compared with an observation by its box
and its time range directly; windows use the fixed distance of five hours between local time
and UTC.
"""

from seapoint.sources.products import catalogue

REQUESTS = """
requests AS (
  SELECT o_orderkey AS request_id,
    CAST(-13.0 AS DOUBLE) + (o_custkey % 12) / CAST(12 AS DOUBLE)
      + ((o_orderkey % 9) - 4) * CAST(0.01 AS DOUBLE) AS lat,
    CAST(-77.5 AS DOUBLE) + CAST(floor((o_custkey % 150) / 12) AS BIGINT) / CAST(12 AS DOUBLE)
      + ((o_orderkey % 7) - 3) * CAST(0.012 AS DOUBLE) AS lon,
    CAST(CAST('2024-01-01' AS DATE) + CAST(o_orderkey % 30 AS INT) AS DATE) AS date,
    CAST(o_orderkey % 12 AS INT) AS hour_start,
    CAST((o_orderkey % 12) * 2 AS INT) AS hour_end
  FROM orders)"""

WINDOWS = """
windows AS (
  SELECT *, CAST(date AS TIMESTAMP) + INTERVAL 1 HOUR * (hour_start + 5) AS w0,
    CAST(date AS TIMESTAMP) + INTERVAL 1 HOUR * (hour_end + 5)
      + INTERVAL 59 MINUTE + INTERVAL 59 SECOND AS w1,
    CAST(date AS TIMESTAMP) + INTERVAL 28 HOUR + INTERVAL 59 MINUTE + INTERVAL 59 SECOND AS day_end
  FROM requests)"""

FULL_DAYS = """
requests AS (SELECT request_id, lat, lon, date, CAST(0 AS INT) AS hour_start,
  CAST(23 AS INT) AS hour_end FROM timed_requests)"""

_IDS = {
    "VHM0": "cmems_mod_glo_wav_anfc_0.083deg_PT3H-i",
    "thetao": "cmems_mod_glo_phy-thetao_anfc_0.083deg_PT6H-i",
    "so": "cmems_mod_glo_phy-so_anfc_0.083deg_PT6H-i",
    "CHL": "cmems_obs-oc_glo_bgc-plankton_nrt_l4-gapfree-multi-4km_P1D",
}
_SCOPES = {
    "VHM0": "oleaje_regional_referencia",
    "thetao": "temperatura_regional_referencia",
    "so": "salinidad_regional_referencia",
    "CHL": "clorofila_regional_referencia",
}
# The texts are the catalogue's own: compared is that every reading, with data or without, carries its product's.
_WARNINGS = {p.variable: p.scope_warning.replace("'", "''") for p in catalogue().values()}
_RECIPES = {"VHM0": (3, 40, 0), "thetao": (6, 50, 15), "so": (6, 200, 34), "CHL": (24, 100, 0)}


def _native(variable: str, name: str) -> str:
    """Observations of one variable as delivered, NaN and NULL both present."""
    step, div, off = _RECIPES[variable]
    return f"""
{name} AS (
  SELECT '{variable}' AS variable, time_utc, cell_lat, cell_lon,
    CASE WHEN v IS NULL AND i % 2 = 0 THEN CAST('NaN' AS DOUBLE) ELSE v END AS value
  FROM (SELECT user_id % 12 AS i,
          CAST(-13.0 AS DOUBLE) + (user_id % 12) / CAST(12 AS DOUBLE) AS cell_lat,
          CAST(-77.5 AS DOUBLE) + CAST(floor(user_id / 12) AS BIGINT) / CAST(12 AS DOUBLE) AS cell_lon,
          CAST(CAST(ts AS DATE) AS TIMESTAMP)
            + INTERVAL '1' HOUR * CAST(CAST(floor(hour(ts) / {step}) AS INT) * {step} AS INT) AS time_utc,
          CAST({off} AS DOUBLE)
            + max(CASE WHEN event_type <> 'error' THEN value END) / CAST({div} AS DOUBLE) AS v
        FROM events GROUP BY 1, 2, 3, 4) g)"""


def _levels(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT variable, time_utc, depth_m, cell_lat, cell_lon, value + 10 * k AS value
  FROM {source} CROSS JOIN (VALUES (0, CAST(0.494025 AS DOUBLE)), (1, CAST(1.541375 AS DOUBLE)),
    (2, CAST(2.645669 AS DOUBLE)), (3, CAST(3.819495 AS DOUBLE)),
    (4, CAST(5.078224 AS DOUBLE))) AS d(k, depth_m))"""


def _obs(variable: str, with_levels: bool = False) -> str:
    """``obs``: the table with NaN turned to NULL; levels below 5 m cut off."""
    clean = "CASE WHEN isnan(value) THEN NULL ELSE value END AS value"
    if with_levels:
        return f"""{_native(variable, 'flat')},{_levels('flat', 'deep')},
obs AS (SELECT variable, time_utc, depth_m, cell_lat, cell_lon, {clean}
        FROM deep WHERE depth_m <= 5.0)"""
    return f"""{_native(variable, 'native')},
obs AS (SELECT variable, time_utc, cell_lat, cell_lon, {clean} FROM native)"""


_KM = (
    "2 * 6371.0088 * asin(sqrt(pow(sin(radians(cell_lat - lat) / 2), 2)"
    " + cos(radians(lat)) * cos(radians(cell_lat)) * pow(sin(radians(cell_lon - lon) / 2), 2)))"
)
_BOX = (
    "cell_lat BETWEEN lat - CAST(0.05 AS DOUBLE) AND lat + CAST(0.05 AS DOUBLE)"
    " AND cell_lon BETWEEN lon - CAST(0.05 AS DOUBLE) AND lon + CAST(0.05 AS DOUBLE)"
)


def _hours(interval: str) -> str:
    return f"epoch_us(TIMESTAMP '1970-01-01' + ({interval})) / 1000000.0 / 3600.0"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _match(first: str, last: str) -> str:
    return f"""
pairs AS (
  SELECT w.*, o.* EXCLUDE (variable), {_KM} AS km
  FROM windows w JOIN obs o ON {_BOX} AND time_utc BETWEEN {first} AND {last})"""


_WAVE = (REQUESTS, WINDOWS, _obs("VHM0"), _match("w0", "w1"))
_WAVE_TOP = (
    *_WAVE,
    """
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id
      ORDER BY value DESC, km, cell_lat, cell_lon, time_utc) AS n
    FROM pairs WHERE value IS NOT NULL AND km <= 6.5) WHERE n = 1)""",
)


def _series_ctes(variable: str, full_days: bool = False) -> tuple[str, ...]:
    requests = (
        (REQUESTS.replace("requests AS", "timed_requests AS"), FULL_DAYS)
        if full_days
        else (REQUESTS,)
    )
    return (
        *requests,
        WINDOWS,
        _obs(variable, with_levels=True),
        _match("w0 - INTERVAL 3 HOUR", "w1 + INTERVAL 3 HOUR"),
        """
axis AS (
  SELECT request_id, min(depth_m) AS depth,
    count(DISTINCT time_utc) FILTER (time_utc BETWEEN w0 AND w1) AS n_in,
    count(DISTINCT time_utc) FILTER (NOT time_utc BETWEEN w0 AND w1) AS n_out
  FROM pairs GROUP BY request_id)""",
        """
usable AS (
  SELECT p.*, time_utc BETWEEN w0 AND w1 AS inside,
    CASE WHEN time_utc < w0 THEN w0 - time_utc WHEN time_utc > w1 THEN time_utc - w1
      ELSE INTERVAL 0 HOUR END AS offs
  FROM pairs p JOIN axis a USING (request_id)
  WHERE depth_m = depth AND value IS NOT NULL AND km <= 6.5)""",
        """
cell AS (
  SELECT * FROM (
    SELECT request_id, cell_lat, cell_lon, km, n_valid, row_number() OVER (
        PARTITION BY request_id ORDER BY n_valid DESC, km, cell_lat, cell_lon) AS n
    FROM (SELECT request_id, cell_lat, cell_lon, any_value(km) AS km, count(*) AS n_valid
          FROM usable WHERE inside GROUP BY 1, 2, 3)) WHERE n = 1)""",
        """
near AS (
  SELECT * FROM (
    SELECT request_id, time_utc, cell_lat, cell_lon, km, value, offs, row_number() OVER (
        PARTITION BY request_id ORDER BY offs, CASE WHEN time_utc < w0 THEN 0 ELSE 1 END,
          time_utc, km, cell_lat, cell_lon) AS n
    FROM usable WHERE NOT inside) WHERE n = 1)""",
    )


def _series(variable: str, value_name: str, units: str | None = None, full_days=False) -> str:
    units_column = f"'{units}' AS units," if units else ""
    return (
        _with(*_series_ctes(variable, full_days))
        + f""",
samples AS (
  SELECT u.request_id, u.time_utc, u.value, TRUE AS is_inside, CAST(0 AS DOUBLE) AS offset_h
  FROM usable u JOIN cell c USING (request_id, cell_lat, cell_lon) WHERE inside
  UNION ALL
  SELECT request_id, time_utc, value, FALSE, {_hours('offs')}
  FROM near WHERE request_id NOT IN (SELECT request_id FROM cell))
SELECT r.request_id, r.lat, r.lon, r.date, r.hour_start AS hour_start_local,
  r.hour_end AS hour_end_local, w0 AS window_start_utc, w1 AS window_end_utc,
  s.time_utc, s.time_utc - INTERVAL 5 HOUR AS time_local, s.value AS {value_name},
  s.is_inside AS inside_requested_window, round(s.offset_h, 6) AS temporal_offset_hours,
  coalesce(n_in, 0) AS n_native_times_in_window,
  CASE WHEN c.n IS NOT NULL THEN n_valid WHEN e.n IS NOT NULL THEN 1 ELSE 0 END AS n_samples,
  coalesce(n_in, 0) - coalesce(n_valid, 0) AS n_missing_samples,
  CASE WHEN n_in > 0 THEN coalesce(n_valid, 0) / CAST(n_in AS DOUBLE) END AS coverage_fraction,
  CAST(0 AS DOUBLE) AS depth_m_requested,
  CASE WHEN coalesce(c.n, e.n) IS NOT NULL THEN depth END AS depth_m_actual,
  CASE WHEN c.n IS NOT NULL THEN c.cell_lat ELSE e.cell_lat END AS cell_lat,
  CASE WHEN c.n IS NOT NULL THEN c.cell_lon ELSE e.cell_lon END AS cell_lon,
  round(CASE WHEN c.n IS NOT NULL THEN c.km ELSE e.km END, 6) AS distance_km,
  '{_IDS[variable]}' AS dataset_id, '{variable}' AS variable, {units_column}
  '{_SCOPES[variable]}' AS data_scope, '{_WARNINGS[variable]}' AS scope_warning,
  CASE WHEN c.n IS NOT NULL THEN 'valida_en_ventana'
    WHEN e.n IS NOT NULL THEN 'valida_cercana_en_tiempo' ELSE 'sin_datos' END AS status
FROM windows r LEFT JOIN axis a USING (request_id) LEFT JOIN cell c USING (request_id)
  LEFT JOIN near e USING (request_id) LEFT JOIN samples s USING (request_id)"""
    )


_CHLOROPHYLL = (
    REQUESTS,
    WINDOWS,
    _obs("CHL"),
    _match("day_end - INTERVAL 96 HOUR", "day_end"),
    f"""
recent AS (
  SELECT *, {_hours('day_end - time_utc')} AS age FROM pairs
  WHERE value IS NOT NULL AND km <= 6.5 AND day_end - time_utc <= INTERVAL 72 HOUR)""",
    """
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id
      ORDER BY time_utc DESC, km, cell_lat, cell_lon) AS n FROM recent) WHERE n = 1)""",
)

_WAVE_STATUS = (
    "CASE WHEN t.value IS NULL THEN 'sin_datos' WHEN t.value >= CAST(1.5 AS DOUBLE)"
    " THEN 'sobre_umbral_regional' ELSE 'bajo_umbral_regional' END"
)
_LATEST_STATUS = (
    "CASE WHEN t.time_utc IS NULL THEN 'sin_datos'"
    " WHEN CAST(t.time_utc - INTERVAL 5 HOUR AS DATE) = r.date THEN 'valida_en_fecha_local'"
    " ELSE 'valida_reciente' END"
)

SQL: dict[str, str] = {
    "grid_subset_scan": _with(_native("VHM0", "native"))
    + """
SELECT time_utc, cell_lat, cell_lon, CASE WHEN isnan(value) THEN NULL ELSE value END AS value
FROM native WHERE variable = 'VHM0'
  AND cell_lat BETWEEN CAST(-12.75 AS DOUBLE) AND CAST(-12.25 AS DOUBLE)
  AND cell_lon BETWEEN CAST(-77.25 AS DOUBLE) AND CAST(-76.5 AS DOUBLE)
  AND time_utc BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-19 23:59:59'""",
    "cube_to_long": """
SELECT vec_id, CAST((pos - 1) // 8 AS INT) AS lat_index, CAST((pos - 1) % 8 AS INT) AS lon_index,
  CAST(embedding[pos] AS DOUBLE) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""",
    "native_null_normalise": _with(_native("VHM0", "native"))
    + """
SELECT cell_lat, cell_lon, count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) AS n_valid,
  count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (isnan(value)) AS n_nan
FROM native GROUP BY cell_lat, cell_lon""",
    "observations_as_known": _with(_native("VHM0", "native"))
    + """,
delivered AS (
  SELECT time_utc, cell_lat, cell_lon, value, TIMESTAMP '2024-02-01' AS delivered_at FROM native
  UNION ALL SELECT time_utc, cell_lat, cell_lon, value * CAST(1.25 AS DOUBLE), TIMESTAMP '2024-02-05'
  FROM native WHERE day(time_utc) % 3 = 0
  UNION ALL SELECT time_utc, cell_lat, cell_lon, CAST(NULL AS DOUBLE), TIMESTAMP '2024-02-09'
  FROM native WHERE day(time_utc) % 2 = 0)
SELECT known_at, time_utc, cell_lat, cell_lon, CASE WHEN isnan(value) THEN NULL ELSE value END AS value
FROM delivered JOIN (VALUES (TIMESTAMP '2024-02-01 00:00:00'), (TIMESTAMP '2024-02-08 23:59:59'),
  (TIMESTAMP '2024-03-01 00:00:00')) AS k(known_at) ON delivered_at <= known_at
QUALIFY row_number() OVER (PARTITION BY known_at, time_utc, cell_lat, cell_lon
  ORDER BY delivered_at DESC) = 1""",
    "product_provenance": _with(
        *[_native(v, f"native_{v}") for v in _RECIPES],
        "all_rows AS ("
        + " UNION ALL ".join(
            f"SELECT '{_IDS[v]}' AS dataset_id, '{_SCOPES[v]}' AS data_scope, * FROM native_{v}"
            for v in _RECIPES
        )
        + ")",
    )
    + """
SELECT dataset_id, variable, data_scope,
  CASE variable WHEN 'so' THEN '1e-3' WHEN 'CHL' THEN 'milligram m-3' END AS units,
  CASE variable WHEN 'VHM0' THEN 'conservative_max' WHEN 'CHL' THEN 'latest_then_nearest'
    ELSE 'coverage_then_nearby_time' END AS rule,
  count(*) AS n_rows, count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) AS n_valid
FROM all_rows GROUP BY ALL""",
    "request_validation": _with(
        REQUESTS,
        """
flawed AS (
  SELECT request_id, CASE request_id % 50 WHEN 1 THEN CAST(100 AS DOUBLE) WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE lat END AS lat,
    CASE WHEN request_id % 50 = 3 THEN CAST(500 AS DOUBLE) ELSE lon END AS lon,
    CASE WHEN request_id % 50 <> 4 THEN date END AS date,
    CASE request_id % 50 WHEN 0 THEN CAST(10 AS DOUBLE) WHEN 5 THEN CAST(-0.9 AS DOUBLE) ELSE hour_start END AS hour_start,
    CASE WHEN request_id % 50 = 0 THEN 5 ELSE hour_end END AS hour_end
  FROM requests)""",
    )
    + """
SELECT request_id, reason IS NULL AS is_valid, reason
FROM (SELECT request_id, CASE WHEN date IS NULL THEN 'date'
    WHEN NOT (hour_start >= 0 AND hour_start <= hour_end AND hour_end <= 23 AND hour_start = floor(hour_start)) THEN 'hours'
    WHEN isnan(lat) OR NOT lat BETWEEN -90 AND 90 THEN 'lat'
    WHEN isnan(lon) OR NOT lon BETWEEN -180 AND 180 THEN 'lon' END AS reason
  FROM flawed)""",
    "local_window_utc": _with(REQUESTS, WINDOWS)
    + """
SELECT request_id, w0 AS window_start_utc, w1 AS window_end_utc,
  w0 - INTERVAL 3 HOUR AS query_start_utc, w1 + INTERVAL 3 HOUR AS query_end_utc FROM windows""",
    "lookback_window": _with(REQUESTS, WINDOWS)
    + """
SELECT request_id, day_end - INTERVAL 96 HOUR AS query_start_utc, day_end AS query_end_utc
FROM windows""",
    "local_time_of_observation": _with(_native("CHL", "native"))
    + """
SELECT time_utc, cell_lat, cell_lon, time_utc - INTERVAL 5 HOUR AS time_local,
  CAST(time_utc - INTERVAL 5 HOUR AS DATE) AS local_date FROM native""",
    "box_time_match": _with(*_WAVE)
    + """
SELECT request_id, count(p.cell_lat) AS n_matched, count(p.value) AS n_valid
FROM requests r LEFT JOIN pairs p USING (request_id) GROUP BY request_id""",
    "haversine_distance": _with(*_WAVE)
    + """
SELECT DISTINCT request_id, cell_lat, cell_lon, round(km, 6) AS distance_km, km <= 6.5 AS is_admissible
FROM pairs""",
    "candidate_cells": _with(*_series_ctes("thetao"))
    + """
SELECT request_id, cell_lat, cell_lon, round(km, 6) AS distance_km, CAST(row_number() OVER (
    PARTITION BY request_id ORDER BY km, cell_lat, cell_lon) AS INT) AS distance_rank
FROM (SELECT DISTINCT request_id, cell_lat, cell_lon, km FROM pairs WHERE km <= 6.5)""",
    "cell_temporal_max": _with(*_WAVE)
    + """
SELECT request_id, cell_lat, cell_lon, round(any_value(km), 6) AS distance_km,
  max(value) AS max_value, arg_max(time_utc, (value, -epoch_us(time_utc))) AS max_time_utc
FROM pairs WHERE value IS NOT NULL AND km <= 6.5 GROUP BY 1, 2, 3""",
    "conservative_cell": _with(*_WAVE)
    + """
SELECT request_id, cell_lat, cell_lon, round(km, 6) AS distance_km, max_value, max_time_utc,
  CAST(row_number() OVER (PARTITION BY request_id
    ORDER BY max_value DESC, km, cell_lat, cell_lon) AS INT) AS cell_rank
FROM (SELECT request_id, cell_lat, cell_lon, any_value(km) AS km, max(value) AS max_value,
        arg_min(time_utc, struct_pack(v := -value, t := time_utc)) AS max_time_utc
      FROM pairs WHERE value IS NOT NULL AND km <= 6.5 GROUP BY 1, 2, 3)""",
    "wave_measurement": _with(*_WAVE_TOP)
    + """
SELECT request_id, t.value AS value_m, t.time_utc, t.cell_lat, t.cell_lon,
  round(t.km, 6) AS distance_km
FROM requests r LEFT JOIN top t USING (request_id)""",
    "wave_gate": _with(*_WAVE_TOP)
    + f"""
SELECT request_id, r.lat, r.lon, r.date, t.value AS significant_wave_height_m,
  t.time_utc AS max_time_utc, t.time_utc - INTERVAL 5 HOUR AS max_time_local, t.cell_lat, t.cell_lon,
  round(t.km, 6) AS distance_km, '{_IDS["VHM0"]}' AS dataset_id, 'VHM0' AS variable,
  '{_SCOPES["VHM0"]}' AS data_scope, '{_WARNINGS["VHM0"]}' AS scope_warning, {_WAVE_STATUS} AS status,
  coalesce(t.value >= CAST(1.5 AS DOUBLE), TRUE) AS kill_switch
FROM requests r LEFT JOIN top t USING (request_id)""",
    "surface_level": _with(*_series_ctes("thetao"))
    + """
SELECT request_id, depth AS depth_m_actual FROM requests LEFT JOIN axis USING (request_id)""",
    "window_classification": _with(*_series_ctes("thetao"))
    + f"""
SELECT request_id, coalesce(any_value(n_in), 0) AS n_in, coalesce(any_value(n_out), 0) AS n_out,
  round(max(CASE WHEN time_utc < p.w0 THEN {_hours('p.w0 - time_utc')}
    WHEN time_utc > p.w1 THEN {_hours('time_utc - p.w1')}
    WHEN time_utc IS NOT NULL THEN 0 END), 6) AS max_offset_hours
FROM requests LEFT JOIN axis USING (request_id) LEFT JOIN pairs p USING (request_id)
GROUP BY request_id""",
    "cell_coverage_rank": _with(*_series_ctes("thetao"))
    + """
SELECT request_id, cell_lat, cell_lon, round(km, 6) AS distance_km, n_valid FROM cell""",
    "nearest_outside_sample": _with(*_series_ctes("thetao"))
    + f"""
SELECT request_id, time_utc, round({_hours('offs')}, 6) AS temporal_offset_hours, cell_lat, cell_lon,
  round(km, 6) AS distance_km, value FROM near""",
    "temperature_series": _series("thetao", "value_celsius"),
    "sst_full_day": _series("thetao", "value_celsius", full_days=True),
    "salinity_series": _series("so", "value_salinity", units="1e-3"),
    "nearest_valid_cell": _with(*_CHLOROPHYLL)
    + """
SELECT request_id, time_utc, cell_lat, cell_lon, round(km, 6) AS distance_km, value
FROM (SELECT *, row_number() OVER (PARTITION BY request_id, time_utc
  ORDER BY km, cell_lat, cell_lon) AS n FROM recent) WHERE n = 1""",
    "asof_latest_valid": _with(*_CHLOROPHYLL)
    + """
SELECT request_id, time_utc, round(age, 6) AS temporal_age_hours FROM top""",
    "chlorophyll_latest": _with(*_CHLOROPHYLL)
    + f"""
SELECT request_id, r.lat, r.lon, r.date, t.value AS value_mg_m3, t.time_utc,
  t.time_utc - INTERVAL 5 HOUR AS time_local, round(t.age, 6) AS temporal_age_hours,
  CAST(t.time_utc - INTERVAL 5 HOUR AS DATE) = r.date AS inside_requested_local_date,
  t.cell_lat, t.cell_lon, round(t.km, 6) AS distance_km, '{_IDS["CHL"]}' AS dataset_id,
  'CHL' AS variable, 'milligram m-3' AS units, '{_SCOPES["CHL"]}' AS data_scope, '{_WARNINGS["CHL"]}' AS scope_warning,
  {_LATEST_STATUS} AS status
FROM requests r LEFT JOIN top t USING (request_id)""",
}

# Other ways to the same rows.
SQL |= {
    "box_time_match_tree": SQL["box_time_match"],
    "cell_max_by_blocks": SQL["cell_temporal_max"],
    "asof_by_scan": SQL["asof_latest_valid"],
    "cell_coverage_by_scan": SQL["cell_coverage_rank"],
    "nearest_outside_by_scan": SQL["nearest_outside_sample"],
    "chlorophyll_by_scan": SQL["chlorophyll_latest"],
}


def _counted(family: str, readings: str) -> str:
    return (
        f"SELECT '{family}' AS family, status, count(*) AS n_readings"
        f" FROM (SELECT DISTINCT request_id, status FROM ({readings})) GROUP BY status"
    )


SQL["status_summary"] = " UNION ALL ".join(
    [
        _counted("waves", SQL["wave_gate"]),
        _counted("temperature", SQL["temperature_series"]),
        _counted("salinity", SQL["salinity_series"]),
        _counted("chlorophyll", SQL["chlorophyll_latest"]),
    ]
)
