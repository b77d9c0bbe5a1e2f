import pytest
from cases import FAR, NAN, NEAR, OUT, Cases, at
from pyspark.sql import functions as F

from seapoint import SALINITY, TEMPERATURE, salinity_series, sst_full_day, temperature_series
from seapoint.functions.readings import SERIES_STATUSES

SURFACE = ((0.494025, 0.0),)
FOUR_LEVELS = ((0.494025, 0.0), (1.541375, 10.0), (2.645669, 10.0), (3.819495, 10.0))
FULL = [at("2026-08-12 06:00"), at("2026-08-12 12:00"), at("2026-08-12 18:00"), at("2026-08-13")]
NO = [NAN] * 4


@pytest.fixture(scope="module")
def cases():
    c = Cases(TEMPERATURE, "2026-08-12")

    def add(*args, **kwargs):
        c.add(*args, **{"depth": SURFACE, **kwargs})

    full_far = [20.0, 20.1, 20.2, 20.3]
    add("most covered", {NEAR: [21.0, NAN, NAN, NAN], FAR: full_far}, FULL)
    add("tie by distance", {NEAR: [22.0, 22.1, 22.2, 22.3], FAR: full_far}, FULL)
    add("near missing", {NEAR: NO, FAR: full_far}, FULL)
    add("only outside the box", {OUT: full_far}, FULL)
    add("only in a far corner of the box", {(-12.422, -76.741): full_far}, FULL)
    add(
        "corner counts for the axis only",
        {(-12.422, -76.741): [*full_far, 9.0], (-12.5, NEAR): [20.0, NAN, NAN, NAN, NAN]},
        [*FULL, at("2026-08-13 01:00")],
    )
    add("offset at limit", {NEAR: [20.5]}, [at("2026-08-12 04:00:00")], hours=(2, 5))
    add("offset over limit", {NEAR: [20.5]}, [at("2026-08-12 03:59:59")], hours=(2, 5))
    add("just over limit", {NEAR: [20.5]}, [at("2026-08-12 03:59:59.999999")], hours=(2, 5))
    add(
        "before preferred",
        {NEAR: [30.0, 10.0]},
        [at("2026-08-12 13:59:59"), at("2026-08-12 04:00:00")],
        hours=(2, 5),
    )
    add("partial", {NEAR: [21.0, NAN, 21.4, NAN]}, FULL)
    add(
        "outside does not cover",
        {NEAR: [19.8, NAN, NAN, NAN, NAN]},
        [at("2026-08-12 03:00"), *FULL],
    )
    add("all missing", {NEAR: NO, FAR: NO}, FULL)
    add("nothing at all", {}, FULL)
    add("half second after the end", {NEAR: [20.0]}, [at("2026-08-12 10:59:59.5")], hours=(2, 5))
    add("ragged axis", {(-12.5, NEAR): [20.0, 20.1]}, FULL[:2])
    add(
        "surface missing is not replaced",
        {NEAR: NO},
        FULL,
        depth=SURFACE + ((1.541375, 10.0), (5.078224, 10.0)),
    )
    deeper = [(*row[:6], 33.0) for row in c.rows if row[3] == 1.541375]
    c.rows = [row for row in c.rows if row[3] != 1.541375] + deeper
    return c


@pytest.fixture(scope="module")
def readings(spark, cases):
    return cases.run(spark, temperature_series)


def values(reading):
    return [s["value_celsius"] for s in reading["samples"]]


def counts(reading):
    return tuple(
        reading[f]
        for f in ("n_native_times_in_window", "n_samples", "n_missing_samples", "coverage_fraction")
    )


@pytest.mark.parametrize(
    "case, cell_lon, samples, figures",
    [
        ("most covered", FAR, [20.0, 20.1, 20.2, 20.3], (4, 4, 0, 1.0)),
        ("tie by distance", NEAR, [22.0, 22.1, 22.2, 22.3], (4, 4, 0, 1.0)),
        ("near missing", FAR, [20.0, 20.1, 20.2, 20.3], (4, 4, 0, 1.0)),
        ("partial", NEAR, [21.0, 21.4], (4, 2, 2, 0.5)),
        ("ragged axis", NEAR, [20.0, 20.1], (2, 2, 0, 1.0)),
        ("corner counts for the axis only", NEAR, [20.0], (5, 1, 4, 0.2)),
    ],
)
def test_series_of_one_cell(readings, case, cell_lon, samples, figures):
    r = readings[case]
    assert r["status"] == "valida_en_ventana"
    assert r["cell_lon"] == cell_lon and values(r) == samples and counts(r) == figures
    assert r["depth_m_actual"] == 0.494025 and r["depth_m_requested"] == 0.0
    assert all(s["inside_requested_window"] for s in r["samples"])
    assert all(s["temporal_offset_hours"] == 0.0 for s in r["samples"])
    assert [s["time_utc"] for s in r["samples"]] == sorted(s["time_utc"] for s in r["samples"])


@pytest.mark.parametrize(
    "case, value, offset, figures",
    [
        ("offset at limit", 20.5, 3.0, (0, 1, 0, None)),
        ("just over limit", 20.5, None, None),
        ("before preferred", 10.0, 3.0, (0, 1, 0, None)),
        ("outside does not cover", 19.8, 2.0, (4, 1, 4, 0.0)),
        ("half second after the end", 20.0, 0.5 / 3600, (0, 1, 0, None)),
    ],
)
def test_one_sample_outside(readings, case, value, offset, figures):
    r = readings[case]
    if offset is None:
        assert r["status"] == "sin_datos"
        return
    assert r["status"] == "valida_cercana_en_tiempo"
    (sample,) = r["samples"]
    assert sample["value_celsius"] == value and not sample["inside_requested_window"]
    assert sample["temporal_offset_hours"] == pytest.approx(offset, abs=1e-12)
    assert counts(r) == figures and r["depth_m_actual"] == 0.494025


@pytest.mark.parametrize(
    "case, n_native",
    [
        ("only outside the box", 0),
        ("only in a far corner of the box", 4),
        ("offset over limit", 0),
        ("all missing", 4),
        ("nothing at all", 0),
        ("surface missing is not replaced", 4),
    ],
)
def test_no_data_keeps_window_and_counts(readings, case, n_native):
    r = readings[case]
    assert r["status"] == "sin_datos" and r["samples"] == []
    assert counts(r) == (n_native, 0, n_native, 0.0 if n_native else None)
    assert r["window_start_utc"] is not None and r["window_end_utc"] is not None
    for field in ("cell_lat", "cell_lon", "distance_km", "depth_m_actual"):
        assert r[field] is None


def test_windows_and_local_times(readings):
    r = readings["most covered"]
    assert r["window_start_utc"] == at("2026-08-12 05:00")
    assert r["window_end_utc"] == at("2026-08-13 04:59:59")
    assert [s["time_local"].hour for s in r["samples"]] == [1, 7, 13, 19]
    assert {s["time_local"].date() for s in r["samples"]} == {r["date"]}


def test_provenance_and_fields(readings):
    for r in readings.values():
        assert r["dataset_id"] == TEMPERATURE.dataset_id and r["variable"] == "thetao"
        assert r["scope_warning"] == TEMPERATURE.scope_warning and "units" not in r
        assert r["status"] in SERIES_STATUSES


def test_hours_default_to_the_whole_day(spark, cases, readings):
    def without_hours(requests, observations):
        return sst_full_day(requests.drop("hour_start", "hour_end"), observations)

    whole = cases.run(spark, without_hours)
    assert {(r["hour_start_local"], r["hour_end_local"]) for r in whole.values()} == {(0, 23)}
    assert whole["most covered"] == readings["most covered"]
    assert whole["before preferred"]["window_start_utc"] == at("2026-08-12 05:00")


# ---- salinity ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def salinity(spark):
    times = [at("2026-08-14 06:00"), at("2026-08-14 12:00"), at("2026-08-14 18:00"), at("2026-08-15")]
    native = [35.2112, 35.2078, 35.2072, 35.2077]
    c = Cases(SALINITY, "2026-08-14")
    c.add("native", {NEAR: native}, times, depth=SURFACE)
    c.add("levels", {NEAR: native}, times, depth=FOUR_LEVELS[::-1])
    c.add("nearby", {NEAR: [35.2050]}, [at("2026-08-14 06:00")], hours=(2, 5), depth=SURFACE)
    c.add("none", {}, times)
    return c.run(spark, salinity_series)


def test_salinity_in_native_unit(salinity):
    r = salinity["native"]
    assert r["units"] == "1e-3"
    assert [s["value_salinity"] for s in r["samples"]] == [35.2112, 35.2078, 35.2072, 35.2077]
    assert [s["time_local"].hour for s in r["samples"]] == [1, 7, 13, 19]
    assert "value_celsius" not in r["samples"][0]


def test_salinity_takes_the_shallowest_level(salinity):
    r = salinity["levels"]
    assert r["depth_m_actual"] == 0.494025
    assert all(s["value_salinity"] < 36 for s in r["samples"]) and counts(r) == (4, 4, 0, 1.0)


def test_salinity_nearby(salinity):
    r = salinity["nearby"]
    assert r["status"] == "valida_cercana_en_tiempo" and counts(r) == (0, 1, 0, None)
    assert r["samples"][0]["temporal_offset_hours"] == 1.0


def test_salinity_provenance_without_data(salinity):
    r = salinity["none"]
    assert r["status"] == "sin_datos" and r["units"] == "1e-3"
    assert r["scope_warning"] == SALINITY.scope_warning


def test_copies_of_observations_change_nothing(spark, cases, readings):
    def with_copies(requests, observations):
        return temperature_series(requests, observations.union(observations).union(observations))

    assert cases.run(spark, with_copies) == readings


def test_missing_rows_are_kept_on_ingest(spark):
    from seapoint import as_observations

    rows = spark.createDataFrame(
        [("d", "v", at("2026-01-01"), None, 0.0, 0.0, v) for v in (NAN, None, 1.0)],
        "dataset_id string, variable string, time_utc timestamp_ntz, depth_m double,"
        " cell_lat double, cell_lon double, value double",
    )
    kept = as_observations(rows)
    assert kept.count() == 3 and kept.where(F.col("value").isNull()).count() == 2
