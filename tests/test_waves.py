import pytest
from cases import FAR, LON, NAN, NEAR, OUT, Cases, at
from pyspark.sql import functions as F

from seapoint import WAVES, wave_gate, wave_measurement
from seapoint.functions.readings import WAVE_STATUSES, kill_switch

TIMES = [at("2026-08-14 06:00"), at("2026-08-14 12:00"), at("2026-08-14 18:00"), at("2026-08-15")]
NO = [NAN] * 4


@pytest.fixture(scope="module")
def cases():
    c = Cases(WAVES, "2026-08-14")
    c.add("highest wins", {NEAR: [0.8, 0.9, 1.0, 0.7], FAR: [1.2, 1.9, 1.4, 1.1]}, TIMES)
    c.add("near cell missing", {NEAR: NO, FAR: [1.6, 1.7, 1.72, 1.6]}, TIMES)
    c.add("null is missing too", {NEAR: [None] * 4, FAR: [1.6, None, 1.72, NAN]}, TIMES)
    c.add("tie by distance", {NEAR: [0.5, 1.4, 0.6, 0.7], FAR: [0.9, 1.4, 0.8, 0.6]}, TIMES)
    c.add(
        "tie by latitude",
        {(-12.500, LON): [1.0, 1.3, 0.9, 0.8], (-12.442, LON): [0.7, 1.3, 1.0, 0.9]},
        TIMES,
    )
    c.add("only too far", {OUT: [2.0, 2.1, 2.2, 2.0]}, TIMES)
    c.add("no instants", {}, TIMES)
    c.add("all missing", {NEAR: NO, FAR: NO}, TIMES)
    c.add("under", {NEAR: [0.8, 0.9, 1.0, 0.7]}, TIMES)
    c.add("exactly at", {NEAR: [0.8, 1.5, 1.0, 0.7]}, TIMES)
    c.add("over", {NEAR: [0.8, 2.1, 1.0, 0.7]}, TIMES)
    c.add("late maximum", {NEAR: [1.0, 1.1, 1.2, 1.9]}, TIMES)
    c.add("first instant of a repeated maximum", {NEAR: [1.0, 1.8, 1.2, 1.8]}, TIMES)
    c.add(
        "outside the window",
        {NEAR: [1.0, 9.0, 9.0]},
        [at("2026-08-14 12:00"), at("2026-08-14 11:59:59"), at("2026-08-14 16:00")],
        hours=(7, 10),
    )
    c.add("latitude beyond the grid", {NEAR: [1.0, 1.1, 1.2, 1.9]}, TIMES, lat=100.0)
    c.add("latitude not a number", {NEAR: [1.0, 1.1, 1.2, 1.9]}, TIMES, lat=NAN)
    return c


@pytest.fixture(scope="module")
def readings(spark, cases):
    return cases.run(spark, wave_gate)


@pytest.mark.parametrize(
    "case, value, cell, status",
    [
        ("highest wins", 1.9, (-12.5, FAR), "sobre_umbral_regional"),
        ("near cell missing", 1.72, (-12.5, FAR), "sobre_umbral_regional"),
        ("null is missing too", 1.72, (-12.5, FAR), "sobre_umbral_regional"),
        ("tie by distance", 1.4, (-12.5, NEAR), "bajo_umbral_regional"),
        ("tie by latitude", 1.3, (-12.5, LON), "bajo_umbral_regional"),
        ("under", 1.0, (-12.5, NEAR), "bajo_umbral_regional"),
        ("exactly at", 1.5, (-12.5, NEAR), "sobre_umbral_regional"),
        ("over", 2.1, (-12.5, NEAR), "sobre_umbral_regional"),
        ("late maximum", 1.9, (-12.5, NEAR), "sobre_umbral_regional"),
        ("outside the window", 1.0, (-12.5, NEAR), "bajo_umbral_regional"),
    ],
)
def test_value_cell_and_status(readings, case, value, cell, status):
    r = readings[case]
    assert r["significant_wave_height_m"] == value
    assert (r["cell_lat"], r["cell_lon"]) == cell
    assert r["distance_km"] <= 6.5
    assert r["status"] == status
    assert r["kill_switch"] is (status == "sobre_umbral_regional")


@pytest.mark.parametrize(
    "case",
    ["only too far", "no instants", "all missing", "latitude beyond the grid", "latitude not a number"],
)
def test_no_data_blocks_and_has_no_values(readings, case):
    r = readings[case]
    assert r["status"] == "sin_datos" and r["kill_switch"] is True
    for field in (
        "significant_wave_height_m max_time_utc max_time_local cell_lat cell_lon distance_km"
    ).split():
        assert r[field] is None, field


def test_time_of_maximum(readings):
    late = readings["late maximum"]
    assert late["max_time_utc"] == at("2026-08-15 00:00")
    assert late["max_time_local"] == at("2026-08-14 19:00")
    assert readings["first instant of a repeated maximum"]["max_time_utc"] == TIMES[1]


def test_distances(readings):
    assert readings["under"]["distance_km"] == pytest.approx(5.408949, abs=1e-6)
    assert readings["highest wins"]["distance_km"] == pytest.approx(5.703543, abs=1e-6)
    assert readings["tie by latitude"]["distance_km"] == pytest.approx(3.224657, abs=1e-6)


def test_provenance_on_every_reading(readings):
    for r in readings.values():
        assert (r["dataset_id"], r["variable"]) == (WAVES.dataset_id, "VHM0")
        assert (r["data_scope"], r["scope_warning"]) == (WAVES.data_scope, WAVES.scope_warning)
        assert r["status"] in WAVE_STATUSES


def test_measurement_is_the_reading_without_classification(spark, cases, readings):
    measured = cases.run(spark, wave_measurement)
    for case, r in readings.items():
        m = measured[case]
        assert m["value_m"] == r["significant_wave_height_m"]
        assert m["time_utc"] == r["max_time_utc"]
        assert (m["cell_lat"], m["cell_lon"], m["distance_km"]) == (
            r["cell_lat"],
            r["cell_lon"],
            r["distance_km"],
        )


def test_kill_switch_fails_safe(spark):
    rows = spark.createDataFrame(
        [("sobre_umbral_regional",), ("bajo_umbral_regional",), ("sin_datos",), (None,), ("?",)],
        "status string",
    )
    blocked = [r.b for r in rows.select(kill_switch(F.col("status")).alias("b")).collect()]
    assert blocked == [True, False, True, True, True]


def test_rank_is_the_questions_and_unknown_products_are_counted(spark):
    """Two requests under one id rank their cells apart; rows of a product nobody knows keep their count."""
    from seapoint.operators.steps import ranked_maxima, rows_by_product
    from seapoint.sources.products import WAVES

    seen = spark.sql(
        f"""SELECT '{WAVES.dataset_id}' AS dataset_id, 'VHM0' AS variable, t AS time_utc, CAST(NULL AS DOUBLE) AS depth_m,
        -12.5D AS cell_lat, -76.75D AS cell_lon, v AS value
        FROM VALUES (TIMESTAMP_NTZ'2026-08-14 12:00:00', 1.0D), (TIMESTAMP_NTZ'2026-08-15 12:00:00', 2.0D) AS x(t, v)"""
    )
    asked = spark.sql(
        """SELECT 1L AS request_id, -12.471D AS lat, -76.79D AS lon, d AS date, 0 AS hour_start, 12 AS hour_end
        FROM VALUES (DATE'2026-08-14'), (DATE'2026-08-15') AS x(d)"""
    )
    assert [r.cell_rank for r in ranked_maxima(asked, seen, WAVES).collect()] == [1, 1]
    other = seen.selectExpr("'unknown' AS dataset_id", "'X' AS variable", "time_utc", "depth_m", "cell_lat", "cell_lon", "value")
    counts = {r.dataset_id: (r.n_rows, r.units) for r in rows_by_product(seen.unionByName(other)).collect()}
    assert counts["unknown"] == (2, None) and counts[WAVES.dataset_id][0] == 2
