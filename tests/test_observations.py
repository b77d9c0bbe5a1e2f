import pytest
from cases import NAN, NEAR, at
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seapoint import (
    TEMPERATURE,
    WAVES,
    catalogue,
    cube_to_rows,
    land_observations,
    products,
    read_observations,
    redeliver_observations,
    request_extent,
    unique_coordinates,
    wave_gate,
)
from seapoint.derived import observations, requests_from_orders
from seapoint.schemas import OBSERVATIONS, PRODUCTS

SF = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().toString()


def test_cube_to_rows_keeps_every_coordinate(spark):
    times = [at("2026-08-14 06:00"), at("2026-08-14 12:00")]
    cube = spark.createDataFrame(
        [("b", times, [0.5, 1.5], [-12.5], [1.0, 2.0, 3.0], [float(v) for v in range(11)] + [NAN])],
        "block string, t array<timestamp_ntz>, d array<double>, la array<double>,"
        " lo array<double>, v array<double>",
    )
    rows = cube_to_rows(
        cube,
        "v",
        {
            "time_utc": F.col("t"),
            "depth_m": F.col("d"),
            "cell_lat": F.col("la"),
            "cell_lon": F.col("lo"),
        },
        keep=("block",),
    ).collect()
    expected = [(t, d, -12.5, lo) for t in times for d in (0.5, 1.5) for lo in (1.0, 2.0, 3.0)]
    assert [(r.time_utc, r.depth_m, r.cell_lat, r.cell_lon) for r in rows] == expected
    assert [r.value for r in rows][:11] == [float(v) for v in range(11)]
    assert rows[11].value != rows[11].value


def test_copies_collapse_and_contradictions_fail(spark):
    row = ("d", "v", at("2026-08-14"), None, -12.5, NEAR)
    copies = spark.createDataFrame([(*row, 1.0), (*row, 1.0), (*row, NAN)], OBSERVATIONS)
    assert [r.value for r in unique_coordinates(copies).collect()] == [1.0]
    with pytest.raises(PySparkException, match="two values for one coordinate"):
        unique_coordinates(
            spark.createDataFrame([(*row, 1.0), (*row, 2.0)], OBSERVATIONS)
        ).collect()
    missing = spark.createDataFrame([(*row, NAN), (*row, None)], OBSERVATIONS)
    assert [r.value for r in unique_coordinates(missing).collect()] == [None]


def test_a_later_delivery_wins_and_other_dates_stay(spark, tmp_path):
    path = str(tmp_path / "observations")

    def rows(*values):
        return spark.createDataFrame(
            [("d", variable, at(time), None, -12.5, NEAR, value) for variable, time, value in values],
            OBSERVATIONS,
        )

    first = [("v", "2026-08-13", 1.0), ("v", "2026-08-14", 2.0), ("v", "2026-08-14 06:00", 3.0)]
    first += [("w", "2026-08-14", 4.0), ("v", "2026-08-16", 5.0)]
    land_observations(rows(*first), path, files=2)
    with pytest.raises(ValueError, match="redeliver"):
        land_observations(rows(*first), path, mode="append")
    untouched = set((tmp_path / "observations").rglob("obs_date=2026-08-13/*.parquet"))
    later = [("v", "2026-08-14", 0.5), ("v", "2026-08-14 06:00", NAN), ("v", "2026-08-15", 7.0)]
    for _ in range(2):
        redeliver_observations(rows(*later), path, files=2)
    redeliver_observations(rows(), path)
    stored = spark.read.parquet(path).select("variable", "time_utc", "value").collect()
    want = {(v, at(t)): x for v, t, x in first} | {(v, at(t)): x for v, t, x in later}
    want["v", at("2026-08-14 06:00")] = None
    assert len(stored) == len(want)
    assert {(r.variable, r.time_utc): r.value for r in stored} == want
    assert set((tmp_path / "observations").rglob("obs_date=2026-08-13/*.parquet")) == untouched


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed") / "observations")
    rows = observations(spark, SF, "waves").unionByName(observations(spark, SF, "temperature"))
    land_observations(rows, path, files=4)
    return path


def test_landed_scan_prunes_and_pushes_down(spark, landed):
    extent = request_extent(requests_from_orders(spark, SF).where(F.col("date") < "2024-01-05"))
    rows = read_observations(spark, landed, WAVES, extent)
    plan = plan_of(rows.select("value"))
    assert "PartitionFilters: [isnotnull(dataset_id" in plan and "obs_date" in plan
    assert "GreaterThanOrEqual(cell_lat" in plan and "EqualTo(variable,VHM0)" in plan
    dates = [r[0] for r in rows.select(F.max("obs_date").cast("string")).collect()]
    assert dates[0] <= "2024-01-07"


def test_landed_table_gives_the_same_readings(spark, landed):
    requests = requests_from_orders(spark, SF)
    fresh = wave_gate(requests, observations(spark, SF, "waves"))
    for extent in (None, request_extent(requests)):
        stored = wave_gate(requests, read_observations(spark, landed, WAVES, extent))
        assert stored.exceptAll(fresh).count() == 0 and fresh.exceptAll(stored).count() == 0


def test_depth_ceiling_reaches_the_scan(spark, landed):
    rows = read_observations(spark, landed, TEMPERATURE)
    assert "LessThanOrEqual(depth_m,5.0)" in plan_of(rows)
    assert rows.agg(F.max("depth_m")).first()[0] == 3.819495


def test_product_dimension(spark):
    rows = {r.variable: r for r in products(spark).collect()}
    assert products(spark).schema == PRODUCTS and set(rows) == {"VHM0", "thetao", "so", "CHL"}
    assert rows["so"].units == "1e-3" and rows["CHL"].max_age_h == 72.0
    assert rows["VHM0"].threshold == 1.5 and rows["thetao"].max_offset_h == 3.0
    assert {r.max_cell_km for r in rows.values()} == {6.5}
    named = catalogue(place="Puerto")
    assert all("Puerto" in p.scope_warning and "{" not in p.scope_warning for p in named.values())
