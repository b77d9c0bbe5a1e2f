"""Deliveries that are only added: what is known when, failures, writers at once, plans."""

from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from cases import NAN, NEAR, at
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seapoint import (
    WAVES,
    as_known,
    deliver_observations,
    land_observations,
    read_deliveries,
    read_observations,
    request_extent,
    wave_gate,
)
from seapoint.derived import deliveries, requests_from_orders
from seapoint.schemas import OBSERVATIONS, STORED_OBSERVATIONS

SF = "/root/testdata/sf0.001"


def rows_of(spark, values):
    head = (WAVES.dataset_id, WAVES.variable)
    return spark.createDataFrame([(*head, at(t), None, -12.5, NEAR, v) for t, v in values], OBSERVATIONS)


def known(spark, path, moment=None):
    return {r.time_utc: r.value for r in read_deliveries(spark, path, WAVES, moment and at(moment)).collect()}


def test_what_is_known_when(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert known(spark, path) == {} and read_deliveries(spark, path, WAVES).schema == STORED_OBSERVATIONS
    day, noon, later = "2026-08-14", "2026-08-14 12:00", "2026-08-15"
    deliver_observations(rows_of(spark, [(day, 1.0), (noon, 2.0)]), path, at("2026-08-16 06:00"), files=1)
    # Written last but delivered in between: the times of the deliveries decide.
    deliver_observations(rows_of(spark, [(day, 0.5), (later, 4.0)]), path, at("2026-08-18"), files=1)
    deliver_observations(rows_of(spark, [(day, NAN), (noon, 3.0)]), path, at("2026-08-17"), files=1)
    assert known(spark, path, "2026-08-16 05:59:59") == {}
    first = {at(day): 1.0, at(noon): 2.0}
    assert known(spark, path, "2026-08-16 06:00") == first == known(spark, path, "2026-08-16 23:59")
    second = {at(day): None, at(noon): 3.0}
    assert known(spark, path, "2026-08-17") == second
    third = second | {at(day): 0.5, at(later): 4.0}
    assert known(spark, path, "2026-08-18") == third == known(spark, path)


def test_a_delivery_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "archive")
    deliver_observations(rows_of(spark, [("2026-08-14", 1.0), ("2026-08-15", 1.0)]), path, at("2026-08-16"), files=1)
    clash = rows_of(spark, [("2026-08-14", 2.0), ("2026-08-15", 3.0), ("2026-08-15", 4.0)])
    with pytest.raises(PySparkException, match="two values for one coordinate"):
        deliver_observations(clash, path, at("2026-08-17"), files=2)
    # Files that are there without the mark of a finished delivery do not count either.
    deliver_observations(rows_of(spark, [("2026-08-14", 9.0)]), path, at("2026-08-18"), files=1)
    mark = next((tmp_path / "archive").rglob("delivered_us=*/writer=*/_SUCCESS"))
    marks = sorted((tmp_path / "archive").rglob("_SUCCESS"), key=str)
    assert mark in marks and len(marks) == 2
    marks[-1].unlink()
    assert known(spark, path) == {at("2026-08-14"): 1.0, at("2026-08-15"): 1.0}


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    start = at("2026-08-16")

    def write(k):
        values = [("2026-08-14", float(k)), (f"2026-08-{10 + k} 06:00", float(k))]
        deliver_observations(rows_of(spark, values), path, start + timedelta(hours=k), files=1)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    want = {at(f"2026-08-{10 + k} 06:00"): float(k) for k in range(4)}
    assert known(spark, path) == want | {at("2026-08-14"): 3.0}
    deliver_observations(rows_of(spark, [("2026-08-14", 7.0)]), path, start, files=1)
    with pytest.raises(ValueError, match="two deliveries of one time"):
        known(spark, path)


def test_readings_as_known(spark, tmp_path):
    """A reading from deliveries equals that from a table landed with what was known then, and the scan is pruned."""
    path, made = str(tmp_path / "archive"), deliveries(spark, SF)
    moments = ["2024-02-01", "2024-02-05", "2024-02-09"]
    for moment in moments:
        part = made.where(F.col("delivered_at") == F.lit(moment).cast("timestamp_ntz"))
        deliver_observations(part.drop("delivered_at"), path, at(moment), files=2)
    requests = requests_from_orders(spark, SF)
    extent = request_extent(requests)
    seen = set()
    for moment in moments:
        landed = str(tmp_path / f"landed-{moment}")
        land_observations(as_known(made, F.lit(moment).cast("timestamp_ntz")), landed, files=2)
        want = wave_gate(requests, read_observations(spark, landed, WAVES, extent))
        got = wave_gate(requests, read_deliveries(spark, path, WAVES, at(moment), extent))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        seen.add(got.agg(F.sum("significant_wave_height_m")).first()[0])
    assert len(seen) == 3
    early = request_extent(requests.where(F.col("date") < "2024-01-05"))
    plan = read_deliveries(spark, path, WAVES, None, early)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan and "obs_date" in plan
    assert "GreaterThanOrEqual(cell_lat" in plan and "EqualTo(variable,VHM0)" in plan
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert len(read_deliveries(spark, path, WAVES, at(moments[0])).inputFiles()) < len(
        read_deliveries(spark, path, WAVES).inputFiles()
    )
