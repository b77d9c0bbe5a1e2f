"""The scan gives the as-of answers of the pairs, and makes fewer of them."""

import random

import pytest
from pyspark.sql import functions as F

from seapoint import chlorophyll_latest
from seapoint.derived import observations, requests_from_orders
from seapoint.operators import steps
from seapoint.operators.latest import admissible_values, day_questions, newest_then_nearest
from seapoint.operators.scan import carried, latest_by_scan, near_cells
from seapoint.sources.products import CHLOROPHYLL
from seapoint.sources.requests import POINT_AND_DAY, as_requests

SF = "/root/testdata/sf0.001"


def same(left, right):
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_carried_against_a_plain_loop(spark):
    rng = random.Random(8)
    at = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    values = [(rng.randrange(3), rng.randrange(20) * 1800, rng.random() if rng.random() > 0.1 else 1.0) for _ in range(90)]
    asks = sorted({(k, rng.choice([rng.randrange(20) * 1800, rng.randrange(43000)])) for k in range(4) for _ in range(40)})
    frame = spark.createDataFrame([(k, at(s), v) for k, s, v in values], "k long, t string, value double")
    wanted = spark.createDataFrame([(k, at(s)) for k, s in asks], "k long, t string")
    cast = F.col("t").cast("timestamp_ntz")
    for hours in (1.0, 1.5, 6.0):
        got = carried(wanted.select("k", cast.alias("time_utc")), frame.select("k", cast.alias("time_utc"), "value"), ["k"], hours)
        got = {(r.k, str(r.time_utc)): r.seen and (str(r.seen.time_utc), r.seen.value) for r in got.collect()}
        want = {}
        for k, s in asks:
            near = [(-t, v) for key, t, v in values if key == k and 0 <= s - t <= hours * 3600]
            want[k, at(s)] = (at(-min(near)[0]), min(near)[1]) if near else None
        assert got == want and any(want.values()) and not all(want.values())


@pytest.mark.parametrize("hot_rows", [250_000, 20])
def test_same_newest_and_nearest(spark, hot_rows):
    asked = day_questions(as_requests(requests_from_orders(spark, SF)), CHLOROPHYLL)
    seen = observations(spark, SF, "chlorophyll")
    scan = latest_by_scan(asked, seen, CHLOROPHYLL, hot_rows)
    pairs = admissible_values(asked, seen, CHLOROPHYLL)
    same(newest_then_nearest(scan, POINT_AND_DAY), newest_then_nearest(pairs, POINT_AND_DAY))
    # One row per question and cell at most, where the pairs have one per instant.
    assert scan.groupBy(*POINT_AND_DAY, "cell_lat", "cell_lon").count().where("count > 1").count() == 0
    assert scan.count() < pairs.count()


def test_exact_age_limit_ties_and_missing_values(spark):
    """The oldest instant that counts, one second older, one second after the day, several values at one instant."""
    end = "2024-01-03 04:59:59"
    rows = [
        (-12.45, -76.79, "2023-12-31 04:59:59", 0.7),
        (-12.45, -76.79, "2023-12-31 04:59:58", 0.1),
        (-12.45, -76.79, "2024-01-03 05:00:00", 9.0),
        (-12.48, -76.79, "2024-01-02 00:00:00", None),
        (-12.48, -76.79, "2024-01-01 00:00:00", 0.4),
        (-12.48, -76.79, "2024-01-01 00:00:00", 0.3),
        (-12.47, -76.79, end, float("nan")),
        (-12.471, -76.91, end, 5.0),
    ]
    seen = spark.createDataFrame(rows, "cell_lat double, cell_lon double, t string, value double").select(
        F.lit(CHLOROPHYLL.dataset_id).alias("dataset_id"),
        F.lit(CHLOROPHYLL.variable).alias("variable"),
        F.col("t").cast("timestamp_ntz").alias("time_utc"),
        F.lit(None).cast("double").alias("depth_m"),
        "cell_lat",
        "cell_lon",
        F.nanvl("value", F.lit(None).cast("double")).alias("value"),
    )
    requests = spark.sql("SELECT 1L AS request_id, -12.471D AS lat, -76.79D AS lon, DATE'2024-01-02' AS date, 0 AS hour_start, 23 AS hour_end")
    asked = day_questions(as_requests(requests), CHLOROPHYLL)
    got = sorted((r.cell_lat, str(r.time_utc), r.value) for r in latest_by_scan(asked, seen, CHLOROPHYLL).collect())
    assert got == [(-12.48, "2024-01-01 00:00:00", 0.3), (-12.45, "2023-12-31 04:59:59", 0.7)]
    same(chlorophyll_latest(requests, seen, by_scan=True), chlorophyll_latest(requests, seen))
    assert latest_by_scan(asked, seen.limit(0), CHLOROPHYLL).count() == 0


def test_readings(spark):
    requests, seen = requests_from_orders(spark, SF), observations(spark, SF, "chlorophyll")
    same(chlorophyll_latest(requests, seen, by_scan=True), chlorophyll_latest(requests, seen))
    same(steps.latest_instants(requests, seen, CHLOROPHYLL, latest_by_scan), steps.latest_instants(requests, seen, CHLOROPHYLL))


def test_plan(spark):
    asked = day_questions(as_requests(requests_from_orders(spark, SF)), CHLOROPHYLL)
    seen = observations(spark, SF, "chlorophyll")
    plan = _plan(latest_by_scan(asked, seen, CHLOROPHYLL))
    for unwanted in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "Python"):
        assert unwanted not in plan
    assert plan.count("Window [") == 1 and "stretch" in plan
    cells = seen.select("cell_lat", "cell_lon").distinct()
    assert "obs_date" not in _plan(near_cells(asked.select(*POINT_AND_DAY, "last_utc"), cells, POINT_AND_DAY, 6.5))
