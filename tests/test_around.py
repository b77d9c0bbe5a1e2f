"""One scan of a cell and level answers what the pairs do: coverage inside a window, the nearest valid instant around it."""

import random

import pytest
from pyspark.sql import functions as F

from seapoint.derived import observations, requests_from_orders
from seapoint.operators import steps
from seapoint.operators.around import answers_by_scan, around
from seapoint.operators.series import by_level_and_cell, by_question, classified, widened_questions
from seapoint.sources.products import SALINITY, TEMPERATURE
from seapoint.sources.requests import POINT_AND_HOURS, as_requests

SF = "/root/testdata/sf0.001"
EPOCH = "2024-01-01"
FACTS = [
    *POINT_AND_HOURS,
    *[f"inside.{c}" for c in ("depth_m", "is_void", "minus_count", "distance_km", "cell_lat", "cell_lon")],
]
BESIDE = [f"outside.{c}" for c in ("offset", "is_after", "time_utc", "distance_km", "cell_lat", "cell_lon", "value")]


def same(left, right):
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def compared(answers):
    inside = answers.select(*[F.col(c).alias(c.replace(".", "_")) for c in FACTS]).withColumn(
        "inside_minus_count", F.col("inside_minus_count").cast("long")
    )
    beside = answers.where("NOT outside.is_void").select(
        *POINT_AND_HOURS, *[F.col(c).alias(c.replace(".", "_")) for c in BESIDE]
    )
    return inside, beside


def by_pairs(asked, seen, product):
    return by_question(by_level_and_cell(classified(asked, seen, product), product))


def at(seconds):
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def test_scan_is_not_gathered(spark):
    """However little the shuffle seems to hold, the scan keeps its partitions: sorting in both directions takes many times that."""
    rows = spark.range(400).select((F.col("id") % 80).alias("k"), at(F.col("id") * 60).alias("time_utc"), F.lit(1.0).alias("value"))
    asked = spark.range(80).select(F.col("id").alias("k"), at(F.lit(0)).alias("first_utc"), at(F.lit(80_000)).alias("last_utc"))
    found = around(asked, rows, ["k"], 1.0).withColumn("partition", F.spark_partition_id()).collect()
    assert len(found) == 80 and len({r.partition for r in found}) > 4


@pytest.mark.parametrize("reach", [0.5, 3.0])
def test_around_against_a_plain_loop(spark, reach):
    rng = random.Random(4)
    # Full half hours, so that instants meet the edges exactly; some twice, some missing.
    rows = [
        (rng.randrange(3), 1800 * rng.randrange(200), None if rng.random() < 0.4 else rng.randrange(9) / 2)
        for _ in range(120)
    ]
    windows = set()
    for _ in range(200):
        start = 1800 * rng.randrange(180)
        windows.add((rng.randrange(4), start, start + rng.choice([1, 1800, 9000, 86399])))
    margin = int(reach * 3600)
    frame = spark.createDataFrame(rows, "k long, s long, value double").select("k", at(F.col("s")).alias("time_utc"), "value")
    asked = spark.createDataFrame(sorted(windows), "k long, a long, b long").select(
        "k", at(F.col("a") - margin).alias("first_utc"), at(F.col("b") + margin).alias("last_utc")
    )
    since = {c: F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(c)) for c in ("first_utc", "last_utc", "before_time", "after_time")}
    got = {
        (r.k, r.first_utc + margin, r.last_utc - margin): (r.n_valid, r.before_time, r.before_value, r.after_time, r.after_value)
        for r in around(asked, frame, ["k"], reach).withColumns(since).collect()
    }
    value = {}
    for k, s, v in rows:
        known = value.setdefault((k, s), v)
        value[k, s] = v if known is None else known if v is None else min(known, v)
    want = {}
    for k, a, b in windows:
        own = {s: v for (key, s), v in value.items() if key == k and a - margin <= s <= b + margin}
        valid = {s: v for s, v in own.items() if v is not None}
        before, after = max((s for s in valid if s < a), default=None), min((s for s in valid if s > b), default=None)
        if own:
            want[k, a, b] = (sum(a <= s <= b for s in valid), before, valid.get(before), after, valid.get(after))
    assert got == want
    assert len({w[0] for w in want.values()}) > 2 and any(w[1] is None for w in want.values()) and any(w[3] is not None for w in want.values())


@pytest.mark.parametrize("family, product", [("temperature", TEMPERATURE), ("salinity", SALINITY)])
@pytest.mark.parametrize("hot_rows", [250_000, 5])
def test_same_answers_as_the_pairs(spark, family, product, hot_rows):
    asked = widened_questions(as_requests(requests_from_orders(spark, SF)), product)
    seen = observations(spark, SF, family)
    for left, right in zip(
        compared(answers_by_scan(asked, seen, product, hot_rows)), compared(by_pairs(asked, seen, product)), strict=True
    ):
        same(left, right)


def test_ties_levels_and_missing_values(spark):
    """Equally near before and after; a deep level alone nearby, a shallow one far off; only missing values; nothing."""
    rows = [
        # As near on both sides of 12:00:00 - 12:59:59 local (17:00:00 - 17:59:59 UTC).
        (-12.47, -76.79, "2024-01-02 16:00:00", 0.4, 20.0),
        (-12.47, -76.79, "2024-01-02 18:59:59", 0.4, 21.0),
        # The nearer cell has the same offset: it wins over the farther one.
        (-12.471, -76.79, "2024-01-02 16:00:00", 0.4, 22.0),
        # One second beyond the reach.
        (-12.47, -76.79, "2024-01-02 13:59:59", 0.4, 1.0),
        # A shallower level in a far cell of the box leaves the near deep one without a say.
        (-14.01, -76.79, "2024-01-02 17:30:00", 0.45, 15.0),
        (-14.069, -76.741, "2024-01-02 17:30:00", 0.3, 16.0),
        (-16.0, -76.79, "2024-01-02 17:30:00", 0.4, None),
    ]
    seen = spark.createDataFrame(rows, "cell_lat double, cell_lon double, t string, depth_m double, value double").select(
        F.lit(TEMPERATURE.dataset_id).alias("dataset_id"),
        F.lit(TEMPERATURE.variable).alias("variable"),
        F.col("t").cast("timestamp_ntz").alias("time_utc"),
        "depth_m",
        "cell_lat",
        "cell_lon",
        "value",
    )
    requests = spark.sql(
        "SELECT id AS request_id, CAST(lat AS DOUBLE) AS lat, -76.79D AS lon, DATE'2024-01-02' AS date, 12 AS hour_start, 12 AS hour_end "
        "FROM VALUES (1L, -12.471), (2L, -14.02), (3L, -16.0), (4L, -40.0) AS t(id, lat)"
    )
    asked = widened_questions(as_requests(requests), TEMPERATURE)
    scan = answers_by_scan(asked, seen, TEMPERATURE)
    for left, right in zip(compared(scan), compared(by_pairs(asked, seen, TEMPERATURE)), strict=True):
        same(left, right)
    outside = [(r.lat, str(r.outside.time_utc), r.outside.value) for r in scan.where("NOT outside.is_void").collect()]
    assert outside == [(-12.471, "2024-01-02 16:00:00", 22.0)]
    assert {r.lat for r in scan.collect()} == {-12.471, -14.02, -16.0}
    assert scan.where("NOT inside.is_void").count() == 0
    assert answers_by_scan(asked, seen.limit(0), TEMPERATURE).count() == 0


def test_scan_does_not_pair_instants(spark):
    """One window per direction over one exchange; no question meets an instant."""
    asked = widened_questions(as_requests(requests_from_orders(spark, SF)), TEMPERATURE)
    seen = observations(spark, SF, "temperature")
    plan = answers_by_scan(asked, seen, TEMPERATURE)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "Python", "obs_date"):
        assert unwanted not in plan
    lines = plan.splitlines()
    scans = [i for i, line in enumerate(lines) if "Window [" in line]
    assert len(scans) == 2 and not any("Exchange" in line for line in lines[scans[0] : scans[1]])
    # A window's own rows are folded where they were scanned.
    fold = max(i for i, line in enumerate(lines[: scans[0]]) if "HashAggregate" in line and "partial_" not in line)
    assert not any("Exchange" in line for line in lines[fold : scans[0]])


def test_steps(spark):
    requests, seen = requests_from_orders(spark, SF), observations(spark, SF, "temperature")
    for step in (steps.best_covered_cell, steps.nearest_outside):
        same(step(requests, seen, TEMPERATURE, answers_by_scan), step(requests, seen, TEMPERATURE))
