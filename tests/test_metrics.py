"""Figures that come with a job equal those counted by queries of their own."""

import pytest
from pyspark.sql import functions as F

from seapoint import WAVES, chlorophyll_latest, temperature_series, wave_gate
from seapoint.derived import flawed_requests, observations, requests_from_orders
from seapoint.operators import steps
from seapoint.plans.metrics import REASONS, observed_readings, observed_requests

SF = "/root/testdata/sf0.001"


def counted(spark):
    reasons = steps.request_validation(flawed_requests(spark, SF)).groupBy("reason").count().collect()
    found = {r.reason: r["count"] for r in reasons}
    return {"requests": sum(found.values())} | {f"rejected_{name}": found.get(name, 0) for name in REASONS}


def test_rejected_by_reason(spark, tmp_path):
    usable, seen = observed_requests(flawed_requests(spark, SF))
    usable.write.parquet(str(tmp_path / "usable"))
    want = counted(spark)
    assert seen.get == want and all(want[f"rejected_{name}"] for name in REASONS)
    assert spark.read.parquet(str(tmp_path / "usable")).count() == want["requests"] - sum(want[f"rejected_{n}"] for n in REASONS)
    nothing, seen = observed_requests(flawed_requests(spark, SF).limit(0))
    assert nothing.collect() == [] and set(seen.get.values()) == {0}


@pytest.mark.parametrize(
    ("operator", "family"), [(wave_gate, "waves"), (temperature_series, "temperature"), (chlorophyll_latest, "chlorophyll")]
)
def test_no_data_per_family(spark, tmp_path, operator, family):
    """Both figures come with the one job that writes the readings, though the requests are used in several places."""
    usable, rejected = observed_requests(flawed_requests(spark, SF))
    plain = operator(usable, observations(spark, SF, family))
    readings, seen = observed_readings(plain)
    readings.write.parquet(str(tmp_path / "readings"))
    stored = spark.read.parquet(str(tmp_path / "readings"))
    by_status = {r.status: r.n_readings for r in steps.count_statuses({family: stored}).collect()}
    assert seen.get == {"readings": sum(by_status.values()), "no_data": by_status.get("sin_datos", 0)}
    assert rejected.get == counted(spark)


def test_figures_need_no_second_scan(spark):
    requests = requests_from_orders(spark, SF)
    plain = wave_gate(requests, observations(spark, SF, "waves"))
    readings, _ = observed_readings(plain)
    scans = [x._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") for x in (plain, readings)]
    assert scans[0] == scans[1] > 0 and readings.schema == plain.schema
    assert readings.where(F.col("variable") != WAVES.variable).count() == 0
