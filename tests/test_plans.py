"""What the plans must and must not contain, and that splitting hot keys changes nothing."""

import pytest
from pyspark.sql import functions as F

import seapoint.plans.completion as completion
import seapoint.plans.match as matching
import seapoint.plans.skew as skew
from __spark_entry__ import queries
from seapoint import chlorophyll_latest, salinity_series, temperature_series, wave_gate
from seapoint.derived import observations, requests_from_orders
from seapoint.functions.geo import in_box
from seapoint.operators.waves import hour_questions
from seapoint.plans.match import match
from seapoint.plans.skew import hot_keys, split_join
from seapoint.sources.observations import of_product
from seapoint.sources.products import WAVES
from seapoint.sources.requests import POINT_AND_HOURS, as_requests

SF = "/root/testdata/sf0.001"
FAMILIES = [
    (wave_gate, "waves"),
    (temperature_series, "temperature"),
    (salinity_series, "salinity"),
    (chlorophyll_latest, "chlorophyll"),
]


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def same(left, right):
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


# The text preparation queries have plans of their own kind and may be absent.
OWN = sorted(n for n in queries() if n != "pipeline" and n[:3].rstrip("0123456789_") != "op")


@pytest.mark.parametrize("name", OWN)
def test_no_nested_loops_no_python_no_single_task(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    for unwanted in (
        "BroadcastNestedLoopJoin",
        "CartesianProduct",
        "Python",
        "MapInPandas",
        "SinglePartition",
    ):
        assert unwanted not in plan, unwanted


@pytest.mark.parametrize("operator, family", FAMILIES)
def test_questions_are_shuffled_once(spark, operator, family):
    readings = operator(requests_from_orders(spark, SF), observations(spark, SF, family))
    readings.collect()
    final = plan_of(readings).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    # One scan for the questions, one for the completion.
    assert final.count("orders.parquet") == 2


def test_top_one_combines_before_the_shuffle(spark):
    plan = plan_of(wave_gate(requests_from_orders(spark, SF), observations(spark, SF, "waves")))
    assert "partial_min(struct" in plan and "Window" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = (
        wave_gate(requests_from_orders(spark, SF), observations(spark, SF, "waves"))
        ._jdf.queryExecution()
        .explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    )
    assert "struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


def test_tiled_match_equals_the_plain_range_join(spark):
    sf = "/root/testdata/sf0.01"
    asked = hour_questions(as_requests(requests_from_orders(spark, sf)), WAVES).where(
        F.col("date") < "2024-01-06"
    )
    rows = of_product(observations(spark, sf, "waves"), WAVES)
    columns = [*POINT_AND_HOURS, "time_utc", "cell_lat", "cell_lon", "value"]
    tiled = match(asked, rows, POINT_AND_HOURS).select(*columns)
    plain = asked.join(
        rows,
        in_box(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
        & F.col("time_utc").between(F.col("first_utc"), F.col("last_utc")),
    ).select(*columns)
    assert "BroadcastHashJoin" in plan_of(tiled) or "SortMergeJoin" in plan_of(tiled)
    assert plain.count() > 500
    same(tiled, plain)


@pytest.mark.parametrize("tile", [0.1, 1.0])
def test_tile_size_changes_no_pair(spark, tile):
    sf = "/root/testdata/sf0.01"
    asked = hour_questions(as_requests(requests_from_orders(spark, sf)), WAVES)
    rows = of_product(observations(spark, sf, "waves"), WAVES)
    columns = [*POINT_AND_HOURS, "time_utc", "cell_lat", "cell_lon", "value"]
    other = match(asked, rows, POINT_AND_HOURS, tile=tile).select(*columns)
    same(other, match(asked, rows, POINT_AND_HOURS).select(*columns))


@pytest.mark.parametrize("operator, family", FAMILIES)
def test_hot_keys_are_split_without_changing_a_reading(spark, monkeypatch, operator, family):
    """A third of all requests ask the same question, another third crowds one tile and date."""
    base = as_requests(requests_from_orders(spark, SF))
    copies = base.withColumns(
        {
            "request_id": F.col("request_id") + 10_000_000,
            "lat": F.lit(-12.9),
            "lon": F.lit(-77.4),
            "date": F.lit("2024-01-10").cast("date"),
            "hour_start": F.lit(2),
            "hour_end": F.lit(20),
        }
    )
    crowd = base.withColumns(
        {
            "request_id": F.col("request_id") + 20_000_000,
            "lat": F.lit(-12.9) + F.pmod(F.hash("request_id"), F.lit(1000)) * F.lit(0.00002),
            "lon": F.lit(-77.4) + F.pmod(F.hash("request_id"), F.lit(997)) * F.lit(0.00002),
            "date": F.lit("2024-01-10").cast("date"),
        }
    )
    requests = base.unionByName(copies).unionByName(crowd)
    rows = observations(spark, SF, family)
    plain = operator(requests, rows).collect()

    def low_bar(function):
        def run(*args, **kwargs):
            return function(*args, **{**kwargs, "hot_rows": 100})

        return run

    monkeypatch.setattr(f"{operator.__module__}.match", low_bar(matching.match))
    monkeypatch.setattr(f"{operator.__module__}.per_request", low_bar(completion.per_request))
    split = operator(requests, rows).collect()
    assert len(split) == requests.count()
    key = lambda r: r.request_id
    assert sorted(split, key=key) == sorted(plain, key=key)


def test_split_join_spreads_a_hot_key(spark):
    crowded = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    other = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(crowded, ["k"], F.lit(1), 500)
    assert [(r.k, r.n_parts) for r in hot.collect()] == [(7, 4)]
    joined = split_join(crowded, other, ["k"], ["id"], hot)
    same(joined.select("k", "id", "v"), crowded.join(other, "k").select("k", "id", "v"))
    fewer = other.where("k < 100")
    left = split_join(crowded, fewer, ["k"], ["id"], hot, "left")
    same(left.select("k", "id", "v"), crowded.join(fewer, "k", "left").select("k", "id", "v"))


def test_the_list_of_hot_keys_has_a_ceiling(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT", 3)
    crowded = spark.range(3000).select(F.least(F.col("id") % 100, F.lit(90)).alias("k"), "id")
    hot = hot_keys(crowded, ["k"], F.lit(1), 20)
    assert [r.k for r in hot.collect()] == [90, 0, 1]
    other = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = split_join(crowded, other, ["k"], ["id"], hot)
    same(joined.select("k", "id", "v"), crowded.join(other, "k").select("k", "id", "v"))


def test_levels_fold_inside_the_shuffled_match(spark):
    """With both sides shuffled, the fold of the levels adds no exchange on top of the join."""
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in limits:
            spark.conf.set(name, "-1")
        readings = temperature_series(
            requests_from_orders(spark, SF), observations(spark, SF, "temperature")
        )
        plan = plan_of(readings)
    finally:
        for name in limits:
            spark.conf.unset(name)
    lines = plan.splitlines()
    folds = [i for i, line in enumerate(lines) if "min_by(value" in line]
    assert len(folds) == 2 and "partial_min_by" in lines[folds[1]]
    between = lines[folds[0] : folds[1]]
    assert not any("Exchange" in line for line in between)
    join = next(i for i in range(folds[1], len(lines)) if "SortMergeJoin" in lines[i])
    assert not any("Exchange" in line for line in lines[folds[1] : join])


@pytest.mark.parametrize("operator, family", FAMILIES[1:3])
def test_levels_fold_without_sorting(spark, operator, family):
    """Plain numbers are all that the aggregates over the matched rows hold."""
    readings = operator(requests_from_orders(spark, SF), observations(spark, SF, family))
    plan = plan_of(readings)
    assert "min_by(value" in plan and "SortAggregate" not in plan
