"""The tree of tiles finds the pairs of the plain match, and no task gets a crowded tile whole."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from seapoint.derived import observations, requests_from_orders
from seapoint.operators import steps
from seapoint.operators.waves import hour_questions
from seapoint.plans.match import match
from seapoint.plans.tiletree import TREE_KEYS, match_by_tree, split_tiles, tree_sides
from seapoint.sources.observations import of_product
from seapoint.sources.products import WAVES
from seapoint.sources.requests import POINT_AND_HOURS, as_requests

SF = "/root/testdata/sf0.001"
SHOWN = [*POINT_AND_HOURS, "time_utc", "depth_m", "cell_lat", "cell_lon", "value"]


def same(left, right):
    left, right = left.select(*SHOWN), right.select(*SHOWN)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.fixture(scope="module")
def given(spark):
    """Requests and observations, and a third of all observations in one tile of one date, many of them in one cell."""
    asked = hour_questions(as_requests(requests_from_orders(spark, SF)), WAVES)
    seen = of_product(observations(spark, SF, "waves"), WAVES)
    # The tile that holds most points asked for, on one day.
    crowd = spark.range(6000).select(
        F.lit(WAVES.dataset_id).alias("dataset_id"),
        F.lit(WAVES.variable).alias("variable"),
        (
            F.lit("2024-01-05 06:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(secs=(F.col("id") % 1900).cast("double"))
        ).alias("time_utc"),
        F.lit(None).cast("double").alias("depth_m"),
        F.when(F.col("id") % 2 == 0, -12.6).otherwise(-12.74 + (F.col("id") % 49) * 0.0047).alias("cell_lat"),
        F.when(F.col("id") % 2 == 0, -76.9).otherwise(-76.99 + (F.col("id") % 47) * 0.0047).alias("cell_lon"),
        F.col("id").cast("double").alias("value"),
    )
    wanted = [c for c in seen.columns if c in crowd.columns]
    return asked, seen.select(*wanted).unionByName(crowd.select(*wanted)).persist()


@pytest.mark.parametrize("most_rows, depth", [(250_000, 3), (500, 3), (40, 1), (40, 4)])
def test_same_pairs(given, most_rows, depth):
    asked, seen = given
    same(match_by_tree(asked, seen, POINT_AND_HOURS, most_rows=most_rows, depth=depth), match(asked, seen, POINT_AND_HOURS))


def test_crowded_tile_is_bounded(given):
    asked, seen = given
    placed, gridded = tree_sides(asked, seen, POINT_AND_HOURS, most_rows=500)
    for side in (placed, gridded):
        largest = side.groupBy(*TREE_KEYS).count().agg(F.max("count")).first()[0]
        # Parts are dealt by hash, so a part holds a little more than its share at most.
        assert largest <= 700
    plain = seen.groupBy(F.floor(F.col("cell_lat") / 0.25), F.floor(F.col("cell_lon") / 0.25), F.to_date("time_utc"))
    assert plain.count().agg(F.max("count")).first()[0] > 5900
    # One leaf for each observation but for those repeated for the parts of a crowded point.
    assert gridded.where("asked_part = 0").count() == seen.count()
    assert gridded.agg(F.max("level")).first()[0] == 3 and gridded.agg(F.max("seen_part")).first()[0] >= 5


def test_crowded_questions(spark, given):
    _, seen = given
    many = spark.range(3000).select(
        F.col("id").alias("request_id"),
        (F.lit(-12.6) + (F.col("id") % 1000) * 1e-6).alias("lat"),
        (F.lit(-76.9) + F.floor(F.col("id") / 1000) * 1e-6).alias("lon"),
        F.lit("2024-01-05").cast("date").alias("date"),
        F.lit(0).alias("hour_start"),
        F.lit(1).alias("hour_end"),
    )
    asked = hour_questions(as_requests(many), WAVES)
    seen = seen.where("time_utc < '2024-01-05 06:02:00'")
    placed, gridded = tree_sides(asked, seen, POINT_AND_HOURS, most_rows=300)
    assert placed.agg(F.max("asked_part")).first()[0] >= 9
    assert placed.groupBy(*TREE_KEYS).count().agg(F.max("count")).first()[0] <= 450
    same(match_by_tree(asked, seen, POINT_AND_HOURS, most_rows=300), match(asked, seen, POINT_AND_HOURS))


def test_ceiling_of_the_list_changes_no_rows(given, monkeypatch):
    import seapoint.plans.tiletree as tiletree

    asked, seen = given
    monkeypatch.setattr(tiletree, "MOST_HOT", 3)
    points = seen.select(F.floor(F.col("cell_lat") * 32).alias("fine_lat"), F.floor(F.col("cell_lon") * 32).alias("fine_lon"), F.to_date("time_utc").alias("obs_date"))
    nodes = split_tiles(points, 40, 3).select(F.inline("nodes")).collect()
    assert len(nodes) == 3 and min(n.level for n in nodes) == 0
    same(match_by_tree(asked, seen, POINT_AND_HOURS, most_rows=40), match(asked, seen, POINT_AND_HOURS))


def test_plan(given):
    asked, seen = given
    rows = match_by_tree(asked, seen, POINT_AND_HOURS, most_rows=500)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "Window"):
        assert unwanted not in plan
    # Counts are combined before they are shuffled; observations are shuffled once, on all keys of the tree.
    assert "partial_count" in plan and "partial_sum" in plan


def test_missing_coordinates_match_nothing(spark, given):
    asked, seen = given
    odd = seen.limit(5).withColumn("cell_lat", F.lit(None).cast("double")).unionByName(seen.limit(5).withColumn("time_utc", F.lit(None).cast("timestamp_ntz")))
    same(match_by_tree(asked, seen.unionByName(odd), POINT_AND_HOURS, most_rows=500), match(asked, seen, POINT_AND_HOURS))
    assert match_by_tree(asked, seen.limit(0), POINT_AND_HOURS).count() == 0


def test_matched_rows(spark):
    requests, seen = requests_from_orders(spark, SF), observations(spark, SF, "waves")
    tree = steps.matched_rows(requests, seen, WAVES, partial(match_by_tree, most_rows=100))
    assert tree.exceptAll(steps.matched_rows(requests, seen, WAVES)).count() == 0
