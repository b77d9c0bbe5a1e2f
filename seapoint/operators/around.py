"""What lies in and around a window, from one scan of each cell and level: coverage inside, the nearest valid instant on either side.

The pairs of the plain way grow with the questions of a cell times its instants in the widened window. Here a question
meets cells and levels only, and what is asked comes down to distinct (cell, level, window) rows. Each puts two
marks, at its start and at its end, among the instants of the cell. Sorted once in either direction, a mark knows

  * how many rows and how many valid ones come before it: a window's coverage is the difference of its two marks (prefix counts);
  * the last row before the start and the first one after the end, valid or not, and the last and first valid one.

Time is cut into stretches as long as the longest widened window. A row stands in its own stretch and in the next one, so a
widened window lies wholly in the stretch of its end, and a scan holds two stretches of one cell and level, never its history.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seapoint.functions.instants import hours_interval, time_outside
from seapoint.operators.scan import near_cells, stretch_of
from seapoint.plans.skew import HOT_ROWS, hot_keys, split_join
from seapoint.sources.observations import of_product
from seapoint.sources.products import Product
from seapoint.sources.requests import POINT_AND_HOURS

_LEVEL = ["cell_lat", "cell_lon", "depth_m"]
_WINDOW = ["first_utc", "last_utc"]
_DAY_HOURS = 24.0
_START, _ROW, _END = 0, 1, 2


def around(windows: DataFrame, rows: DataFrame, keys: list[str], reach_hours: float) -> DataFrame:
    """The distinct ``windows(keys, first_utc, last_utc)``, each a window of at most a day widened by ``reach_hours``, that hold any
    row of ``rows(keys, time_utc, value)``, with ``n_valid`` inside and the nearest valid ``before_time, before_value, after_time,
    after_value`` outside, NULL where there is none. Of several values at one instant the smallest one counts.
    """
    reach = hours_interval(reach_hours)
    length = _DAY_HOURS + 2 * reach_hours
    own = stretch_of(F.col("time_utc"), length)
    nothing = F.lit(None).cast("timestamp_ntz")
    placed = rows.select(
        *keys,
        F.explode(F.array(own, own + 1)).alias("stretch"),
        "time_utc",
        F.lit(_ROW).alias("kind"),
        "value",
        *[nothing.alias(c) for c in _WINDOW],
    )
    ends = F.array(
        F.struct((F.col("first_utc") + reach).alias("time_utc"), F.lit(_START).alias("kind")),
        F.struct((F.col("last_utc") - reach).alias("time_utc"), F.lit(_END).alias("kind")),
    )
    marks = windows.select(
        *keys, stretch_of(F.col("last_utc"), length).alias("stretch"), *_WINDOW, F.explode(ends).alias("m")
    ).select(
        *keys, "stretch", "m.time_utc", "m.kind", F.lit(None).cast("double").alias("value"), *_WINDOW
    )
    # Spark normalises keys that are fractions anew in each step and would shuffle for each. With one shuffle
    # by a number that stands for them, all that follows groups within its partitions.
    # Sorting in both directions takes some thirty times what the shuffle reads. A given number of partitions is
    # not gathered into few large ones.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scan = ["place", *keys, "stretch"]
    united = (
        placed.unionByName(marks)
        .withColumn("place", F.xxhash64(*keys))
        .repartition(parts, "place", "stretch")
        .groupBy(*scan, "time_utc", "kind", *_WINDOW)
        .agg(F.min("value").alias("value"))
    )
    part = Window.partitionBy(*scan)
    # A row at the very start or end of a window lies inside it: after the one mark, before the other.
    past = part.orderBy("time_utc", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = part.orderBy(F.desc("time_utc"), F.desc("kind")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    is_row = F.col("kind") == _ROW
    row_time = F.when(is_row, F.col("time_utc"))
    valid = F.when(is_row & F.col("value").isNotNull(), F.struct("time_utc", "value"))
    scanned = united.withColumns(
        {
            "rows_seen": F.count(row_time).over(past),
            "valid_seen": F.count(valid).over(past),
            "past_row": F.last(row_time, True).over(past),
            "past_valid": F.last(valid, True).over(past),
            "next_row": F.last(row_time, True).over(future),
            "next_valid": F.last(valid, True).over(future),
        }
    ).where(~is_row)

    def at(kind: int, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    def inside_reach(side: str, edge: str, column: str):
        is_reached = (
            F.col(f"{side}_time") >= F.col(edge) if side == "before" else F.col(f"{side}_time") <= F.col(edge)
        )
        return F.when(is_reached, F.col(column)).alias(column)

    per_window = scanned.groupBy(*scan, *_WINDOW).agg(
        (F.max("rows_seen") - F.min("rows_seen")).alias("n_rows"),
        (F.max("valid_seen") - F.min("valid_seen")).alias("n_valid"),
        at(_START, "past_row").alias("past_row"),
        at(_END, "next_row").alias("next_row"),
        at(_START, "past_valid.time_utc").alias("before_time"),
        at(_START, "past_valid.value").alias("before_value"),
        at(_END, "next_valid.time_utc").alias("after_time"),
        at(_END, "next_valid.value").alias("after_value"),
    )
    holds_rows = (
        (F.col("n_rows") > 0)
        | (F.col("past_row") >= F.col("first_utc"))
        | (F.col("next_row") <= F.col("last_utc"))
    )
    return per_window.where(holds_rows).select(
        *keys,
        *_WINDOW,
        "n_valid",
        inside_reach("before", "first_utc", "before_value"),
        inside_reach("before", "first_utc", "before_time"),
        inside_reach("after", "last_utc", "after_value"),
        inside_reach("after", "last_utc", "after_time"),
    )


def answers_by_scan(
    asked: DataFrame, observations: DataFrame, product: Product, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per question with any row: the best covered cell ``inside`` its window and the nearest valid sample ``outside`` it.

    The structs have the fields of the plain way (``by_question``) but for the samples, which a scan does not list.
    """
    rows = of_product(observations, product).select(*_LEVEL, "time_utc", "value")
    # Far cells count too: their rows decide which level is the shallowest.
    pairs = near_cells(
        asked.select(*POINT_AND_HOURS, *_WINDOW),
        rows.select(*_LEVEL).distinct(),
        POINT_AND_HOURS,
        float("inf"),
        hot_rows=hot_rows,
    )
    keys = [*_LEVEL, *_WINDOW]
    found = around(pairs.select(*keys).distinct(), rows, _LEVEL, product.max_offset_h)
    # A cell and window that very many questions share is cut into parts.
    hot = hot_keys(pairs, keys, F.lit(1), hot_rows)
    reach = hours_interval(product.max_offset_h)
    start, end = F.col("first_utc") + reach, F.col("last_utc") - reach
    before = time_outside(F.col("before_time"), start, end)
    after = time_outside(F.col("after_time"), start, end)
    # As near on both sides: the one before.
    is_after = F.col("before_time").isNull() | (F.col("after_time").isNotNull() & (after < before))
    cells = (
        split_join(pairs, found, keys, list(POINT_AND_HOURS), hot)
        .withColumn("is_near", F.col("distance_km") <= product.max_cell_km)
        .withColumn("is_after", is_after)
        .withColumn("time_utc", F.when(F.col("is_after"), F.col("after_time")).otherwise(F.col("before_time")))
        .withColumn("value", F.when(F.col("is_after"), F.col("after_value")).otherwise(F.col("before_value")))
        .withColumn("offset", time_outside(F.col("time_utc"), start, end))
    )
    place = ["distance_km", "cell_lat", "cell_lon"]
    inside = F.struct(
        "depth_m",
        (~F.col("is_near") | (F.col("n_valid") == 0)).alias("is_void"),
        (-F.col("n_valid")).alias("minus_count"),
        *place,
    )
    outside = F.struct(
        "depth_m",
        (~F.col("is_near") | F.col("time_utc").isNull()).alias("is_void"),
        "offset",
        "is_after",
        "time_utc",
        *place,
        "value",
    )
    return cells.groupBy(*POINT_AND_HOURS).agg(
        F.min(inside).alias("inside"), F.min(outside).alias("outside")
    )
