"""The point-by-grid join over a tree of tiles, for archives and questions that crowd in few places.

The plain match hashes on fixed tiles and dates, so a tile-date with a third of all observations is one
task's work. Here rows are counted by the finest tile first; a tile of a date that holds more than
``most_rows`` is split into quarters, and those again, down to ``depth`` levels. Observations go to their one
leaf, a question to the leaves that its box touches. What is still crowded at the lowest level (one cell with very
many instants or levels, one point asked for by very many questions) is cut into parts: each side is
dealt to its own parts and repeated for the parts of the other, so every pair meets exactly once.

The list of split tiles and that of crowded leaves are broadcast and have a fixed ceiling, the most crowded ones first (a tile
comes before its quarters). What is beyond it stays whole; that changes the plan and not the rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seapoint.functions.geo import HALF_WIDTH_DEG, TILE_DEG, in_box, tile_of
from seapoint.plans.skew import HOT_ROWS, MOST_HOT

DEPTH = 3
LEAF = ("level", "tile_lat", "tile_lon", "obs_date")
#: A question, a cell and an instant meet on exactly one combination of these.
TREE_KEYS = (*LEAF, "asked_part", "seen_part")
_BASE = ["base_lat", "base_lon", "obs_date"]


def _up(tile: Column, levels: int | Column) -> Column:
    """The tile so many levels higher that holds a tile (the shift rounds down, below zero too)."""
    return F.call_function("shiftright", tile, F.lit(levels) if isinstance(levels, int) else levels)


def _node(level: int, lat: Column, lon: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), lat.alias("lat"), lon.alias("lon"))


def split_tiles(points: DataFrame, most_rows: int, depth: int) -> DataFrame:
    """Per base tile and date, the ``nodes`` of the tree that are split, of ``points(fine_lat, fine_lon, obs_date)``."""
    finest = points.groupBy("fine_lat", "fine_lon", "obs_date").agg(F.count(F.lit(1)).alias("n"))
    higher = depth - F.col("level")
    nodes = (
        finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
        .groupBy(
            "level",
            _up(F.col("fine_lat"), higher).alias("lat"),
            _up(F.col("fine_lon"), higher).alias("lon"),
            "obs_date",
        )
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > most_rows)
        # A tile holds no fewer rows than its quarters, so it is in the list whenever one of them is.
        .orderBy(F.desc("n"), "level", "lat", "lon", "obs_date")
        .limit(MOST_HOT)
    )
    return nodes.groupBy(
        _up(F.col("lat"), F.col("level")).alias("base_lat"),
        _up(F.col("lon"), F.col("level")).alias("base_lon"),
        "obs_date",
    ).agg(F.collect_list(F.struct("level", "lat", "lon")).alias("nodes"))


def _observed_leaf(tree: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """Each observation in its leaf."""
    held = rows.withColumns(
        {
            "base_lat": _up(F.col("fine_lat"), depth),
            "base_lon": _up(F.col("fine_lon"), depth),
        }
    ).join(F.broadcast(tree), _BASE, "left")
    level = F.lit(0)
    for k in range(depth):
        node = _node(k, _up(F.col("fine_lat"), depth - k), _up(F.col("fine_lon"), depth - k))
        level = level + F.coalesce(F.array_contains("nodes", node), F.lit(False)).cast("int")
    return (
        held.withColumn("level", level)
        .withColumns(
            {
                "tile_lat": _up(F.col("fine_lat"), depth - F.col("level")),
                "tile_lon": _up(F.col("fine_lon"), depth - F.col("level")),
            }
        )
        .drop("fine_lat", "fine_lon", "base_lat", "base_lon", "nodes")
    )


def _asked_leaves(tree: DataFrame, asked: DataFrame, half_width: float, fine: float, depth: int) -> DataFrame:
    """Each question in all leaves that its box touches."""
    sides = {}
    for side in ("lat", "lon"):
        sides[f"low_{side}"] = tile_of(F.col(side) - half_width, fine)
        sides[f"high_{side}"] = tile_of(F.col(side) + half_width, fine)
    placed = asked.withColumns(sides)
    for side in ("lat", "lon"):
        ends = (_up(F.col(f"{end}_{side}"), depth) for end in ("low", "high"))
        placed = placed.withColumn(f"base_{side}", F.explode(F.sequence(*ends)))
    placed = placed.withColumn(
        "obs_date", F.explode(F.sequence(F.to_date("first_utc"), F.to_date("last_utc")))
    ).join(F.broadcast(tree), _BASE, "left")

    leaves = F.array(_node(0, F.col("base_lat"), F.col("base_lon")))
    unsplit = leaves
    for k in range(depth):
        leaves = F.flatten(F.transform(leaves, _descent(k, depth)))
    leaf = F.explode(F.when(F.col("nodes").isNull(), unsplit).otherwise(leaves))
    return (
        placed.withColumn("leaf", leaf)
        .withColumns(
            {
                "level": F.col("leaf.level"),
                "tile_lat": F.col("leaf.lat"),
                "tile_lon": F.col("leaf.lon"),
            }
        )
        .drop("leaf", "nodes", "base_lat", "base_lon", *sides)
    )


def _descent(k: int, depth: int):
    """From a tile of level ``k`` to those of its quarters that a box touches, if it is split."""

    def touched(child: Column) -> Column:
        return child["lat"].between(
            _up(F.col("low_lat"), depth - k - 1), _up(F.col("high_lat"), depth - k - 1)
        ) & child["lon"].between(
            _up(F.col("low_lon"), depth - k - 1), _up(F.col("high_lon"), depth - k - 1)
        )

    def down(node: Column) -> Column:
        quarters = F.array(
            *[_node(k + 1, node["lat"] * 2 + i, node["lon"] * 2 + j) for i in (0, 1) for j in (0, 1)]
        )
        is_split = (node["level"] == k) & F.array_contains("nodes", node)
        return F.when(is_split, F.filter(quarters, touched)).otherwise(F.array(node))

    return down


def _crowded_leaves(placed: DataFrame, gridded: DataFrame, most_rows: int) -> DataFrame:
    """Leaves that are crowded on one side or both, and into how many parts to cut each side."""
    one, none = F.lit(1).alias, F.lit(0).alias
    counted = (
        placed.select(*LEAF, one("asked"), none("seen"))
        .unionByName(gridded.select(*LEAF, none("asked"), one("seen")))
        .groupBy(*LEAF)
        .agg(F.sum("asked").alias("asked"), F.sum("seen").alias("seen"))
        # A leaf with one side only has no pairs.
        .where((F.greatest("asked", "seen") > most_rows) & (F.least("asked", "seen") > 0))
    )
    return (
        counted.orderBy(F.desc(F.greatest("asked", "seen")), *LEAF)
        .limit(MOST_HOT)
        .select(
            *LEAF,
            F.ceil(F.col("asked") / most_rows).alias("asked_parts"),
            F.ceil(F.col("seen") / most_rows).alias("seen_parts"),
        )
    )


def _dealt(rows: DataFrame, crowded: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
    """Rows of a crowded leaf in one part of their own side and in all parts of the other."""
    n_own, n_other = (F.coalesce(F.col(f"{side}_parts"), F.lit(1)) for side in (own, other))
    return (
        rows.join(F.broadcast(crowded), list(LEAF), "left")
        .withColumn(f"{own}_part", F.pmod(F.xxhash64(*by), n_own))
        .withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("bigint"), n_other - 1)))
        .drop("asked_parts", "seen_parts")
    )


def tree_sides(
    asked: DataFrame,
    observations: DataFrame,
    question: tuple[str, ...],
    half_width: float = HALF_WIDTH_DEG,
    tile: float = TILE_DEG,
    most_rows: int = HOT_ROWS,
    depth: int = DEPTH,
) -> tuple[DataFrame, DataFrame]:
    """Questions and observations with their ``TREE_KEYS``, ready to be joined."""
    fine = tile / 2**depth
    asked = asked.select(*question, "first_utc", "last_utc")
    gridded = observations.select("time_utc", "depth_m", "cell_lat", "cell_lon", "value").withColumns(
        {
            "fine_lat": tile_of(F.col("cell_lat"), fine),
            "fine_lon": tile_of(F.col("cell_lon"), fine),
            "obs_date": F.to_date("time_utc"),
        }
    )
    # A question counts where its point is; only the shape of the tree depends on that.
    centres = asked.select(
        tile_of(F.col("lat"), fine).alias("fine_lat"),
        tile_of(F.col("lon"), fine).alias("fine_lon"),
        F.explode(F.sequence(F.to_date("first_utc"), F.to_date("last_utc"))).alias("obs_date"),
    )
    points = gridded.select("fine_lat", "fine_lon", "obs_date").unionByName(centres)
    tree = split_tiles(points, most_rows, depth)
    placed = _asked_leaves(tree, asked, half_width, fine, depth)
    gridded = _observed_leaf(tree, gridded, depth)
    crowded = _crowded_leaves(placed, gridded, most_rows)
    return (
        _dealt(placed, crowded, "asked", "seen", list(question)),
        _dealt(gridded, crowded, "seen", "asked", ["cell_lat", "cell_lon", "time_utc", "depth_m"]),
    )


def match_by_tree(
    asked: DataFrame,
    observations: DataFrame,
    question: tuple[str, ...],
    half_width: float = HALF_WIDTH_DEG,
    tile: float = TILE_DEG,
    most_rows: int = HOT_ROWS,
    depth: int = DEPTH,
) -> DataFrame:
    """The pairs of ``match``, found over the tree; the keys that they met on are ``TREE_KEYS``."""
    placed, gridded = tree_sides(asked, observations, question, half_width, tile, most_rows, depth)
    return placed.join(gridded, list(TREE_KEYS)).where(
        in_box(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"), half_width)
        & F.col("time_utc").between(F.col("first_utc"), F.col("last_utc"))
    )
