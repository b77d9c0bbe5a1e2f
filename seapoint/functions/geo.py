"""Distances and tile keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius (km), half-width of the search box (degrees).
EARTH_RADIUS_KM = 6371.0088
HALF_WIDTH_DEG = 0.05

# Tile size: a question is shuffled once per tile its box touches, and compared with all rows of
# those tiles. Wider tiles mean fewer copies and more comparisons, and a comparison is far
# cheaper: at 0.25 a box of 0.1 touches 2 tiles on average (4 at 0.1).
TILE_DEG = 0.25


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance between two points given in degrees."""
    half_chord = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(half_chord))


def in_box(
    lat: Column, lon: Column, cell_lat: Column, cell_lon: Column, half_width: float = HALF_WIDTH_DEG
) -> Column:
    """Whether a cell lies in the closed box around a point."""
    return cell_lat.between(lat - half_width, lat + half_width) & cell_lon.between(
        lon - half_width, lon + half_width
    )


def tile_of(degrees: Column, tile: float = TILE_DEG) -> Column:
    """The one tile that holds a coordinate."""
    return F.floor(degrees / F.lit(tile))


def tiles_of_box(
    degrees: Column, half_width: float = HALF_WIDTH_DEG, tile: float = TILE_DEG
) -> Column:
    """All tiles that a box side touches.

    The ends are the same expressions as in ``in_box`` and ``floor(x / tile)`` never decreases,
    so rounding cannot put a cell of the box outside these tiles.
    """
    return F.sequence(tile_of(degrees - half_width, tile), tile_of(degrees + half_width, tile))
