"""Coordinate predicates and grid snapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import GRID_SIZE, POINT_BOX
from .calendar import col_of


def in_box(lat, lon, inclusive: bool) -> Column:
    """P-10. Point maps use an open box, the grid rollup a closed one."""
    lat_min, lat_max, lon_min, lon_max = POINT_BOX
    la, lo = col_of(lat), col_of(lon)
    if inclusive:
        return la.between(lat_min, lat_max) & lo.between(lon_min, lon_max)
    return (la > lat_min) & (la < lat_max) & (lo > lon_min) & (lo < lon_max)


def cell_id(x, size: float = GRID_SIZE) -> Column:
    """Integer cell index, truncating toward zero (-122.419 -> -12241)."""
    return (col_of(x) / F.lit(size)).cast("int")


def cell_origin(x, size: float = GRID_SIZE) -> Column:
    """P-14: cell corner as a double, ``int(x / size) * size``."""
    return cell_id(x, size) * F.lit(size)
