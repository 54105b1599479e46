"""Distance joins by grid blocking.

The build side is put into one latitude band and one longitude cell; the probe side is
expanded to the few cells a circle around it can touch. The join is then an equi-join
on the cell (plus any match keys), with the exact distance as a residual filter.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km
from ..functions.num import rnd

KM_PER_DEGREE = 111.19


def _num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _band_width(band: Column, degrees: Column) -> Column:
    """Longitude width of a cell in a band, wide enough at the band's far edge."""
    edge = F.greatest(F.abs(band * degrees), F.abs((band + 1) * degrees))
    return degrees / F.greatest(F.cos(F.radians(edge)), F.lit(0.05))


def with_cell(df: DataFrame, lat: str, lon: str, radius_km: float | Column) -> DataFrame:
    deg = _num(radius_km) / F.lit(KM_PER_DEGREE)
    band = F.floor(F.col(lat) / deg)
    return (df.withColumn("_band", band)
              .withColumn("_cell", F.floor(F.col(lon) / _band_width(F.col("_band"), deg))))


def with_probe_cells(df: DataFrame, lat: str, lon: str, radius_km: float | Column, within_km: float | Column | None = None) -> DataFrame:
    """Every cell that a circle around the row can touch, over the poles and across +-180 too. The
    radius may differ by row; cells of different radii are different grids. ``within_km`` is a circle
    smaller than the radius that the grid is made for."""
    deg, angle = _num(radius_km) / F.lit(KM_PER_DEGREE), _num(radius_km if within_km is None else within_km) / F.lit(EARTH_KM)
    over_pole = F.abs(F.col(lat)) + F.degrees(angle) >= 90.0
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.least(angle, F.lit(math.pi / 2)))
                                    / F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-9))))) + F.lit(1e-6)
    reach = F.when(over_pole | (angle >= math.pi / 2), 180.0).otherwise(F.least(side, F.lit(180.0)))
    tall = F.degrees(angle) + F.lit(1e-6)
    low, high = F.floor((F.col(lat) - tall) / deg), F.floor((F.col(lat) + tall) / deg)
    out = df.withColumn("_reach", reach).withColumn("_band", F.explode(F.sequence(low, high)))
    out = out.withColumn("_width", _band_width(F.col("_band"), deg))
    last, first = F.floor(F.lit(180.0) / F.col("_width")), F.floor(F.lit(-180.0) / F.col("_width"))

    def between(shift):
        lo = F.greatest(F.floor((F.col(lon) + shift - F.col("_reach")) / F.col("_width")), first)
        hi = F.least(F.floor((F.col(lon) + shift + F.col("_reach")) / F.col("_width")), last)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    # one short expression for every side of the map: the JVM does not compile generated methods that grow too long
    passes = F.abs(F.col(lon)) + F.col("_reach") >= 180.0            # only there the other sides of the map count
    shifts = F.when(passes, F.array(*[F.lit(s) for s in (-360.0, 0.0, 360.0)])).otherwise(F.array(F.lit(0.0)))
    cells = F.array_distinct(F.flatten(F.transform(shifts, between)))
    return out.withColumn("_cell", F.explode(cells)).drop("_reach", "_width")


def near_pairs(probe: DataFrame, build: DataFrame, radius_km: float,
               probe_at=("to_lat", "to_lon"), build_at=("from_lat", "from_lon"),
               on: list[str] | None = None) -> DataFrame:
    """Pairs of probe and build rows within the radius and equal on ``on``; adds the
    exact ``km`` and ``distance_km`` rounded to 0.1."""
    left = with_probe_cells(probe.filter(F.col(probe_at[0]).isNotNull()), *probe_at, radius_km)
    right = with_cell(build.filter(F.col(build_at[0]).isNotNull()), *build_at, radius_km)
    pairs = left.join(right, [*(on or []), "_band", "_cell"]).drop("_band", "_cell")
    return (pairs.withColumn("km", haversine_km(*probe_at, *build_at))
                 .filter(F.col("km") <= F.lit(float(radius_km)))
                 .withColumn("distance_km", rnd("km", 1)))

