"""Map datum conversion, planar distance and coordinate checks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# City centre, kilometres per degree, ellipsoid, study region.
CENTRE = (121.4737, 31.2304)
KM_PER_DEGREE = (111.32, 110.57)
SEMI_MAJOR = 6378245.0
ECCENTRICITY = 0.006693421622965943
REGION = (120.8, 122.2, 30.5, 31.9)
# Fixed values of the published datum shift: constant, x, y, quadratic, xy, root and
# the (amplitude, frequency in units of pi) pairs of its three wave groups.
LAT_SHIFT = {
    "linear": (-100.0, 2.0, 3.0), "quadratic": 0.2, "cross": 0.1, "root": 0.2,
    "waves_x": ((20.0, 6.0), (20.0, 2.0)),
    "waves": ((20.0, 1.0), (40.0, 1.0 / 3.0), (160.0, 1.0 / 12.0), (320.0, 1.0 / 30.0)),
}
LON_SHIFT = {
    "linear": (300.0, 1.0, 2.0), "quadratic": 0.1, "cross": 0.1, "root": 0.1,
    "waves_x": ((20.0, 6.0), (20.0, 2.0)),
    "waves": ((20.0, 1.0), (40.0, 1.0 / 3.0), (150.0, 1.0 / 12.0), (300.0, 1.0 / 30.0)),
}


def planar_km(lon: Column, lat: Column, centre: tuple[float, float] = CENTRE) -> Column:
    """Equirectangular distance to ``centre``."""
    dx = (lon - centre[0]) * KM_PER_DEGREE[0] * F.cos(F.radians(lat))
    dy = (lat - centre[1]) * KM_PER_DEGREE[1]
    return F.sqrt(dx * dx + dy * dy)


def _shift(x: Column, y: Column, own: Column, spec: dict) -> Column:
    c0, cx, cy = spec["linear"]
    total = c0 + cx * x + cy * y + spec["quadratic"] * own * own
    total = total + spec["cross"] * x * y + spec["root"] * F.sqrt(F.abs(x))
    for axis, waves in ((x, spec["waves_x"]), (own, spec["waves"])):
        for amplitude, frequency in waves:
            total = total + (2.0 / 3.0) * amplitude * F.sin(axis * (frequency * math.pi))
    return total


def wgs84_to_gcj02(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lon - 105.0, lat - 35.0
    phi = F.radians(lat)
    curvature = 1.0 - ECCENTRICITY * F.pow(F.sin(phi), 2)
    north = SEMI_MAJOR * (1.0 - ECCENTRICITY) / (curvature * F.sqrt(curvature))
    east = SEMI_MAJOR / F.sqrt(curvature) * F.cos(phi)
    return (
        lon + F.degrees(_shift(x, y, x, LON_SHIFT) / east),
        lat + F.degrees(_shift(x, y, y, LAT_SHIFT) / north),
    )


def gcj02_to_wgs84(lon: Column, lat: Column, steps: int = 5) -> Column:
    """Fixed-point inverse; a lambda per step keeps the expression linear in ``steps``."""
    start = F.struct(lon.alias("lon"), lat.alias("lat"))

    def refine(guess: Column, _: Column) -> Column:
        mapped_lon, mapped_lat = wgs84_to_gcj02(guess["lon"], guess["lat"])
        return F.struct(
            (guess["lon"] + (lon - mapped_lon)).alias("lon"),
            (guess["lat"] + (lat - mapped_lat)).alias("lat"),
        )

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, refine)
    return F.struct(F.round(done["lon"], 6).alias("lon"), F.round(done["lat"], 6).alias("lat"))


def in_region(lon: Column, lat: Column, box: tuple[float, float, float, float] = REGION) -> Column:
    return (lon > box[0]) & (lon < box[1]) & (lat > box[2]) & (lat < box[3])


def require_region(lon: Column, lat: Column, box: tuple[float, float, float, float] = REGION) -> Column:
    """``lon`` unchanged; the job fails on the first coordinate outside the region."""
    return F.when(in_region(lon, lat, box), lon).otherwise(
        F.raise_error(F.concat(F.lit("coordinate outside region: "), lon.cast("string"), F.lit(","), lat.cast("string")))
    )
