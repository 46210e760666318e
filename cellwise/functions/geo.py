"""UTM as column expressions: the transverse Mercator series of Krueger to the fourth order in the third flattening."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and UTM: fixed values.
MAJOR_AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

N = FLATTENING / (2 - FLATTENING)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = MAJOR_AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Coefficients of the series, forward and inverse.
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
INVERSE = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
# From conformal to geographic latitude.
LATITUDE = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def _central(zone: int) -> float:
    return math.radians(zone * 6 - 183)


def utm_forward(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees."""
    phi, lam = F.radians(lat), F.radians(lon) - _central(zone)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(FORWARD, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return FALSE_EASTING + SCALE * RADIUS * x, SCALE * RADIUS * y + (FALSE_NORTHING_SOUTH if south else 0.0)


def utm_inverse(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi = (y - (FALSE_NORTHING_SOUTH if south else 0.0)) / (SCALE * RADIUS)
    eta = (x - FALSE_EASTING) / (SCALE * RADIUS)
    xi0, eta0 = xi, eta
    for k, b in enumerate(INVERSE, 1):
        xi0 = xi0 - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta0 = eta0 - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))  # conformal latitude
    phi = chi
    for k, d in enumerate(LATITUDE, 1):
        phi = phi + d * F.sin(2 * k * chi)
    return F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)) + _central(zone)), F.degrees(phi)


#: The synthetic events' local origin in UTM zone 16: fixed values.
LOCAL_OFFSET = (430000.0, 4623000.0)


def local_to_lonlat(x: Column, y: Column, zone: int = 16) -> tuple[Column, Column]:
    return utm_inverse(x + LOCAL_OFFSET[0], y + LOCAL_OFFSET[1], zone)
