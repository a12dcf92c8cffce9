"""Closed-form map projections on the GRS80 ellipsoid, longitude/latitude order.

The numpy forms run inside Arrow batches; Web Mercator also exists as plain columns
in ``tiles.py``. EPSG codes: 4326 (degrees), 25832 and 25833 (transverse Mercator),
3035 (equal-area azimuthal), 3857 (spherical Mercator).
"""

from __future__ import annotations

import numpy as np

# GRS80 and the published projection parameters.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
TM_SCALE = 0.9996
TM_FALSE_EASTING = 500000.0
TM_CENTRAL_MERIDIAN = {25832: 9.0, 25833: 15.0}
LAEA_LAT0, LAEA_LON0 = 52.0, 10.0
LAEA_FALSE_EASTING, LAEA_FALSE_NORTHING = 4321000.0, 3210000.0
MERCATOR_RADIUS = 6378137.0

E2 = FLATTENING * (2 - FLATTENING)
ECC = E2 ** 0.5
N = FLATTENING / (2 - FLATTENING)
RECTIFYING_RADIUS = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
KRUEGER = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)


def transverse_mercator(lon, lat, epsg: int):
    phi = np.radians(lat)
    lam = np.radians(lon - TM_CENTRAL_MERIDIAN[epsg])
    s = np.sin(phi)
    t = np.sinh(np.arctanh(s) - ECC * np.arctanh(ECC * s))
    xi = np.arctan2(t, np.cos(lam))
    eta = np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    east, north = eta.copy(), xi.copy()
    for j, alpha in enumerate(KRUEGER, start=1):
        east = east + alpha * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        north = north + alpha * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    k = TM_SCALE * RECTIFYING_RADIUS
    return TM_FALSE_EASTING + k * east, k * north


def _authalic_q(s):
    return (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(ECC * s) / ECC)


_QP = _authalic_q(np.float64(1.0))
_RQ = SEMI_MAJOR * np.sqrt(_QP / 2)
_SIN0 = np.sin(np.radians(LAEA_LAT0))
_BETA0 = np.arcsin(_authalic_q(_SIN0) / _QP)
_D = (
    SEMI_MAJOR * np.cos(np.radians(LAEA_LAT0)) / np.sqrt(1 - E2 * _SIN0**2)
    / (_RQ * np.cos(_BETA0))
)


def laea_forward(lon, lat):
    lam = np.radians(lon - LAEA_LON0)
    beta = np.arcsin(np.clip(_authalic_q(np.sin(np.radians(lat))) / _QP, -1, 1))
    b = _RQ * np.sqrt(
        2 / (1 + np.sin(_BETA0) * np.sin(beta) + np.cos(_BETA0) * np.cos(beta) * np.cos(lam))
    )
    east = LAEA_FALSE_EASTING + b * _D * np.cos(beta) * np.sin(lam)
    north = LAEA_FALSE_NORTHING + b / _D * (
        np.cos(_BETA0) * np.sin(beta) - np.sin(_BETA0) * np.cos(beta) * np.cos(lam)
    )
    return east, north


def laea_inverse(east, north):
    x, y = (east - LAEA_FALSE_EASTING) / _D, (north - LAEA_FALSE_NORTHING) * _D
    rho = np.hypot(x, y)
    c = 2 * np.arcsin(np.clip(rho / (2 * _RQ), -1, 1))
    safe = np.where(rho > 0, rho, 1.0)
    sin_beta = np.cos(c) * np.sin(_BETA0) + np.where(rho > 0, y * np.sin(c) * np.cos(_BETA0) / safe, 0.0)
    beta = np.arcsin(np.clip(sin_beta, -1, 1))
    lam = np.arctan2(x * np.sin(c), rho * np.cos(_BETA0) * np.cos(c) - y * np.sin(_BETA0) * np.sin(c))
    phi = (
        beta
        + (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040) * np.sin(2 * beta)
        + (23 * E2**2 / 360 + 251 * E2**3 / 3780) * np.sin(4 * beta)
        + (761 * E2**3 / 45360) * np.sin(6 * beta)
    )
    # One Newton step removes the series' remainder of about 1e-9 degrees.
    s = np.sin(phi)
    slope = 2 * (1 - E2) * np.cos(phi) / (1 - E2 * s * s) ** 2
    phi = phi + (_QP * np.sin(beta) - _authalic_q(s)) / slope
    return LAEA_LON0 + np.degrees(np.where(rho > 0, lam, 0.0)), np.degrees(phi)


def mercator_forward(lon, lat):
    return MERCATOR_RADIUS * np.radians(lon), MERCATOR_RADIUS * np.arctanh(np.sin(np.radians(lat)))


def mercator_inverse(x, y):
    return np.degrees(x / MERCATOR_RADIUS), np.degrees(np.arcsin(np.tanh(y / MERCATOR_RADIUS)))


def projector(src: int, dst: int):
    """Function (x, y) -> (x, y) between two EPSG codes, or None when they are equal."""
    if src == dst:
        return None
    if src == 4326 and dst in TM_CENTRAL_MERIDIAN:
        return lambda x, y: transverse_mercator(x, y, dst)
    table = {
        (4326, 3035): laea_forward, (3035, 4326): laea_inverse,
        (4326, 3857): mercator_forward, (3857, 4326): mercator_inverse,
    }
    if (src, dst) not in table:
        raise ValueError(f"no projection from EPSG:{src} to EPSG:{dst}")
    return table[src, dst]
