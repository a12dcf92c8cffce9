"""Geohash text of a position, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _cell(value: Column, low: float, span: float, bits: int) -> Column:
    cells = 1 << bits
    index = F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(cells))).cast("bigint")
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), index))


def geohash(lon: Column, lat: Column, precision: int = 3) -> Column:
    """Interleave longitude and latitude bits (longitude first), five bits per letter."""
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    x = _cell(lon, -180.0, 360.0, lon_bits)
    y = _cell(lat, -90.0, 180.0, lat_bits)
    letters = []
    for letter in range(precision):
        index = F.lit(0).cast("bigint")
        for bit in range(5):
            position = 5 * letter + bit
            source, width = (x, lon_bits) if position % 2 == 0 else (y, lat_bits)
            shift = width - 1 - position // 2
            digit = F.shiftright(source, shift).bitwiseAND(F.lit(1).cast("bigint"))
            index = index + F.shiftleft(digit, 4 - bit)
        letters.append(F.substring(F.lit(ALPHABET), (index + 1).cast("int"), F.lit(1)))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(*letters))
