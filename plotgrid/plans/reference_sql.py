"""SQL building blocks of the checks: the derived tables and the map projections again,
written as plain arithmetic for another engine."""

from __future__ import annotations

from plotgrid.functions import projections as p
from plotgrid.plans.fixtures import ZONE_PIECES

RECT = """rect AS (
  SELECT k, 'o' || k AS external_id,
    CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k // 2 AS INTEGER) END AS building_id,
    CASE WHEN (k // 16) % 2 = 0 THEN 'osm' ELSE 'fkb' END AS source,
    lpad(CAST(1 + k % 15 AS VARCHAR), 2, '0') AS region,
    CASE WHEN k % 5 = 0 THEN 'yes' WHEN k % 5 = 1 THEN 'garage' ELSE 'house' END AS building_type,
    CASE WHEN k % 16 = 1 THEN 10.375 + ((k * 7919) % 4093) / 65536.0::DOUBLE
         ELSE 10.0 + ((k * 7919) % 4093) / 4096.0::DOUBLE END AS minx,
    CASE WHEN k % 16 = 1 THEN 63.40625 + ((k * 104729) % 4091) / 65536.0::DOUBLE
         WHEN k % 4 = 0 THEN 59.5 + ((k * 104729) % 4091) / 4096.0::DOUBLE
         ELSE 63.0 + ((k * 104729) % 4091) / 4096.0::DOUBLE END AS miny,
    (1 + k % 7) / 16384.0::DOUBLE AS w,
    (1 + k % 5) / 16384.0::DOUBLE AS h
  FROM (SELECT o_orderkey AS k FROM orders))"""

# Vertices of the triangle, L and holed shapes: ring number, place and offsets in w and h.
SHAPE_POINTS = """shape_points AS (
  SELECT * FROM (VALUES
    (0,0,0,0.0,0.0),(0,0,1,1.0,0.0),(0,0,2,0.0,1.0),(0,0,3,0.0,0.0),
    (1,0,0,0.0,0.0),(1,0,1,1.0,0.0),(1,0,2,1.0,0.5),(1,0,3,0.5,0.5),(1,0,4,0.5,1.0),(1,0,5,0.0,1.0),(1,0,6,0.0,0.0),
    (2,0,0,0.0,0.0),(2,0,1,1.0,0.0),(2,0,2,1.0,1.0),(2,0,3,0.0,1.0),(2,0,4,0.0,0.0),
    (2,1,0,0.25,0.25),(2,1,1,0.25,0.75),(2,1,2,0.75,0.75),(2,1,3,0.75,0.25),(2,1,4,0.25,0.25)
  ) AS t(kind, ring, i, fx, fy))"""

SHAPE_EDGES = """vertices AS (
  SELECT r.k, s.ring, s.i, r.minx + s.fx::DOUBLE * r.w AS x, r.miny + s.fy::DOUBLE * r.h AS y
  FROM rect r JOIN shape_points s ON s.kind = r.k % 3),
edges AS (
  SELECT a.k, a.ring, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1
  FROM vertices a JOIN vertices b ON a.k = b.k AND a.ring = b.ring AND b.i = a.i + 1)"""


def overlaps(frame, prefix: str = "") -> str:
    minx, miny, maxx, maxy = frame
    q = prefix
    return (
        f"{q}minx <= {maxx}::DOUBLE AND {q}minx + {q}w >= {minx}::DOUBLE "
        f"AND {q}miny <= {maxy}::DOUBLE AND {q}miny + {q}h >= {miny}::DOUBLE"
    )


def transverse_mercator(source: str, epsg: int, result: str) -> str:
    """CTEs from ``source(…, lon, lat)`` to ``result(…, east, north)``."""
    k = p.TM_SCALE * p.RECTIFYING_RADIUS
    east = " + ".join(
        [f"eta_"] + [f"{a!r} * cos({2 * j} * xi_) * sinh({2 * j} * eta_)" for j, a in enumerate(p.KRUEGER, 1)]
    )
    north = " + ".join(
        [f"xi_"] + [f"{a!r} * sin({2 * j} * xi_) * cosh({2 * j} * eta_)" for j, a in enumerate(p.KRUEGER, 1)]
    )
    return f"""{result}_t AS (
  SELECT *, sinh(atanh(sin(radians(lat))) - {p.ECC!r} * atanh({p.ECC!r} * sin(radians(lat)))) AS t_,
    radians(lon - {p.TM_CENTRAL_MERIDIAN[epsg]!r}) AS lam_ FROM {source}),
{result}_s AS (
  SELECT *, atan2(t_, cos(lam_)) AS xi_, atanh(sin(lam_) / sqrt(1 + t_ * t_)) AS eta_ FROM {result}_t),
{result} AS (
  SELECT *, {p.TM_FALSE_EASTING!r} + {k!r} * ({east}) AS east, {k!r} * ({north}) AS north FROM {result}_s)"""


def laea(source: str, result: str) -> str:
    """CTEs from ``source(…, lon, lat)`` to ``result(…, east, north)`` in EPSG:3035."""
    sb0, cb0 = float(p.np.sin(p._BETA0)), float(p.np.cos(p._BETA0))
    rq, d, qp = float(p._RQ), float(p._D), float(p._QP)
    return f"""{result}_b AS (
  SELECT *, radians(lon - {p.LAEA_LON0!r}) AS lam_,
    asin({1 - p.E2!r} * (sin(radians(lat)) / (1 - {p.E2!r} * sin(radians(lat)) * sin(radians(lat)))
      + atanh({p.ECC!r} * sin(radians(lat))) / {p.ECC!r}) / {qp!r}) AS beta_ FROM {source}),
{result} AS (
  SELECT *, {p.LAEA_FALSE_EASTING!r} + b_ * {d!r} * cos(beta_) * sin(lam_) AS east,
    {p.LAEA_FALSE_NORTHING!r} + b_ / {d!r} * ({cb0!r} * sin(beta_) - {sb0!r} * cos(beta_) * cos(lam_)) AS north
  FROM (SELECT *, {rq!r} * sqrt(2 / (1 + {sb0!r} * sin(beta_) + {cb0!r} * cos(beta_) * cos(lam_))) AS b_ FROM {result}_b))"""


CORNERS = """corners AS (
  SELECT k, i, minx + CASE WHEN i IN (1, 2) THEN w ELSE 0 END AS lon,
    miny + CASE WHEN i IN (2, 3) THEN h ELSE 0 END AS lat
  FROM rect, (VALUES (0), (1), (2), (3)) AS c(i))"""


def rect_measures(epsg: int, result: str = "m") -> str:
    """CTEs ending in ``result(k, area, perimeter)`` of rectangles in a projection."""
    return f"""{CORNERS},
{transverse_mercator('corners', epsg, 'projected')},
{result} AS (
  SELECT a.k,
    abs(sum((a.east - o.east) * (b.north - o.north) - (b.east - o.east) * (a.north - o.north))) / 2 AS area,
    sum(sqrt((b.east - a.east) * (b.east - a.east) + (b.north - a.north) * (b.north - a.north))) AS perimeter
  FROM projected a JOIN projected b ON b.k = a.k AND b.i = (a.i + 1) % 4
  JOIN projected o ON o.k = a.k AND o.i = 0 GROUP BY a.k)"""


def zone_tables() -> str:
    """CTEs ``zone_edges(region, piece, x0..y1)`` (counterclockwise convex pieces) and
    ``zone_boxes``."""
    rows = []
    for piece, (region, points) in enumerate(ZONE_PIECES):
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))
        ordered = points if twice > 0 else points[::-1]
        for a, b in zip(ordered, ordered[1:] + ordered[:1]):
            rows.append(f"('{region}',{piece},{a[0]!r}::DOUBLE,{a[1]!r}::DOUBLE,{b[0]!r}::DOUBLE,{b[1]!r}::DOUBLE)")
    return f"""zone_edges AS (
  SELECT * FROM (VALUES {','.join(rows)}) AS z(region, piece, x0, y0, x1, y1)),
zone_boxes AS (
  SELECT region, piece, min(x0) AS zminx, min(y0) AS zminy, max(x0) AS zmaxx, max(y0) AS zmaxy
  FROM zone_edges GROUP BY region, piece)"""


ZONE_PAIRS = """zone_pairs AS (
  SELECT DISTINCT r.k, b.region AS zone
  FROM rect r JOIN zone_boxes b
    ON r.minx <= b.zmaxx AND r.minx + r.w >= b.zminx AND r.miny <= b.zmaxy AND r.miny + r.h >= b.zminy
  WHERE NOT EXISTS (
    SELECT 1 FROM zone_edges e WHERE e.piece = b.piece
      AND greatest(
        (e.x1 - e.x0) * (r.miny - e.y0) - (e.y1 - e.y0) * (r.minx - e.x0),
        (e.x1 - e.x0) * (r.miny - e.y0) - (e.y1 - e.y0) * (r.minx + r.w - e.x0),
        (e.x1 - e.x0) * (r.miny + r.h - e.y0) - (e.y1 - e.y0) * (r.minx - e.x0),
        (e.x1 - e.x0) * (r.miny + r.h - e.y0) - (e.y1 - e.y0) * (r.minx + r.w - e.x0)) < 0))"""


GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash3(lon: str, lat: str) -> str:
    """Three-letter geohash by plain integer arithmetic (8 longitude, 7 latitude bits)."""
    x = f"CAST(floor(({lon} + 180) / 360 * 256) AS BIGINT)"
    y = f"CAST(floor(({lat} + 90) / 180 * 128) AS BIGINT)"

    def bit(axis, place):
        return f"((({axis}) >> {place}) & 1)"

    def letter(bits):
        index = " + ".join(f"{b} * {1 << (4 - i)}" for i, b in enumerate(bits))
        return f"substr('{GEOHASH_ALPHABET}', CAST({index} + 1 AS INTEGER), 1)"

    order = []
    for i in range(15):
        order.append(bit(x, 7 - i // 2) if i % 2 == 0 else bit(y, 6 - i // 2))
    return " || ".join(letter(order[5 * i:5 * i + 5]) for i in range(3))
