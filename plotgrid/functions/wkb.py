"""WKB to nested rings and back, one Arrow batch at a time.

Little-endian flat polygons with any number of rings (nearly every footprint) are read
with whole-batch numpy gathers, ring by ring; other rows take a small per-value reader.
Writing is done by gathers for all kinds. Z values are dropped.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from plotgrid.functions import kernels as k

POLYGON, MULTIPOLYGON = 3, 6
_HEAD = 9  # byte order, type, number of rings or parts


def decode(array: pa.Array) -> pa.ListArray:
    """Polygons and multipolygons as nested rings; anything unreadable becomes NULL."""
    n = len(array)
    array = array.cast(pa.binary())
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + n + 1].astype(np.int64)
    body = array.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    known = array.is_valid().to_numpy(zero_copy_only=False)
    flat, ring_row, ring_begin, ring_len = _flat_polygons(data, offsets, known)
    xy = _points(data, ring_begin, ring_len)
    part_row, part_rings = flat, np.bincount(ring_row, minlength=n)[flat]
    slow = known.copy()
    slow[flat] = False
    shapes = {i: shape for i in np.flatnonzero(slow) if (shape := _read(data[offsets[i]:offsets[i + 1]].tobytes())) is not None}
    if shapes:
        rings = [(i, r) for i, shape in shapes.items() for part in shape for r in part]
        xy = np.concatenate([xy, *(r for _, r in rings)])
        ring_row = np.concatenate([ring_row, np.array([i for i, _ in rings], np.int64)])
        ring_len = np.concatenate([ring_len, np.array([len(r) for _, r in rings], np.int64)])
        parts = [(i, len(part)) for i, shape in shapes.items() for part in shape]
        part_row = np.concatenate([part_row, np.array([i for i, _ in parts], np.int64)])
        part_rings = np.concatenate([part_rings, np.array([m for _, m in parts], np.int64)])
    null = np.ones(n, bool)
    null[flat] = False
    null[list(shapes)] = False
    by_ring, by_part = np.argsort(ring_row, kind="stable"), np.argsort(part_row, kind="stable")
    xy = xy[_spans((np.cumsum(ring_len) - ring_len)[by_ring], ring_len[by_ring])]
    return k.nest(xy[:, 0], xy[:, 1], ring_len[by_ring], part_rings[by_part], np.bincount(part_row, minlength=n), null)


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. for ``count[0]`` places, then from begin[1], and so on."""
    ahead = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(ahead - begin, count)


def _points(data: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    inner = _spans(np.zeros(len(count), np.int64), count)
    at = np.repeat(begin, count) + 16 * inner
    return data[at[:, None] + np.arange(16)].copy().view("<f8") if len(at) else np.zeros((0, 2))


def _flat_polygons(data: np.ndarray, offsets: np.ndarray, known: np.ndarray):
    """Rows that are whole little-endian polygons without Z, and their rings: (rows, row of
    each ring, byte of its first point, number of points), the rings of a row in order."""
    start, end = offsets[:-1], offsets[1:]
    rows = np.flatnonzero(known & (end - start >= _HEAD))
    head = data[start[rows, None] + np.arange(_HEAD)] if len(rows) else np.zeros((0, _HEAD), np.uint8)
    plain = (head[:, 0] == 1) & (_u32(head, 1) == POLYGON) & (_u32(head, 5) > 0)
    rows, left = rows[plain], _u32(head, 5)[plain].astype(np.int64)
    at, broken = start[rows] + _HEAD, np.zeros(len(rows), bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.arange(len(rows))
    while len(live):
        short = at[live] + 4 > end[rows[live]]
        broken[live[short]] = True
        live = live[~short]
        count = _u32(data[at[live, None] + np.arange(4)], 0).astype(np.int64) if len(live) else np.zeros(0, np.int64)
        after = at[live] + 4 + 16 * count
        short = after > end[rows[live]]
        broken[live[short]] = True
        live, count, after = live[~short], count[~short], after[~short]
        found.append((live, at[live] + 4, count))
        at[live] = after
        left[live] -= 1
        live = live[left[live] > 0]
    broken |= at != end[rows]
    ring, begin, count = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))
    whole = ~broken[ring]
    ring, begin, count = ring[whole], begin[whole], count[whole]
    order = np.argsort(ring, kind="stable")
    return rows[~broken], rows[ring[order]], begin[order], count[order]


def _u32(rows: np.ndarray, column: int) -> np.ndarray:
    return np.ascontiguousarray(rows[:, column:column + 4]).view("<u4").ravel()


def from_lists(shapes: list) -> pa.ListArray:
    """Nested Python lists (parts of rings of (m, 2) arrays, None for NULL) to Arrow."""
    rings = [r for s in shapes if s is not None for part in s for r in part]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    return k.nest(
        xy[:, 0], xy[:, 1],
        np.array([len(r) for r in rings], np.int64),
        np.array([len(part) for s in shapes if s is not None for part in s], np.int64),
        np.array([0 if s is None else len(s) for s in shapes], np.int64),
        np.array([s is None for s in shapes], bool),
    )


def _read(value: bytes):
    try:
        shape, _ = _read_geometry(value, 0)
        return shape
    except (struct.error, ValueError, IndexError):
        return None


def _read_geometry(value: bytes, at: int):
    order = "<" if value[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", value, at + 1)
    has_z = bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3)
    has_m = bool(code & 0x40000000) or (code & 0xFFFF) // 1000 in (2, 3)
    at += 9 if code & 0x20000000 else 5
    kind = (code & 0xFFFF) % 1000
    if kind == POLYGON:
        rings, at = _read_rings(value, at, order, 2 + has_z + has_m)
        return [rings], at
    if kind == MULTIPOLYGON:
        (count,) = struct.unpack_from(order + "I", value, at)
        at += 4
        parts = []
        for _ in range(count):
            part, at = _read_geometry(value, at)
            parts.extend(part)
        return parts, at
    raise ValueError(f"geometry type {kind} has no area")


def _read_rings(value: bytes, at: int, order: str, width: int):
    (count,) = struct.unpack_from(order + "I", value, at)
    at += 4
    rings = []
    for _ in range(count):
        (points,) = struct.unpack_from(order + "I", value, at)
        at += 4
        flat = np.frombuffer(value, order + "f8", points * width, at)
        rings.append(flat.reshape(points, width)[:, :2].astype(np.float64))
        at += 8 * points * width
    return rings, at


def encode(array: pa.ListArray) -> pa.Array:
    """Little-endian WKB: polygon for one part, multipolygon for several."""
    s = k.Shapes(array)
    null = np.asarray(s.null, bool)
    parts_of = np.bincount(s.part_geom, minlength=s.n)
    n_parts = len(s.part_geom)
    rings_of_part = np.bincount(s.ring_part, minlength=n_parts)
    several = (parts_of != 1) & ~null
    ring_size = 4 + 16 * s.ring_len
    part_size = _HEAD + np.bincount(s.ring_part, ring_size, minlength=n_parts).astype(np.int64)
    size = _HEAD * several + np.bincount(s.part_geom, part_size, minlength=s.n).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    data = np.zeros(int(offsets[-1]), np.uint8)
    part_at = offsets[:-1][s.part_geom] + _HEAD * several[s.part_geom] + _within(part_size, s.part_geom)
    ring_at = part_at[s.ring_part] + _HEAD + _within(ring_size, s.ring_part)
    many = np.flatnonzero(several)
    _write_heads(data, offsets[many], MULTIPOLYGON, parts_of[many])
    _write_heads(data, part_at, POLYGON, rings_of_part)
    data[ring_at[:, None] + np.arange(4)] = s.ring_len.astype("<u4")[:, None].view(np.uint8)
    xy = np.stack([s.x, s.y], axis=1)[_spans(s.ring_start, s.ring_len)]
    byte_at = np.repeat(ring_at + 4, s.ring_len) + 16 * _spans(np.zeros(len(s.ring_len), np.int64), s.ring_len)
    data[byte_at[:, None] + np.arange(16)] = np.ascontiguousarray(xy.astype("<f8")).view(np.uint8).reshape(-1, 16)
    valid = None if not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(
        pa.binary(), s.n, [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    )


def _within(size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sum of the sizes before each item inside its group; groups are in order."""
    ahead = np.cumsum(size) - size
    first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
    return ahead - np.repeat(ahead[first], np.diff(np.append(np.flatnonzero(first), len(group)))) if len(group) else ahead


def _write_heads(data: np.ndarray, at: np.ndarray, kind: int, count: np.ndarray) -> None:
    head = np.zeros((len(at), _HEAD), np.uint8)
    head[:, 0] = 1
    head[:, 1:5] = np.full(len(at), kind, "<u4")[:, None].view(np.uint8)
    head[:, 5:9] = count.astype("<u4")[:, None].view(np.uint8)
    data[at[:, None] + np.arange(_HEAD)] = head
