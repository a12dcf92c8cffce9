"""Cutting segments and tracing rings over Arrow batches.

Both run on streams of rows that Spark has dealt and sorted by tile. A stream is worked on in
chunks of whole groups (tiles, or cells), so a task holds one chunk and not its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_ROWS = 100_000
PAIRS_PER_STEP = 1 << 20
#: Cells along a tile's side.
TILE = 32
HALF = 1 << 31

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
CUT = pa.struct([("along", pa.float64()), *POINT])
BOX = pa.struct([(c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax")])
PIECES = "open boolean, x0 double, y0 double, x1 double, y1 double, tags array<bigint>, cuts array<struct<along:double,x:double,y:double>>"
RINGS = (
    "label bigint, ring array<struct<x:double,y:double>>, twice double, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, "
    "next bigint, ids array<bigint>, least bigint, at bigint"
)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, step) of ``counts[i]`` rows for each i."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - (np.cumsum(counts) - counts)[index]


def in_chunks(group: str, work: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], rows: int = CHUNK_ROWS):
    """A stream function that gives ``work`` the columns of many rows at once, never part of a group (rows equal in ``group``)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size, wanted = 0, rows
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names})
            size += batch.num_rows
            if size < wanted:
                continue
            whole = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            ends = np.flatnonzero(whole[group][1:] != whole[group][:-1])
            at = int(ends[-1]) + 1 if len(ends) else 0
            if at:
                yield from work({n: v[:at] for n, v in whole.items()})
            held, size = [{n: v[at:] for n, v in whole.items()}], size - at
            wanted = max(rows, 2 * size)  # a group larger than a chunk is joined together a few times only
        if size:
            yield from work({n: np.concatenate([h[n] for h in held]) for n in held[0]})

    return stream


def _first_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Flags of the rows that differ from the row before."""
    first = np.ones(len(sorted_columns[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return first


def _cells_below(x0, y0, x1, y1, cell, reach, rows, columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, row, column) of the cells a segment touches, as ``zones.edge_cells`` walks them, inside ranges of rows and columns."""
    low_y, high_y, low_x, high_x = np.minimum(y0, y1), np.maximum(y0, y1), np.minimum(x0, x1), np.maximum(x0, x1)
    first = np.maximum(np.ceil((low_y - reach) / cell).astype(np.int64) - 1, rows[0])
    last = np.minimum(np.floor((high_y + reach) / cell).astype(np.int64), rows[1])
    s, step = expand(np.maximum(last - first + 1, 0))
    row = first[s] + step
    flat = (y0 == y1)[s]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = ((x1 - x0) / (y1 - y0))[s]
        at_floor = x0[s] + slope * (np.clip(row * cell - reach, low_y[s], high_y[s]) - y0[s])
        at_roof = x0[s] + slope * (np.clip((row + 1) * cell + reach, low_y[s], high_y[s]) - y0[s])
    slack = cell * 1e-9
    left = np.where(flat, low_x[s], np.maximum(low_x[s], np.minimum(at_floor, at_roof) - slack)) - reach
    right = np.where(flat, high_x[s], np.minimum(high_x[s], np.maximum(at_floor, at_roof) + slack)) + reach
    first = np.maximum(np.ceil(left / cell).astype(np.int64) - 1, columns[0][s])
    last = np.minimum(np.floor(right / cell).astype(np.int64), columns[1][s])
    again, step = expand(np.maximum(last - first + 1, 0))
    return s[again], row[again], first[again] + step


def _near_pairs(group: np.ndarray, member: np.ndarray, meet) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of members of one group that pass ``meet``; members ascend inside a group. A bounded number is looked at a time."""
    ends = np.append(np.flatnonzero(_first_of(group))[1:], len(group))
    partners = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(group)) - 1
    done = np.cumsum(partners)
    found_a, found_b, at = [], [], 0
    while at < len(group):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_PER_STEP)))
        i, step = expand(partners[at:upto])
        a, b = member[at + i], member[at + i + 1 + step]
        kept = meet(a, b)
        found_a.append(a[kept])
        found_b.append(b[kept])
        at = upto
    return np.concatenate([*found_a, np.zeros(0, np.int64)]), np.concatenate([*found_b, np.zeros(0, np.int64)])


def _cuts(x0, y0, x1, y1, a, b, snap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, x, y) of the points inside segments at which the pairs cut each other."""

    def turn(s, x, y):
        return (x1[s] - x0[s]) * (y - y0[s]) - (y1[s] - y0[s]) * (x - x0[s])

    def on(s, x, y, side):
        line = np.abs(side) <= snap * np.hypot(x1[s] - x0[s], y1[s] - y0[s]) if snap else side == 0
        found = (
            line & (x >= x0[s] - snap) & (x <= x1[s] + snap)
            & (y >= np.minimum(y0[s], y1[s]) - snap) & (y <= np.maximum(y0[s], y1[s]) + snap)
        )
        if not snap:
            return found
        # beside an end of the segment there is nothing to cut
        return found & (np.hypot(x - x0[s], y - y0[s]) > snap) & (np.hypot(x - x1[s], y - y1[s]) > snap)

    # a's line against both ends of b and the other way round
    a0, a1 = turn(a, x0[b], y0[b]), turn(a, x1[b], y1[b])
    b0, b1 = turn(b, x0[a], y0[a]), turn(b, x1[a], y1[a])
    touches = [(a, x0[b], y0[b], a0), (a, x1[b], y1[b], a1), (b, x0[a], y0[a], b0), (b, x1[a], y1[a], b1)]
    hits = [on(*t) for t in touches]
    proper = (np.sign(a0) * np.sign(a1) < 0) & (np.sign(b0) * np.sign(b1) < 0)
    if snap:
        proper &= ~np.logical_or.reduce(hits)
    # both segments get the same crossing point, computed from the lesser one
    p = a[proper]
    t = b0[proper] / (b0[proper] - b1[proper])
    px, py = x0[p] + t * (x1[p] - x0[p]) + 0.0, y0[p] + t * (y1[p] - y0[p]) + 0.0
    s = np.concatenate([p, b[proper], *[t[0][h] for t, h in zip(touches, hits)]])
    x = np.concatenate([px, px, *[t[1][h] for t, h in zip(touches, hits)]])
    y = np.concatenate([py, py, *[t[2][h] for t, h in zip(touches, hits)]])
    inner = ((x != x0[s]) | (y != y0[s])) & ((x != x1[s]) | (y != y1[s]))
    return s[inner], x[inner], y[inner]


def lesser_first(x0, y0, x1, y1) -> list[np.ndarray]:
    """Segments with their lesser end first."""
    swap = (x1 < x0) | ((x1 == x0) & (y1 < y0))
    return [np.where(swap, a, b) for a, b in ((x1, x0), (y1, y0), (x0, x1), (y0, y1))]


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)


def _points(x: np.ndarray, y: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(POINT))


def cut_tiles(cell: float, snap: float, tagged: bool):
    """Stream function for rows ``tile, x0, y0, x1, y1`` (and ``tag``) in order of tile: every segment listed in each tile it comes near.

    All that can cut a segment of a single tile is in its tile, so its pieces are final: they come with ``open`` false, once each.
    Segments of several tiles come with ``open`` true and ``cuts``, the points found in this tile with their way along the segment, its ends among
    them. A piece that lies on such a segment too is left to it; with tags it comes open and without cuts.
    """

    def work(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        # segments without their copies, in order inside a tile
        x0, y0, x1, y1 = (rows[c] + 0.0 for c in ("x0", "y0", "x1", "y1"))
        tile = rows["tile"]
        order = np.lexsort((y1, x1, y0, x0, tile))
        tile, x0, y0, x1, y1 = (v[order] for v in (tile, x0, y0, x1, y1))
        first = _first_of(tile, x0, y0, x1, y1)
        owned = np.diff(np.append(np.flatnonzero(first), len(first)))
        tags = rows["tag"][order] if tagged else None
        tag_at = np.cumsum(owned) - owned
        tile, x0, y0, x1, y1 = (v[first] for v in (tile, x0, y0, x1, y1))
        n = len(tile)

        size = cell * TILE
        wide = np.zeros(n, bool)
        for low, high in ((x0, x1), (np.minimum(y0, y1), np.maximum(y0, y1))):
            wide |= np.ceil((low - snap) / size) - 1 != np.floor((high + snap) / size)
        column = (tile + HALF) % (1 << 32) - HALF
        row = (tile - column) >> 32
        # one cell more on each side, for cells that do not fill a tile exactly in doubles
        rows_in, columns_in = ((v * TILE - 1, v * TILE + TILE) for v in (row, column))
        s, r, c = _cells_below(x0, y0, x1, y1, cell, snap, rows_in, columns_in)
        number = np.cumsum(_first_of(tile)) - 1
        span = TILE + 2
        key = (number[s] * span + r - rows_in[0][s]) * span + c - columns_in[0][s]
        order = np.argsort(key, kind="stable")

        def meet(a, b):
            return (
                (x0[a] - snap <= x1[b]) & (x0[b] - snap <= x1[a])
                & (np.minimum(y0[a], y1[a]) - snap <= np.maximum(y0[b], y1[b]))
                & (np.minimum(y0[b], y1[b]) - snap <= np.maximum(y0[a], y1[a]))
            )

        a, b = _near_pairs(key[order], s[order], meet)
        cut, px, py = _cuts(x0, y0, x1, y1, a, b, snap)
        every = np.arange(n)
        point_of = np.concatenate([every, every, cut])
        px, py = np.concatenate([x0, x1, px]), np.concatenate([y0, y1, py])
        # a crossing point may be rounded off its segment, so its coordinates alone do not tell its place on it
        along = (px - x0[point_of]) * (x1 - x0)[point_of] + (py - y0[point_of]) * (y1 - y0)[point_of]
        order = np.lexsort((py, px, along, point_of))
        point_of, along, px, py = point_of[order], along[order], px[order], py[order]
        kept = _first_of(point_of, px, py)
        point_of, along, px, py = point_of[kept], along[kept], px[kept], py[kept]

        # pieces between points that follow each other on a segment
        start = np.flatnonzero(point_of[1:] == point_of[:-1])
        parent = point_of[start]
        ends = lesser_first(px[start], py[start], px[start + 1], py[start + 1])
        order = np.lexsort((*ends[::-1], number[parent]))
        parent, ends = parent[order], [e[order] for e in ends]
        first = _first_of(number[parent], *ends)
        piece = np.cumsum(first) - 1
        shared = np.zeros(int(first.sum()), bool)
        shared[piece[wide[parent]]] = True

        def batch(is_open, columns, owners, owners_of, cuts):
            size = len(columns[0])
            listed = pa.nulls(size, pa.list_(pa.int64()))
            if tagged:
                which, step = expand(owned[owners])
                lengths = np.bincount(owners_of, owned[owners], size).astype(np.int64)
                listed = _lists(pa.array(tags[tag_at[owners][which] + step], pa.int64()), lengths)
            names = ["open", "x0", "y0", "x1", "y1", "tags", "cuts"]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, is_open)), *[pa.array(v) for v in columns], listed, cuts or pa.nulls(size, pa.list_(CUT))], names=names
            )

        own = ~shared[piece]
        lead = first & own
        yield batch(False, [e[lead] for e in ends], parent[own], np.cumsum(lead)[own] - 1, None)
        if tagged:  # owners of pieces that lie on a segment of several tiles
            left = shared[piece] & ~wide[parent]
            if left.any():
                yield batch(True, [e[left] for e in ends], parent[left], np.arange(int(left.sum())), None)
        several = np.flatnonzero(wide)
        if len(several):
            mine = wide[point_of]
            lengths = np.bincount(point_of[mine], minlength=n)[several]
            cuts = _lists(pa.StructArray.from_arrays([pa.array(v[mine]) for v in (along, px, py)], fields=list(CUT)), lengths)
            yield batch(True, [v[several] for v in (x0, y0, x1, y1)], several, np.arange(len(several)), cuts)

    return in_chunks("tile", work)


def _labels(ids: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id of every element's ring and the steps to it, by pointer doubling over closed rings."""
    label, steps, jump, span = ids.copy(), np.zeros(len(ids), np.int64), following, 1
    while True:
        seen = label[jump]
        less = seen < label
        if not less.any():
            return label, steps
        steps = np.where(less, steps[jump] + span, steps)
        label = np.where(less, seen, label)
        jump = jump[jump]
        span *= 2


def _find(ids: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` among ids sorted by ``order``, -1 where absent."""
    at = np.minimum(np.searchsorted(ids, wanted, sorter=order), len(ids) - 1)
    place = order[at]
    return np.where(ids[place] == wanted, place, -1)


def _rings(ids, following, x, y) -> pa.RecordBatch:
    label, steps = _labels(ids, following)
    # the leader comes first, then the others by their way still to go
    order = np.lexsort((np.where(steps == 0, -len(ids) - 1, -steps), label))
    label, x, y = label[order], x[order], y[order]
    starts = np.flatnonzero(_first_of(label))
    lengths = np.diff(np.append(starts, len(label)))
    ring, step = expand(lengths)
    after = np.where(step + 1 < lengths[ring], np.arange(len(label)) + 1, starts[ring])
    dx, dy = x - x[starts][ring], y - y[starts][ring]
    twice = np.add.reduceat(dx * dy[after] - dx[after] * dy, starts)
    box = [f.reduceat(v, starts) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
    ring, step = expand(lengths + 1)
    closed = starts[ring] + step % lengths[ring]
    return _ring_batch(
        label[starts], _lists(_points(x[closed], y[closed]), lengths + 1), pa.array(twice),
        pa.StructArray.from_arrays([pa.array(v) for v in box], fields=list(BOX)),
    )


def _ring_batch(label, ring, twice=None, box=None, following=None, ids=None, least=None, at=None) -> pa.RecordBatch:
    n = len(label)

    def given(values, kind):
        return pa.nulls(n, kind) if values is None else values if isinstance(values, pa.Array) else pa.array(values, kind)

    whole = pa.int64()
    columns = {
        "label": given(label, whole), "ring": ring, "twice": given(twice, pa.float64()), "bbox": given(box, BOX), "next": given(following, whole),
        "ids": given(ids, pa.list_(whole)), "least": given(least, whole), "at": given(at, whole),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _chains(ids, following, end, togo, x, y, end_x, end_y) -> pa.RecordBatch:
    order = np.lexsort((-togo, end))
    end, ids, x, y = end[order], ids[order], x[order], y[order]
    starts = np.flatnonzero(_first_of(end))
    lengths = np.diff(np.append(starts, len(end)))
    chain, step = expand(lengths)
    least = np.minimum.reduceat(ids, starts)
    at = step[ids == least[chain]]
    # the points have the last one's end too
    tail = end[starts]
    places = np.cumsum(lengths)
    return _ring_batch(
        ids[starts], _lists(_points(np.insert(x, places, end_x[tail]), np.insert(y, places, end_y[tail])), lengths + 1),
        following=following[tail], ids=_lists(pa.array(ids, pa.int64()), lengths), least=least, at=at,
    )


def trace_ways(twins: bool):
    """Stream function for rows ``cell, x, y, ox, oy, into, out`` in order of cell, which is a number of (x, y): the directed edges at
    that point, whose other end is (ox, oy); ``into`` and ``out`` are the ids of the one that comes and the one that goes, or negative.

    An edge goes on with the first one that leaves clockwise of the way back. Rings inside a chunk come whole (``next`` is null);
    of others come the stretches inside it, as chains: ``label`` is the first edge, ``next`` the one after the last, ``least`` the least id,
    ``at`` its place, and ``ring`` has one point more than ``ids``. With ``twins``, ids of an edge's two directions differ in the last
    bit, and edges with both directions in one ring are taken out of whole rings.
    """

    def work(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, y, ox, oy, into, out = (rows[c] for c in ("x", "y", "ox", "oy", "into", "out"))
        goes = out >= 0
        order = np.lexsort((np.where(goes, out, into), goes & (into < 0), np.arctan2(oy - y, ox - x), y, x, rows["cell"]))
        x, y, ox, oy, into, out = (v[order] for v in (x, y, ox, oy, into, out))
        place = np.arange(len(x))
        starts = np.flatnonzero(_first_of(x, y))
        group, _ = expand(np.diff(np.append(starts, len(x))))
        last = np.maximum.accumulate(np.where(out >= 0, place, -1))
        before = np.concatenate(([-1], last[:-1]))
        around = last[np.append(starts[1:], len(x)) - 1][group]
        chosen = np.where(before >= starts[group], before, np.where(around >= starts[group], around, -1))
        after = np.where(chosen >= 0, out[chosen], -1)

        comes = into >= 0
        ids, after, px, py, ex, ey = (v[comes] for v in (into, after, ox, oy, x, y))
        if not len(ids):
            return
        by_id = np.argsort(ids)
        following = _find(ids, by_id, after)
        # the way to the end of a chain; inside rings there is none
        stops = following < 0
        end, togo = np.where(stops, np.arange(len(ids)), following), (~stops).astype(np.int64)
        known = 0
        while (reached := int(stops[end].sum())) > known:
            known = reached
            togo, end = togo + togo[end], end[end]
        loose_ends = stops[end]
        if loose_ends.any():
            k = np.flatnonzero(loose_ends)
            yield _chains(ids[k], after, end[k], togo[k], px[k], py[k], ex, ey)
        whole = np.flatnonzero(~loose_ends)
        if not len(whole):
            return
        index = np.full(len(ids), -1)
        index[whole] = np.arange(len(whole))
        ids, following, px, py = ids[whole], index[following[whole]], px[whole], py[whole]
        if twins:
            label, _ = _labels(ids, following)
            twin = _find(ids, np.argsort(ids), ids ^ 1)
            loose = (twin >= 0) & (label[twin] == label)
            if loose.any():
                # past a loose edge goes what follows its other direction
                skip = np.where(loose, following[twin], following)
                while loose[following[~loose]].any():
                    following = np.where(loose[following], skip[following], following)
                    skip = np.where(loose & loose[skip], skip[skip], skip)
                stay = np.flatnonzero(~loose)
                if not len(stay):
                    return
                index = np.full(len(ids), -1)
                index[stay] = np.arange(len(stay))
                ids, following, px, py = ids[stay], index[following[stay]], px[stay], py[stay]
        yield _rings(ids, following, px, py)

    return in_chunks("cell", work)
