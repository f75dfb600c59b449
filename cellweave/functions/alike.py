"""Geometries of one structure as matrices: a batch of WKB is cut into groups that differ in their numbers alone.

:func:`evaluate` runs a function of :mod:`cellweave.functions.geometry` over whole groups where ``FAST`` knows how, and row by row
for the rest (other byte orders, Z and M, empty or mixed geometries), with the same results.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from cellweave.functions import geometry as G

_NUMBER = re.compile(r"[-+.\d][-+.\deE]*")
_HEAD = struct.Struct("<I")


def _places(data: bytes, at: int = 0) -> tuple[list[int], int] | None:
    """Where the points of plain WKB (this byte order, two numbers a point) stand, and its end."""
    if data[at] != 1:
        return None
    (kind,) = _HEAD.unpack_from(data, at + 1)
    at += 5
    if kind == 1:
        return [at], at + 16
    if not 2 <= kind <= 7:
        return None
    (n,) = _HEAD.unpack_from(data, at)
    at += 4
    if kind == 2:
        return [at + 16 * i for i in range(n)], at + 16 * n
    found: list[int] = []
    for _ in range(n):
        if kind == 3:
            (m,) = _HEAD.unpack_from(data, at)
            got = [at + 4 + 16 * i for i in range(m)], at + 4 + 16 * m
        else:
            got = _places(data, at)
        if got is None:
            return None
        found, at = found + got[0], got[1]
    return found, at


def _mask(length: int, at: list[int]) -> np.ndarray:
    mask = np.zeros(length, bool)
    for a in at:
        mask[a : a + 16] = True
    return mask


@dataclass
class Alike:
    """WKB that all rows share but for its numbers, and the numbers: rows x points x 2."""

    head: bytes
    xy: np.ndarray
    rect: bool = False

    @property
    def kind(self) -> int:
        return self.head[1]

    @cached_property
    def indexed(self) -> G.Geometry:
        """The structure as a geometry whose point i is (2 i, 2 i + 1)."""
        made = np.frombuffer(self.head, np.uint8).copy()
        made[_mask(len(made), _places(self.head)[0])] = np.arange(2.0 * self.xy.shape[1]).view(np.uint8)
        return G.read(made.tobytes())

    @cached_property
    def box(self) -> np.ndarray:
        """xmin, ymin, xmax, ymax of each row."""
        return np.concatenate([self.xy.min(axis=1), self.xy.max(axis=1)], axis=1)

    def of(self, rows) -> Alike:
        return Alike(self.head, self.xy[rows], self.rect)

    def chosen(self, g: G.Geometry) -> Alike:
        """What ``g``, made of points of :attr:`indexed`, is in each row."""
        data = G.write(g)
        numbers = np.frombuffer(data, np.uint8)[_mask(len(data), _places(data)[0])].copy().view("<f8")
        return Alike(data, self.xy[:, (numbers[::2] / 2).astype(int)])

    def binary(self) -> pa.Array:
        n, size = len(self.xy), len(self.head)
        made = np.tile(np.frombuffer(self.head, np.uint8), (n, 1))
        made[:, _mask(size, _places(self.head)[0])] = np.ascontiguousarray(self.xy, "<f8").reshape(n, -1).view(np.uint8)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(made)])


def _rectangles(xy: np.ndarray) -> np.ndarray:
    x, y = xy[..., 0].T, xy[..., 1].T
    up = (x[0] == x[1]) & (y[1] == y[2]) & (x[2] == x[3]) & (y[3] == y[0])
    along = (y[0] == y[1]) & (x[1] == x[2]) & (y[2] == y[3]) & (x[3] == x[0])
    return (x[0] == x[4]) & (y[0] == y[4]) & (up | along) & (x[0] != x[2]) & (y[0] != y[2])


def groups(column: pa.Array, most: int = 8) -> list[tuple[np.ndarray, Alike]]:
    """(rows, their geometries) for up to ``most`` structures; other rows, nulls and numbers that are not finite are in none."""
    column = column if column.type == pa.binary() else column.cast(pa.binary())
    n, out = len(column), []
    if not n or column.null_count == n:
        return out
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int32, column.offset + n + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(starts)
    left = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (sizes >= 21))
    while len(left) and most:
        most -= 1
        size = int(sizes[left[0]])
        head = data[starts[left[0]] : starts[left[0]] + size].tobytes()
        told = _places(head)
        rows = left[sizes[left] == size]
        if told is None or not told[0] or told[1] != size:
            left = left[1:] if len(rows) < len(left) else left[:0]
            continue
        flat = data[starts[0] : starts[0] + n * size].reshape(n, size) if len(rows) == n else data[starts[rows][:, None] + np.arange(size)]
        mask = _mask(size, told[0])
        same = (flat[:, ~mask] == np.frombuffer(head, np.uint8)[~mask]).all(axis=1)
        xy = np.ascontiguousarray(flat[same][:, mask]).view("<f8").reshape(int(same.sum()), -1, 2)
        left = np.setdiff1d(left, rows[same], assume_unique=True)
        fine = np.isfinite(xy).all(axis=(1, 2))
        found, xy = rows[same][fine], xy[fine]
        if head[1] == 3 and xy.shape[1] == 5 and _HEAD.unpack_from(head, 5)[0] == 1:
            rect = _rectangles(xy)
            out += [(found[w], Alike(head, xy[w], k)) for w, k in ((rect, True), (~rect, False)) if w.any()]
        elif len(found):
            out.append((found, Alike(head, xy)))
    return out


# -- functions on groups: they give a value for each row, (rows it holds for, values there), or None ----------------


def _sum(terms: list[np.ndarray]) -> np.ndarray:
    """As ``sum`` adds floats: with a running compensation."""
    total, lost = np.zeros(len(terms[0])), np.zeros(len(terms[0]))
    for x in terms:
        t = total + x
        lost += np.where(np.abs(total) >= np.abs(x), (total - t) + x, (x - t) + total)
        total = t
    return total + lost


def _lines(a: Alike) -> list[np.ndarray]:
    """Each line and ring of a row as the numbers of its points."""
    return [np.array([int(p[0]) // 2 for p in line]) for line in G.lines_of(a.indexed)]


def _steps(a: Alike, f: Callable) -> list[np.ndarray]:
    return [f(a.xy[:, i], a.xy[:, j]) for line in _lines(a) for i, j in zip(line, line[1:], strict=False)]


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.hypot(q[:, 0] - p[:, 0], q[:, 1] - p[:, 1])


def _ring_area(a: Alike, ring: list) -> np.ndarray:
    at = [int(p[0]) // 2 for p in ring]
    x, y = a.xy[..., 0], a.xy[..., 1]
    return _sum([x[:, i] * y[:, j] - x[:, j] * y[:, i] for i, j in zip(at, at[1:], strict=False)] or [np.zeros(len(x))]) / 2


def _area(a: Alike):
    parts = [_sum([np.abs(_ring_area(a, p[0]))]) - _sum([np.abs(_ring_area(a, h)) for h in p[1:]] or [np.zeros(len(a.xy))]) for k, p in G.simple_parts(a.indexed) if k == 3]
    return _sum(parts) if parts else None


def _length(a: Alike):
    return _sum(_steps(a, _far) or [np.zeros(len(a.xy))])


def _sphere(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    a, b = np.radians(p[:, 1]), np.radians(q[:, 1])
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(q[:, 0] - p[:, 0]) / 2) ** 2
    return 2 * G.SPHERE * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _centroid(a: Alike):
    if a.kind == 1:
        return a
    if a.kind != 2:
        return None
    n = _steps(a, _far)
    total = sum(n)
    if not len(n) or (total == 0).any():
        return None
    mids = _steps(a, lambda p, q: (p + q) / 2)
    xy = sum(w[:, None] * m for w, m in zip(n, mids, strict=True)) / total[:, None]
    return Alike(G.write((1, (0.0, 0.0))), xy[:, None])


def _rect(box: np.ndarray) -> Alike:
    x0, y0, x1, y1 = box.T
    return Alike(G.write(G.box(0.0, 0.0, 1.0, 1.0)), np.stack([np.stack(p, axis=-1) for p in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))], axis=1))


def _extents(box: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in box.T], names=["xmin", "ymin", "xmax", "ymax"])


def _points(x: np.ndarray, y: np.ndarray) -> Alike:
    return Alike(G.write((1, (0.0, 0.0))), np.stack([x, y], axis=-1)[:, None])


def _point_m(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> pa.Array:
    made = np.tile(np.frombuffer(struct.pack("<BI3d", 1, 2001, 0, 0, 0), np.uint8), (len(x), 1))
    made[:, 5:] = np.stack([x, y, m], axis=-1).astype("<f8").view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(29)), pa.py_buffer(made)])


def _structural(name: str) -> Callable:
    """Of functions that look at the structure alone: the first row's."""
    return lambda a, *more: G.FUNCTIONS[name][2](a.indexed, *more)


def _choosing(name: str) -> Callable:
    """Of functions that choose among points without a look at them: what they make of the points' numbers."""

    def choose(a: Alike, *numbers):
        if any((n != n[0]).any() for n in numbers):
            return None
        got = G.FUNCTIONS[name][2](a.indexed, *(int(n[0]) for n in numbers))
        return _NULLS if got is None else a.chosen(got)

    return choose


_NULLS = object()


def _told(dump: Callable, number: str) -> Callable:
    """Texts by a pattern that the structure gives."""

    def tell(a: Alike):
        pattern = _NUMBER.sub(number, dump(a.indexed).replace("%", "%%"))
        return [pattern % tuple(row) for row in a.xy.reshape(len(a.xy), -1).tolist()]

    return tell


def _parsed(name: str) -> Callable:
    """Well-known texts that differ in their numbers alone are parsed once."""

    def parse(texts: list):
        texts = [t.strip().removeprefix("SRID=4326;") for t in texts]
        shape = _NUMBER.sub("#", texts[0])
        good = np.array([_NUMBER.sub("#", t) == shape for t in texts])
        count = iter(range(shape.count("#")))
        g = G.FUNCTIONS[name][2](_NUMBER.sub(lambda _: str(next(count)), texts[0]))
        points = G.points_of(g)
        if not points:
            return None
        numbers = np.array([[float(v) for v in _NUMBER.findall(t)] for t, k in zip(texts, good, strict=True) if k])
        return good, Alike(G.write(g), numbers[:, np.array(points).astype(int)])

    return parse


def _on(p, q, r) -> np.ndarray:
    """Exactly on a segment."""
    flat = (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]) == 0
    return flat & (np.minimum(p, q) <= r).all(axis=1) & (r <= np.maximum(p, q)).all(axis=1)


def _meet(a, b, c, d, joints: list) -> np.ndarray:
    """Two segments meet in another point than ``joints``."""
    other = lambda p: np.logical_and.reduce([(p != j).any(axis=1) for j in joints]) if joints else True
    met = np.zeros(len(a), bool)
    for p, q, r in ((a, b, c), (a, b, d), (c, d, a), (c, d, b)):
        met |= _on(p, q, r) & other(r)
    cross = (b[:, 0] - a[:, 0]) * (d[:, 1] - c[:, 1]) - (b[:, 1] - a[:, 1]) * (d[:, 0] - c[:, 0])
    with np.errstate(all="ignore"):
        u = ((c[:, 0] - a[:, 0]) * (d[:, 1] - c[:, 1]) - (c[:, 1] - a[:, 1]) * (d[:, 0] - c[:, 0])) / cross
        v = ((c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]) - (c[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])) / cross
        at = a + u[:, None] * (b - a)
        return met | ((np.abs(cross) > 1e-300) & (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1) & other(at))


def _simple(a: Alike):
    good, simple = np.ones(len(a.xy), bool), np.ones(len(a.xy), bool)
    for line in _lines(a):
        if len(line) > 64:
            return None
        s = [(a.xy[:, i], a.xy[:, j]) for i, j in zip(line, line[1:], strict=False)]
        for p, q in s:
            good &= (p != q).any(axis=1)  # segments of no length are left out row by row
        closed = (a.xy[:, line[0]] == a.xy[:, line[-1]]).all(axis=1)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                bad = _meet(*s[i], *s[j], [s[i][1]] if j == i + 1 else [])
                if i == 0 and j == len(s) - 1 and j > 1:
                    bad = np.where(closed, _meet(*s[i], *s[j], [s[0][0]]), bad)
                simple &= ~bad
    return good, simple[good]


def _valid(a: Alike):
    if a.kind == 1:
        return np.ones(len(a.xy), bool)
    if a.kind != 3:
        return None
    got = _simple(a)
    if got is None:
        return None
    valid, rings = np.zeros(len(a.xy), bool), _lines(a)
    valid[got[0]] = got[1]
    for ring in rings:
        valid &= (a.xy[:, ring[0]] == a.xy[:, ring[-1]]).all(axis=1) & (len(ring) >= 4)
    for hole in rings[1:]:
        p, odd, on = a.xy[:, hole[0]], np.zeros(len(a.xy), bool), np.zeros(len(a.xy), bool)
        for i, j in zip(rings[0], rings[0][1:], strict=False):
            f, t = a.xy[:, i], a.xy[:, j]
            with np.errstate(all="ignore"):
                odd ^= ((f[:, 1] > p[:, 1]) != (t[:, 1] > p[:, 1])) & (p[:, 0] < (t[:, 0] - f[:, 0]) * (p[:, 1] - f[:, 1]) / (t[:, 1] - f[:, 1]) + f[:, 0])
            on |= _on(f, t, p)
        valid &= odd | on
    return got[0], valid[got[0]]


def _ring(a: Alike):
    if a.kind != 2:
        return np.zeros(len(a.xy), bool)
    got = _simple(a)
    return None if got is None else (got[0], got[1] & (a.xy[:, 0] == a.xy[:, -1]).all(axis=1)[got[0]])


def _closed(a: Alike):
    return np.logical_and.reduce([(a.xy[:, line[0]] == a.xy[:, line[-1]]).all(axis=1) for line in _lines(a)] or [np.ones(len(a.xy), bool)])


def _boundary(a: Alike):
    if a.kind in (3, 6):
        return a.chosen(G.boundary(a.indexed))
    if a.kind != 2:
        return None
    open_ = (a.xy[:, 0] != a.xy[:, -1]).any(axis=1)
    return open_, a.of(open_).chosen(G.boundary(a.indexed))


# -- relations ------------------------------------------------------------------------------------------------------


def _tiny(a: Alike, b: Alike) -> np.ndarray:
    return 1e-12 * np.maximum(np.maximum(np.abs(a.box).max(axis=1), np.abs(b.box).max(axis=1)), 1e-12)


def _nine(a: np.ndarray, b: np.ndarray, tiny: np.ndarray) -> np.ndarray:
    """The nine intersections of two rectangles by their sides: -1 where empty."""
    less = lambda u, v: u < v - tiny
    (ax, ay, aX, aY), (bx, by, bX, bY) = a.T, b.T
    over_x, over_y = less(ax, bX) & less(bx, aX), less(ay, bY) & less(by, aY)
    meet = ~(less(bX, ax) | less(aX, bx) | less(bY, ay) | less(aY, by))
    within = lambda x, y, X, Y, u, v, U, V: ~(less(x, u) | less(U, X) | less(y, v) | less(V, Y))
    a_in, b_in = within(ax, ay, aX, aY, bx, by, bX, bY), within(bx, by, bX, bY, ax, ay, aX, aY)
    deep = lambda x, y, X, Y, u, v, U, V: less(u, x) & less(X, U) & less(v, y) & less(Y, V)
    between = lambda v, low, high: less(low, v) & less(v, high)
    a_cut = ((between(bx, ax, aX) | between(bX, ax, aX)) & over_y) | ((between(by, ay, aY) | between(bY, ay, aY)) & over_x)
    b_cut = ((between(ax, bx, bX) | between(aX, bx, bX)) & over_y) | ((between(ay, by, bY) | between(aY, by, bY)) & over_x)
    level = lambda u, v: ~(less(u, v) | less(v, u))
    shared = ((level(ax, bx) | level(ax, bX) | level(aX, bx) | level(aX, bX)) & over_y) | ((level(ay, by) | level(ay, bY) | level(aY, by) | level(aY, bY)) & over_x)
    edges = meet & ~deep(ax, ay, aX, aY, bx, by, bX, bY) & ~deep(bx, by, bX, bY, ax, ay, aX, aY)
    some = lambda w, d: np.where(w, d, -1)
    return np.stack([some(over_x & over_y, 2), some(a_cut, 1), some(~a_in, 2), some(b_cut, 1), np.where(shared, 1, some(edges, 0)), some(~a_in, 1), some(~b_in, 2), some(~b_in, 1), np.full(len(a), 2)], axis=1)


_AT_POINT = np.array([[-1, -1, 0, -1, -1, -1, 0, -1, 2], [0, -1, -1, -1, -1, -1, -1, -1, 2]])
_IN_RECT = np.array([[-1, -1, 0, -1, -1, -1, 2, 1, 2], [-1, 0, -1, -1, -1, -1, 2, 1, 2], [0, -1, -1, -1, -1, -1, 2, 1, 2]])


def _matrices(a: Alike, b: Alike) -> tuple[np.ndarray, np.ndarray] | None:
    """(rows, nine intersections): of points and rectangles, which have them in closed form."""
    tiny = _tiny(a, b)
    wide = lambda g: (g.box[:, 2:] - g.box[:, :2]).min(axis=1) > 16 * tiny
    if a.kind == b.kind == 1:
        return np.ones(len(tiny), bool), _AT_POINT[(_far(a.xy[:, 0], b.xy[:, 0]) <= tiny).astype(int)]
    if a.rect and b.rect:
        return wide(a) & wide(b), _nine(a.box, b.box, tiny)
    if a.kind == 1 and b.rect:
        p, low, high, by = a.xy[:, 0], b.box[:, :2], b.box[:, 2:], tiny[:, None]
        return wide(b), _IN_RECT[((low - by <= p) & (p <= high + by)).all(axis=1).astype(int) + ((low + by < p) & (p < high - by)).all(axis=1)]
    if a.rect and b.kind == 1:
        good, m = _matrices(b, a)
        return good, m.reshape(-1, 3, 3).transpose(0, 2, 1).reshape(-1, 9)
    return None


def _named(m: np.ndarray, f: Callable[[str], object]) -> np.ndarray:
    """``f`` of each row's matrix, asked once for each that occurs."""
    codes, first, back = np.unique(((m + 1) * 4 ** np.arange(9)).sum(axis=1), return_index=True, return_inverse=True)
    found = [f("".join("F" if d < 0 else str(d) for d in m[i])) for i in first]
    return np.array(found, object)[back] if len(found) else np.zeros(0, object)


def _relate(a: Alike, b: Alike):
    got = _matrices(a, b)
    return got and (got[0], _named(got[1][got[0]], str).tolist())


def _relate_as(a: Alike, b: Alike, patterns: list):
    got = _matrices(a, b)
    if got is None or len(set(patterns)) != 1:
        return None
    return got[0], _named(got[1][got[0]], lambda m: G.matches(m, patterns[0])).tolist()


def _holding(name: str) -> Callable:
    def hold(a: Alike, b: Alike):
        p, q = a.box, b.box
        apart = (p[:, 2] < q[:, 0]) | (q[:, 2] < p[:, 0]) | (p[:, 3] < q[:, 1]) | (q[:, 3] < p[:, 1])
        known, value = apart.copy(), np.full(len(p), name == "disjoint")
        if name == "equals" and a.kind == b.kind == 2 and a.head == b.head:  # a line that is the other, point for point
            same = (a.xy == b.xy).all(axis=(1, 2)) & (np.array(_steps(a, _far)).max(axis=0) > 16 * _tiny(a, b))
            known, value = known | same, np.where(same, True, value)
        if (got := _matrices(a, b)) is not None:
            told = ~apart & got[0]
            value[told] = _named(got[1][told], lambda m: G.PREDICATES[name](m, a.indexed, b.indexed))
            known |= told
        return known, value[known]

    return hold


def _nearest(a: Alike, b: Alike) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(distance, point of a, point of b) of points and rectangles."""
    at = lambda g, p: g.xy[:, 0] if g.kind == 1 else np.clip(p, g.box[:, :2], g.box[:, 2:])
    if not ((a.kind == 1 and (b.kind == 1 or b.rect)) or (a.rect and b.kind == 1)):
        return None
    p = at(a, b.xy[:, 0])
    q = at(b, a.xy[:, 0])
    return _far(p, q), p, q


# -- places ---------------------------------------------------------------------------------------------------------


def _circle(a: Alike, metres: np.ndarray):
    if a.kind != 1:
        return None
    lng, lat, r = np.radians(a.xy[:, 0, 0]), np.radians(a.xy[:, 0, 1]), metres / G.SPHERE
    ring = []
    for i in range(64):
        t = 2 * math.pi * i / 64
        b = np.arcsin(np.sin(lat) * np.cos(r) + np.cos(lat) * np.sin(r) * math.cos(t))
        ring.append(np.stack([np.degrees(lng + np.arctan2(math.sin(t) * np.sin(r) * np.cos(lat), np.cos(r) - np.sin(lat) * np.sin(b))), np.degrees(b)], axis=-1))
    return Alike(G.write((3, [[(0.0, 0.0)] * 65])), np.stack([*ring, ring[0]], axis=1))


def _within_world(a: Alike):
    good = (a.box[:, 0] >= -180) & (a.box[:, 2] <= 180) if a.kind == 3 else np.ones(len(a.xy), bool)
    return good, a.of(good)


def _bits(low: float, high: float, v: np.ndarray, bits: int) -> list[np.ndarray]:
    x0, x1, out = np.full(len(v), low), np.full(len(v), high), []
    for _ in range(bits):
        m = (x0 + x1) / 2
        up = v >= m
        x0, x1 = np.where(up, m, x0), np.where(up, x1, m)
        out.append(up)
    return out


def _texts(letters: np.ndarray) -> pa.Array:
    n, width = letters.shape
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(letters))])


def _geohash(a: Alike, bits: np.ndarray):
    c = _centroid(a)
    if c is None or (bits != bits[0]).any():
        return None
    n = -(-int(bits[0]) // 5) * 5
    x, y = _bits(-180.0, 180.0, c.xy[:, 0, 0], -(-n // 2)), _bits(-90.0, 90.0, c.xy[:, 0, 1], n // 2)
    each = [x[i // 2] if i % 2 == 0 else y[i // 2] for i in range(n)]
    codes = [sum(each[s + t].astype(int) << (4 - t) for t in range(5)) for s in range(0, n, 5)]
    return _texts(np.frombuffer(G._HASH.encode(), np.uint8)[np.stack(codes, axis=1)]) if codes else None


def _hash_boxes(texts: list) -> tuple[np.ndarray, np.ndarray] | None:
    size = len(texts[0])
    good = np.array([len(t) == size and t.isascii() for t in texts])
    letters = np.frombuffer("".join(t for t, k in zip(texts, good, strict=True) if k).lower().encode(), np.uint8).reshape(-1, size) if size else np.zeros((0, 0))
    table = np.full(256, -1)
    table[np.frombuffer(G._HASH.encode(), np.uint8)] = np.arange(32)
    if not size or (codes := table[letters]).min() < 0:
        return None
    ends = [np.full(len(codes), v) for v in (-180.0, 180.0, -90.0, 90.0)]
    for i in range(5 * size):
        up, k = (codes[:, i // 5] >> (4 - i % 5)) & 1 == 1, 2 * (i % 2)
        m = (ends[k] + ends[k + 1]) / 2
        ends[k], ends[k + 1] = np.where(up, m, ends[k]), np.where(up, ends[k + 1], m)
    x0, x1, y0, y1 = ends
    return good, np.stack([x0, y0, x1, y1], axis=1)


def _hash_box(texts: list):
    got = _hash_boxes(texts)
    return got and (got[0], _rect(got[1]))


def _hash_point(texts: list):
    got = _hash_boxes(texts)
    return got and (got[0], _points(got[1][:, 0] / 2 + got[1][:, 2] / 2, got[1][:, 1] / 2 + got[1][:, 3] / 2))


def _sides(e: pa.StructArray) -> np.ndarray | None:
    names = {f.name.lower(): f.name for f in e.type}
    found = [names.get(a, names.get(b)) for a, b in (("xmin", "minx"), ("ymin", "miny"), ("xmax", "maxx"), ("ymax", "maxy"))]
    columns = [e.field(n) for n in found if n]
    if len(columns) < 4 or any(c.null_count for c in columns):
        return None
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)


def _boxed(e: pa.StructArray):
    box = _sides(e)
    return None if box is None else _rect(box)


def _box_in(e: pa.StructArray, source: list, target: list):
    from cellweave.operators.joins import boxes_in

    box = _sides(e)
    if box is None or len(set(source)) != 1 or len(set(target)) != 1:
        return None
    return boxes_in(box, source[0], target[0])


def _xz2(e: pa.StructArray, crs: list, res: np.ndarray):
    box = _box_in(e, crs, ["EPSG:4326"])
    if box is None or (res != res[0]).any() or not 0 < int(res[0]) <= 28:
        return None
    r = int(res[0])
    low, high = (box[:, :2] + (180, 90)) / (360, 180), (box[:, 2:] + (180, 90)) / (360, 180)
    most = (high - low).max(axis=1)
    level = np.array([r if m <= 0 else min(r, int(math.floor(math.log(m) / math.log(0.5)))) for m in most.tolist()])
    w = (0.5 ** (level + 1.0))[:, None]
    level += (level < r) & (high <= np.floor(low / w) * w + 2 * w).all(axis=1)
    code, a, b = np.zeros(len(box), np.int64), np.zeros((len(box), 2)), np.ones((len(box), 2))
    for i in range(r):
        on, m = i < level, (a + b) / 2
        up = low >= m
        code += np.where(on, 1 + (up[:, 0] + 2 * up[:, 1]) * ((4 ** (r - i) - 1) // 3), 0)
        a, b = np.where(up, m, a), np.where(up, b, m)
    return code


def _joined(column: pa.ListArray):
    """The points of lists of one length: rows x points x 2."""
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count or not len(sizes) or sizes[0] < 2 or (sizes != sizes[0]).any():
        return None
    held = groups(column.flatten())
    if len(held) != 1 or held[0][1].kind != 1 or len(held[0][0]) != len(column) * sizes[0]:
        return None
    return held[0][1].xy.reshape(len(column), sizes[0], 2)


def _line(column: pa.ListArray):
    xy = _joined(column)
    return None if xy is None else Alike(G.write((2, [(0.0, 0.0)] * xy.shape[1])), xy)


def _along(column: pa.ListArray):
    xy = _joined(column)
    return None if xy is None else _sum([_sphere(xy[:, i], xy[:, i + 1]) for i in range(xy.shape[1] - 1)])


def _ordinate(i: int) -> Callable:
    return lambda a: a.xy[:, 0, i] if a.kind == 1 else _NULLS


FAST: dict[str, Callable] = {
    "st_point": _points, "st_makePoint": _points, "st_makePointM": _point_m, "st_makeLine": _line, "st_aggregateDistanceSphere": _along, "st_geometry": _boxed, "rf_geometry": _boxed, "st_x": _ordinate(0), "st_y": _ordinate(1),
    "st_area": _area, "st_length": _length, "st_centroid": _centroid, "st_extent": lambda a: _extents(a.box), "st_envelope": lambda a: _rect(a.box), "st_boundary": _boundary, "st_isClosed": _closed, "st_isRing": _ring, "st_isSimple": _simple, "st_isValid": _valid,
    "st_makeBox2D": lambda a, b: _rect(np.concatenate([np.minimum(a.xy[:, 0], b.xy[:, 0]), np.maximum(a.xy[:, 0], b.xy[:, 0])], axis=1)) if a.kind == b.kind == 1 else None,
    "st_translate": lambda a, dx, dy: Alike(a.head, a.xy + np.stack([dx, dy], axis=-1)[:, None]), "st_asText": _told(G.to_text, "%.15g"), "st_asGeoJSON": _told(lambda g: json.dumps(G.to_json(g)), "%r"),
    "st_asLatLonText": lambda a: [G.latlon_text(x, y) for x, y in a.xy[:, 0].tolist()] if a.kind == 1 else None, "st_lengthSphere": lambda a: _sum(_steps(a, _sphere) or [np.zeros(len(a.xy))]),
    "st_distanceSphere": lambda a, b: _sphere(a.xy[:, 0], b.xy[:, 0]) if a.kind == b.kind == 1 else None, "st_bufferPoint": _circle, "st_antimeridianSafeGeom": _within_world, "st_geoHash": _geohash, "st_geomFromGeoHash": _hash_box, "st_pointFromGeoHash": _hash_point,
    "rf_xz2_index": _xz2, "rf_reprojected_extent": lambda e, s, t: None if (b := _box_in(e, s, t)) is None else _extents(b), "st_relate": _relate, "st_relateBool": _relate_as,
    "st_distance": lambda a, b: None if (n := _nearest(a, b)) is None else n[0], "st_closestPoint": lambda a, b: None if (n := _nearest(a, b)) is None else _points(*n[1].T),
}
FAST |= {f"st_{n}": _structural(f"st_{n}") for n in ("dimension", "geometryType", "isCollection", "isEmpty", "numGeometries", "numPoints")}
FAST |= {f"st_{n}": _choosing(f"st_{n}") for n in ("exteriorRing", "interiorRingN", "geometryN", "pointN", "makePolygon", "polygon", "castToPoint", "castToPolygon", "castToLineString")}
FAST |= {f"st_{n}": _parsed(f"st_{n}") for n in ("geomFromWKT", "lineFromText", "mLineFromText", "mPointFromText", "mPolyFromText", "pointFromText", "polygonFromText")}
FAST |= {f"st_{n}": _holding(n) for n in G.PREDICATES}
#: Functions of WKB itself: plain WKB is what they give back.
FAST |= {"st_asBinary": lambda a: a, "st_geomFromWKB": lambda a: a, "st_pointFromWKB": lambda a: a if a.kind == 1 else _NULLS, "st_coordDim": lambda a: 2}
_WKB = {"st_geomFromWKB", "st_pointFromWKB", "st_coordDim"}


# -- evaluation -----------------------------------------------------------------------------------------------------


def _given(column: pa.Array, rows: np.ndarray, kind: str):
    part = column if len(rows) == len(column) else column.take(pa.array(rows))
    if kind in ("double", "int"):
        return part.to_numpy(zero_copy_only=False)
    return part.to_pylist() if kind == "string" else part


def _arrow(value, n: int, gives: str) -> pa.Array:
    kind = G._ARROW[gives]
    if value is _NULLS:
        return pa.nulls(n, kind)
    if isinstance(value, Alike):
        return value.binary()
    if isinstance(value, pa.Array):
        return value.cast(kind)
    if isinstance(value, np.ndarray):
        return pa.array(np.ascontiguousarray(value), from_pandas=False).cast(kind) if value.dtype != object else pa.array(value.tolist(), kind)
    return pa.array(value if isinstance(value, list) else [value] * n, kind)


def _row_by_row(name: str, columns: list[pa.Array]) -> pa.Array:
    takes, gives, function = G.FUNCTIONS[name]
    ready = [G.read if t == G.G else (lambda x: x) for t in takes]
    out = []
    for row in zip(*(c.to_pylist() for c in columns), strict=True):
        got = None if any(x is None for x in row) else function(*(f(x) for f, x in zip(ready, row, strict=True)))
        out.append(G.write(got) if gives == G.G and got is not None else got)
    return pa.array(out, G._ARROW[gives])


def _by_groups(name: str, columns: list[pa.Array]) -> pa.Array:
    takes, gives, _ = G.FUNCTIONS[name]
    n, made, where = len(columns[0]), [], []
    valid = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    sets: list[tuple[np.ndarray, list]] = [(np.flatnonzero(valid), [])]
    for t, c in zip(takes, columns, strict=True):
        if t == G.G or name in _WKB:
            cut = groups(c)
            found = []
            for rows, before in sets:
                for here, g in cut:
                    both, i, j = np.intersect1d(rows, here, assume_unique=True, return_indices=True)
                    if len(both):
                        found.append((both, [*((b.of(i) if len(i) < len(rows) else b) if isinstance(b, Alike) else b for b in before), g.of(j) if len(j) < len(here) else g]))
            sets = found
        else:
            sets = [(rows, [*before, None]) for rows, before in sets]
    for rows, held in sets:
        if not len(rows):
            continue
        value = FAST[name](*(h if h is not None else _given(c, rows, t) for h, c, t in zip(held, columns, takes, strict=True)))
        if value is None:
            continue
        if isinstance(value, tuple):
            good, value = value
            rows = rows[good]
        made.append(_arrow(value, len(rows), gives))
        where.append(rows)
    done = np.zeros(n, bool)
    for rows in where:
        done[rows] = True
    if len(made) == 1 and done.all():
        return made[0]
    rest = np.flatnonzero(~done)
    made.append(_row_by_row(name, [c.take(pa.array(rest)) for c in columns]))
    order = np.empty(n, np.int64)
    order[np.concatenate([*where, rest])] = np.arange(n)
    return pa.concat_arrays(made).take(pa.array(order))


#: The last results of this process: one batch asks for the same more than once where functions are nested.
_LAST: dict[str, deque] = {}


def evaluate(name: str, *columns: pa.Array) -> pa.Array:
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    held = _LAST.setdefault(name, deque(maxlen=3))
    for given, found in held:
        if len(given) == len(columns) and all(a is b or a.equals(b) for a, b in zip(given, columns, strict=True)):
            return found
    found = _by_groups(name, columns) if name in FAST and len(columns[0]) else _row_by_row(name, columns)
    held.append((columns, found))
    return found
