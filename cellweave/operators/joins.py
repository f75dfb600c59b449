"""The raster join: tiles of one frame laid over the tiles of another by place.

A left outer join on intersecting boxes is not an equality, so both sides are dealt
to the cells of a grid by integer keys and joined on the cell; a pair that
meets in several cells counts in the one of the lower left corner of what they share. The grid's width is the
largest left box, so a left row is in at most four cells. No row of either side is ever held against all of the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave import functions as rf
from cellweave.functions.kernels import alike, matrices, resampled, to_tiles
from cellweave.operators.cells import tile_columns
from cellweave.tiles import TILE

R = 6378137.0


def mercator(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.radians(x) * R, R * np.log(np.tan(np.pi / 4 + np.radians(y) / 2))


def from_mercator(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.asarray(x) / R), np.degrees(2 * np.arctan(np.exp(np.asarray(y) / R)) - np.pi / 2)


def _utm(x: np.ndarray, y: np.ndarray, zone: int, south: bool, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Universal transverse Mercator on WGS84 by series of the third flattening."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    centre, north = np.radians(6 * zone - 183), 1e7 if south else 0.0
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    lats = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not back:
        lng, lat = np.radians(x) - centre, np.radians(y)
        e = 2 * np.sqrt(n) / (1 + n)
        t = np.sinh(np.arctanh(np.sin(lat)) - e * np.arctanh(e * np.sin(lat)))
        xi, eta = np.arctan2(t, np.cos(lng)), np.arctanh(np.sin(lng) / np.sqrt(1 + t * t))
        east = eta + sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(forward, 1))
        up = xi + sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(forward, 1))
        return 5e5 + 0.9996 * big * east, north + 0.9996 * big * up
    xi, eta = (y - north) / (0.9996 * big), (x - 5e5) / (0.9996 * big)
    xi0 = xi - sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(inverse, 1))
    eta0 = eta - sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(inverse, 1))
    chi = np.arcsin(np.sin(xi0) / np.cosh(eta0))
    lat = chi + sum(c * np.sin(2 * j * chi) for j, c in enumerate(lats, 1))
    return np.degrees(centre + np.arctan2(np.sinh(eta0), np.cos(xi0))), np.degrees(lat)


def reproject(x: np.ndarray, y: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in another CRS: EPSG:4326, EPSG:3857 and the zones EPSG:326nn and EPSG:327nn; others raise."""
    if source == target:
        return np.asarray(x, float), np.asarray(y, float)

    def utm(crs: str) -> tuple[int, bool] | None:
        code = int(crs.removeprefix("EPSG:")) if crs.startswith("EPSG:") and crs[5:].isdigit() else 0
        return (code % 100, code // 100 == 327) if code // 100 in (326, 327) and 1 <= code % 100 <= 60 else None

    for crs in (source, target):
        if crs not in ("EPSG:4326", "EPSG:3857") and not utm(crs):
            raise ValueError(f"no closed form for {crs}")
    if source == "EPSG:3857":
        x, y = from_mercator(x, y)
    elif zone := utm(source):
        x, y = _utm(x, y, *zone, True)
    if target == "EPSG:3857":
        return mercator(np.asarray(x), np.asarray(y))
    if zone := utm(target):
        return _utm(x, y, *zone, False)
    return np.asarray(x, float), np.asarray(y, float)


def boxes_in(boxes: np.ndarray, source: str, target: str, steps: int = 8) -> np.ndarray:
    """Boxes (rows of xmin, ymin, xmax, ymax) in another CRS: the boxes there of points along their edges."""
    t = np.linspace(0, 1, steps + 1)
    xs = boxes[:, 0:1] + t * (boxes[:, 2:3] - boxes[:, 0:1])
    ys = boxes[:, 1:2] + t * (boxes[:, 3:4] - boxes[:, 1:2])
    first, last = (lambda v: np.repeat(v[:, :1], steps + 1, axis=1)), (lambda v: np.repeat(v[:, -1:], steps + 1, axis=1))
    x, y = reproject(np.concatenate([xs, xs, first(xs), last(xs)], axis=1), np.concatenate([first(ys), last(ys), ys, ys], axis=1), source, target)
    return np.stack([x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)], axis=1)


def box_in(extent: dict, source: str, target: str, steps: int = 8) -> tuple[float, float, float, float]:
    """The box in another CRS of points along the edges of a box."""
    return tuple(float(v) for v in boxes_in(np.array([[extent[k] for k in ("xmin", "ymin", "xmax", "ymax")]], float), source, target, steps)[0])


def _sides_of(extents: pa.StructArray) -> np.ndarray:
    """xmin, ymin, xmax, ymax of each row; NaN where there is no box."""
    sides = np.stack([extents.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("xmin", "ymin", "xmax", "ymax")], axis=1)
    sides[~extents.is_valid().to_numpy(zero_copy_only=False)] = np.nan
    return sides


def _moved(df: DataFrame, extent: str, crs: str, to: str, prefix: str) -> DataFrame:
    """With the box in ``to`` as columns; plain arithmetic where the CRS is the same."""
    kinds = T.StructType([*df.schema.fields, *(T.StructField(f"{prefix}{n}", T.DoubleType()) for n in ("x0", "y0", "x1", "y1"))])
    names = list(kinds.names[-4:])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            extents, systems = b.column(b.schema.get_field_index(extent)), b.column(b.schema.get_field_index(crs)).to_pylist()
            sides = _sides_of(extents)
            boxes = np.full((len(b), 4), np.nan)
            for c, rows in alike([None if e is None else e for e in systems], 1):
                boxes[rows] = boxes_in(sides[rows], c, to)
            lost = np.isnan(sides).any(axis=1) | np.array([c is None for c in systems], bool)
            for i, n in enumerate(names):
                b = b.append_column(n, pa.array(np.ascontiguousarray(boxes[:, i]), mask=lost))
            yield b

    same = df.where(F.col(crs) != to).isEmpty()
    if same:
        return df.select("*", *(F.col(f"{extent}.{k}").alias(n) for k, n in zip(("xmin", "ymin", "xmax", "ymax"), names, strict=True)))
    return df.mapInArrow(move, kinds)


def raster_join(
    left: DataFrame,
    right: DataFrame,
    left_extent: str = "extent",
    left_crs: str = "crs",
    right_extent: str = "extent",
    right_crs: str = "crs",
    resampling: str = "nearest_neighbor",
    condition: str | None = None,
    index_crs: str | None = None,
) -> DataFrame:
    """Each left row with the right tiles that meet its box, laid on the grid of its first tile.

    Right tiles become one tile for each column (of several at a cell the last in the order of the right boxes
    counts); other right columns become lists ``<name>_agg``. Left rows without a
    match keep nulls. ``condition`` is SQL over both sides, with ``left_`` before the left names and ``right_`` before
    the right ones, and takes the place of the boxes.
    """
    left_tiles, right_tiles = tile_columns(left), tile_columns(right)
    others = [c for c in right.columns if c not in (*right_tiles, right_extent, right_crs)]
    spark = left.sparkSession
    first_crs = index_crs or (left.select(left_crs).where(F.col(left_crs).isNotNull()).first() or ["EPSG:4326"])[0]
    one = left.select(F.monotonically_increasing_id().alias("_row"), F.struct(*left.columns).alias("_left"))
    if spark.conf.get("spark.checkpoint.dir", None):
        one = one.checkpoint()  # row numbers must stay if a task runs again
    else:
        one = one.persist()
    two = right.select(F.struct(*right.columns).alias("_right"))
    if condition:
        l = one.select("*", *(F.col(f"_left.{c}").alias(f"left_{c}") for c in left.columns))  # noqa: E741
        r = two.select("*", *(F.col(f"_right.{c}").alias(f"right_{c}") for c in right.columns))
        pairs = l.join(r, F.expr(condition), "inner").select("_row", "_right")
    else:
        flat = lambda df, side, e, c, p: _moved(df.select("*", F.col(f"{side}.{e}").alias(f"{p}e"), F.col(f"{side}.{c}").alias(f"{p}c")), f"{p}e", f"{p}c", first_crs, p)
        l, r = flat(one, "_left", left_extent, left_crs, "l"), flat(two, "_right", right_extent, right_crs, "r")  # noqa: E741
        width = l.agg(F.max(F.greatest(F.col("lx1") - F.col("lx0"), F.col("ly1") - F.col("ly0")))).first()[0] or 1.0
        cell = lambda v: F.floor(F.col(v) / width).cast("bigint")
        spread = lambda df, p: df.withColumn("gx", F.explode(F.sequence(cell(f"{p}x0"), cell(f"{p}x1")))).withColumn("gy", F.explode(F.sequence(cell(f"{p}y0"), cell(f"{p}y1"))))
        keys = spread(l.select("_row", "lx0", "ly0", "lx1", "ly1").where("lx0 is not null"), "l")
        met = keys.join(spread(r.where("rx0 is not null"), "r"), ["gx", "gy"]).where("lx0 <= rx1 and rx0 <= lx1 and ly0 <= ry1 and ry0 <= ly1")
        here = (F.floor(F.greatest("lx0", "rx0") / width) == F.col("gx")) & (F.floor(F.greatest("ly0", "ry0") / width) == F.col("gy"))
        pairs = met.where(here).select("_row", "_right")
    paired = one.join(pairs, "_row", "left")
    grid = f"_left.{left_tiles[0]}" if left_tiles else None
    name = lambda c: c if c not in left.columns else f"right_{c}"
    if right_tiles:
        names = [f"_on_{t}" for t in right_tiles]
        kinds = T.StructType([*paired.schema.fields, *(T.StructField(n, T._parse_datatype_string(TILE)) for n in names)])

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lefts, rights = b.column(b.schema.get_field_index("_left")), b.column(b.schema.get_field_index("_right"))
                (le, lc), (re_, rc) = ((_sides_of(s.field(e)), s.field(c).to_pylist()) for s, e, c in ((lefts, left_extent, left_crs), (rights, right_extent, right_crs)))
                shapes = [(256, 256)] * len(b) if grid is None else [None if t is None else t[1].shape for t in matrices(lefts.field(left_tiles[0]))]
                good = rights.is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(le).any(axis=1) & ~np.isnan(re_).any(axis=1)
                for n, t in zip(names, right_tiles, strict=True):
                    held = list(matrices(rights.field(t)))
                    keys = [(m[1].shape, rc[i], lc[i], shapes[i]) if good[i] and m is not None and shapes[i] is not None else None for i, m in enumerate(held)]
                    found = [None] * len(b)
                    for (_, source, target, shape), rows in alike(keys, max((k[3][0] * k[3][1] for k in keys if k), default=1)):
                        for i, cells in zip(rows, laid(np.stack([held[i][1] for i in rows]), re_[rows], source, le[rows], target, shape, resampling), strict=True):
                            found[i] = (held[i][0], cells)
                    b = b.append_column(n, to_tiles(found))
                yield b

        paired = paired.mapInArrow(lay, kinds)
    keep = F.struct(F.col(f"_right.{right_extent}").alias("e"), *(F.col(f"_on_{t}").alias(t) for t in right_tiles))
    gathered = paired.groupBy("_row").agg(F.any_value("_left").alias("_left"), F.sort_array(F.collect_list(keep)).alias("_all"), *(F.collect_list(f"_right.{c}").alias(f"{c}_agg") for c in others))
    out = [F.col(f"_left.{c}").alias(c) for c in left.columns]
    for t in right_tiles:
        tiles = F.col("_all")
        out.append(_merged(tiles, t).alias(name(t)))
    return gathered.select(*out, *(F.col(f"{c}_agg") for c in others))


def _merged(items, tile: str):
    """The tiles of ``items`` on one another; data covers what came before."""
    tiles = F.filter(F.transform(items, lambda x: x[tile]), lambda t: t.isNotNull())
    over = lambda a, b: F.when(a.isNull(), b).otherwise(
        F.struct(b["cell_type"].alias("cell_type"), b["cols"].alias("cols"), b["rows"].alias("rows"), F.zip_with(a["cells"], b["cells"], lambda x, y: F.coalesce(y, x)).alias("cells"))
    )
    return F.aggregate(tiles, F.lit(None).cast(TILE), over)


def laid(cells: np.ndarray, source: np.ndarray, source_crs: str, target: np.ndarray, target_crs: str, shape: tuple[int, int], method: str) -> np.ndarray:
    """Of each of an array of tiles the part that lies on another grid; ``source`` and ``target`` are their boxes."""
    rows, cols = shape
    side = lambda e, i: e[:, i, None]
    width, height = (side(target, 2) - side(target, 0)) / cols, (side(target, 3) - side(target, 1)) / rows
    if not method.lower().startswith("nearest"):  # to the resolution of the target first
        many = lambda at, of, size, n: np.maximum(1, np.round((of[:, at + 2] - of[:, at]) / size[:, 0])).astype(int) if source_crs == target_crs else np.full(len(of), n)
        sizes = list(zip(many(1, source, height, cells.shape[1]).tolist(), many(0, source, width, cells.shape[2]).tolist(), strict=True))
        out = np.empty((len(cells), rows, cols))
        for size, some in alike(sizes, 1):
            made = np.stack([resampled(cells[i], *size, method) for i in some])
            out[some] = laid(made, source[some], source_crs, target[some], target_crs, shape, "nearest")
        return out
    x = side(target, 0) + (np.arange(cols) + 0.5) * width
    y = side(target, 3) - (np.arange(rows) + 0.5) * height
    px, py = np.broadcast_arrays(x[:, None, :], y[:, :, None])
    px, py = reproject(px, py, target_crs, source_crs)
    box = lambda i: source[:, i, None, None]
    c = np.floor((px - box(0)) / (box(2) - box(0)) * cells.shape[2]).astype(int)
    r = np.floor((box(3) - py) / (box(3) - box(1)) * cells.shape[1]).astype(int)
    good = (c >= 0) & (c < cells.shape[2]) & (r >= 0) & (r < cells.shape[1])
    return np.where(good, cells[np.arange(len(cells))[:, None, None], np.clip(r, 0, cells.shape[1] - 1), np.clip(c, 0, cells.shape[2] - 1)], np.nan)


_SIDES = ("xmin", "ymin", "xmax", "ymax")


def vector_join(shapes: DataFrame, rasters: DataFrame, geometry: str = "geometry", extent: str = "extent", predicate: str = "st_intersects", cell: float | None = None) -> DataFrame:
    """Each row of ``shapes`` with each of ``rasters`` whose box satisfies ``predicate(geometry, box)``; both in one CRS.

    Boxes are dealt to square cells. A box goes to the level whose cells (``cell`` times a power of two; by default
    the middle size of the rasters' boxes) are at least its size, so it meets four of them at most, and is told to each coarser level of the other side; two
    boxes meet at the coarser of their levels alone, in the cell that holds the lower left corner of what they share, so a pair is made once
    and nothing is joined but on equal keys. Boxes beyond the whole of the other side are left out first, and boxes are compared before the predicate is asked. Null geometries and boxes join nothing.
    """
    rf.register(shapes.sparkSession)
    size = lambda e: F.greatest(e["xmax"] - e["xmin"], e["ymax"] - e["ymin"])
    boxes = {"a": shapes.select(rf.call("st_extent", F.col(geometry)).alias("box")), "b": rasters.select(F.col(extent).alias("box"))}
    middle = F.percentile_approx(size(F.col("box")), 0.5).alias("middle")
    whole = {k: df.agg(*(f(f"box.{v}").alias(v) for f, v in zip((F.min, F.min, F.max, F.max), _SIDES, strict=True)), *([middle] if k == "b" and cell is None else [])).first() for k, df in boxes.items()}
    if cell is None:
        cell = whole["b"].middle or 1.0

    def reached(other: str) -> Column:
        """A box meets the whole of the other side; beyond it nothing is dealt."""
        low, high = (tuple(F.lit(whole[other][v]) for v in vs) for vs in (_SIDES[:2], _SIDES[2:]))
        at = lambda v: F.col(f"box.{v}")
        return (at("xmin") <= high[0]) & (at("ymin") <= high[1]) & (at("xmax") >= low[0]) & (at("ymax") >= low[1])

    def levelled(df: DataFrame, box: Column, row: str) -> DataFrame:
        held = df.select(F.struct(*(df[c] for c in df.columns)).alias(row), box.alias("box")).where("box is not null").where(reached("b" if row == "a" else "a"))
        level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size(F.col("box")), F.lit(1e-300)) / cell))).cast("int")
        return held.withColumn("own", level)

    a = levelled(shapes, rf.call("st_extent", F.col(geometry)), "a")
    b = levelled(rasters, F.col(extent), "b")
    levels = {side: sorted(r.own for r in df.select("own").distinct().collect()) for side, df in (("a", a), ("b", b))}  # a few dozen at most

    def dealt(df: DataFrame, side: str) -> DataFrame:
        theirs = levels["b" if side == "a" else "a"]
        coarser = F.filter(F.array(*(F.lit(n) for n in theirs)), lambda n: n > F.col("own")) if theirs else F.array().cast("array<int>")
        told = df.withColumn("level", F.explode(F.concat(F.array("own"), coarser)))
        width = F.lit(cell) * F.pow(F.lit(2.0), "level")
        at = lambda v: F.floor(F.col(f"box.{v}") / width)
        told = told.withColumn("cx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("cy", F.explode(F.sequence(at("ymin"), at("ymax"))))
        return told.select("level", "cx", "cy", side, F.col("own").alias(f"own_{side}"), *(F.col(f"box.{v}").alias(f"{v}_{side}") for v in _SIDES))

    joined = dealt(a, "a").join(dealt(b, "b"), ["level", "cx", "cy"])
    width = F.lit(cell) * F.pow(F.lit(2.0), "level")
    once = (F.col("level") == F.greatest("own_a", "own_b")) & (F.col("cx") == F.floor(F.greatest("xmin_a", "xmin_b") / width)) & (F.col("cy") == F.floor(F.greatest("ymin_a", "ymin_b") / width))
    meet = F.expr("xmin_a <= xmax_b and xmin_b <= xmax_a and ymin_a <= ymax_b and ymin_b <= ymax_a")
    pairs = joined.where(once & meet).select("a", "b")
    held = pairs.where(rf.call(predicate, F.col(f"a.{geometry}"), rf.call("st_geometry", F.col(f"b.{extent}"))))
    names = [c if c not in shapes.columns else f"right_{c}" for c in rasters.columns]
    return held.select(*(F.col("a").getField(c).alias(c) for c in shapes.columns), *(F.col("b").getField(c).alias(n) for c, n in zip(rasters.columns, names, strict=True)))
