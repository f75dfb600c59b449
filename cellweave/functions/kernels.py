"""Work on whole tiles that expressions can't say: windows, surfaces, resampling, pictures.

Arrow functions over batches of tiles; a tile is a numpy matrix with NaN where there is no data.
A window ignores cells beyond the tile. To see over an edge, give tiles a margin first
(:func:`cellweave.operators.layers.with_margin`).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from cellweave.tiles import PROJ_RASTER, TILE, tile_type

ARROW_TILE = pa.struct([("cell_type", pa.string()), ("cols", pa.int32()), ("rows", pa.int32()), ("cells", pa.list_(pa.float64()))])
RESAMPLERS = ["nearest_neighbor", "bilinear", "cubic_convolution", "cubic_spline", "lanczos", "average", "mode", "median", "max", "min", "sum"]
_KEEPS_TYPE = {"nearestneighbor", "mode", "max", "min", "sum"}
#: Colours of the ramps: from low to high.
RAMPS = {
    "Greys": ["ffffff", "bdbdbd", "636363", "000000"],
    "Viridis": ["440154", "3b528b", "21908c", "5dc863", "fde725"],
    "Inferno": ["000004", "57106e", "bc3754", "f98e09", "fcffa4"],
    "Magma": ["000004", "51127c", "b73779", "fc8961", "fcfdbf"],
    "Plasma": ["0d0887", "7e03a8", "cc4778", "f89540", "f0f921"],
    "BlueToRed": ["2a2e7f", "8aa8d6", "e8e8e8", "e58b6b", "aa2429"],
    "GreenToRed": ["1a9850", "d9ef8b", "fee08b", "d73027"],
    "HeatmapYellowToRed": ["f7da22", "ec9a1a", "e15113", "b9140c"],
    "Bathymetry": ["08306b", "2171b5", "6baed6", "deebf7"],
    "LandUse": ["1b7837", "a6dba0", "f7f7bb", "c2a5cf", "762a83"],
}


def matrices(tiles: pa.Array) -> Iterator[tuple[str, np.ndarray] | None]:
    """(cell type, matrix) of each tile, or None."""
    kinds, rows, cells = tiles.field("cell_type").to_pylist(), tiles.field("rows").to_pylist(), tiles.field("cells")
    starts, flat = cells.offsets.to_numpy().tolist(), cells.values.to_numpy(zero_copy_only=False).astype(float)
    for i, valid in enumerate(tiles.is_valid().to_pylist()):
        yield (kinds[i], flat[starts[i] : starts[i + 1]].reshape(rows[i], -1)) if valid else None


def to_tiles(found: list[tuple[str, np.ndarray] | None]) -> pa.Array:
    flat = [np.zeros(0) if t is None else np.asarray(t[1], float).ravel() for t in found]
    starts = np.concatenate([[0], np.cumsum([len(v) for v in flat])]).astype(np.int32)
    values = np.concatenate([np.zeros(0), *flat])
    cells = pa.ListArray.from_arrays(pa.array(starts), pa.array(values, mask=np.isnan(values)))
    kinds, cols, rows = ([None if t is None else f(t) for t in found] for f in (lambda t: t[0], lambda t: t[1].shape[1], lambda t: t[1].shape[0]))
    held = [pa.array(kinds, pa.string()), pa.array(cols, pa.int32()), pa.array(rows, pa.int32()), cells]
    return pa.StructArray.from_arrays(held, fields=list(ARROW_TILE), mask=pa.array([t is None for t in found], pa.bool_()))


def alike(keys: list, cells: int) -> Iterator[tuple[object, list[int]]]:
    """Rows with equal keys (None: none), cut so that ``cells`` numbers a row stay few."""
    held: dict = {}
    for i, k in enumerate(keys):
        if k is not None:
            held.setdefault(k, []).append(i)
    for k, rows in held.items():
        step = max(1, 2_000_000 // max(1, cells))
        for at in range(0, len(rows), step):
            yield k, rows[at : at + step]


def offsets(neighbourhood: str) -> list[tuple[int, int]]:
    """(row, column) steps of ``square-N``, ``circle-R``, ``nesw-N``, ``wedge-R-from-to`` (degrees) or ``annulus-inner-outer``."""
    kind, *numbers = neighbourhood.lower().split("-")
    n = [float(x) for x in numbers]
    reach = int(np.ceil(n[1] if kind == "annulus" else n[0]))
    out = []
    for r in range(-reach, reach + 1):
        for c in range(-reach, reach + 1):
            far = np.hypot(r, c)
            angle = np.degrees(np.arctan2(-r, c)) % 360
            good = {
                "square": lambda: True,
                "circle": lambda far=far: far <= n[0],
                "nesw": lambda r=r, c=c: r == 0 or c == 0,
                "wedge": lambda far=far, angle=angle: far == 0 or (far <= n[0] and (n[1] <= angle <= n[2] if n[1] <= n[2] else angle >= n[1] or angle <= n[2])),
                "annulus": lambda far=far: n[0] <= far <= n[1],
            }
            if kind not in good:
                raise ValueError(f"unknown neighbourhood: {neighbourhood}")
            if good[kind]():
                out.append((r, c))
    return out


def stacked(cells: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """The tile (or each of an array of tiles) moved by each step; NaN beyond it."""
    reach = max((max(abs(r), abs(c)) for r, c in steps), default=0)
    rows, cols = cells.shape[-2:]
    padded = np.pad(cells, [(0, 0)] * (cells.ndim - 2) + [(reach, reach)] * 2, constant_values=np.nan)
    return np.stack([padded[..., reach + r : reach + r + rows, reach + c : reach + c + cols] for r, c in steps])


def _mode(windows: np.ndarray) -> np.ndarray:
    """The most frequent value, of ties the smallest."""
    ordered = np.sort(windows, axis=0)
    best, most, run = np.full(windows.shape[1:], np.nan), np.zeros(windows.shape[1:]), np.zeros(windows.shape[1:])
    for i, layer in enumerate(ordered):
        run = np.where(i and (layer == ordered[i - 1]), run + 1, 1) if i else np.ones_like(most)
        better = (run > most) & ~np.isnan(layer)
        best, most = np.where(better, layer, best), np.where(better, run, most)
    return best


def _moran(windows: np.ndarray, cells: np.ndarray) -> np.ndarray:
    mean, var = np.nanmean(cells), np.nanvar(cells)
    return (cells - mean) / var * np.nanmean(windows - mean, axis=0) if var else np.full(cells.shape, np.nan)


FOCAL: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mean": lambda w: np.nanmean(w, axis=0),
    "median": lambda w: np.nanmedian(w, axis=0),
    "mode": _mode,
    "max": lambda w: np.nanmax(w, axis=0),
    "min": lambda w: np.nanmin(w, axis=0),
    "stddev": lambda w: np.nanstd(w, axis=0),
}


def _aimed(cells: np.ndarray, found: np.ndarray, target: str) -> np.ndarray:
    """The result at cells that ``target`` (all, data, nodata) names; the cell itself elsewhere."""
    missing = np.isnan(cells)
    return {"all": lambda: found, "data": lambda: np.where(missing, cells, found), "nodata": lambda: np.where(missing, found, cells)}[target.lower()]()


def _focal(name: str):
    def function(tiles: pa.Array, neighbourhood: pa.Array, target: pa.Array) -> pa.Array:
        import warnings

        held, out = list(matrices(tiles)), [None] * len(tiles)
        keys = [None if t is None else (t[1].shape, hood, aim) for t, hood, aim in zip(held, neighbourhood.to_pylist(), target.to_pylist(), strict=True)]
        most = max((k[0][0] * k[0][1] * len(offsets(k[1])) for k in {k for k in keys if k}), default=1)
        for (_, hood, aim), rows in alike(keys, most):
            cells, steps = np.stack([held[i][1] for i in rows]), offsets(hood)
            with np.errstate(all="ignore"), warnings.catch_warnings():
                warnings.simplefilter("ignore")
                if name == "moransi":
                    around = [s for s in steps if s != (0, 0)]
                    found = np.stack([_moran(stacked(c, around), c) for c in cells])
                else:
                    found = FOCAL[name](stacked(cells, steps))
            for i, c in zip(rows, _aimed(cells, found, aim), strict=True):
                kind = held[i][0]
                out[i] = (kind if name in ("mode", "max", "min") or kind.startswith("float") else "float64", c)
        return to_tiles(out)

    return arrow_udf(function, tile_type)


def _convolve(tiles: pa.Array, kernel: pa.Array, target: pa.Array) -> pa.Array:
    out = []
    for t, k, aim in zip(matrices(tiles), matrices(kernel), target.to_pylist(), strict=True):
        if t is None or k is None:
            out.append(None)
            continue
        rows, cols = k[1].shape
        steps = [(r - rows // 2, c - cols // 2) for r in range(rows) for c in range(cols)]
        windows = stacked(t[1], steps)
        found = np.nansum(windows * k[1].ravel()[:, None, None], axis=0)
        out.append(("float64", _aimed(t[1], np.where(np.isnan(windows).all(axis=0), np.nan, found), aim)))
    return to_tiles(out)


def gradients(cells: np.ndarray, width: float, height: float) -> tuple[np.ndarray, np.ndarray]:
    """East and south gradients by the third-order finite difference over 3x3 cells; a missing neighbour counts as the cell."""
    steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    w = stacked(cells, steps)
    a, b, c, d, _, f, g, h, i = np.where(np.isnan(w), cells, w)
    return ((c + 2 * f + i) - (a + 2 * d + g)) / (8 * width), ((g + 2 * h + i) - (a + 2 * b + c)) / (8 * height)


def _surface(finish: Callable):
    def rows(rasters: pa.StructArray, numbers: list[pa.Array], target: pa.Array) -> pa.Array:
        out, extents = [], rasters.field("extent").to_pylist()
        for i, t in enumerate(matrices(rasters.field("tile"))):
            e = extents[i]
            if t is None or e is None:
                if t is not None:
                    raise ValueError("a surface needs the extent of its tile")
                out.append(None)
                continue
            width, height = (e["xmax"] - e["xmin"]) / t[1].shape[1], (e["ymax"] - e["ymin"]) / t[1].shape[0]
            found = finish(*gradients(t[1], width, height), *(float(n[i].as_py()) for n in numbers))
            out.append(("float64", _aimed(t[1], found, target[i].as_py())))
        return pa.StructArray.from_arrays([to_tiles(out), rasters.field("extent"), rasters.field("crs")], names=["tile", "extent", "crs"])

    return rows


def _slope_of(dx, dy, z):
    return np.degrees(np.arctan(z * np.hypot(dx, dy)))


def _aspect_of(dx, dy):
    found = np.degrees(np.arctan2(dy, -dx))
    return np.where((dx == 0) & (dy == 0), np.nan, (90 - found) % 360)


def _shade_of(dx, dy, azimuth, altitude, z):
    zenith, angle = np.radians(90 - altitude), np.radians((360 - azimuth + 90) % 360)
    slope, aspect = np.arctan(z * np.hypot(dx, dy)), np.arctan2(dy, -dx)
    return np.clip(np.round(127 * (np.cos(zenith) * np.cos(slope) + np.sin(zenith) * np.sin(slope) * np.cos(angle - aspect))), 0, 127)


def _slope(r: pa.Array, z: pa.Array, target: pa.Array) -> pa.Array:
    return _surface(_slope_of)(r, [z], target)


def _aspect(r: pa.Array, target: pa.Array) -> pa.Array:
    return _surface(_aspect_of)(r, [], target)


def _hillshade(r: pa.Array, azimuth: pa.Array, altitude: pa.Array, z: pa.Array, target: pa.Array) -> pa.Array:
    return _surface(_shade_of)(r, [azimuth, altitude, z], target)


_WEIGHTS: dict[str, tuple[int, Callable]] = {
    "bilinear": (1, lambda d: 1 - d),
    "cubicconvolution": (2, lambda d: np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2)),
    "cubicspline": (2, lambda d: np.where(d < 1, (4 - 6 * d**2 + 3 * d**3) / 6, (2 - d) ** 3 / 6)),
    "lanczos": (3, lambda d: np.sinc(d) * np.sinc(d / 3)),
}


def resampled(cells: np.ndarray, rows: int, cols: int, method: str) -> np.ndarray:
    """The matrix on a grid of another shape over the same box, cell centres aligned, clamped at the edges."""
    name = method.lower().replace("_", "").replace("-", "")
    name = {"nearest": "nearestneighbor", "cubic": "cubicconvolution"}.get(name, name)
    sy, sx = cells.shape[0] / rows, cells.shape[1] / cols
    y, x = (np.arange(rows) + 0.5) * sy, (np.arange(cols) + 0.5) * sx
    if name == "nearestneighbor":
        return cells[np.minimum(y.astype(int), cells.shape[0] - 1)][:, np.minimum(x.astype(int), cells.shape[1] - 1)]
    if name in _WEIGHTS:
        reach, weight = _WEIGHTS[name]
        total, weights = np.zeros((rows, cols)), np.zeros((rows, cols))
        base_y, base_x = np.floor(y - 0.5).astype(int), np.floor(x - 0.5).astype(int)
        for dr in range(1 - reach, reach + 1):
            for dc in range(1 - reach, reach + 1):
                r, c = base_y + dr, base_x + dc
                w = np.outer(weight(np.abs(y - 0.5 - r)), weight(np.abs(x - 0.5 - c)))
                v = cells[np.clip(r, 0, cells.shape[0] - 1)][:, np.clip(c, 0, cells.shape[1] - 1)]
                good = ~np.isnan(v)
                total += np.where(good, v, 0) * w
                weights += good * w
        return np.where(np.abs(weights) > 1e-12, total / np.where(weights == 0, 1, weights), np.nan)
    blocks = {"average": np.nanmean, "median": np.nanmedian, "max": np.nanmax, "min": np.nanmin, "sum": np.nansum, "mode": lambda b: _mode(b.reshape(-1, 1))[0]}
    if name not in blocks:
        raise ValueError(f"unknown method: {method}; known: {', '.join(RESAMPLERS)}")
    out = np.full((rows, cols), np.nan)
    for r in range(rows):
        for c in range(cols):
            block = cells[int(r * sy) : max(int(r * sy) + 1, int(np.ceil((r + 1) * sy))), int(c * sx) : max(int(c * sx) + 1, int(np.ceil((c + 1) * sx)))]
            if not np.isnan(block).all():
                out[r, c] = blocks[name](block[~np.isnan(block)])
    return out


def _new_type(kind: str, method: str) -> str:
    short = method.lower().replace("_", "").replace("-", "")
    return kind if short in _KEEPS_TYPE or short == "nearest" or kind.startswith("float") else "float64"


def _resample(tiles: pa.Array, factor: pa.Array, method: pa.Array) -> pa.Array:
    out = []
    for t, f, m in zip(matrices(tiles), factor.to_pylist(), method.to_pylist(), strict=True):
        out.append(None if t is None else (_new_type(t[0], m), resampled(t[1], max(1, int(t[1].shape[0] * f)), max(1, int(t[1].shape[1] * f)), m)))
    return to_tiles(out)


def _resample_like(tiles: pa.Array, shape: pa.Array, method: pa.Array) -> pa.Array:
    out = []
    for t, s, m in zip(matrices(tiles), matrices(shape), method.to_pylist(), strict=True):
        out.append(None if t is None or s is None else (_new_type(t[0], m), resampled(t[1], *s[1].shape, m)))
    return to_tiles(out)


def png(pixels: np.ndarray) -> bytes:
    """A PNG of (rows, cols, 4) bytes."""
    rows, cols, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[r].astype(np.uint8).tobytes() for r in range(rows))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _scaled(cells: np.ndarray) -> np.ndarray:
    if np.isnan(cells).all():
        return np.zeros(cells.shape)
    low, high = np.nanmin(cells), np.nanmax(cells)
    return np.nan_to_num((cells - low) / (high - low) if high > low else cells * 0)


def ramp_pixels(cells: np.ndarray, ramp: str) -> np.ndarray:
    """Colours by the rank of a cell among the tile's; clear where there is no data."""
    if ramp not in RAMPS:
        raise ValueError(f"unknown colour ramp: {ramp}; known: {', '.join(RAMPS)}")
    stops = np.array([[int(c[i : i + 2], 16) for i in (0, 2, 4)] for c in RAMPS[ramp]], float)
    data = np.sort(cells[~np.isnan(cells)])
    share = np.searchsorted(data, np.nan_to_num(cells), side="right") / max(1, len(data))
    at = np.linspace(0, 1, len(stops))
    colours = np.stack([np.interp(share, at, stops[:, i]) for i in range(3)], axis=-1)
    return np.concatenate([colours, np.where(np.isnan(cells), 0, 255)[..., None]], axis=-1)


def _render_png(r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for bands in zip(matrices(r), matrices(g), matrices(b), strict=True):
        if any(t is None for t in bands):
            out.append(None)
            continue
        cells = [t[1] for t in bands]
        clear = np.isnan(np.stack(cells)).any(axis=0)
        out.append(png(np.stack([*(255 * _scaled(c) for c in cells), np.where(clear, 0, 255)], axis=-1)))
    return pa.array(out, pa.binary())


def _render_ramp(tiles: pa.Array, ramp: pa.Array) -> pa.Array:
    return pa.array([None if t is None else png(ramp_pixels(t[1], r)) for t, r in zip(matrices(tiles), ramp.to_pylist(), strict=True)], pa.binary())


def _rasterize(geometry: pa.Array, bounds: pa.Array, value: pa.Array, cols: pa.Array, rows: pa.Array) -> pa.Array:
    from cellweave.functions import geometry as G
    from cellweave.functions.alike import groups

    columns = [x.to_pylist() for x in (bounds, value, cols, rows)]
    out, left = [None] * len(geometry), np.ones(len(geometry), bool)
    centres = lambda e, w, h: np.meshgrid(e["xmin"] + (np.arange(w) + 0.5) * (e["xmax"] - e["xmin"]) / w, e["ymax"] - (np.arange(h) + 0.5) * (e["ymax"] - e["ymin"]) / h)
    keys = [None if e is None else (*(e[k] for k in ("xmin", "ymin", "xmax", "ymax")), w, h) for e, _, w, h in zip(*columns, strict=True)]
    for at, shapes in groups(geometry):  # geometries of one structure, on one grid
        for (*e, w, h), some in alike([keys[i] for i in at], max(1, columns[2][at[0]] or 1) * max(1, columns[3][at[0]] or 1)):
            x, y = centres(dict(zip(("xmin", "ymin", "xmax", "ymax"), e, strict=True)), w, h)
            for i, burnt in zip(at[some], G.covers_points(shapes.indexed, x, y, shapes.xy[some]), strict=True):
                out[i], left[i] = ("int32", np.where(burnt, float(columns[1][i]), np.nan)), False
    wkb = geometry.to_pylist() if left.any() else []
    for i in np.flatnonzero(left):
        if wkb[i] is not None and keys[i] is not None:
            e, v, w, h = (c[i] for c in columns)
            out[i] = ("int32", np.where(G.covers_points(G.read(wkb[i]), *centres(e, w, h)), float(v), np.nan))
    return to_tiles(out)


#: What :func:`register` adds to SQL.
NAMES = [f"rf_focal_{n}" for n in [*FOCAL, "moransi"]] + [f"rf_{n}" for n in ("convolve", "resample", "resample_like", "resample_nearest", "slope", "aspect", "hillshade", "render_png", "render_color_ramp_png", "rasterize")]


def register(spark: SparkSession) -> None:
    known = {f"rf_focal_{n}": _focal(n) for n in [*FOCAL, "moransi"]}
    known |= {"rf_convolve": arrow_udf(_convolve, tile_type), "rf_resample": arrow_udf(_resample, tile_type), "rf_resample_like": arrow_udf(_resample_like, tile_type)}
    known |= {"rf_slope": arrow_udf(_slope, PROJ_RASTER), "rf_aspect": arrow_udf(_aspect, PROJ_RASTER), "rf_hillshade": arrow_udf(_hillshade, PROJ_RASTER)}
    known |= {"rf_render_png": arrow_udf(_render_png, "binary"), "rf_render_color_ramp_png": arrow_udf(_render_ramp, "binary"), "rf_rasterize": arrow_udf(_rasterize, TILE)}
    for name, function in known.items():
        spark.udf.register(name, function)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rf_resample_nearest(a {TILE}, f DOUBLE) RETURNS {TILE} RETURN rf_resample(a, f, 'nearest_neighbor')")
