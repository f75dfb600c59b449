"""TIFF with geographic tags, read in windows and written whole, by numpy and zlib.

Reads strips and tiles, one or more bands, uncompressed, deflate or LZW, predictors 1 and 2. Other files raise.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: field types (size, code), sample formats, tags.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_FORMATS = {(1, 8): "uint8", (1, 16): "uint16", (1, 32): "uint32", (2, 8): "int8", (2, 16): "int16", (2, 32): "int32", (3, 32): "float32", (3, 64): "float64"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, KEYS, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113


def lzw(data: bytes) -> bytes:
    """The variant of TIFF: most significant bit first, codes widen one early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, value, bits, before = [], 9, 0, 0, b""
    for byte in data:
        value, bits = value << 8 | byte, bits + 8
        while bits >= width:
            code = value >> (bits - width)
            bits -= width
            value &= (1 << bits) - 1
            if code == 256:
                table, width, before = table[:258], 9, b""
                continue
            if code == 257:
                return b"".join(out)
            if not before:
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(before + entry[:1])
            else:
                entry = before + before[:1]
                table.append(entry)
            out.append(entry)
            before = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


@dataclass
class Header:
    """What a reader needs to know of a file."""

    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, usual=None):
        return self.tags.get(tag, (usual,))[0]

    @property
    def cols(self) -> int:
        return self.one(WIDTH)

    @property
    def rows(self) -> int:
        return self.one(HEIGHT)

    @property
    def bands(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def dtype(self) -> np.dtype:
        key = (self.one(FORMAT, 1), self.one(BITS, 8))
        if key not in _FORMATS:
            raise ValueError(f"cells of another kind: format {key[0]}, {key[1]} bits")
        return np.dtype(self.order + np.dtype(_FORMATS[key]).str[1:])

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax; cells of size one from 0 where the file has no place."""
        sx, sy = self.tags.get(SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y = self.tags.get(TIEPOINT, (0.0, 0.0, 0.0, 0.0, float(self.rows)))[:5]
        left, top = x - i * sx, y + j * sy
        return left, top - self.rows * sy, left + self.cols * sx, top

    @property
    def crs(self) -> str | None:
        keys = self.tags.get(KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
        code = found.get(3072) or found.get(2048)
        return f"EPSG:{code}" if code and code != 32767 else None

    @property
    def no_data(self) -> float | None:
        text = b"".join(self.tags[NO_DATA]).split(b"\0")[0].strip() if NO_DATA in self.tags else b""
        return float(text) if text else None

    @property
    def cell_type(self) -> str:
        name = self.dtype.name if self.dtype.name != "uint32" else "float64"
        if name.startswith("float"):
            return name
        return f"{name}raw" if self.no_data is None else f"{name}ud{self.no_data:g}"


class Reader:
    """A TIFF in an open file that can be read at any place."""

    def __init__(self, f):
        self.f = f
        head = f.read_at(8, 0)
        order = {b"II": "<", b"MM": ">"}.get(bytes(head[:2]))
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError("not a TIFF")
        (at,) = struct.unpack(order + "I", head[4:8])
        (count,) = struct.unpack(order + "H", f.read_at(2, at))
        raw, tags = f.read_at(12 * count, at + 2), {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", raw, 12 * i)
            if kind not in _TYPES:
                continue
            size = struct.calcsize(f"{order}{n}{_TYPES[kind]}")
            data = raw[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else f.read_at(size, struct.unpack_from(order + "I", raw, 12 * i + 8)[0])
            tags[tag] = struct.unpack(f"{order}{n}{_TYPES[kind]}", data)
        self.header = Header(order, tags)

    def _block(self, i: int, rows: int, cols: int, samples: int) -> np.ndarray:
        h = self.header
        tiled = TILE_OFFSETS in h.tags
        data = bytes(self.f.read_at(h.tags[TILE_COUNTS if tiled else COUNTS][i], h.tags[TILE_OFFSETS if tiled else OFFSETS][i]))
        packing = h.one(COMPRESSION, 1)
        if packing in (8, 32946):
            data = zlib.decompress(data)
        elif packing == 5:
            data = lzw(data)
        elif packing != 1:
            raise ValueError(f"compression {packing} is not known")
        cells = np.frombuffer(data, h.dtype, rows * cols * samples).reshape(rows, cols, samples)
        if h.one(PREDICTOR, 1) == 2:
            cells = np.cumsum(cells.astype(h.dtype.newbyteorder("=")), axis=1, dtype=h.dtype.newbyteorder("="))
        return cells

    def window(self, band: int, row: int, col: int, rows: int, cols: int) -> np.ndarray:
        """Cells as doubles, NaN for no data; what lies beyond the file is NaN."""
        h = self.header
        if not 0 <= band < h.bands:
            raise IndexError(f"band {band} of {h.bands}")
        out = np.full((rows, cols), np.nan)
        tiled = TILE_OFFSETS in h.tags
        bw, bh = (h.one(TILE_WIDTH), h.one(TILE_HEIGHT)) if tiled else (h.cols, min(h.one(STRIP_ROWS, h.rows), h.rows))
        across, down = -(-h.cols // bw), -(-h.rows // bh)
        apart = h.one(PLANAR, 1) == 2
        for by in range(max(0, row) // bh, min(down, -(-(min(row + rows, h.rows)) // bh))):
            for bx in range(max(0, col) // bw, min(across, -(-(min(col + cols, h.cols)) // bw))):
                i = by * across + bx + (band * across * down if apart else 0)
                height = bh if tiled else min(bh, h.rows - by * bh)
                cells = self._block(i, height, bw, 1 if apart else h.bands)[..., 0 if apart else band].astype(float)
                r0, r1 = max(row, by * bh), min(row + rows, by * bh + height, h.rows)
                c0, c1 = max(col, bx * bw), min(col + cols, bx * bw + bw, h.cols)
                if r0 < r1 and c0 < c1:
                    out[r0 - row : r1 - row, c0 - col : c1 - col] = cells[r0 - by * bh : r1 - by * bh, c0 - bx * bw : c1 - bx * bw]
        if h.no_data is not None:
            out[out == h.no_data] = np.nan
        return out


def to_bytes(bands: list[np.ndarray], extent: tuple[float, float, float, float], crs: str | None, no_data: float | None = None, compress: bool = True, strip_rows: int = 64) -> bytes:
    """A file of bands of one shape and type; NaN becomes ``no_data`` where the type is whole."""
    kind = bands[0].dtype
    if not np.issubdtype(kind, np.floating) and no_data is None and any(np.isnan(b.astype(float)).any() for b in bands):
        raise ValueError("whole cells with gaps need a no-data value")
    cells = np.stack([np.where(np.isnan(b), no_data, b) if no_data is not None else b for b in (b.astype(float) for b in bands)], axis=-1).astype(kind.newbyteorder("<"))
    rows, cols, samples = cells.shape
    strips = [cells[i : i + strip_rows].tobytes() for i in range(0, rows, strip_rows)]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    code = {"u": 1, "i": 2, "f": 3}[kind.kind]
    epsg = int(crs.removeprefix("EPSG:")) if crs and crs.startswith("EPSG:") else None
    keys = [1, 1, 0, 1, *((1024, 0, 1, 2, 2048, 0, 1, epsg) if epsg == 4326 else (1024, 0, 1, 1, 3072, 0, 1, epsg) if epsg else ())]
    keys[3] = (len(keys) - 4) // 4
    xmin, ymin, xmax, ymax = extent
    fields: list[tuple[int, int, list]] = [
        (WIDTH, 4, [cols]), (HEIGHT, 4, [rows]), (BITS, 3, [kind.itemsize * 8] * samples), (COMPRESSION, 3, [8 if compress else 1]), (262, 3, [1]), (OFFSETS, 4, [0] * len(strips)),
        (SAMPLES, 3, [samples]), (STRIP_ROWS, 4, [strip_rows]), (COUNTS, 4, [len(s) for s in strips]), (PLANAR, 3, [1]), (FORMAT, 3, [code] * samples),
        (SCALE, 12, [(xmax - xmin) / cols, (ymax - ymin) / rows, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, xmin, ymax, 0.0]), (KEYS, 3, keys),
    ]
    if no_data is not None:
        fields.append((NO_DATA, 2, [bytes([c]) for c in f"{no_data:g}".encode() + b"\0"]))
    body_at = 8
    at = body_at + sum(map(len, strips))
    offsets, place = [], body_at
    for s in strips:
        offsets.append(place)
        place += len(s)
    fields = [(t, k, offsets if t == OFFSETS else v) for t, k, v in fields]
    directory, extra, extra_at = [], b"", at + 2 + 12 * len(fields) + 4
    for tag, k, values in sorted(fields):
        data = struct.pack(f"<{len(values)}{_TYPES[k]}", *values)
        if len(data) <= 4:
            directory.append(struct.pack("<HHI", tag, k, len(values)) + data.ljust(4, b"\0"))
        else:
            directory.append(struct.pack("<HHII", tag, k, len(values), extra_at + len(extra)))
            extra += data + b"\0" * (len(data) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(strips) + struct.pack("<H", len(fields)) + b"".join(directory) + b"\0\0\0\0" + extra
