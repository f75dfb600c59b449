"""The data model: tiles, extents and cell types as plain nested values.

A tile is ``struct<cell_type, cols, rows, cells>``: cells in rows from the top, as
doubles, with NULL where there is no data. ``cell_type`` is a label such as
``uint8ud255``: a base, then ``raw`` (no value stands for missing data), ``ud<value>`` or nothing (the
base's own value). NULL in, NULL out is the rule for missing data in cell-wise work.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

TILE = "STRUCT<cell_type: STRING, cols: INT, rows: INT, cells: ARRAY<DOUBLE>>"
EXTENT = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
PROJ_RASTER = f"STRUCT<tile: {TILE}, extent: {EXTENT}, crs: STRING>"
tile_type = T.StructType().add("cell_type", T.StringType()).add("cols", T.IntegerType()).add("rows", T.IntegerType()).add("cells", T.ArrayType(T.DoubleType()))
extent_type = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])

#: Bases from narrow to wide, with the least and largest value and the usual value for missing data.
BASES = {
    "bool": (0, 1, None),
    "int8": (-128, 127, -128),
    "uint8": (0, 255, 0),
    "int16": (-32768, 32767, -32768),
    "uint16": (0, 65535, 0),
    "int32": (-2147483648, 2147483647, -2147483648),
    "float32": (None, None, float("nan")),
    "float64": (None, None, float("nan")),
}
CELL_TYPES = [b + s for b in BASES for s in (("",) if b == "bool" else ("", "raw"))]
STANDARD_COLUMNS = "spatial_key temporal_key timestamp geometry center extent crs spatial_index tile proj_raster tile_data metadata column_index row_index path".split()
_NAME = re.compile(r"(bool|u?int8|u?int16|int32|float32|float64)(raw|ud(-?[0-9.]+|nan))?", re.I)


@dataclass(frozen=True)
class CellType:
    """A parsed cell type name."""

    base: str
    no_data: float | None  # NaN for floats

    @classmethod
    def of(cls, name: str) -> CellType:
        m = _NAME.fullmatch(name.strip())
        if not m:
            raise ValueError(f"unknown cell type: {name}")
        base = m[1].lower()
        if m[2] is None:
            return cls(base, BASES[base][2])
        return cls(base, None if m[2].lower() == "raw" else float(m[3]))

    @property
    def name(self) -> str:
        usual = BASES[self.base][2]
        if self.no_data is None:
            return self.base if usual is None else self.base + "raw"
        same = usual is not None and (self.no_data == usual or (np.isnan(usual) and np.isnan(self.no_data)))
        return self.base if same else f"{self.base}ud{self.no_data:g}"

    @property
    def is_float(self) -> bool:
        return self.base.startswith("float")

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("uint8" if self.base == "bool" else self.base)

    def with_no_data(self, value: float | None) -> CellType:
        return CellType(self.base, value)


@dataclass
class Tile:
    """A collected tile: a numpy masked array and its cell type, with arithmetic."""

    cells: np.ma.MaskedArray
    cell_type: str

    @classmethod
    def from_row(cls, row) -> Tile | None:
        if row is None:
            return None
        values = [np.nan if x is None else x for x in row["cells"]]
        data = np.array(values, float).reshape(row["rows"], row["cols"])
        return cls(np.ma.masked_invalid(data), row["cell_type"])

    def to_row(self) -> dict:
        flat = self.cells.ravel()
        gone = np.ma.getmaskarray(flat)
        rows, cols = self.cells.shape
        return {"cell_type": self.cell_type, "cols": cols, "rows": rows, "cells": [None if g else float(x) for x, g in zip(flat.data, gone, strict=True)]}

    def _with(self, other, op) -> Tile:
        value = other.cells if isinstance(other, Tile) else other
        return Tile(np.ma.masked_invalid(op(self.cells.astype(float), value)), self.cell_type)

    def __add__(self, other):
        return self._with(other, np.ma.add)

    def __sub__(self, other):
        return self._with(other, np.ma.subtract)

    def __mul__(self, other):
        return self._with(other, np.ma.multiply)

    def __truediv__(self, other):
        return self._with(other, np.ma.divide)

    def __matmul__(self, other):
        return self._with(other, np.ma.dot)


@dataclass(frozen=True)
class Extent:
    """A box."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float

    @property
    def width(self) -> float:
        return self.xmax - self.xmin

    @property
    def height(self) -> float:
        return self.ymax - self.ymin

    def buffer(self, by: float) -> Extent:
        return Extent(self.xmin - by, self.ymin - by, self.xmax + by, self.ymax + by)

    def intersects(self, other: Extent) -> bool:
        return self.xmin <= other.xmax and other.xmin <= self.xmax and self.ymin <= other.ymax and other.ymin <= self.ymax
