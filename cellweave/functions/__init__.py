"""Functions on columns. After ``register(spark)`` each has an SQL function of its name too.

``rf_local_add(tile, tile)`` and its like also take a number in place of the second
tile. In SQL the forms with a number are ``rf_local_add_double`` and ``rf_local_add_int``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.definitions import DEFINITIONS
from cellweave.tiles import TILE


def register(spark: SparkSession) -> SparkSession:
    """Make all functions known to SQL and to the functions of this module in ``spark``."""
    if spark.conf.get("cellweave.registered", None) != spark.sparkContext.applicationId:
        for name, (params, returns, body) in DEFINITIONS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION rf_explode_tiles(t {TILE}) RETURNS TABLE (column_index INT, row_index INT, cell DOUBLE)
            RETURN SELECT int(p.pos % t.cols), int(p.pos div t.cols), p.col FROM posexplode(t.cells) p""")
        spark.conf.set("cellweave.registered", spark.sparkContext.applicationId)
    from cellweave.functions import geometry, kernels

    kernels.register(spark)
    geometry.register(spark)
    return spark


def _column(x) -> Column:
    if isinstance(x, str):
        return F.col(x)
    if isinstance(x, list | tuple):
        return F.array(*(F.lit(int(v)) for v in x))
    return x if isinstance(x, Column) else F.lit(x)


def call(name: str, *args) -> Column:
    """The function of this name; numbers choose its scalar form, lists become arrays."""
    numbers = [a for a in args[1:] if isinstance(a, int | float | Decimal) and not isinstance(a, bool)]
    if numbers and f"{name}_double" in DEFINITIONS:
        whole = f"{name}_int" in DEFINITIONS and all(isinstance(n, int) for n in numbers)
        name += "_int" if whole else "_double"
        args = (args[0], *(a if whole or not isinstance(a, int | Decimal) else float(a) for a in args[1:]))
    return F.call_function(name, *map(_column, args))


def rf_mk_crs(crs: str) -> Column:
    """A literal CRS; raises if it is not an EPSG code."""
    if not crs.upper().startswith("EPSG:") or not crs[5:].isdigit():
        raise ValueError(f"not an EPSG code: {crs}")
    return F.lit(crs.upper())


def rf_local_algebra(op, left, right) -> Column:
    """Any function of two columns, cell by cell, as a tile."""
    a, b = _column(left), _column(right)
    made = F.struct(a["cell_type"].alias("cell_type"), a["cols"].alias("cols"), a["rows"].alias("rows"), F.zip_with(a["cells"], b["cells"], op).alias("cells"))
    return F.when(a.isNotNull() & b.isNotNull(), made)


#: Aggregates over columns, which SQL functions can't be.
_AGGREGATES = {
    "rf_agg_mean": "agg_mean",
    "rf_agg_data_cells": "agg_data_cells",
    "rf_agg_no_data_cells": "agg_no_data_cells",
    "rf_agg_stats": "agg_stats_column",
    "rf_agg_extent": "agg_extent",
    "rf_agg_reprojected_extent": "agg_reprojected_extent",
    "rf_assemble_tile": "assembled",
}


def _known() -> set[str]:
    """All SQL functions, and the short names of those with a scalar form."""
    import importlib

    geometry, kernels = (importlib.import_module(f"{__name__}.{m}") for m in ("geometry", "kernels"))
    return {*DEFINITIONS, *geometry.FUNCTIONS, *kernels.NAMES, *(n.removesuffix("_double") for n in DEFINITIONS)}


def __getattr__(name: str):
    """``rf_*`` and ``st_*`` as functions of columns."""
    if name in _AGGREGATES:
        from cellweave.operators import cells

        return getattr(cells, _AGGREGATES[name])
    if name.startswith(("rf_", "st_")) and name in _known():

        def function(*args) -> Column:
            return call(name, *args)

        function.__name__ = name
        function.__doc__ = f"SQL: {DEFINITIONS[name][2]}" if name in DEFINITIONS else None
        return function
    raise AttributeError(name)
