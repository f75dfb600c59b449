"""Between tiles and cells: explode, assemble, and aggregates over cells.

Aggregates over all cells of a column combine one partial per tile where the answer is made of sums, and
otherwise go through one row per cell, which Spark aggregates in part before it
shuffles. Aggregates by cell position keep one row per key and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave import functions as rf
from cellweave.tiles import EXTENT, TILE, extent_type, tile_type


def tile_columns(df: DataFrame) -> list[str]:
    names = set(tile_type.names)
    return [f.name for f in df.schema if f.dataType.typeName() == "struct" and set(f.dataType.names) == names]


def explode_tiles(df: DataFrame, *tiles: str, keep: list[str] | None = None, fraction: float | None = None, seed: int = 0, as_nan: bool = False) -> DataFrame:
    """One row per cell: the ``keep`` columns, column_index, row_index and a column for each tile.

    Tiles must have one shape; a null tile gives nulls, and rows without any tile give
    none. With ``fraction`` a random ``ceil(cells x fraction)`` of each tile's cells.
    """
    keep = [c for c in df.columns if c not in tiles] if keep is None else keep
    shape = F.coalesce(*(F.when(F.col(t).isNotNull(), F.struct(F.col(f"{t}.cols").alias("cols"), F.col(f"{t}.rows").alias("rows"))) for t in tiles))
    size = F.col("_shape.cols") * F.col("_shape.rows")
    nothing = F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(None).cast("double"))
    fit = lambda t: F.when(F.col(t).isNull(), nothing).when(F.size(f"{t}.cells") == size, F.col(f"{t}.cells")).otherwise(F.raise_error(F.lit("tiles of different shapes")).cast("array<double>"))
    cells = F.arrays_zip(F.transform(F.sequence(F.lit(0), size - 1), lambda i: i).alias("at"), *(fit(t).alias(t) for t in tiles))
    shaped = df.select(*keep, *tiles, shape.alias("_shape")).where(F.col("_shape").isNotNull())
    zipped = shaped.select(*keep, F.col("_shape.cols").alias("_cols"), cells.alias("_cells"))
    if fraction is not None:
        zipped = zipped.withColumn("_cells", F.slice(F.shuffle("_cells", F.lit(seed)), F.lit(1), F.ceil(F.size("_cells") * fraction).cast("int")))
    rows = zipped.select(*keep, "_cols", F.explode("_cells").alias("_c"))
    value = lambda i, t: F.coalesce(F.col("_c").getField(t), F.lit(float("nan"))).alias(t) if as_nan else F.col("_c").getField(t).alias(t)
    names = [f.name for f in rows.schema["_c"].dataType.fields]
    at = F.col("_c").getField(names[0])
    return rows.select(*keep, F.pmod(at, "_cols").cast("int").alias("column_index"), F.floor(at / F.col("_cols")).cast("int").alias("row_index"), *(value(i, n).alias(t) for i, (n, t) in enumerate(zip(names[1:], tiles, strict=True))))


def assembled(column: Column | str, row: Column | str, value: Column | str, cols: int, rows: int, cell_type: str = "float64") -> Column:
    """An aggregate: the tile of a group's cells; cells without a row have no data, and of rows for one cell the largest counts."""
    at = (F.col(row) if isinstance(row, str) else row) * cols + (F.col(column) if isinstance(column, str) else column)
    inside = F.when((at >= 0) & (at < cols * rows), at.cast("int")).otherwise(F.raise_error(F.lit("a cell outside the tile")).cast("int"))
    entries = F.sort_array(F.collect_list(F.struct(inside.alias("at"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("v"))))
    bound = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))  # noqa: E731  evaluates x once
    places = F.sequence(F.lit(0), F.lit(cols * rows - 1))
    # a null for every place sorts before that place's cells, of which the last counts
    nulls = F.arrays_zip(places.alias("at"), F.array_repeat(F.lit(None).cast("double"), cols * rows).alias("v"))
    last_of_each = lambda es: F.filter(es, lambda e, i: F.coalesce(F.get(es, i + 1)["at"] != e["at"], F.lit(True)))["v"]
    filled = lambda es: bound(F.sort_array(F.concat(es, nulls)), last_of_each)
    cells = bound(entries, lambda es: F.when(es["at"] == places, es["v"]).otherwise(filled(es)))
    made = F.struct(F.lit("float64").alias("cell_type"), F.lit(cols).alias("cols"), F.lit(rows).alias("rows"), cells.alias("cells"))
    return made if cell_type == "float64" else rf.rf_convert_cell_type(made, F.lit(cell_type))


def agg_mean(tile: Column | str) -> Column:
    return F.try_divide(F.sum(rf.rf_tile_sum(tile)), F.sum(rf.rf_data_cells(tile)))


def agg_data_cells(tile: Column | str) -> Column:
    return F.sum(rf.rf_data_cells(tile))


def agg_no_data_cells(tile: Column | str) -> Column:
    return F.sum(rf.rf_no_data_cells(tile))


def agg_stats_column(tile: Column | str) -> Column:
    """As :func:`agg_stats`, as an aggregate over a column, from one partial per tile."""
    t = F.col(tile) if isinstance(tile, str) else tile
    n, squares = F.sum(rf.rf_data_cells(t)), F.sum(F.aggregate(t["cells"], F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))
    mean = F.try_divide(F.sum(rf.rf_tile_sum(t)), n)
    return F.struct(
        n.alias("data_cells"), F.sum(rf.rf_no_data_cells(t)).alias("no_data_cells"), F.min(F.array_min(t["cells"])).alias("min"), F.max(F.array_max(t["cells"])).alias("max"),
        mean.alias("mean"), F.greatest(F.lit(0.0), F.try_divide(squares, n) - mean * mean).alias("variance"),
    )


def _cells(df: DataFrame, keys: list[str], tile: str) -> DataFrame:
    return df.where(F.col(tile).isNotNull()).select(*keys, F.posexplode(F.col(f"{tile}.cells")).alias("pos", "x"))


def agg_stats(df: DataFrame, keys: list[str], tile: str) -> DataFrame:
    """data_cells, no_data_cells, min, max, mean and population variance of all cells, by key."""
    x = F.col("x")
    return _cells(df, keys, tile).groupBy(*keys).agg(
        F.count(x).alias("data_cells"), F.count_if(x.isNull()).alias("no_data_cells"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance")
    )


def agg_approx_histogram(df: DataFrame, keys: list[str], tile: str, buckets: int = 80) -> DataFrame:
    """bins: array<struct<value, count>>."""
    bins = F.transform(F.histogram_numeric("x", F.lit(buckets)), lambda b: F.struct(b["x"].alias("value"), b["y"].cast("bigint").alias("count")))
    return _cells(df, keys, tile).groupBy(*keys).agg(F.struct(bins.alias("bins")).alias("histogram"))


def agg_approx_quantiles(df: DataFrame, keys: list[str], tile: str, shares: list[float], error: float = 1e-5) -> DataFrame:
    if not shares:
        raise ValueError("at least one share is needed")
    return _cells(df, keys, tile).groupBy(*keys).agg(F.percentile_approx("x", shares, int(1 / error)).alias("quantiles"))


def agg_extent(extent: Column | str) -> Column:
    e = F.col(extent) if isinstance(extent, str) else extent
    return F.struct(F.min(e["xmin"]).alias("xmin"), F.min(e["ymin"]).alias("ymin"), F.max(e["xmax"]).alias("xmax"), F.max(e["ymax"]).alias("ymax"))


def agg_reprojected_extent(extent: Column | str, source_crs: Column | str, target_crs: str) -> Column:
    """The box of all boxes, each moved to ``target_crs`` first."""
    e, c = (F.col(x) if isinstance(x, str) else x for x in (extent, source_crs))
    return agg_extent(rf.call("rf_reprojected_extent", e, c, F.lit(target_crs)))


#: What each aggregate by position makes of the cells at one.
LOCAL = {
    "max": lambda x: F.max(x),
    "min": lambda x: F.min(x),
    "mean": lambda x: F.avg(x),
    "data_cells": lambda x: F.count(x).cast("double"),
    "no_data_cells": lambda x: F.count_if(x.isNull()).cast("double"),
    "count": lambda x: F.nullif(F.count(x).cast("double"), F.lit(0.0)),
    "variance": lambda x: F.var_pop(x),
}
_COUNTS = {"data_cells": "int32", "no_data_cells": "int32", "count": "int32ud0"}


def agg_local(df: DataFrame, keys: list[str], tile: str, *what: str) -> DataFrame:
    """A tile for each of ``what`` (see LOCAL): the aggregate of the cells at each position, by key."""
    shape = df.where(F.col(tile).isNotNull()).select(*keys, F.col(f"{tile}.cols").alias("_cols"), F.col(f"{tile}.rows").alias("_rows"), F.posexplode(f"{tile}.cells").alias("pos", "x"))
    by_cell = shape.groupBy(*keys, "pos").agg(F.max("_cols").alias("_cols"), F.max("_rows").alias("_rows"), F.min("_cols").alias("_least"), *(LOCAL[w](F.col("x")).alias(w) for w in what))
    ordered = F.array_sort(F.collect_list(F.struct("pos", *what)))
    made = by_cell.groupBy(*keys).agg(ordered.alias("_all"), F.max("_cols").alias("_cols"), F.min("_least").alias("_least"), F.max("_rows").alias("_rows"))
    checked = F.when(F.col("_cols") == F.col("_least"), F.col("_cols")).otherwise(F.raise_error(F.lit("tiles of different shapes")).cast("int"))
    one = lambda w: F.struct(F.lit(_COUNTS.get(w, "float64")).alias("cell_type"), checked.alias("cols"), F.col("_rows").alias("rows"), F.transform("_all", lambda v: v[w]).alias("cells")).alias(w)
    return made.select(*keys, *(one(w) for w in what))


def agg_local_stats(df: DataFrame, keys: list[str], tile: str) -> DataFrame:
    return agg_local(df, keys, tile, "count", "min", "max", "mean", "variance")


def agg_overview(df: DataFrame, keys: list[str], tile: str, extent: str, cols: int, rows: int, aoi: tuple[float, float, float, float]) -> DataFrame:
    """One tile over the box ``aoi`` by nearest cells; where tiles overlap, the largest value. Frames share one CRS; tiles that miss the box are left out first."""
    xmin, ymin, xmax, ymax = aoi
    e, w, h = F.col(extent), (xmax - xmin) / cols, (ymax - ymin) / rows
    near = df.where((e["xmin"] < xmax) & (e["xmax"] > xmin) & (e["ymin"] < ymax) & (e["ymax"] > ymin))
    first = lambda v, n: F.greatest(F.lit(0), F.ceil(v - 0.5)).cast("int")
    last = lambda v, n: F.least(F.lit(n - 1), F.ceil(v - 0.5) - 1).cast("int")
    t = F.col(tile)
    span = near.select(
        *keys, t["cells"].alias("_cells"), t["cols"].alias("_w"), t["rows"].alias("_h"), *(e[k].alias(f"_{k}") for k in ("xmin", "ymin", "xmax", "ymax")),
        first((e["xmin"] - xmin) / w, cols).alias("_c0"), last((e["xmax"] - xmin) / w, cols).alias("_c1"),
        first((ymax - e["ymax"]) / h, rows).alias("_r0"), last((ymax - e["ymin"]) / h, rows).alias("_r1"),
    ).where("_c0 <= _c1 and _r0 <= _r1")
    at = span.withColumn("_c", F.explode(F.sequence("_c0", "_c1"))).withColumn("_r", F.explode(F.sequence("_r0", "_r1")))
    sx = F.least(F.floor((xmin + (F.col("_c") + 0.5) * w - F.col("_xmin")) / (F.col("_xmax") - F.col("_xmin")) * F.col("_w")).cast("int"), F.col("_w") - 1)
    sy = F.least(F.floor((F.col("_ymax") - (ymax - (F.col("_r") + 0.5) * h)) / (F.col("_ymax") - F.col("_ymin")) * F.col("_h")).cast("int"), F.col("_h") - 1)
    cells = at.select(*keys, "_c", "_r", F.get("_cells", sy * F.col("_w") + sx).alias("_v")).groupBy(*keys, "_c", "_r").agg(F.max("_v").alias("_v"))
    return cells.groupBy(*keys).agg(assembled("_c", "_r", "_v", cols, rows).alias("overview"))


__all__ = ["EXTENT", "TILE", "extent_type", *[n for n in dir() if n.startswith(("agg_", "explode_", "assembled", "tile_columns"))]]
