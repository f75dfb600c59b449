"""Keyed layers: frames whose rows are the cells of a regular grid of tiles.

A layer has a key column ``struct<col, row>``, at least one tile column, and metadata on the key's field: the grid.
Columns are made from keys by arithmetic, so nothing moves but where a join or an order asks for it.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import functions as rf
from cellweave.operators.cells import agg_extent, explode_tiles, tile_columns
from cellweave.operators.joins import raster_join
from cellweave.tiles import Tile

_KEY, _TIME = "spatial_key", "temporal_key"


@dataclass(frozen=True)
class Layout:
    """The grid of a layer: its box, CRS, numbers of tiles, and cells of a tile."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    crs: str
    layout_cols: int
    layout_rows: int
    tile_cols: int
    tile_rows: int
    cell_type: str = "float64"

    @property
    def width(self) -> float:
        return (self.xmax - self.xmin) / self.layout_cols

    @property
    def height(self) -> float:
        return (self.ymax - self.ymin) / self.layout_rows


def layout_of(df: DataFrame, tile: str, extent: str = "extent", crs: str = "crs", tile_cols: int | None = None, tile_rows: int | None = None) -> Layout:
    """The layout that holds all rows at the finest cell size among them."""
    e, t = F.col(extent), F.col(tile)
    told = df.where(t.isNotNull()).agg(agg_extent(extent).alias("e"), F.min((e["xmax"] - e["xmin"]) / t["cols"]).alias("sx"), F.min((e["ymax"] - e["ymin"]) / t["rows"]).alias("sy"), F.max(t["cols"]).alias("c"), F.max(t["rows"]).alias("r"), F.max(t["cell_type"]).alias("k"), F.max(crs).alias("crs")).first()
    if told.e.xmin is None:
        raise ValueError("no rows to make a layout of")
    cols, rows = tile_cols or told.c, tile_rows or told.r
    tiles = lambda low, high, size, n: max(1, math.ceil((high - low) / (size * n) - 1e-9))
    across, down = tiles(told.e.xmin, told.e.xmax, told.sx, cols), tiles(told.e.ymin, told.e.ymax, told.sy, rows)
    return Layout(told.e.xmin, told.e.ymax - down * rows * told.sy, told.e.xmin + across * cols * told.sx, told.e.ymax, told.crs, across, down, cols, rows, told.k)


def as_layer(df: DataFrame, layout: Layout, key: str = _KEY) -> DataFrame:
    """The frame as a layer; raises if it has no key or no tiles."""
    if key not in df.columns or not tile_columns(df):
        raise ValueError("a layer needs a key column and a tile column")
    return df.withMetadata(key, {"role": "spatial", "layout": json.dumps(asdict(layout))})


def as_layer_safely(df: DataFrame, layout: Layout) -> DataFrame | None:
    try:
        return as_layer(df, layout)
    except ValueError:
        return None


def is_layer(df: DataFrame) -> bool:
    return any(f.metadata.get("role") == "spatial" for f in df.schema) and bool(tile_columns(df))


def key_column(df: DataFrame, role: str = "spatial") -> str | None:
    return next((f.name for f in df.schema if f.metadata.get("role") == role), None)


def layer_layout(df: DataFrame) -> Layout:
    name = key_column(df)
    if name is None:
        raise ValueError("not a layer")
    return Layout(**json.loads(df.schema[name].metadata["layout"]))


def to_layer(df: DataFrame, layout: Layout, resampling: str = "nearest_neighbor") -> DataFrame:
    """Any frame of tiles with ``extent`` and ``crs`` on the layout's grid, as the right side of a raster join; only keys that a box meets are made."""
    grid = _met(df, layout)
    blank = F.struct(F.lit(layout.cell_type).alias("cell_type"), F.lit(layout.tile_cols).alias("cols"), F.lit(layout.tile_rows).alias("rows"), F.array_repeat(F.lit(None).cast("double"), layout.tile_cols * layout.tile_rows).alias("cells"))
    grid = grid.select(_KEY, blank.alias("_grid"), extent_of(layout).alias("extent"), F.lit(layout.crs).alias("crs"))
    joined = raster_join(grid, df, resampling=resampling)
    kept = joined.drop("_grid").where(" or ".join(f"{t} is not null" for t in tile_columns(df)))
    return as_layer(kept, layout)


def _met(df: DataFrame, layout: Layout) -> DataFrame:
    """The keys of the layout's cells that the boxes of ``df`` meet."""
    rf.register(df.sparkSession)
    e = F.when(F.col("crs") == layout.crs, F.col("extent")).otherwise(rf.call("rf_reprojected_extent", F.col("extent"), F.col("crs"), F.lit(layout.crs)))
    at = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    box = df.where("extent is not null and crs is not null").select(e.alias("e")).select("e.*")
    span = box.select(
        at((F.col("xmin") - layout.xmin) / layout.width, layout.layout_cols).alias("c0"), at((F.col("xmax") - layout.xmin) / layout.width, layout.layout_cols).alias("c1"),
        at((layout.ymax - F.col("ymax")) / layout.height, layout.layout_rows).alias("r0"), at((layout.ymax - F.col("ymin")) / layout.height, layout.layout_rows).alias("r1"),
    ).distinct()
    cells = span.withColumn("col", F.explode(F.sequence("c0", "c1"))).withColumn("row", F.explode(F.sequence("r0", "r1")))
    return cells.select(F.struct("col", "row").alias(_KEY)).distinct()


def extent_of(layout: Layout, key: str = _KEY) -> Column:
    k = F.col(key)
    x, y = layout.xmin + k["col"] * layout.width, layout.ymax - k["row"] * layout.height
    return F.struct(x.cast("double").alias("xmin"), (y - layout.height).cast("double").alias("ymin"), (x + layout.width).cast("double").alias("xmax"), y.cast("double").alias("ymax"))


def with_extent(layer: DataFrame, name: str = "extent") -> DataFrame:
    return layer.withColumn(name, extent_of(layer_layout(layer), key_column(layer)))


def with_geometry(layer: DataFrame, name: str = "geometry") -> DataFrame:
    rf.register(layer.sparkSession)
    return layer.withColumn(name, rf.call("st_geometry", extent_of(layer_layout(layer), key_column(layer))))


def with_crs(layer: DataFrame, name: str = "crs") -> DataFrame:
    return layer.withColumn(name, F.lit(layer_layout(layer).crs))


def with_center(layer: DataFrame, name: str = "center") -> DataFrame:
    e = extent_of(layer_layout(layer), key_column(layer))
    return layer.withColumn(name, F.struct(((e["xmin"] + e["xmax"]) / 2).alias("x"), ((e["ymin"] + e["ymax"]) / 2).alias("y")))


def with_center_lat_lng(layer: DataFrame, name: str = "center") -> DataFrame:
    """The centre in degrees, for layers in EPSG:3857 or EPSG:4326."""
    rf.register(layer.sparkSession)
    layout = layer_layout(layer)
    made = with_center(layer, "_c")
    x, y = F.col("_c.x"), F.col("_c.y")
    if layout.crs == "EPSG:3857":
        x, y = rf.rf_mercator_lng(x), rf.rf_mercator_lat(y)
    elif layout.crs != "EPSG:4326":
        raise ValueError(f"no closed form for {layout.crs}")
    return made.withColumn(name, F.struct(x.alias("longitude"), y.alias("latitude"))).drop("_c")


def with_spatial_index(layer: DataFrame, name: str = "spatial_index", ordered: bool = True) -> DataFrame:
    rf.register(layer.sparkSession)
    layout = layer_layout(layer)
    made = layer.withColumn(name, rf.rf_z2_index(extent_of(layout, key_column(layer)), F.lit(layout.crs), F.lit(31)))
    return made.orderBy(name) if ordered else made


def add_temporal(layer: DataFrame, millis: int) -> DataFrame:
    made = layer.withColumn(_TIME, F.struct(F.lit(millis).cast("bigint").alias("instant")))
    return made.withMetadata(_TIME, {"role": "temporal"})


def with_timestamp(layer: DataFrame, name: str = "timestamp") -> DataFrame:
    return layer.withColumn(name, F.timestamp_millis(F.col(f"{_TIME}.instant")))


def renamed(layer: DataFrame, old: str, new: str) -> DataFrame:
    """A rename that keeps the field's metadata."""
    return layer.withColumnRenamed(old, new).withMetadata(new, dict(layer.schema[old].metadata))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns})


def clip_extent(layer: DataFrame) -> DataFrame:
    """The layer with a layout that ends at the keys it has; keys are counted from its new corner."""
    key, old = key_column(layer), layer_layout(layer)
    k = F.col(key)
    b = layer.agg(F.min(k["col"]).alias("c0"), F.max(k["col"]).alias("c1"), F.min(k["row"]).alias("r0"), F.max(k["row"]).alias("r1")).first()
    if b.c0 is None:
        return layer
    new = Layout(old.xmin + b.c0 * old.width, old.ymax - (b.r1 + 1) * old.height, old.xmin + (b.c1 + 1) * old.width, old.ymax - b.r0 * old.height, old.crs, b.c1 - b.c0 + 1, b.r1 - b.r0 + 1, old.tile_cols, old.tile_rows, old.cell_type)
    return as_layer(layer.withColumn(key, F.struct((k["col"] - b.c0).alias("col"), (k["row"] - b.r0).alias("row"))), new, key)


def spatial_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """An equi-join on the keys (and times, if both have them); the right tiles of equal names get the prefix right_."""
    keys = [_KEY] + [_TIME] * (_TIME in left.columns and _TIME in right.columns)
    clash = {c: f"right_{c}" for c in right.columns if c in left.columns and c not in keys}
    return as_layer(left.join(right.withColumnsRenamed(clash), keys, how), layer_layout(left))


def to_raster(layer: DataFrame, tile: str) -> Tile:
    """All tiles as one matrix on the driver; its size is the layout's. Of several tiles with a key the largest value counts."""
    import numpy as np

    layout, key = layer_layout(layer), key_column(layer)
    cells = explode_tiles(layer.select(F.col(f"{key}.col").alias("_kc"), F.col(f"{key}.row").alias("_kr"), tile), tile, keep=["_kc", "_kr"])
    merged = cells.groupBy((F.col("_kc") * layout.tile_cols + F.col("column_index")).alias("x"), (F.col("_kr") * layout.tile_rows + F.col("row_index")).alias("y")).agg(F.max(tile).alias("v"))
    out = np.full((layout.layout_rows * layout.tile_rows, layout.layout_cols * layout.tile_cols), np.nan)
    got = merged.toArrow()
    out[got["y"].to_numpy(), got["x"].to_numpy()] = got["v"].to_numpy(zero_copy_only=False) if got["v"].null_count == 0 else [np.nan if v is None else v for v in got["v"].to_pylist()]
    return Tile(np.ma.masked_invalid(out), layout.cell_type)


def with_margin(layer: DataFrame, tile: str, cells: int) -> DataFrame:
    """``tile`` widened by cells of its eight neighbours (no data beyond the layer), for windows that see over edges. Each tile's strips go to its neighbours by key: one shuffle of the strips."""
    layout, key = layer_layout(layer), key_column(layer)
    w, h, m = layout.tile_cols, layout.tile_rows, cells
    if m > min(w, h):
        raise ValueError("a margin wider than a tile")
    k = F.col(key)
    steps = [(dc, dr) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]

    def strip(dc: int, dr: int) -> Column:
        """What the neighbour at (dc, dr) needs of this tile, row by row."""
        c0, c1 = (0, m) if dc == -1 else (w - m, w) if dc == 1 else (0, w)
        r0, r1 = (0, m) if dr == -1 else (h - m, h) if dr == 1 else (0, h)
        all_ = F.col(tile)["cells"]
        if c1 - c0 == w:
            return F.slice(all_, r0 * w + 1, (r1 - r0) * w)
        return F.flatten(F.transform(F.sequence(F.lit(r0), F.lit(r1 - 1)), lambda r: F.slice(all_, (r * w + c0 + 1).cast("int"), F.lit(m))))

    sent = layer.select(F.explode(F.array(*(F.struct(F.struct((k["col"] + dc).cast("int").alias("col"), (k["row"] + dr).cast("int").alias("row")).alias("key"), F.lit(i).alias("step"), strip(dc, dr).alias("cells")) for i, (dc, dr) in enumerate(steps) if m or (dc, dr) == (0, 0)))).alias("s"))
    wide = sent.groupBy(F.col("s.key").alias(key)).agg(F.collect_list(F.struct("s.step", "s.cells")).alias("_all"))  # nine strips at most

    def band(dr: int) -> tuple[Column, dict[str, Column]]:
        """Rows of the wide tile: what came from the left, the middle and the right, no data where nothing did."""
        n = h if dr == 0 else m

        def sent_from(dc: int, width: int) -> Column:
            step = steps.index((dc, dr))
            return F.coalesce(F.get(F.filter("_all", lambda s: s["step"] == step), F.lit(0))["cells"], F.array_repeat(F.lit(None).cast("double"), n * width))

        came = {dc: (sent_from(dc, width), width) for dc, width in ((1, m), (0, w), (-1, m)) if width}
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.concat(*(F.slice(F.col(f"_{dr + 1}{dc + 1}"), (r * width + 1).cast("int"), F.lit(width)) for dc, (_, width) in came.items())))), {f"_{dr + 1}{dc + 1}": c for dc, (c, _) in came.items()}

    bands = [band(dr) for dr in ((1, 0, -1) if m else (0,))]
    wide = wide.withColumns({name: c for _, named in bands for name, c in named.items()})
    cells_ = F.concat(*(rows for rows, _ in bands))
    made = wide.select(key, F.struct(F.lit(layout.cell_type).alias("cell_type"), F.lit(w + 2 * m).alias("cols"), F.lit(h + 2 * m).alias("rows"), cells_.alias("cells")).alias(f"{tile}_wide"))
    return as_layer(layer.join(made, key, "left"), layout, key)


def between_times(df: DataFrame, column: str, first, last) -> DataFrame:
    """Rows from first to last, both included."""
    return df.where(F.col(column).between(F.lit(first), F.lit(last)))


def to_markdown(df: DataFrame, rows: int = 5, width: int = 40) -> str:
    """The first rows as a table; tiles by their shape."""
    shown = df.select(*(F.concat(F.lit("tile "), F.col(f"{c}.cols").cast("string"), F.lit("x"), F.col(f"{c}.rows").cast("string")).alias(c) if c in tile_columns(df) else F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns))
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in shown.limit(rows).collect()])


def to_html(df: DataFrame, rows: int = 5) -> str:
    head, _, *body = to_markdown(df, rows).split("\n")
    row = lambda line, tag: "<tr>" + "".join(f"<{tag}>{c.strip()}</{tag}>" for c in line.strip("|").split("|")) + "</tr>"
    return f"<table>{row(head, 'th')}{''.join(row(b, 'td') for b in body)}</table>"


def write_layer(layer: DataFrame, folder: str, name: str, zoom: int = 0, partitions: int | None = None) -> None:
    """Parquet below ``folder/name``, by zoom (and day, if the layer has times), in the order of the Z2 index, and its layout as JSON."""
    layout = layer_layout(layer)
    made = with_spatial_index(layer, "_z", ordered=False).withColumn("zoom", F.lit(zoom))
    by = ["zoom"]
    if _TIME in layer.columns:
        made = with_timestamp(made, "_t").withColumn("day", F.to_date("_t")).drop("_t")
        by.append("day")
    dealt = made.repartitionByRange(partitions, "_z") if partitions else made.repartitionByRange("_z")
    dealt.sortWithinPartitions("_z").drop("_z").write.mode("append").partitionBy(*by).parquet(f"{folder}/{name}")
    row = layer.sparkSession.createDataFrame([(name, zoom, json.dumps(asdict(layout)))], "name string, zoom int, layout string")
    row.coalesce(1).write.mode("append").json(f"{folder}/_layers")


def read_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """name, zoom, layout (JSON) of each layer."""
    return spark.read.schema("name string, zoom int, layout string").json(f"{folder}/_layers")


def read_layer(spark: SparkSession, folder: str, name: str, zoom: int = 0, subdivisions: int = 1) -> DataFrame:
    """A layer that :func:`write_layer` wrote; filters on day and columns reach the files. With ``subdivisions`` each tile in n x n."""
    told = read_catalog(spark, folder).where((F.col("name") == name) & (F.col("zoom") == zoom)).first()
    if told is None:
        raise ValueError(f"no layer {name} at zoom {zoom}")
    layer = as_layer(spark.read.parquet(f"{folder}/{name}").where(F.col("zoom") == zoom).drop("zoom"), Layout(**json.loads(told.layout)))
    return layer if subdivisions == 1 else subdivided(layer, subdivisions)


def subdivided(layer: DataFrame, n: int) -> DataFrame:
    layout, key = layer_layout(layer), key_column(layer)
    if layout.tile_cols % n or layout.tile_rows % n:
        raise ValueError("tiles must divide evenly")
    w, h = layout.tile_cols // n, layout.tile_rows // n
    parts = layer.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    pc, pr = F.pmod("_i", F.lit(n)), F.floor(F.col("_i") / n).cast("int")
    for t in tile_columns(layer):
        c = F.col(t)
        rows = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.slice(c["cells"], ((pr * h + r) * layout.tile_cols + pc * w + 1).cast("int"), F.lit(w)))  # noqa: B023
        parts = parts.withColumn(t, F.when(c.isNotNull(), F.struct(c["cell_type"].alias("cell_type"), F.lit(w).alias("cols"), F.lit(h).alias("rows"), F.flatten(rows).alias("cells"))))
    k = F.col(key)
    parts = parts.withColumn(key, F.struct((k["col"] * n + pc).cast("int").alias("col"), (k["row"] * n + pr).cast("int").alias("row"))).drop("_i")
    return as_layer(parts, Layout(**(asdict(layout) | {"layout_cols": layout.layout_cols * n, "layout_rows": layout.layout_rows * n, "tile_cols": w, "tile_rows": h})), key)
