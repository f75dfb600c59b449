"""Readers and writers of rasters and vectors.

``register(spark)`` makes the formats ``raster`` and ``geotiff`` known: one row per window of a file, one task per
run of windows, read on executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellweave.functions.kernels import ARROW_TILE, matrices, png, ramp_pixels, to_tiles
from cellweave.operators import cells as C
from cellweave.sources import tiff
from cellweave.sources.files import get, opened, put
from cellweave.tiles import CellType, extent_type, tile_type

proj_raster_type = T.StructType().add("tile", tile_type).add("extent", extent_type).add("crs", T.StringType())
_EXTENT = pa.struct([(n, pa.float64()) for n in extent_type.names])
_RASTER = pa.struct([("tile", ARROW_TILE), ("extent", _EXTENT), ("crs", pa.string())])


class Windows(InputPartition):
    """Some windows of the files of one catalog row."""

    def __init__(self, uris: list[str], windows: list[tuple[int, int, int, int]]):
        super().__init__((uris, windows))


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.schema = schema
        self.bands = [int(b) for b in options.get("band_indexes", "0").split(",")]
        self.size = tuple(int(n) for n in options.get("tile_dimensions", "256,256").split(","))
        self.margin = int(options.get("buffer_size", "0"))
        self.run = int(options.get("windows_per_task", "16"))
        self.catalog = _catalog(options)

    def partitions(self) -> list[Windows]:
        parts = []
        cols, rows = self.size
        for uris in self.catalog:
            system, path = opened(uris[0])
            with system.open_input_file(path) as f:
                h = tiff.Reader(f).header
            windows = [(r, c, min(rows, h.rows - r), min(cols, h.cols - c)) for r in range(0, h.rows, rows) for c in range(0, h.cols, cols)]
            parts += [Windows(uris, windows[i : i + self.run]) for i in range(0, len(windows), self.run)]
        return parts

    def read(self, partition: Windows) -> Iterator[pa.RecordBatch]:
        uris, windows = partition.value
        files = []
        for uri in uris:
            system, path = opened(uri)
            files.append(tiff.Reader(system.open_input_file(path)))
        for r, c, rows, cols in windows:
            row: list = []
            for uri, reader in zip(uris, files, strict=True):
                h, m = reader.header, self.margin
                x0, y0, x1, y1 = h.extent
                sx, sy = (x1 - x0) / h.cols, (y1 - y0) / h.rows
                extent = {"xmin": x0 + (c - m) * sx, "ymin": y1 - (r + rows + m) * sy, "xmax": x0 + (c + cols + m) * sx, "ymax": y1 - (r - m) * sy}
                row.append(pa.array([uri]))
                for band in self.bands:
                    if band >= h.bands:  # a band that a file lacks is null
                        row.append(pa.nulls(1, _RASTER))
                        continue
                    cells = reader.window(band, r - m, c - m, rows + 2 * m, cols + 2 * m)
                    row.append(pa.StructArray.from_arrays([to_tiles([(h.cell_type, cells)]), pa.array([extent], _EXTENT), pa.array([h.crs])], names=["tile", "extent", "crs"]))
            yield pa.RecordBatch.from_arrays(row, names=self.schema.names)


def _catalog(options: dict[str, str]) -> list[list[str]]:
    """Rows of URIs; several columns are separated by commas in ``paths``."""
    if "path" in options and "paths" in options:
        raise ValueError("either path or paths")
    if "path" not in options and "paths" not in options:
        raise ValueError("path or paths is needed")
    return [[u.strip() for u in line.split(",")] for line in options.get("paths", options.get("path", "")).split("\n") if line.strip()]


class RasterSource(DataSource):
    """Options: path, or paths (a line per scene, its files separated by commas), names (of the columns), band_indexes,
    tile_dimensions, buffer_size, windows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> T.StructType:
        width = len(_catalog(self.options)[0])
        names = self.options.get("names", "proj_raster" if width == 1 else ",".join(f"proj_raster_{i}" for i in range(width))).split(",")
        bands = self.options.get("band_indexes", "0").split(",")
        out = T.StructType()
        for n in names:
            out.add(f"{n}_path", T.StringType())
            for b in bands:
                out.add(n if bands == ["0"] else f"{n}_b{b}", proj_raster_type)
        return out

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RasterReader(self.options, schema)


class GeoTiffSource(RasterSource):
    """The same reader under its other name."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"


def register(spark: SparkSession) -> SparkSession:
    from cellweave import functions

    spark.dataSource.register(RasterSource)
    spark.dataSource.register(GeoTiffSource)
    return functions.register(spark)


def read_catalog(spark: SparkSession, catalog: DataFrame, columns: list[str], **options: str) -> DataFrame:
    """One row per window of the files that the catalog's columns name, with the catalog's other columns."""
    lines = [",".join(r[c] for c in columns) for r in catalog.select(*columns).distinct().collect()]  # file names
    frame = spark.read.format("raster").options(paths="\n".join(lines), names=",".join(columns), **options).load()
    return frame.join(catalog.withColumnsRenamed({c: f"{c}_path" for c in columns}), [f"{c}_path" for c in columns])


def with_spatial_index(df: DataFrame, raster: str, partitions: int | None = None) -> DataFrame:
    """With the Z2 index of the raster's centre, and dealt by it."""
    from cellweave import functions as rf

    indexed = df.withColumn("spatial_index", rf.rf_z2_index(F.col(f"{raster}.extent"), F.col(f"{raster}.crs"), F.lit(31)))
    return indexed.repartitionByRange(partitions, "spatial_index") if partitions else indexed.repartitionByRange("spatial_index")


def write_geotiff(df: DataFrame, path: str, tiles: list[str], cols: int, rows: int, crs: str, extent: str = "extent", cell_type: str = "float64", compress: bool = True) -> None:
    """One file of the mosaic of all rows. The picture of cols x rows cells is put together on the driver; what reaches it has this size whatever the input."""
    e = df.agg(C.agg_extent(extent).alias("e")).first().e
    box = (e.xmin, e.ymin, e.xmax, e.ymax)
    kind = CellType.of(cell_type)
    bands = []
    for t in tiles:
        made = C.agg_overview(df, [], t, extent, cols, rows, box).first()
        cells = np.array([np.nan if x is None else x for x in made.overview["cells"]]).reshape(rows, cols)
        bands.append(cells if kind.is_float else cells)
    no_data = None if kind.is_float else kind.no_data
    put(path, tiff.to_bytes([b.astype(kind.dtype) if kind.is_float else np.where(np.isnan(b), no_data or 0, b).astype(kind.dtype) for b in bands], box, crs, no_data, compress))


def write_tiles(df: DataFrame, folder: str, filename: str, tile: str, extent: str | None = None, crs: str | None = None, form: str = "tiff", metadata: tuple[str, ...] = (), catalog: bool = True) -> DataFrame:
    """A file per row, written by the tasks, and a catalog (also as CSV): filename, extent, crs and the metadata columns. Rows with nulls are left out."""
    columns = [filename, tile, *filter(None, (extent, crs)), *metadata]
    rows = df.select(*dict.fromkeys(columns)).dropna()
    suffix = {"tiff": ".tif", "png": ".png"}[form]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get_ = lambda n, b=b: b.column(b.schema.get_field_index(n))
            names = get_(filename).to_pylist()
            extents = get_(extent).to_pylist() if extent else [None] * len(names)
            systems = get_(crs).to_pylist() if crs else [None] * len(names)
            for name, t, e, c in zip(names, matrices(get_(tile)), extents, systems, strict=True):
                box = tuple(e[k] for k in ("xmin", "ymin", "xmax", "ymax")) if e else (0.0, 0.0, float(t[1].shape[1]), float(t[1].shape[0]))
                put(f"{folder}/{name}{suffix}", png(ramp_pixels(t[1], "Greys")) if form == "png" else tiff.to_bytes([t[1]], box, c))
            yield b.drop_columns([tile]).set_column(0, filename, pa.array([f"{n}{suffix}" for n in names])) if hasattr(b, "drop_columns") else b

    kept = [f for f in rows.schema if f.name != tile]
    told = rows.select(filename, *(f.name for f in kept if f.name != filename), tile).mapInArrow(write, T.StructType([f for f in rows.select(filename, *(f.name for f in kept if f.name != filename)).schema]))
    if not catalog:
        told.count()
        return told
    told.write.mode("overwrite").parquet(f"{folder}/catalog.parquet")
    found = df.sparkSession.read.parquet(f"{folder}/catalog.parquet")
    flat = found.select(*(F.concat(F.lit("["), F.concat_ws("|", *(F.col(f"{extent}.{k}") for k in ("xmin", "ymin", "xmax", "ymax"))), F.lit("]")).alias(c) if c == extent else F.col(c) for c in found.columns))
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/catalog.csv")
    return found


def read_geojson(spark: SparkSession, path: str, infer_schema: bool = True) -> DataFrame:
    """``geometry`` (WKB) and a column for each property, or all of them as a map of strings."""
    from cellweave.functions import geometry as G

    raw = spark.read.option("multiLine", True).option("primitivesAsString", not infer_schema)
    told = raw.json(path).select(F.explode("features").alias("f"))

    @F.arrow_udf("binary")
    def to_wkb(text: pa.Array) -> pa.Array:
        return pa.array([None if x is None else G.write(G.from_json(json.loads(x))) for x in text.to_pylist()], pa.binary())

    geometry = to_wkb(F.to_json("f.geometry")).alias("geometry")
    if infer_schema:
        return told.select(geometry, "f.properties.*")
    names = told.schema["f"].dataType["properties"].dataType.names
    pairs = F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(F.col(f"f.properties.{n}").cast("string") for n in names)))
    return told.select(geometry, pairs.alias("properties"))


def read_stac(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Items of STAC feature collections kept as JSON files."""
    items = spark.read.option("multiLine", True).json(path)
    items = items.select(F.explode("features").alias("i")).select("i.*") if "features" in items.columns else items
    return items if limit is None else items.limit(limit)


def flatten_assets(items: DataFrame) -> DataFrame:
    """One row per asset: the item's columns, asset_name and asset."""
    names = items.schema["assets"].dataType.names
    common = F.array(*(F.struct(F.lit(n).alias("asset_name"), F.to_json(F.col(f"assets.{n}")).alias("asset")) for n in names))
    rows = items.withColumn("_a", F.explode(common)).where("_a.asset is not null")
    return rows.select(*[c for c in items.columns if c != "assets"], "_a.asset_name", F.from_json("_a.asset", "map<string,string>").alias("asset"))


def write_slippy(df: DataFrame, folder: str, tile: str, extent: str, zooms: range, ramp: str = "Viridis", html: bool = True, size: int = 256) -> DataFrame:
    """A pyramid of PNGs ``zoom/x/y.png`` from frames in EPSG:3857: (zoom, x, y) of each that was written.

    Cells are dealt to pictures by integer keys and averaged at each pixel.
    """
    half = 20037508.342789244
    world = 2 * half
    e, t = F.col(extent), F.col(tile)
    cells = df.where(t.isNotNull()).select(e.alias("e"), t["cols"].alias("w"), t["rows"].alias("h"), F.posexplode(t["cells"]).alias("pos", "v")).where("v is not null")
    x = F.col("e.xmin") + (F.pmod("pos", "w") + 0.5) * (F.col("e.xmax") - F.col("e.xmin")) / F.col("w")
    y = F.col("e.ymax") - (F.floor(F.col("pos") / F.col("w")) + 0.5) * (F.col("e.ymax") - F.col("e.ymin")) / F.col("h")
    each = cells.select(x.alias("x"), y.alias("y"), "v", F.explode(F.array(*(F.lit(z) for z in zooms))).alias("zoom"))
    scale = F.pow(F.lit(2.0), F.col("zoom")) * size / world
    pixel = each.select("zoom", F.floor((F.col("x") + half) * scale).alias("px"), F.floor((half - F.col("y")) * scale).alias("py"), "v").groupBy("zoom", "px", "py").agg(F.avg("v").alias("v"))
    keyed = pixel.select("zoom", F.floor(F.col("px") / size).cast("int").alias("x"), F.floor(F.col("py") / size).cast("int").alias("y"), F.pmod("px", F.lit(size)).cast("int").alias("c"), F.pmod("py", F.lit(size)).cast("int").alias("r"), "v")

    def draw(group: pa.Table) -> pa.Table:
        canvas = np.full((size, size), np.nan)
        canvas[group["r"].to_numpy(), group["c"].to_numpy()] = group["v"].to_numpy()
        z, x_, y_ = (group[n][0].as_py() for n in ("zoom", "x", "y"))
        put(f"{folder}/{z}/{x_}/{y_}.png", png(ramp_pixels(canvas, ramp)))
        return pa.table({"zoom": pa.array([z], pa.int32()), "x": pa.array([x_], pa.int32()), "y": pa.array([y_], pa.int32())})

    told = keyed.groupBy("zoom", "x", "y").applyInArrow(draw, "zoom int, x int, y int")
    told.write.mode("overwrite").parquet(f"{folder}/pictures.parquet")
    if html:
        put(f"{folder}/index.html", f"<!doctype html><title>Map</title><p>Pictures at zoom/x/y.png, zooms {min(zooms)} to {max(zooms)}.</p>".encode())
    return df.sparkSession.read.parquet(f"{folder}/pictures.parquet")


__all__ = ["get", "register", "read_catalog", "read_geojson", "read_stac", "flatten_assets", "with_spatial_index", "write_geotiff", "write_slippy", "write_tiles"]
