import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import cellweave.functions as rf
from cellweave.operators import layers as L
from cellweave.sources import raster as S
from cellweave.sources import tiff
from cellweave.sources.files import get, put
from cellweave.tiles import Tile


class Memory:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("kind", ["uint8", "int16", "int32", "float32", "float64"])
@pytest.mark.parametrize("compress", [True, False])
def test_tiff_round_trip(kind, compress):
    rng = np.random.default_rng(1)
    bands = [rng.integers(0, 100, (70, 33)).astype(kind) for _ in range(3)]
    data = tiff.to_bytes(bands, (10, 20, 43, 90), "EPSG:32633", 7.0, compress, strip_rows=16)
    r = tiff.Reader(Memory(data))
    assert (r.header.cols, r.header.rows, r.header.bands, r.header.crs, r.header.extent) == (33, 70, 3, "EPSG:32633", (10, 20, 43, 90))
    for i, b in enumerate(bands):
        want = np.where(b == 7, np.nan, b)
        assert np.array_equal(r.window(i, 0, 0, 70, 33), want, equal_nan=True)
        assert np.array_equal(r.window(i, 13, 5, 40, 20), want[13:53, 5:25], equal_nan=True)
    assert np.isnan(r.window(0, -2, -2, 4, 4)[:2]).all()


def test_lzw():
    # Clear, then 7 7 7 8 8 7 7 6 6 as in the format's own example, then the end.
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    data = "".join(f"{c:09b}" for c in codes)
    data += bits + "0" * (-len(data) % 8)
    assert tiff.lzw(bytes(int(data[i : i + 8], 2) for i in range(0, len(data), 8))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_raster_source(spark, tmp_path):
    S.register(spark)
    a = np.arange(600.0).reshape(20, 30)
    for name, add in (("a", 0), ("b", 1000)):
        put(f"file://{tmp_path}/{name}.tif", tiff.to_bytes([a + add, a * 2], (0, 0, 30, 20), "EPSG:3857"))
    df = spark.read.format("raster").option("path", f"file://{tmp_path}/a.tif").option("tile_dimensions", "16,16").option("band_indexes", "0,1,5").load()
    assert df.columns == ["proj_raster_path", "proj_raster_b0", "proj_raster_b1", "proj_raster_b5"]
    rows = df.collect()
    assert len(rows) == 4 and all(r.proj_raster_b5 is None for r in rows)
    assert sum(sum(r.proj_raster_b1["tile"]["cells"]) for r in rows) == 2 * a.sum()
    box = [r for r in rows if r.proj_raster_b0["extent"]["xmin"] == 16 and r.proj_raster_b0["extent"]["ymax"] == 4][0]
    assert Tile.from_row(box.proj_raster_b0["tile"]).cells.tolist() == a[16:, 16:].tolist()
    wide = spark.read.format("raster").option("path", f"file://{tmp_path}/a.tif").option("tile_dimensions", "30,20").option("buffer_size", "1").load().first().proj_raster
    assert (wide["tile"]["cols"], wide["extent"]["xmin"]) == (32, -1.0)
    catalog = spark.createDataFrame([("x", f"file://{tmp_path}/a.tif", f"file://{tmp_path}/b.tif")], "scene string, one string, two string")
    both = S.read_catalog(spark, catalog, ["one", "two"])
    assert both.select("scene", (F.element_at("two.tile.cells", 1) - F.element_at("one.tile.cells", 1)).alias("d")).collect() == [("x", 1000.0)]
    assert S.with_spatial_index(both, "one").select("spatial_index").first()[0] > 0
    with pytest.raises(Exception, match="either"):
        spark.read.format("raster").option("path", "x").option("paths", "y").load()
    S.write_geotiff(df.select("proj_raster_b0.*"), f"file://{tmp_path}/m.tif", ["tile"], 30, 20, "EPSG:3857")
    assert np.array_equal(tiff.Reader(Memory(get(f"file://{tmp_path}/m.tif"))).window(0, 0, 0, 20, 30), a)
    named = df.select("proj_raster_b0.*", F.concat(F.lit("t"), F.monotonically_increasing_id().cast("string")).alias("name"))
    found = S.write_tiles(named, f"file://{tmp_path}/out", "name", "tile", "extent", "crs")
    assert found.count() == 4 and {r.name[-4:] for r in found.collect()} == {".tif"}
    made = S.write_slippy(named, f"file://{tmp_path}/map", "tile", "extent", range(1, 3))
    assert made.count() >= 2 and get(f"file://{tmp_path}/map/1/{made.where('zoom = 1').first().x}/{made.where('zoom = 1').first().y}.png")[:4] == b"\x89PNG"


def test_geojson_and_stac(spark, tmp_path):
    rf.register(spark)
    told = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"ID": 1, "p": "x"}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [3, 4]}, "properties": {"ID": 2, "p": None}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(told))
    df = S.read_geojson(spark, f"file://{tmp_path}/a.geojson")
    assert sorted(df.select("ID", rf.call("st_x", "geometry")).collect()) == [(1, 1.0), (2, 3.0)]
    assert S.read_geojson(spark, f"file://{tmp_path}/a.geojson", infer_schema=False).first().properties == {"ID": "1", "p": "x"}
    items = {"features": [{"id": "i1", "assets": {"B1": {"href": "u1"}, "B2": {"href": "u2"}}}]}
    (tmp_path / "s.json").write_text(json.dumps(items))
    flat = S.flatten_assets(S.read_stac(spark, f"file://{tmp_path}/s.json"))
    assert sorted((r.id, r.asset_name, r.asset["href"]) for r in flat.collect()) == [("i1", "B1", "u1"), ("i1", "B2", "u2")]


@pytest.fixture(scope="module")
def layer(spark):
    rf.register(spark)
    layout = L.Layout(0, 0, 30, 20, "EPSG:3857", 3, 2, 4, 4)
    base = spark.range(6).select(F.struct((F.col("id") % 3).cast("int").alias("col"), F.floor(F.col("id") / 3).cast("int").alias("row")).alias("spatial_key"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i + F.col("id") * 100).cast("double")).alias("v"))
    return L.as_layer(base.select("spatial_key", rf.call("rf_array_to_tile", "v", F.lit(4), F.lit(4)).alias("tile")), layout)


def test_layers(spark, layer, tmp_path):
    assert L.is_layer(layer) and L.key_column(layer) == "spatial_key" and L.as_layer_safely(layer.drop("tile"), L.layer_layout(layer)) is None
    extents = {tuple(r.spatial_key): tuple(r.extent) for r in L.with_extent(layer).collect()}
    assert extents[0, 0] == (0.0, 10.0, 10.0, 20.0) and extents[2, 1] == (20.0, 0.0, 30.0, 10.0)
    assert L.with_center_lat_lng(L.with_geometry(L.with_crs(layer))).count() == 6
    whole = L.to_raster(layer, "tile").cells
    assert whole.shape == (8, 12) and whole[4, 0] == 300 and whole[7, 11] == 515
    clipped = L.clip_extent(layer.where("spatial_key.col > 0"))
    assert L.layer_layout(clipped).xmin == 10 and L.layer_layout(clipped).layout_cols == 2
    assert np.array_equal(L.to_raster(L.subdivided(layer, 2), "tile").cells, whole)
    joined = L.spatial_join(layer, layer.where("spatial_key.row = 0"))
    assert joined.count() == 3 and joined.columns == ["spatial_key", "tile", "right_tile"]
    timed = L.with_timestamp(L.add_temporal(layer, 1_500_000_000_000))
    assert timed.first().timestamp.year == 2017
    L.write_layer(L.add_temporal(layer, 1_500_000_000_000), f"file://{tmp_path}/store", "one")
    back = L.read_layer(spark, f"file://{tmp_path}/store", "one")
    assert np.array_equal(L.to_raster(back, "tile").cells, whole) and back.where("day = date'2017-07-14'").count() == 6
    assert L.to_markdown(layer).count("tile 4x4") == 5 and L.to_html(layer).startswith("<table>")


def test_windows_over_edges(spark, layer):
    wide = L.with_margin(layer, "tile", 1)
    focal = wide.select("spatial_key", rf.call("rf_focal_max", "tile_wide", F.lit("square-1"), F.lit("all")).alias("f"))
    whole = np.array(L.to_raster(layer, "tile").cells)
    padded = np.pad(whole, 1, constant_values=-np.inf)
    want = np.max([padded[r : r + 8, c : c + 12] for r in range(3) for c in range(3)], axis=0)
    for r in focal.collect():
        got = Tile.from_row(r.f).cells[1:-1, 1:-1]
        k = r.spatial_key
        assert np.array_equal(got, want[k["row"] * 4 : k["row"] * 4 + 4, k["col"] * 4 : k["col"] * 4 + 4])


def test_regridding_is_exact_on_aligned_cells(spark, layer):
    from cellweave.operators.joins import raster_join

    frame = L.with_crs(L.with_extent(layer))
    layout = L.layout_of(frame, "tile", tile_cols=6, tile_rows=4)
    again = L.to_layer(frame.drop("spatial_key"), layout)
    assert np.array_equal(L.to_raster(again, "tile").cells, L.to_raster(layer, "tile").cells)
    none = frame.withColumn("tile", F.when(F.col("spatial_key.col") > 0, F.col("tile")))
    joined = raster_join(none, frame.select(F.col("tile").alias("r"), "extent", "crs", F.lit(1).alias("one")))
    rows = joined.collect()
    assert len(rows) == 6 and all((r.r is None) == (r.tile is None) for r in rows)
    other = raster_join(frame, frame.select("spatial_key", F.col("tile").alias("r"), "extent", "crs"), condition="left_spatial_key = right_spatial_key")
    assert all(r.r["cells"] == r.tile["cells"] for r in other.collect())


def test_reprojected_join_keeps_rows(spark):
    from cellweave.operators.joins import raster_join

    rf.register(spark)
    tile = rf.rf_make_constant_tile(F.lit(5.0), F.lit(8), F.lit(8), F.lit("float64"))
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("xmin", "ymin", "xmax", "ymax"), strict=True)))
    left = spark.range(1).select(tile.alias("t"), box(1, 1, 2, 2).alias("extent"), F.lit("EPSG:4326").alias("crs"))
    right = spark.range(1).select(tile.alias("u"), box(0, 0, 400000, 400000).alias("extent"), F.lit("EPSG:3857").alias("crs"))
    got = raster_join(left, right).first()
    assert got.u["cells"] == [5.0] * 64


def test_transformers(spark, layer, tmp_path):
    from cellweave.operators.learning import NoDataFilter, TileExploder

    rows = TileExploder().transform(layer)
    assert rows.count() == 96 and rows.columns == ["spatial_key", "column_index", "row_index", "tile"]
    kept = NoDataFilter(inputCols=["tile", "other"])
    assert kept.transform(rows.withColumn("tile", F.when(F.col("tile") > 3, F.col("tile")))).count() == 92
    kept.save(f"file://{tmp_path}/f")
    assert NoDataFilter.load(f"file://{tmp_path}/f").getInputCols() == ["tile", "other"]
    assert struct.calcsize("<d") == 8


def test_layer_of_rasters_higher_than_a_thousand_rows(spark, tmp_path):
    """Tiles above the layout's first 1,000 rows stay, with negative rows as in the SQL."""
    import duckdb

    from cellweave.plans import layered
    from cellweave.plans.queries import SQL

    duckdb.sql(f"copy (select unnest([0, 9, 127999, 128000, 140003, 192077]) as l_orderkey, 1::int as l_linenumber, 2.0::double as l_quantity) to '{tmp_path}/lineitem.parquet' (format parquet)")
    lineitem = duckdb.read_parquet(f"{tmp_path}/lineitem.parquet")
    told = lineitem.query("lineitem", f"select col, row, total, n from ({SQL['layer_from_rasters']})").fetchall()
    got = layered.layer_from_rasters(spark, str(tmp_path)).select("col", "row", "total", "n").collect()
    assert len(told) == 6 and sorted(map(tuple, got)) == sorted(told)


def test_margin_without_neighbours_and_with_null_tiles(spark, layer):
    """A tile alone has no data around it; a null tile takes what its neighbours send."""
    one = L.with_margin(layer.where("spatial_key.col = 0 and spatial_key.row = 0"), "tile", 2).first()
    cells = Tile.from_row(one.tile_wide).cells
    assert cells.shape == (8, 8) and cells.count() == 16
    gap = L.as_layer(layer.withColumn("tile", F.when(F.expr("spatial_key.col > 0"), F.col("tile"))), L.layer_layout(layer))
    found = L.with_margin(gap, "tile", 1).where("spatial_key.col = 0 and spatial_key.row = 0").first()
    assert found.tile is None and Tile.from_row(found.tile_wide).cells.count() == 5


@pytest.mark.parametrize("sizes", [(1, 3), (0.2, 9)])
def test_vector_join_of_all_sizes(spark, sizes):
    """Shapes of several levels, some beyond all tiles and tiles beyond all shapes, against every pair."""
    from cellweave.operators.joins import vector_join

    rf.register(spark)
    rng = np.random.default_rng(3)
    boxes = [[(i, float(x), float(y), float(x + d), float(y + d)) for i, (x, y, d) in enumerate(zip(*rng.integers(at, 30 + at, (2, 40)), rng.choice(sizes, 40), strict=True))] for at in (0, 20)]
    a, b = (spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double") for rows in boxes)
    e = lambda df: df.select("id", F.struct(*(F.col(c).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), ("xmin", "ymin", "xmax", "ymax"), strict=True))).alias("extent"))
    got = vector_join(e(a).select("id", rf.call("st_geometry", "extent").alias("geometry")), e(b).withColumnRenamed("id", "other"))
    want = sorted((i, j) for i, x0, y0, x1, y1 in boxes[0] for j, u0, v0, u1, v1 in boxes[1] if x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1)
    assert want and sorted((r.id, r.other) for r in got.collect()) == want
