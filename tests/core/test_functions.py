import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import cellweave.functions as rf
from cellweave.functions import kernels as K
from cellweave.operators import cells as C
from cellweave.tiles import CellType, Extent, Tile


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    rf.register(spark)


def one(spark, sql):
    return spark.sql(f"select {sql} as v").first().v


def test_null_rules(spark):
    t = "rf_make_constant_tile(2D, 2, 1, 'float64')"
    none = f"if(false, {t}, null)"
    assert one(spark, f"rf_local_add({t}, {none})")["cells"] == [2.0, 2.0]
    assert one(spark, f"rf_local_subtract({t}, {none})") is None
    assert math.isnan(one(spark, f"rf_tile_mean({none})"))
    assert one(spark, f"rf_data_cells({none})") == 0
    assert one(spark, f"rf_is_no_data_tile({none})") is True
    assert one(spark, f"rf_tile_min({none})") > 1e308


def test_cell_types(spark):
    assert one(spark, "rf_convert_cell_type(rf_make_constant_tile(-7.9D, 1, 1, 'float64'), 'int16')")["cells"] == [-7.0]
    assert one(spark, "rf_convert_cell_type(rf_make_constant_tile(300D, 1, 1, 'float64'), 'uint8')")["cells"] == [None]
    assert one(spark, "rf_convert_cell_type(rf_make_constant_tile(255D, 1, 1, 'float64'), 'uint8ud255')")["cells"] == [None]
    assert one(spark, "rf_with_no_data(rf_make_constant_tile(0D, 1, 1, 'uint8'), 9D)")["cell_type"] == "uint8ud9"
    assert one(spark, "rf_local_divide_int(rf_make_constant_tile(7D, 1, 1, 'int32'), 2)")["cells"] == [3.0]
    assert one(spark, "rf_local_divide_double(rf_make_constant_tile(7D, 1, 1, 'int32'), 2D)")["cells"] == [3.5]
    assert one(spark, "rf_local_add(rf_make_constant_tile(7D, 1, 1, 'uint8'), rf_make_constant_tile(7D, 1, 1, 'float32'))")["cell_type"] == "float32"
    for name in ("uint8ud255", "int8", "float32raw", "bool", "float64"):
        assert CellType.of(name).name == name
    with pytest.raises(ValueError):
        CellType.of("uint12")


def test_logarithms_of_nothing(spark):
    assert one(spark, "rf_log(rf_make_constant_tile(0D, 1, 1, 'float64'))")["cells"] == [-math.inf]
    assert one(spark, "rf_log(rf_make_constant_tile(-1D, 1, 1, 'float64'))")["cells"] == [None]


def test_resampling_examples():
    a = np.array([[1, 1, 2, 2], [1, 3, 6, 2], [3, 3, 4, 4], [3, 7, 5, 4]], float)
    assert K.resampled(a, 2, 2, "max").ravel().tolist() == [3, 6, 7, 5]
    assert K.resampled(a, 2, 2, "mode").ravel().tolist() == [1, 2, 3, 4]
    assert K.resampled(a, 2, 2, "Average").ravel().tolist() == [1.5, 3, 4, 4.25]
    for method in ("bilinear", "cubic_spline", "cubic_convolution", "lanczos"):
        assert np.allclose(K.resampled(np.full((5, 5), 3.0), 9, 7, method), 3)
    with pytest.raises(ValueError):
        K.resampled(a, 2, 2, "other")


def test_windows():
    assert len(K.offsets("square-2")) == 25 and len(K.offsets("nesw-2")) == 9 and len(K.offsets("circle-1")) == 5
    assert (0, 0) not in K.offsets("annulus-1-2")
    plane = np.add.outer(np.zeros(5), np.arange(5.0))
    dx, dy = K.gradients(plane, 1, 1)
    assert np.allclose(dx[1:-1, 1:-1], 1) and np.allclose(dy[1:-1, 1:-1], 0)
    assert np.allclose(K._slope_of(dx, dy, 1)[1:-1, 1:-1], 45) and np.allclose(K._aspect_of(dx, dy)[1:-1, 1:-1], 270)


def test_explode_and_assemble_are_inverse(spark):
    tiles = spark.range(3).select("id", rf.rf_local_multiply(rf.rf_array_to_tile(F.array(*(F.lit(float(i)) for i in range(6))), F.lit(3), F.lit(2)), 2.0).alias("t"))
    cells = C.explode_tiles(tiles, "t").where("t <> 4")
    back = cells.groupBy("id").agg(C.assembled("column_index", "row_index", "t", 3, 2).alias("t"))
    assert {tuple(r.t["cells"]) for r in back.collect()} == {(0.0, 2.0, None, 6.0, 8.0, 10.0)}
    with pytest.raises(Exception, match="outside"):
        cells.groupBy("id").agg(C.assembled("column_index", "row_index", "t", 2, 2).alias("t")).collect()


def test_pictures(spark):
    t = "rf_array_to_tile(array(1D, 2D, 3D, 4D), 2, 2)"
    assert one(spark, f"rf_render_png({t}, {t}, {t})")[:4] == b"\x89PNG"
    assert one(spark, f"rf_render_color_ramp_png({t}, 'Viridis')")[:4] == b"\x89PNG"
    assert one(spark, f"rf_render_ascii({t})").count("\n") == 1


def test_collected_tiles(spark):
    t = Tile.from_row(one(spark, "rf_array_to_tile(array(1D, double('NaN'), 3D, 4D), 2, 2)"))
    assert (t + t).to_row()["cells"] == [2.0, None, 6.0, 8.0]
    assert (t * 2 - 1).to_row()["cells"] == [1.0, None, 5.0, 7.0]
    assert Extent(0, 0, 2, 1).buffer(1).width == 4 and Extent(0, 0, 1, 1).intersects(Extent(1, 1, 2, 2))


def test_sql_table_function_and_algebra(spark):
    rows = spark.sql("select c.* from (select rf_array_to_tile(array(1D, 2D, 3D, 4D), 2, 2) t) s, lateral rf_explode_tiles(s.t) c").collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    t = spark.sql("select rf_array_to_tile(array(1D, 2D, 3D, 4D), 2, 2) t")
    assert t.select(rf.rf_local_algebra(lambda x, y: x * y + 1, "t", "t").alias("v")).first().v["cells"] == [2.0, 5.0, 10.0, 17.0]
    e = spark.sql("select st_makeBBox(0D, 0D, 1D, 1D) e, 'EPSG:4326' c")
    assert abs(e.agg(C.agg_reprojected_extent("e", "c", "EPSG:3857").alias("x")).first().x["xmax"] - 111319.49) < 0.01
    with pytest.raises(ValueError):
        rf.rf_mk_crs("here")


def test_histograms(spark):
    from cellweave.operators.histograms import CellHistogram

    h = CellHistogram(one(spark, "rf_tile_histogram(rf_array_to_tile(array(1D, 2D, 2D, 4D), 2, 2))")["bins"])
    assert (h.labels, h.total_count, h.item_count(2.0), h.mode, h.mean) == ([1.0, 2.0, 4.0], 4, 2, 2.0, 2.25)
    assert h.quantiles([0.25, 0.5, 1.0]) == [1.0, 1.5, 4.0] and h.ascii().count("\n") == 2


def test_aggregates_of_columns(spark):
    t = spark.sql("select id % 2 k, rf_mask_by_value(t, t, 3) t from (select id, rf_array_to_tile(transform(array(1D, 2D, 3D, 4D), x -> x + id), 2, 2) t from range(6))")
    one_ = t.groupBy("k").agg(rf.rf_agg_stats("t").alias("s"), rf.rf_agg_mean("t").alias("m")).select("k", "s.*", "m").orderBy("k").collect()
    two = C.agg_stats(t, ["k"], "t").orderBy("k").collect()
    for a, b in zip(one_, two, strict=True):
        assert np.allclose([float(x) for x in tuple(a)[:-1]], [float(x) for x in b]) and math.isclose(a.m, b["mean"])


def test_histograms_and_gaps_against_brute_force(spark):
    from collections import Counter

    values = [3.0, None, 1.0, 3.0, float("inf"), 1.0, 3.0, None, -2.5]
    schema = "t struct<cell_type: string, cols: int, rows: int, cells: array<double>>"
    frame = spark.createDataFrame([(("float64", 3, 3, v),) for v in (values, [None] * 9)], schema)
    full, none = (r.h.bins for r in frame.selectExpr("rf_tile_histogram(t) as h").collect())
    assert [(b["value"], b["count"]) for b in full] == sorted(Counter(v for v in values if v is not None).items()) and none == []
    # a place without a row, one with two rows, one with a null and a value
    rows = [(0, 0, 5.0), (2, 1, 1.0), (2, 1, 4.0), (1, 0, None), (1, 0, -1.0)]
    given = spark.createDataFrame(rows, "c int, r int, v double")
    one = given.agg(C.assembled("c", "r", "v", 3, 2).alias("t")).select(F.col("t.cells").alias("x")).first().x
    assert one == [5.0, -1.0, None, None, None, 4.0]
    whole = spark.createDataFrame([(i % 3, i // 3, float(i)) for i in range(6)], "c int, r int, v double")
    assert whole.agg(C.assembled("c", "r", "v", 3, 2).alias("t")).first().t.cells == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_shapes_are_burnt_in_by_groups(monkeypatch):
    """Shapes of two structures and sizes of tiles, a hole, a null: as one at a time, and alike shapes at once."""
    import numpy as np
    import pyarrow as pa

    from cellweave.functions import geometry as G
    from cellweave.functions import kernels as K

    rng = np.random.default_rng(1)
    boxes = [G.box(*sorted(rng.integers(0, 8, 2) + 0.25), *sorted(rng.integers(2, 9, 2) + 0.5)) for _ in range(40)]
    holed = [(3, [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)], [(2.0, 2.0), (4.0 + i, 2.0), (3.0, 5.0), (2.0, 2.0)]]) for i in range(4)]
    wkb = pa.array([*map(G.write, boxes + holed), G.write((2, [(0.0, 0.0), (1.0, 1.0)])), None], pa.binary())
    n = len(wkb)
    bounds = pa.array([{"xmin": 0.0, "ymin": 0.0, "xmax": 8.0, "ymax": 8.0}] * n)
    sizes = pa.array([8 if i % 3 else 5 for i in range(n)], pa.int32())
    run = lambda at, k: K._rasterize(*(c.slice(at, k) for c in (wkb, bounds, pa.array(range(n), pa.int32()), sizes, sizes)))
    one_by_one = [run(i, 1).to_pylist()[0] for i in range(n)]
    told = [None if w is None else K.to_tiles([("int32", np.where(G.covers_points(G.read(w), *np.meshgrid((np.arange(s) + 0.5) * 8 / s, 8 - (np.arange(s) + 0.5) * 8 / s)), float(i), np.nan))]).to_pylist()[0] for i, (w, s) in enumerate(zip(wkb.to_pylist(), sizes.to_pylist(), strict=True))]
    monkeypatch.setattr(G, "read", lambda data, read=G.read: read(data) if len(reads.append(1) or reads) <= 8 else pytest.fail("row by row"))
    reads = []
    assert run(0, n).to_pylist() == one_by_one == told
