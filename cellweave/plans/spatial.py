"""Queries for places, geometries, layers and whole-tile kernels; see :mod:`cellweave.plans.queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import functions as rf
from cellweave.operators import cells as C
from cellweave.operators import layers as L
from cellweave.plans.queries import _CELLS, _PAIRS, QUERIES, SQL, digest, local, pairs, quantity_tiles, query, spread, table

_SUMS = "select vec_id, count(z) as n, round(coalesce(sum(z), 0), 4) as s, round(coalesce(sum(z * i), 0), 4) as w from e group by vec_id"
_NEAR = "from c join c n on n.vec_id = c.vec_id and abs((n.i - 1) // 8 - (c.i - 1) // 8) <= 1 and abs((n.i - 1) % 8 - (c.i - 1) % 8) <= 1 group by c.vec_id, c.i"

local("convolve", lambda x, y, n: rf.call("rf_convolve", n, rf.rf_make_ones_tile(F.lit(3), F.lit(3), F.lit("float64")), F.lit("all")), "nx")
SQL["convolve"] = f"{_PAIRS} e as (select c.vec_id, c.i, sum(n.nx) as z {_NEAR}) {_SUMS}"
local("focal_max_data", lambda x, y, n: rf.call("rf_focal_max", n, F.lit("square-1"), F.lit("data")), "nx")
SQL["focal_max_data"] = f"{_PAIRS} e as (select c.vec_id, c.i, case when any_value(c.nx) is not null then max(n.nx) end as z {_NEAR}) {_SUMS}"
local("resample_average", lambda x, y, n: rf.call("rf_resample", n, F.lit(0.5), F.lit("average")), "nx")
SQL["resample_average"] = f"{_PAIRS} d as (select vec_id, ((i - 1) // 16) * 4 + ((i - 1) % 8) // 2 + 1 as i, avg(nx) as z from c group by all), e as (select * from d) {_SUMS}"
for _name in ("focal_mode", "focal_moransi"):
    local(_name, lambda x, y, n, f=f"rf_{_name}": rf.call(f, _tens(n), F.lit("circle-1"), F.lit("all")), "nx")
    del SQL[_name]
for _name in ("bilinear", "cubic_convolution", "cubic_spline", "lanczos", "median", "sum"):
    local(f"resample_{_name}", lambda x, y, n, m=_name: rf.call("rf_resample", n, F.lit(1.5), F.lit(m)), "nx")
    del SQL[f"resample_{_name}"]


def _tens(n):
    return rf.rf_round(rf.rf_local_multiply(n, 10.0))


def _surfaces(name: str, *numbers: float) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        box = rf.call("st_makeBBox", 0.0, 0.0, 8.0, 8.0)
        raster = rf.rf_proj_raster(F.col("x"), box, F.lit("EPSG:3857"))
        made = pairs(spark, sf_dir).withColumn("p", rf.call(f"rf_{name}", raster, *(F.lit(v) for v in numbers), F.lit("all")))
        return made.select("vec_id", *digest(F.col("p.tile")))

    QUERIES[name] = run


_surfaces("slope", 1.0)
_surfaces("aspect")
_surfaces("hillshade", 315.0, 45.0, 1.0)


@query(_PAIRS + """ m as (select vec_id, i, floor(255 * (x - min(x) over p) / (max(x) over p - min(x) over p)) as r, floor(255 * (y - min(y) over p) / (max(y) over p - min(y) over p)) as g
from c window p as (partition by vec_id)) select vec_id, count(*) as n, sum(r * 16777216 + g * 65536 + r * 256 + 255)::double as s from m group by vec_id""")
def rgb_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rf.rf_rgb_composite("x", "y", "x")
    made = pairs(spark, sf_dir).select("vec_id", t.alias("t"))
    return made.select("vec_id", rf.rf_data_cells("t").alias("n"), rf.rf_tile_sum("t").alias("s"))


@query()
def render_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pairs(spark, sf_dir)
    return made.select("vec_id", F.octet_length(rf.call("rf_render_png", "x", "y", "x")).alias("png"), F.octet_length(rf.call("rf_render_color_ramp_png", "x", F.lit("Viridis"))).alias("ramp"), F.length(rf.rf_render_ascii("x")).alias("ascii"), F.length(rf.rf_render_matrix("x")).alias("matrix"))


@query(_CELLS + " select vec_id, sum(trunc(nx * 100))::bigint as ints, round(sum(nx), 4) as doubles, count(nx) as n, 'float64' as kind, 8 as cols from c group by vec_id")
def tile_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rf.rf_mask_by_value("x", rf.rf_local_less("x", -0.1), 1)
    made = pairs(spark, sf_dir).select("vec_id", n.alias("n"))
    held = made.select("vec_id", "n", rf.rf_tile_to_array_double("n").alias("d"), rf.rf_tile_to_array_int(rf.rf_local_multiply("n", 100.0)).alias("k"))
    whole = F.filter("k", lambda v: v != -2147483648)
    good = F.filter("d", lambda v: ~F.isnan(v))
    total = lambda a, zero: F.aggregate(a, F.lit(zero), lambda s, v: s + v)
    return held.select("vec_id", F.aggregate(whole, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("ints"), F.round(total(good, 0.0), 4).alias("doubles"), F.size(good).cast("bigint").alias("n"), rf.rf_cell_type("n").alias("kind"), rf.rf_dimensions("n")["cols"].alias("cols"))


_POINTS = "select c_custkey as k, (c_custkey % 360 - 180)::double as x, (c_custkey % 170 - 85)::double as y from customer"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("k"), (F.pmod(k, F.lit(360)) - 180).cast("double").alias("x"), (F.pmod(k, F.lit(170)) - 85).cast("double").alias("y"))


@query(f"select k, round(2 * 6371008.7714 * asin(least(1, sqrt(pow(sin(radians(y - 10) / 2), 2) + cos(radians(10)) * cos(radians(y)) * pow(sin(radians(x - 20) / 2), 2)))), 2) as metres from ({_POINTS})")
def distance_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("k", F.round(rf.call("st_distanceSphere_of", F.lit(20.0), F.lit(10.0), "x", "y"), 2).alias("metres"))


@query(f"""select k, x > -50 and x < 50 and y > -20 and y < 40 as inside, x between -50 and 50 and y between -20 and 40 as covered,
round(greatest(0, -50 - x, x - 50) + greatest(0, -20 - y, y - 40), 6) > 0 as away, x as px, y as py from ({_POINTS})""")
def geometry_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = rf.call("st_geometry", rf.call("st_makeBBox", -50.0, -20.0, 50.0, 40.0))
    p = _points(spark, sf_dir).withColumn("b", box).withColumn("p", rf.call("st_makePoint", "x", "y"))
    return p.select("k", rf.call("st_contains", "b", "p").alias("inside"), rf.call("st_covers", "b", "p").alias("covered"), rf.call("st_disjoint", "b", "p").alias("away"), rf.call("st_x", "p").alias("px"), rf.call("st_y", "p").alias("py"))


@query(f"select k, round(radians(x) * 6378137, 3) as px, round(6378137 * ln(tan(pi() / 4 + radians(y) / 2)), 3) as py from ({_POINTS})")
def reproject_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("p", rf.call("st_reproject", rf.call("st_makePoint", "x", "y"), F.lit("EPSG:4326"), F.lit("EPSG:3857")))
    return p.select("k", F.round(rf.call("st_x", "p"), 3).alias("px"), F.round(rf.call("st_y", "p"), 3).alias("py"))


@query("""with g as (select distinct l_orderkey // 8 as tile_id from lineitem)
select tile_id, 1000000.0::double as area, 4000.0::double as perimeter, ((tile_id % 16) * 1000 + 500)::double as cx, ((tile_id // 16) * 1000 + 500)::double as cy, 'Polygon' as kind, 5 as points from g""")
def geometry_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = quantity_tiles(spark, sf_dir).select("tile_id", rf.call("st_geometry", "extent").alias("g")).withColumn("c", rf.call("st_centroid", "g"))
    return g.select("tile_id", rf.call("st_area", "g").alias("area"), rf.call("st_length", "g").alias("perimeter"), F.round(rf.call("st_x", "c"), 6).alias("cx"), F.round(rf.call("st_y", "c"), 6).alias("cy"), rf.call("st_geometryType", "g").alias("kind"), rf.call("st_numPoints", "g").alias("points"))


@query()
def geometry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("p", rf.call("st_makePoint", "x", "y"))
    box = rf.call("st_makeBBox", F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)
    return p.select("k", rf.call("st_geoHash", "p", F.lit(30)).alias("hash"), rf.call("rf_xz2_index", box, F.lit("EPSG:4326"), F.lit(12)).alias("xz2"), rf.call("st_asText", "p").alias("text"), rf.call("st_asGeoJSON", "p").alias("json"), rf.call("st_asLatLonText", "p").alias("degrees"))


@query(_CELLS + " select distinct vec_id, 36::bigint as n from c")
def rasterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of an 8x8 tile whose centre lies in a triangle."""
    shape = rf.call("st_geomFromWKT", F.lit("POLYGON ((0 0, 0 8.5, 8.5 0, 0 0))"))
    made = pairs(spark, sf_dir).select("vec_id", rf.call("rf_rasterize", shape, rf.call("st_makeBBox", 0.0, 0.0, 8.0, 8.0), F.lit(1), F.lit(8), F.lit(8)).alias("t"))
    return made.select("vec_id", rf.rf_data_cells("t").alias("n"))


def _layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity tiles as a layer of 16 columns; its rows count from the top of a fixed height."""
    key = F.struct(F.pmod("tile_id", F.lit(16)).cast("int").alias("col"), F.floor(F.col("tile_id") / 16).cast("int").alias("row"))
    frame = quantity_tiles(spark, sf_dir).select(key.alias("spatial_key"), "tile_id", F.col("t").alias("tile"))
    return L.as_layer(frame, L.Layout(0.0, 0.0, 16_000.0, 1_000_000_000.0, "EPSG:3857", 16, 1_000_000, 7, 8))


@query("""select distinct l_orderkey // 8 as tile_id, ((l_orderkey // 8) % 16 * 1000)::double as xmin, (1e9 - (l_orderkey // 8) // 16 * 1000 - 1000)::double as ymin,
((l_orderkey // 8) % 16 * 1000 + 500)::double as cx from lineitem""")
def layer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = L.with_center(L.with_crs(L.with_extent(_layer(spark, sf_dir))))
    return made.select("tile_id", "extent.xmin", "extent.ymin", F.col("center.x").alias("cx"))


@query("select l_orderkey // 8 as tile_id, sum(l_quantity) * 2 as total from lineitem where (l_orderkey // 8) % 16 < 8 group by 1")
def layer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = _layer(spark, sf_dir)
    joined = L.spatial_join(layer, layer.where("spatial_key.col < 8").select("spatial_key", "tile"))
    return joined.select("tile_id", (rf.rf_tile_sum("tile") + rf.rf_tile_sum("right_tile")).alias("total"))


@query("select 16 as across, max(l_orderkey // 8 // 16)::int + 1 - min(l_orderkey // 8 // 16)::int as down from lineitem")
def layer_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = L.layer_layout(L.clip_extent(_layer(spark, sf_dir)))
    return spark.createDataFrame([(layout.layout_cols, layout.layout_rows)], "across int, down int")


@query()
def layer_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = L.with_margin(_layer(spark, sf_dir), "tile", 1)
    return wide.select("tile_id", rf.rf_data_cells(rf.call("rf_focal_max", "tile_wide", F.lit("square-1"), F.lit("all"))).alias("n"))


@query()
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overview of each block of 16 x 16 tiles, so that each tile has 4 x 4 cells at any number of tiles."""
    block = F.floor(F.col("tile_id") / 256)
    down = block * 16_000.0
    e = F.col("extent")
    box = F.struct(e["xmin"].alias("xmin"), (e["ymin"] - down).alias("ymin"), e["xmax"].alias("xmax"), (e["ymax"] - down).alias("ymax"))
    moved = quantity_tiles(spark, sf_dir).select(block.alias("block"), "t", box.alias("extent"))
    made = C.agg_overview(moved, ["block"], "t", "extent", 64, 64, (0.0, 0.0, 16_000.0, 16_000.0))
    return made.select("block", rf.rf_data_cells("overview").alias("n"), rf.rf_tile_sum("overview").alias("s"))
