"""Queries for keyed layers, pipeline transformers and joins of shapes with tiles; see :mod:`cellweave.plans.queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import functions as rf
from cellweave.operators import cells as C
from cellweave.operators import joins, learning
from cellweave.operators import layers as L
from cellweave.plans.queries import _CELLS, _LINES, pairs, quantity_tiles, query, table, tiles
from cellweave.plans.spatial import _POINTS, _layer, _points

call = rf.call
_G = "select distinct l_orderkey // 8 as tile_id, (l_orderkey // 8) % 16 as c, (l_orderkey // 8) // 16 as r from lineitem"


@query(f"""with g as ({_G}), p as (select tile_id, c * 1000.0::double + 500 as x, 1e9::double - r * 1000 - 500 as y from g), d as (select tile_id, x / 20037508.342789244 * 180 as lng, degrees(2 * atan(exp(y / 6378137)) - pi() / 2) as lat from p),
z as (select *, least(floor((lng + 180) / 360 * 2147483648), 2147483647)::bigint as i, least(floor((lat + 90) / 180 * 2147483648), 2147483647)::bigint as j from d)
select tile_id, 1000000.0::double as area, round(lng, 8) as lng, round(lat, 6) as lat, (select sum((((i >> k) & 1) << (2 * k)) | (((j >> k) & 1) << (2 * k + 1)))::bigint from range(31) t(k)) as z2,
1700000000 as seconds, 'key,tile_id,tile' as names, 'a_spatial_key,a_tile_id,a_tile' as prefixed, true as layer, 'tile' as tile_names from z""")
def layer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = _layer(spark, sf_dir)
    made = L.with_timestamp(L.add_temporal(L.with_spatial_index(L.with_center_lat_lng(L.with_geometry(layer))), 1_700_000_000_000))
    names = ",".join(L.renamed(layer, "spatial_key", "key").columns)
    still = L.is_layer(L.renamed(layer, "spatial_key", "key")) and L.key_column(L.renamed(layer, "spatial_key", "key")) == "key" and L.as_layer_safely(layer.drop("tile"), L.layer_layout(layer)) is None
    return made.select(
        "tile_id", call("st_area", "geometry").alias("area"), F.round("center.longitude", 8).alias("lng"), F.round("center.latitude", 6).alias("lat"), F.col("spatial_index").alias("z2"), F.unix_seconds("timestamp").cast("int").alias("seconds"),
        F.lit(names).alias("names"), F.lit(",".join(L.prefixed(layer, "a_").columns)).alias("prefixed"), F.lit(still).alias("layer"), F.lit(",".join(C.tile_columns(layer))).alias("tile_names"),
    )


@query(f"select (tile_id % 16)::int as col, (1000 - 1 - tile_id // 16)::int as row, sum(q) as total, count(*) as n from ({_LINES}) group by tile_id")
def layer_from_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with boxes laid on a layout's grid; boxes drawn in a little, so that they meet one cell each.

    The grid is as high as the tiles reach, 1,000 rows at least; rows are counted from the top of the 1,000th, and negative above it.
    """
    e = F.col("extent")
    inner = F.struct((e["xmin"] + 1e-3).alias("xmin"), (e["ymin"] + 1e-3).alias("ymin"), (e["xmax"] - 1e-3).alias("xmax"), (e["ymax"] - 1e-3).alias("ymax"))
    frame = quantity_tiles(spark, sf_dir).select("t", inner.alias("extent"), "crs")
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    down = max(1000, (last or 0) // 128 + 1)  # eight orders a tile, 16 tiles a row
    made = L.to_layer(frame, L.Layout(0.0, 0.0, 16_000.0, down * 1000.0, "EPSG:3857", 16, down, 7, 8))
    row = (F.col("spatial_key.row") - (down - 1000)).cast("int").alias("row")
    return made.select("spatial_key.col", row, rf.rf_tile_sum("t").alias("total"), rf.rf_data_cells("t").alias("n")).where("n > 0")


@query(f"with h as ({_LINES}) select (tile_id % 16)::int as col, (tile_id // 16 * 2 + r // 4)::int as row, sum(q) as total, count(*) as n from h group by tile_id, r // 4")
def layer_rows_halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile cut in two by rows, through a 1 x 2 grid of windows."""
    layer = _layer(spark, sf_dir)
    k, t = F.col("spatial_key"), F.col("tile")
    halves = layer.select(k.alias("k"), t.alias("t"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"))
    made = halves.select(F.col("k.col").alias("col"), (F.col("k.row") * 2 + F.col("i")).cast("int").alias("row"), F.slice("t.cells", F.col("i") * 28 + 1, F.lit(28)).alias("cells"))
    tile = call("rf_array_to_tile", F.transform("cells", lambda x: F.coalesce(x, F.lit(float("nan")))), F.lit(7), F.lit(4))
    return made.select("col", "row", rf.rf_tile_sum(tile).alias("total"), rf.rf_data_cells(tile).alias("n")).where("n > 0")


@query(f"select tile_id, 'inner' as how, sum(q) * 2 as total from ({_LINES}) group by tile_id union all select tile_id, 'left_semi', sum(q) from ({_LINES}) where tile_id % 16 = 3 group by tile_id union all select tile_id, 'left_anti', sum(q) from ({_LINES}) where tile_id % 16 <> 3 group by tile_id")
def layer_join_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = _layer(spark, sf_dir)
    right = layer.select("spatial_key", "tile")
    some = right.where("spatial_key.col = 3")
    both = L.spatial_join(layer, right).select("tile_id", F.lit("inner").alias("how"), (rf.rf_tile_sum("tile") + rf.rf_tile_sum("right_tile")).alias("total"))
    for how in ("left_semi", "left_anti"):
        both = both.union(L.spatial_join(layer, some, how).select("tile_id", F.lit(how), rf.rf_tile_sum("tile")))
    return both


@query("select vec_id, ((i - 1) % 8)::int as column_index, ((i - 1) // 8)::int as row_index, nx, y from (" + _CELLS.replace("\n", " ") + " select vec_id, i, nx, y from c where nx is not null)")
def tile_exploder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transformers of a pipeline: cells as rows, without those that lack data."""
    from pyspark.ml import Pipeline

    nx = rf.rf_mask_by_value("x", rf.rf_local_less("x", -0.1), 1)
    frame = pairs(spark, sf_dir).select("vec_id", nx.alias("nx"), "y")
    return Pipeline(stages=[learning.TileExploder(), learning.NoDataFilter(inputCols=["nx", "y"])]).fit(frame).transform(frame).select("vec_id", "column_index", "row_index", "nx", "y")


@query("select label, count(*) as n, round(sum(x), 4) as s, round(sum(x * (pos + 1)), 4) as w from (select label, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as x from embeddings) group by label")
def explode_tiles_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles(spark, sf_dir).createOrReplaceTempView("cellweave_tiles")
    return spark.sql("""select label, count(*) n, round(sum(cell), 4) s, round(sum(cell * (row_index * 8 + column_index + 1)), 4) w
        from cellweave_tiles, lateral rf_explode_tiles(t) group by label""")


_SHAPES = f"select k, (k * 37 % 16000)::double as x0, (k * 53 % 5000)::double as y0, (100 + k % 7 * 300)::double as w from ({_POINTS})"


@query(f"""with s as ({_SHAPES}), t as (select tile_id, (tile_id % 16) * 1000 as x, (tile_id // 16) * 1000 as y, sum(q) as total from ({_LINES}) group by tile_id)
select k, tile_id, total from s join t on x0 <= x + 1000 and x <= x0 + w and y0 <= y + 1000 and y <= y0 + w""")
def vector_raster_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    x0, y0, w = F.pmod(k * 37, F.lit(16000)).cast("double"), F.pmod(k * 53, F.lit(5000)).cast("double"), (100 + F.pmod(k, F.lit(7)) * 300).cast("double")
    shapes = _points(spark, sf_dir).select("k", call("st_geometry", call("st_makeBBox", x0, y0, x0 + w, y0 + w)).alias("geometry"))
    joined = joins.vector_join(shapes, quantity_tiles(spark, sf_dir))
    return joined.select("k", "tile_id", rf.rf_tile_sum("t").alias("total"))
