"""A query for each operator on tiles, made from the test tables, and its SQL for DuckDB.

``embeddings`` are 8x8 tiles: an even vec_id is band x and the next one band y. ``lineitem`` gives tiles with
cells missing by nature: a tile of 7 columns (line numbers) and 8 rows (orders).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import functions as rf
from cellweave.operators import cells as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rf.register(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores: a file of narrow rows is one task or a few, however much work each row is."""
    return df.repartition(max(24, 2 * df.sparkSession.sparkContext.defaultParallelism), key)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, t."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", rf.rf_array_to_tile(F.col("embedding").cast("array<double>"), 8, 8).alias("t"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x, y: two bands."""
    t = tiles(spark, sf_dir)
    even = t.where("vec_id % 2 = 0").withColumnRenamed("t", "x")
    return even.join(t.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("t").alias("y")), "vec_id")


def digest(t: Column) -> list[Column]:
    """Of a tile's cells: how many have data, their sum, and their sum weighted by place."""
    weighted = F.aggregate(F.transform(t["cells"], lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return [rf.rf_data_cells(t).alias("n"), F.round(rf.rf_tile_sum(t), 4).alias("s"), F.round(weighted, 4).alias("w")]


_PAIRS = """
with a as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings where vec_id % 2 = 0),
b as (select vec_id - 1 as vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as y from embeddings where vec_id % 2 = 1),
c as (select vec_id, i, x, y, case when x < -0.1 then null else x end as nx from a join b using (vec_id, i)),
"""


def local(name: str, make: Callable[[Column, Column, Column], Column], sql: str) -> None:
    """A cell-wise operator over x, y and nx (x without data below -0.1); ``sql`` says it of one cell."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = pairs(spark, sf_dir)
        x, y = F.col("x"), F.col("y")
        nx = rf.rf_mask_by_value(x, rf.rf_local_less(x, -0.1), 1)
        df = df.withColumn("nx", nx).withColumn("z", make(x, y, F.col("nx")))
        return df.select("vec_id", *digest(F.col("z")))

    QUERIES[name] = query
    SQL[name] = f"{_PAIRS} d as (select vec_id, i, ({sql})::double as z from c) select vec_id, count(z) as n, round(coalesce(sum(z), 0), 4) as s, round(coalesce(sum(z * i), 0), 4) as w from d group by vec_id"


_trunc = "trunc({})"
local("local_add", lambda x, y, n: rf.rf_local_add(x, n), "x + nx")
local("local_add_scalar", lambda x, y, n: rf.rf_local_add(n, 1.5), "nx + 1.5")
local("local_subtract", lambda x, y, n: rf.rf_local_subtract(n, y), "nx - y")
local("local_multiply", lambda x, y, n: rf.rf_local_multiply(n, y), "nx * y")
local("local_divide", lambda x, y, n: rf.rf_local_divide(n, rf.rf_local_add(y, 3.0)), "nx / (y + 3)")
local("local_divide_by_zero", lambda x, y, n: rf.rf_local_divide(n, rf.rf_local_greater(y, 0.0)), "nx / nullif((y > 0)::double, 0)")
local("local_biased_add", lambda x, y, n: rf.rf_local_biased_add(n, y), "coalesce(nx + y, nx, y)")
local("normalized_difference", lambda x, y, n: rf.rf_normalized_difference(rf.rf_local_add(n, 1.0), rf.rf_local_add(y, 1.0)), "((nx + 1) - (y + 1)) / nullif((nx + 1) + (y + 1), 0)")
for _name, _op in {"less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">=", "equal": "=", "unequal": "<>"}.items():
    local(f"local_{_name}", lambda x, y, n, f=f"rf_local_{_name}": rf.call(f, n, y), f"nx {_op} y")
    local(f"local_{_name}_scalar", lambda x, y, n, f=f"rf_local_{_name}": rf.call(f, n, 0.05), f"nx {_op} 0.05")
local("local_min", lambda x, y, n: rf.rf_local_min(n, y), "case when nx is not null then least(nx, y) end")
local("local_max", lambda x, y, n: rf.rf_local_max(n, y), "case when nx is not null then greatest(nx, y) end")
local("local_clamp", lambda x, y, n: rf.rf_local_clamp(n, -0.05, 0.1), "case when nx is not null then greatest(least(nx, 0.1), -0.05) end")
local("local_is_in", lambda x, y, n: rf.rf_local_is_in(rf.rf_round(rf.rf_local_multiply(n, 10.0)), [0, 2]), "coalesce(floor(nx * 10 + 0.5)::int in (0, 2), false)::int")
local("local_no_data", lambda x, y, n: rf.rf_local_no_data(n), "(nx is null)::int")
local("local_data", lambda x, y, n: rf.rf_local_data(n), "(nx is not null)::int")
local("where", lambda x, y, n: rf.rf_where(rf.rf_local_greater(n, 0.0), x, y), "case when coalesce(nx > 0, false) then x else y end")
local("abs", lambda x, y, n: rf.rf_abs(n), "abs(nx)")
local("round", lambda x, y, n: rf.rf_round(rf.rf_local_multiply(n, 10.0)), "floor(nx * 10 + 0.5)")
local("sqrt", lambda x, y, n: rf.rf_sqrt(n), "case when nx >= 0 then sqrt(nx) end")
for _name, _sql in {"log": "ln({0})", "log10": "log10({0})", "log2": "log2({0})", "log1p": "ln({0} + 1)"}.items():
    local(_name, lambda x, y, n, f=f"rf_{_name}": rf.call(f, rf.rf_local_add(n, 1.0)), _sql.format("(nx + 1)"))
for _name, _sql in {"exp": "exp(nx)", "exp10": "pow(10, nx)", "exp2": "pow(2, nx)", "expm1": "exp(nx) - 1"}.items():
    local(_name, lambda x, y, n, f=f"rf_{_name}": rf.call(f, n), _sql)
local("identity", lambda x, y, n: rf.rf_identity(n), "nx")
local("rescale", lambda x, y, n: rf.rf_rescale(n, F.lit(-0.05), F.lit(0.2)), "(case when nx is not null then greatest(least(nx, 0.2), -0.05) end + 0.05) / 0.25")
local("standardize", lambda x, y, n: rf.rf_standardize(n, F.lit(0.01), F.lit(0.12)), "(nx - 0.01) / 0.12")
local("extract_bits", lambda x, y, n: rf.rf_local_extract_bits(rf.rf_convert_cell_type(rf.rf_abs(rf.rf_local_multiply(n, 100.0)), F.lit("int32")), F.lit(1), F.lit(2)), "(trunc(abs(nx * 100))::int >> 1) & 3")
local("mask", lambda x, y, n: rf.rf_mask(y, n), "case when nx is not null then y end")
local("inverse_mask", lambda x, y, n: rf.rf_inverse_mask(y, n), "case when nx is null then y end")
_tens = lambda n: rf.rf_round(rf.rf_local_multiply(n, 10.0))
local("mask_by_value", lambda x, y, n: rf.rf_mask_by_value(y, _tens(n), 1), "case when floor(nx * 10 + 0.5) is distinct from 1 then y end")
local("inverse_mask_by_value", lambda x, y, n: rf.rf_inverse_mask_by_value(y, _tens(n), 1), "case when floor(nx * 10 + 0.5) = 1 then y end")
local("mask_by_values", lambda x, y, n: rf.rf_mask_by_values(y, _tens(n), [0, 2]), "case when not coalesce(floor(nx * 10 + 0.5)::int in (0, 2), false) then y end")
_hundreds = lambda n: rf.rf_convert_cell_type(rf.rf_abs(rf.rf_local_multiply(n, 100.0)), F.lit("int32"))
local("mask_by_bits", lambda x, y, n: rf.rf_mask_by_bits(y, _hundreds(n), F.lit(1), F.lit(2), [1, 3]), "case when not coalesce(((trunc(abs(nx * 100))::int >> 1) & 3) in (1, 3), false) then y end")
local("mask_by_bit", lambda x, y, n: rf.rf_mask_by_bit(y, _hundreds(n), F.lit(2), F.lit(True)), "case when not coalesce(((trunc(abs(nx * 100))::int >> 2) & 1) = 1, false) then y end")
local("convert_cell_type", lambda x, y, n: rf.rf_convert_cell_type(rf.rf_local_multiply(n, 300.0), F.lit("int8")), "case when trunc(nx * 300) between -127 and 127 then trunc(nx * 300) end")
local("interpret_cell_type", lambda x, y, n: rf.rf_interpret_cell_type_as(rf.rf_convert_cell_type(rf.rf_local_multiply(n, 100.0), F.lit("int16")), F.lit("int16ud3")), "nullif(coalesce(trunc(nx * 100), -32768), 3)")
local("with_no_data", lambda x, y, n: rf.rf_with_no_data(rf.rf_round(rf.rf_local_multiply(n, 10.0)), F.lit(1.0)), "nullif(floor(nx * 10 + 0.5), 1)")
local("make_constant_tile", lambda x, y, n: rf.rf_local_add(n, rf.rf_make_constant_tile(F.lit(2.5), F.lit(8), F.lit(8), F.lit("float64"))), "nx + 2.5")
local("make_ones_tile", lambda x, y, n: rf.rf_local_add(n, rf.rf_make_ones_tile(F.lit(8), F.lit(8), F.lit("int32"))), "nx + 1")
local("make_zeros_tile", lambda x, y, n: rf.rf_local_add(n, rf.rf_make_zeros_tile(F.lit(8), F.lit(8), F.lit("float32"))), "nx + 0")
local("resample_nearest", lambda x, y, n: rf.rf_resample(rf.rf_resample(n, F.lit(2.0), F.lit("nearest_neighbor")), F.lit(0.5), F.lit("max")), "nx")
_WINDOW = """e as (select c.vec_id, c.i, {of} as z from c join c n on n.vec_id = c.vec_id
and abs((n.i - 1) // 8 - (c.i - 1) // 8) <= 1 and abs((n.i - 1) % 8 - (c.i - 1) % 8) <= 1 group by c.vec_id, c.i)
select vec_id, count(z) as n, round(coalesce(sum(z), 0), 4) as s, round(coalesce(sum(z * i), 0), 4) as w from e group by vec_id"""
for _name, _sql in {"mean": "avg(n.nx)", "max": "max(n.nx)", "min": "min(n.nx)", "median": "median(n.nx)", "stddev": "stddev_pop(n.nx)"}.items():
    local(f"focal_{_name}", lambda x, y, n, f=f"rf_focal_{_name}": rf.call(f, n, F.lit("square-1"), F.lit("all")), "nx")
    SQL[f"focal_{_name}"] = _PAIRS + _WINDOW.format(of=_sql)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CELLS = _PAIRS.rstrip().rstrip(",")


@query(_CELLS + """ select vec_id, count(nx) as data_cells, 64 - count(nx) as no_data_cells, round(sum(nx), 5) as total, round(avg(nx), 5) as mean,
round(min(nx), 5) as low, round(max(nx), 5) as high, round(var_pop(nx), 5) as variance, count(nx) = 0 as empty, bool_or(coalesce(nx, 0) <> 0) as some, bool_and(coalesce(nx, 0) <> 0) as every from c group by vec_id""")
def tile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    df = pairs(spark, sf_dir).withColumn("n", rf.rf_mask_by_value(F.col("x"), rf.rf_local_less("x", -0.1), 1)).withColumn("st", rf.rf_tile_stats("n"))
    r = lambda c: F.round(c, 5)
    return df.select(
        "vec_id", rf.rf_data_cells(n).alias("data_cells"), rf.rf_no_data_cells(n).alias("no_data_cells"), r(rf.rf_tile_sum(n)).alias("total"), r(rf.rf_tile_mean(n)).alias("mean"),
        r(rf.rf_tile_min(n)).alias("low"), r(rf.rf_tile_max(n)).alias("high"), r(F.col("st.variance")).alias("variance"), rf.rf_is_no_data_tile(n).alias("empty"), rf.rf_exists(n).alias("some"), rf.rf_for_all(n).alias("every"),
    )


@query(_CELLS + " select vec_id, floor(nx * 10 + 0.5) as value, count(*) as count from c where nx is not null group by all")
def tile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(spark, sf_dir)
    n = rf.rf_mask_by_value("x", rf.rf_local_less("x", -0.1), 1)
    held = df.select("vec_id", rf.rf_tile_histogram(_tens(n)).alias("h"))
    return held.select("vec_id", F.explode("h.bins").alias("b")).select("vec_id", "b.value", "b.count")


@query("select label, count(*) * 64 as data_cells, 0::bigint as no_data_cells, round(avg(m), 6) as mean from (select label, list_avg(embedding::double[]) as m from embeddings) group by label")
def agg_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = tiles(spark, sf_dir).groupBy("label").agg(C.agg_data_cells("t").alias("data_cells"), C.agg_no_data_cells("t").alias("no_data_cells"), C.agg_mean("t").alias("mean"))
    return agg.withColumn("mean", F.round("mean", 6))


_LONG = "with c as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as x from embeddings), m as (select *, case when x >= -0.1 then x end as nx from c)"


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).withColumn("t", rf.rf_mask_by_value("t", rf.rf_local_less("t", -0.1), 1))


@query(_LONG + " select label, count(nx) as data_cells, count(*) - count(nx) as no_data_cells, min(nx) as min, max(nx) as max, round(avg(nx), 6) as mean, round(var_pop(nx), 6) as variance from m group by label")
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.agg_stats(_masked(spark, sf_dir), ["label"], "t").withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 6))


@query(_LONG + " select label, quantile_disc(nx, 0.25) as q1, quantile_disc(nx, 0.5) as q2, quantile_disc(nx, 0.9) as q3 from m group by label")
def agg_approx_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = C.agg_approx_quantiles(_masked(spark, sf_dir), ["label"], "t", [0.25, 0.5, 0.9])
    return q.select("label", *(F.get("quantiles", F.lit(i)).alias(f"q{i + 1}") for i in range(3)))


@query()
def agg_approx_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C.agg_approx_histogram(_masked(spark, sf_dir), ["label"], "t", 20)
    return h.select("label", F.posexplode("histogram.bins").alias("bin", "b")).select("label", "bin", "b.value", "b.count")


@query(_LONG + """ select label, pos, max(nx) as high, min(nx) as low, round(avg(nx), 6) as mean, count(nx)::double as data_cells,
(count(*) - count(nx))::double as no_data_cells, round(var_pop(nx), 6) as variance from m group by label, pos""")
def agg_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    what = ["max", "min", "mean", "data_cells", "no_data_cells", "variance"]
    a = C.agg_local(_masked(spark, sf_dir), ["label"], "t", *what)
    rows = a.select("label", F.posexplode(F.arrays_zip(*(F.col(f"{w}.cells").alias(w) for w in what))).alias("pos", "c"))
    names = rows.schema["c"].dataType.names
    of = {w: F.col("c").getField(n) for w, n in zip(what, names, strict=True)}
    return rows.select("label", F.col("pos").cast("bigint").alias("pos"), of["max"].alias("high"), of["min"].alias("low"), F.round(of["mean"], 6).alias("mean"), of["data_cells"].alias("data_cells"), of["no_data_cells"].alias("no_data_cells"), F.round(of["variance"], 6).alias("variance"))


@query("select vec_id, ((i - 1) % 8)::int as column_index, ((i - 1) // 8)::int as row_index, x, y from (" + _CELLS.replace("\n", " ") + " select vec_id, i, x, y from c)")
def explode_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.explode_tiles(pairs(spark, sf_dir), "x", "y", keep=["vec_id"])


@query("select vec_id, 16::bigint as n from embeddings where vec_id % 2 = 0")
def explode_tiles_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.explode_tiles(pairs(spark, sf_dir), "x", keep=["vec_id"], fraction=0.25, seed=3).groupBy("vec_id").agg(F.count("*").alias("n"))


_LINES = "select l_orderkey // 8 as tile_id, l_linenumber - 1 as c, l_orderkey % 8 as r, sum(l_quantity) as q from lineitem group by all"


def quantity_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, t, extent: tiles with natural gaps, on a grid of 16 columns."""
    lines = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).cast("bigint").alias("tile_id"), (F.col("l_linenumber") - 1).alias("c"), F.pmod("l_orderkey", F.lit(8)).cast("int").alias("r"), "l_quantity")
    cells = lines.groupBy("tile_id", "c", "r").agg(F.sum("l_quantity").alias("q"))
    made = cells.groupBy("tile_id").agg(C.assembled("c", "r", "q", 7, 8).alias("t"))
    gx, gy = F.pmod("tile_id", F.lit(16)).cast("double"), F.floor(F.col("tile_id") / 16).cast("double")
    box = F.struct((gx * 1000).alias("xmin"), (gy * 1000).alias("ymin"), (gx * 1000 + 1000).alias("xmax"), (gy * 1000 + 1000).alias("ymax"))
    return made.select("tile_id", "t", box.alias("extent"), F.lit("EPSG:3857").alias("crs"))


@query(f"select tile_id, count(*) as data_cells, 56 - count(*) as no_data_cells, sum(q) as total, sum(q * (r * 7 + c + 1)) as weighted from ({_LINES}) group by tile_id")
def assemble_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    weighted = F.aggregate(F.transform(t["cells"], lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return quantity_tiles(spark, sf_dir).select("tile_id", rf.rf_data_cells(t).alias("data_cells"), rf.rf_no_data_cells(t).alias("no_data_cells"), rf.rf_tile_sum(t).alias("total"), weighted.alias("weighted"))


@query(f"""with t as (select tile_id, count(*) as n, sum(q) as s from ({_LINES}) group by tile_id)
select a.tile_id, a.n as left_cells, b.n as right_cells, b.s as right_sum from t a join t b using (tile_id)""")
def raster_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles joined with themselves by place, boxes drawn in a little so that neighbours don't touch."""
    from cellweave.operators.joins import raster_join as join

    left = quantity_tiles(spark, sf_dir)
    e = F.col("extent")
    inner = F.struct((e["xmin"] + 1e-3).alias("xmin"), (e["ymin"] + 1e-3).alias("ymin"), (e["xmax"] - 1e-3).alias("xmax"), (e["ymax"] - 1e-3).alias("ymax"))
    joined = join(left, left.select(F.col("t").alias("u"), inner.alias("extent"), "crs"))
    return joined.select("tile_id", rf.rf_data_cells("t").alias("left_cells"), rf.rf_data_cells("u").alias("right_cells"), rf.rf_tile_sum("u").alias("right_sum"))


_DAYS = "select user_id, hour(ts) as c, case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as r, day(ts) as d, sum(value) as v from events group by all"


@query(f"""with t as ({_DAYS}), m as (select r, c, count(*) as n, max(v) as high, round(avg(v), 7) as mean from t group by r, c) select r::int as row_index, c::int as column_index, n::double as n, high, mean from m""")
def time_series_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    e = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("c"), kind.alias("r"), F.dayofmonth("ts").alias("d")).agg(F.sum("value").alias("v"))
    days = e.groupBy("user_id", "d").agg(C.assembled("c", "r", "v", 24, 5).alias("t"))
    local_ = C.agg_local(days, [], "t", "data_cells", "max", "mean")
    rows = C.explode_tiles(local_, "data_cells", "max", "mean", keep=[])
    return rows.where("data_cells > 0").select("row_index", "column_index", F.col("data_cells").alias("n"), F.col("max").alias("high"), F.round("mean", 7).alias("mean"))


@query("""with g as (select tile_id, (tile_id % 16) * 1000.0 + 500 as x, (tile_id // 16) * 1000.0 + 500 as y from (select distinct l_orderkey // 8 as tile_id from lineitem)),
l as (select tile_id, least(floor((x / 20037508.342789244 * 180 + 180) / 360 * 4096), 4095)::bigint as i, least(floor((degrees(2 * atan(exp(y / 6378137)) - pi() / 2) + 90) / 180 * 4096), 4095)::bigint as j from g)
select tile_id, (select sum((((i >> k) & 1) << (2 * k)) | (((j >> k) & 1) << (2 * k + 1)))::bigint from range(12) t(k)) as z2 from l""")
def z2_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantity_tiles(spark, sf_dir).select("tile_id", rf.rf_z2_index("extent", "crs", F.lit(12)).alias("z2"))


@query("""select min((tile_id % 16) * 1000.0)::double as xmin, min((tile_id // 16) * 1000.0)::double as ymin, max((tile_id % 16) * 1000.0 + 1000)::double as xmax,
max((tile_id // 16) * 1000.0 + 1000)::double as ymax from (select l_orderkey // 8 as tile_id from lineitem)""")
def agg_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantity_tiles(spark, sf_dir).agg(C.agg_extent("extent").alias("e")).select("e.*")


@query("select vec_id, label, round((x - y) / (x + y), 4) as nd from (select l.vec_id, l.label, list_avg(l.embedding::double[]) + 2 as x, list_avg(r.embedding::double[]) + 2 as y from embeddings l join embeddings r on r.vec_id = l.vec_id + 1 where l.vec_id % 2 = 0)")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs(spark, sf_dir).createOrReplaceTempView("cellweave_pairs")
    return spark.sql("select vec_id, label, round((m.x - m.y) / (m.x + m.y), 4) nd from (select vec_id, label, named_struct('x', rf_tile_mean(x) + 2, 'y', rf_tile_mean(y) + 2) m from cellweave_pairs)")


@query(_PAIRS + """ d as (select l.label, (nx - y) / nullif(nx + y, 0) as z from c join embeddings l using (vec_id))
select label, count(z) as data_cells, count(*) - count(z) as no_data_cells, round(quantile_disc(z, 0.5), 5) as median from d group by label""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A normalized difference of two bands and its statistics by label."""
    x = rf.rf_mask_by_value("x", rf.rf_local_less("x", -0.1), 1)
    nd = pairs(spark, sf_dir).select("label", rf.rf_normalized_difference(x, "y").alias("nd")).select("label", F.explode("nd.cells").alias("z"))
    return nd.groupBy("label").agg(F.count("z").alias("data_cells"), F.count_if(F.col("z").isNull()).alias("no_data_cells"), F.round(F.percentile_approx("z", 0.5, 100_000), 5).alias("median"))
