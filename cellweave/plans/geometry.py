"""Queries for vector functions, windows and resampling, with the arithmetic that gives the same in SQL.

``customer`` gives points with whole degrees (k, x, y); lines, boxes and rings are made around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import functions as rf
from cellweave.functions.definitions import EXTENT  # noqa: F401
from cellweave.operators import cells as C
from cellweave.plans.queries import _LINES, _LONG, _PAIRS, QUERIES, SQL, _masked, local, pairs, quantity_tiles, query
from cellweave.plans.spatial import _POINTS, _SUMS, _points, _tens

call = rf.call


def _text(*parts) -> Column:
    """A text of fixed parts and whole numbers."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("bigint").cast("string") for p in parts))


@query(f"""select k, 'POINT (' || x::bigint || ' ' || y::bigint || ')' as told, x as px, y as py, 0 as dim, 2 as coords, false as none, 1 as points, 1 as parts, false as many, true as plain, true as good,
'POINT (' || (x + 1)::bigint || ' ' || (y - 2)::bigint || ')' as moved, '{{"type": "Point", "coordinates": [' || x::bigint || '.0, ' || y::bigint || '.0]}}' as json,
abs(y)::bigint || '°0''0.000"' || case when y >= 0 then 'N' else 'S' end || ' ' || abs(x)::bigint || '°0''0.000"' || case when x >= 0 then 'E' else 'W' end as degrees, 3 as with_m, x + y as kept_m from ({_POINTS})""")
def geometry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    made = _points(spark, sf_dir).select("k", "x", "y", call("st_point", "x", "y").alias("p"), call("st_pointFromText", _text("POINT (", x, " ", y, ")")).alias("t"), call("st_makePointM", x, y, x + y).alias("m"))
    whole = call("st_castToPoint", call("st_pointFromWKB", call("st_asBinary", call("st_geomFromWKB", call("st_asBinary", "t")))))
    same = F.when(call("st_equals", "p", "t") & call("st_equals", "p", call("st_geomFromWKT", call("st_asText", "t"))), call("st_asText", whole))
    number = {n: call(f"st_{n}", "p") for n in ("dimension", "coordDim", "isEmpty", "numPoints", "numGeometries", "isCollection", "isSimple", "isValid")}
    return made.select(
        "k", same.alias("told"), call("st_x", "p").alias("px"), call("st_y", "p").alias("py"), number["dimension"].alias("dim"), number["coordDim"].alias("coords"), number["isEmpty"].alias("none"), number["numPoints"].alias("points"), number["numGeometries"].alias("parts"),
        number["isCollection"].alias("many"), number["isSimple"].alias("plain"), number["isValid"].alias("good"), call("st_asText", call("st_translate", "p", F.lit(1.0), F.lit(-2.0))).alias("moved"), call("st_asGeoJSON", "p").alias("json"),
        call("st_asLatLonText", "p").alias("degrees"), call("st_coordDim", "m").alias("with_m"), (call("st_x", "m") + call("st_y", "m")).alias("kept_m"),
    )


_HASHED = f"""with p as ({_POINTS}), c as (select k, floor((x + 180) / 360 * 32768)::bigint as i, least(floor((y + 90) / 180 * 32768), 32767)::bigint as j from p),
b as (select k, i, j, s, 1 + sum(case when (5 * s + t) % 2 = 0 then (i >> (14 - (5 * s + t) // 2)) & 1 else (j >> (14 - (5 * s + t) // 2)) & 1 end << (4 - t))::int as nth from c, range(6) a(s), range(5) d(t) group by all)"""


@query(_HASHED + """ select k, string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', nth, 1), '' order by s) as hash, any_value(i) * 360 / 32768.0 - 180 as west, any_value(j) * 180 / 32768.0 - 90 as south,
(any_value(i) + 0.5) * 360 / 32768.0 - 180 as px, (any_value(j) + 0.5) * 180 / 32768.0 - 90 as py from b group by k""")
def geometry_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _points(spark, sf_dir).select("k", call("st_geoHash", call("st_point", "x", "y"), F.lit(30)).alias("hash"))
    held = made.select("k", "hash", call("st_extent", call("st_geomFromGeoHash", "hash")).alias("e"), call("st_pointFromGeoHash", "hash").alias("p"))
    return held.select("k", "hash", F.col("e.xmin").alias("west"), F.col("e.ymin").alias("south"), call("st_x", "p").alias("px"), call("st_y", "p").alias("py"))


_SPHERE = "2 * 6371008.7714 * asin(least(1, sqrt(pow(sin(radians(({y1}) - ({y0})) / 2), 2) + cos(radians({y0})) * cos(radians({y1})) * pow(sin(radians(({x1}) - ({x0})) / 2), 2))))"


@query(f"""select k, round({_SPHERE.format(x0="x", y0="y", x1="20", y1="10")}, 2) as apart, round({_SPHERE.format(x0="x", y0="y", x1="x + 3", y1="y")} + {_SPHERE.format(x0="x + 3", y0="y", x1="x + 3", y1="y + 4")}, 2) as along,
5000.0::double as around, 65 as corners, case when x > 170 then 'MultiPolygon' else 'Polygon' end as kind, 10.0::double as area from ({_POINTS})""")
def geometry_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    p = call("st_point", x, y)
    ends = F.array(p, call("st_point", x + 3, y), call("st_point", x + 3, y + 4))
    made = _points(spark, sf_dir).select("k", p.alias("p"), ends.alias("ps"), call("st_makeLine", ends).alias("l"), call("st_bufferPoint", p, F.lit(5000.0)).alias("c"), call("st_antimeridianSafeGeom", call("st_geometry", call("st_makeBBox", x, y, x + 10, y + 1))).alias("g"))
    along = F.when(F.abs(call("st_lengthSphere", "l") - call("st_aggregateDistanceSphere", "ps")) < 1e-6, call("st_lengthSphere", "l"))
    return made.select(
        "k", F.round(call("st_distanceSphere", "p", call("st_point", F.lit(20.0), F.lit(10.0))), 2).alias("apart"), F.round(along, 2).alias("along"), F.round(call("st_distanceSphere", "p", call("st_pointN", call("st_exteriorRing", "c"), F.lit(20))), 3).alias("around"),
        call("st_numPoints", "c").alias("corners"), call("st_geometryType", "g").alias("kind"), F.round(call("st_area", "g"), 6).alias("area"),
    )


@query(f"""select k, 'LINESTRING (' || x::bigint || ' ' || y::bigint || ', ' || (x + 3)::bigint || ' ' || y::bigint || ', ' || (x + 3)::bigint || ' ' || (y + 4)::bigint || ')' as told, 7.0::double as size, 'POINT (' || (x + 3)::bigint || ' ' || y::bigint || ')' as second,
'POINT (' || (x + 3)::bigint || ' ' || (y + 4)::bigint || ')' as last, false as closed, false as ring, true as plain, 2 as ends, 1 as dim, 12.0::double as around, round((3 * (x + 1.5) + 4 * (x + 3)) / 7, 6) as cx, round((3 * y + 4 * (y + 2)) / 7, 6) as cy,
2 as parts, 3 as dots, 5.0::double as other, true as many, true as loop, 1 as ones from ({_POINTS})""")
def geometry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    corners = F.array(call("st_point", x, y), call("st_point", x + 3, y), call("st_point", x + 3, y + 4))
    body = _text("(", x, " ", y, ", ", x + 3, " ", y, ", ", x + 3, " ", y + 4, ")")
    two = F.concat(F.lit("MULTILINESTRING ("), body, F.lit(", "), _text("(", x, " ", y, ", ", x, " ", y + 5, ")"), F.lit(")"))
    dots = _text("MULTIPOINT ((", x, " ", y, "), (", x + 1, " ", y, "), (", x, " ", y + 1, "))")
    made = _points(spark, sf_dir).select(
        "k", call("st_castToLineString", call("st_lineFromText", F.concat(F.lit("LINESTRING "), body))).alias("l"), call("st_makeLine", corners).alias("m"), call("st_mLineFromText", two).alias("two"), call("st_mPointFromText", dots).alias("dots"),
        call("st_makeLine", F.array(*(call("st_point", x + a, y + b) for a, b in ((0, 0), (2, 0), (2, 2), (0, 0))))).alias("loop"), call("st_mPolyFromText", _text("MULTIPOLYGON (((", x, " ", y, ", ", x + 1, " ", y, ", ", x, " ", y + 1, ", ", x, " ", y, ")))")).alias("poly"),
    )
    c = call("st_centroid", "l")
    return made.select(
        "k", F.when(call("st_equals", "l", "m"), call("st_asText", "m")).alias("told"), call("st_length", "l").alias("size"), call("st_asText", call("st_pointN", "l", F.lit(2))).alias("second"), call("st_asText", call("st_pointN", "l", F.lit(-1))).alias("last"),
        call("st_isClosed", "l").alias("closed"), call("st_isRing", "l").alias("ring"), call("st_isSimple", "l").alias("plain"), call("st_numPoints", call("st_boundary", "l")).alias("ends"), call("st_dimension", "l").alias("dim"), call("st_area", call("st_envelope", "l")).alias("around"),
        F.round(call("st_x", c), 6).alias("cx"), F.round(call("st_y", c), 6).alias("cy"), call("st_numGeometries", "two").alias("parts"), call("st_numGeometries", "dots").alias("dots"), call("st_length", call("st_geometryN", "two", F.lit(2))).alias("other"), call("st_isCollection", "two").alias("many"),
        call("st_isRing", "loop").alias("loop"), call("st_numGeometries", "poly").alias("ones"),
    )


@query(f"""select k, 74.0::double as area, 46.0::double as edges, 36.0::double as outer_, 10.0::double as hole, 10 as points, 'MultiLineString' as edge, 80.0::double as filled, 80.0::double as box, true as good, false as many, x as xmin, y + 8 as ymax, 'Polygon' as kind, true as same,
hex(('POINT ' || k)::blob) as bytes from ({_POINTS})""")
def geometry_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    ring = lambda a, b, c, d: _text("(", x + a, " ", y + b, ", ", x + c, " ", y + b, ", ", x + c, " ", y + d, ", ", x + a, " ", y + d, ", ", x + a, " ", y + b, ")")
    made = _points(spark, sf_dir).select("k", "x", "y", call("st_castToPolygon", call("st_polygonFromText", F.concat(F.lit("POLYGON ("), ring(0, 0, 10, 8), F.lit(", "), ring(2, 2, 4, 5), F.lit(")")))).alias("g"))
    held = made.select("*", call("st_exteriorRing", "g").alias("o"), call("st_interiorRingN", "g", F.lit(1)).alias("h"), call("st_extent", "g").alias("e"), call("st_makeBox2D", call("st_point", "x", "y"), call("st_point", F.col("x") + 10, F.col("y") + 8)).alias("b"))
    return held.select(
        "k", call("st_area", "g").alias("area"), call("st_length", "g").alias("edges"), call("st_length", "o").alias("outer_"), call("st_length", "h").alias("hole"), call("st_numPoints", "g").alias("points"), call("st_geometryType", call("st_boundary", "g")).alias("edge"),
        call("st_area", call("st_makePolygon", "o")).alias("filled"), call("st_area", "b").alias("box"), call("st_isValid", "g").alias("good"), call("st_isCollection", "g").alias("many"), F.col("e.xmin").alias("xmin"), F.col("e.ymax").alias("ymax"), call("st_geometryType", call("st_polygon", "o")).alias("kind"),
        call("st_equals", call("rf_geometry", "e"), "b").alias("same"), F.hex(call("st_byteArray", _text("POINT ", F.col("k")))).alias("bytes"),
    )


_IN, _MEET = "x < 50 and x + 20 > -50 and y < 40 and y + 15 > -20", "x <= 50 and x + 20 >= -50 and y <= 40 and y + 15 >= -20"
_WITHIN, _AT = "x >= -50 and x + 20 <= 50 and y >= -20 and y + 15 <= 40", "x between -50 and 50 and y between -20 and 40"


@query(f"""select k, {_MEET} as meets, not ({_MEET}) as apart, {_WITHIN} as inside, {_WITHIN} as holds, {_WITHIN} as covers, ({_MEET}) and not ({_IN}) as touches, ({_IN}) and not ({_WITHIN}) as overlaps, true as equal,
y > -20 and y < 40 and x < 50 and x + 20 > -50 and (x < -50 or x + 20 > 50) as crosses, {_IN} as inner_,
case when x > -50 and x < 50 and y > -20 and y < 40 then '0FFFFF212' when {_AT} then 'F0FFFF212' else 'FF0FFF212' end as matrix,
round(sqrt(pow(greatest(-50 - x, 0, x - 50), 2) + pow(greatest(-20 - y, 0, y - 40), 2)), 6) as distance, least(greatest(x, -50), 50)::double as near_x, least(greatest(y, -20), 40)::double as near_y from ({_POINTS})""")
def geometry_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    made = _points(spark, sf_dir).select("k", call("st_geometry", call("st_makeBBox", x, y, x + 20, y + 15)).alias("b"), call("st_geometry", call("st_makeBBox", -50.0, -20.0, 50.0, 40.0)).alias("c"), call("st_point", x, y).alias("p"), call("st_makeLine", F.array(call("st_point", x, y), call("st_point", x + 20, y))).alias("l"))
    r = lambda n, a, b: call(f"st_{n}", a, b)
    return made.withColumn("near", r("closestPoint", "c", "p")).select(
        "k", r("intersects", "b", "c").alias("meets"), r("disjoint", "b", "c").alias("apart"), r("within", "b", "c").alias("inside"), r("contains", "c", "b").alias("holds"), r("covers", "c", "b").alias("covers"), r("touches", "b", "c").alias("touches"), r("overlaps", "b", "c").alias("overlaps"),
        r("equals", "b", call("st_envelope", "b")).alias("equal"), r("crosses", "l", "c").alias("crosses"), call("st_relateBool", "b", "c", F.lit("T********")).alias("inner_"), r("relate", "p", "c").alias("matrix"), F.round(r("distance", "p", "c"), 6).alias("distance"), F.round(call("st_x", "near"), 6).alias("near_x"), F.round(call("st_y", "near"), 6).alias("near_y"),
    )


@query(f"""select round(min(radians(x) * 6378137), 2) as xmin, round(min(6378137 * ln(tan(pi() / 4 + radians(y) / 2))), 2) as ymin, round(max(radians(x + 1) * 6378137), 2) as xmax,
round(max(6378137 * ln(tan(pi() / 4 + radians(y + 1) / 2))), 2) as ymax from ({_POINTS})""")
def agg_reprojected_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _points(spark, sf_dir).select(call("st_makeBBox", F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("e"), F.lit("EPSG:4326").alias("crs"))
    held = made.agg(C.agg_reprojected_extent("e", "crs", "EPSG:3857").alias("e"))
    return held.select(*(F.round(F.col(f"e.{n}"), 2).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")))


@query(f"""select tile_id, ((tile_id % 16) * 1000)::double as xmin, 'EPSG:3857' as crs, count(*) as n, 1000000.0::double as area, true as same, 7 as cols from ({_LINES}) group by tile_id""")
def raster_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quantity_tiles(spark, sf_dir).select("tile_id", rf.rf_proj_raster("t", "extent", "crs").alias("p"))
    area = call("st_area", call("rf_geometry", rf.rf_extent("p")))
    return made.select("tile_id", rf.rf_extent("p")["xmin"].alias("xmin"), rf.rf_crs("p").alias("crs"), rf.rf_data_cells(rf.rf_tile("p")).alias("n"), area.alias("area"), (rf.rf_crs("p") == rf.rf_mk_crs("epsg:3857")).alias("same"), rf.rf_dimensions(rf.rf_tile("p"))["cols"].alias("cols"))


@query(f"""with b as (select k, (k % 5) + 0.25 as x0, (k % 3) + 0.25 as y0, (k % 5) + (k % 4) + 1.25 as x1, (k % 3) + (k % 6) + 1.25 as y1, (k % 7) + 1 as v from ({_POINTS}))
select k, count(*) as n, sum(v)::double as s, sum(v * ((7 - r) * 8 + c + 1))::double as w from b, range(8) a(c), range(8) d(r) where c + 0.5 > x0 and c + 0.5 < x1 and r + 0.5 > y0 and r + 0.5 < y1 group by k""")
def rasterize_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of several sizes, one a row, burnt into 8x8 tiles with a value of the row."""
    k = F.col("k")
    x0, y0 = F.pmod(k, F.lit(5)) + 0.25, F.pmod(k, F.lit(3)) + 0.25
    shape = call("st_geometry", call("st_makeBBox", x0, y0, x0 + F.pmod(k, F.lit(4)) + 1, y0 + F.pmod(k, F.lit(6)) + 1))
    made = _points(spark, sf_dir).select("k", call("rf_rasterize", shape, call("st_makeBBox", 0.0, 0.0, 8.0, 8.0), (F.pmod(k, F.lit(7)) + 1).cast("int"), F.lit(8), F.lit(8)).alias("t"))
    weighted = F.aggregate(F.transform(F.col("t.cells"), lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return made.select("k", rf.rf_data_cells("t").alias("n"), rf.rf_tile_sum("t").alias("s"), weighted.alias("w"))


# -- scalar forms ---------------------------------------------------------------------------

local("local_subtract_scalar", lambda x, y, n: rf.rf_local_subtract(n, 1.5), "nx - 1.5")
local("local_multiply_scalar", lambda x, y, n: rf.rf_local_multiply(n, 2.5), "nx * 2.5")
local("local_divide_scalar", lambda x, y, n: rf.rf_local_divide(n, 2.5), "nx / 2.5")
for _name, _op in {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}.items():
    local(f"local_{_name}_whole", lambda x, y, n, f=f"rf_local_{_name}": call(f, n, 3), f"nx {_op} 3")
local("local_algebra", lambda x, y, n: rf.rf_local_algebra(lambda a, b: a * 2 + b * b, n, y), "nx * 2 + y * y")

# -- windows and surfaces -------------------------------------------------------------------

_TENS = f"{_PAIRS} t as (select vec_id, i, floor(nx * 10 + 0.5) as v from c),"
_PLUS = "from t c join t n on n.vec_id = c.vec_id and abs((n.i - 1) // 8 - (c.i - 1) // 8) + abs((n.i - 1) % 8 - (c.i - 1) % 8)"
SQL["focal_mode"] = f"""{_TENS} f as (select c.vec_id, c.i, n.v, count(*) as times {_PLUS} <= 1 where n.v is not null group by all),
e as (select vec_id, i, arg_min(v, (-times) * 1000 + v) as z from f group by all) {_SUMS}"""
SQL["focal_moransi"] = f"""{_TENS} m as (select vec_id, avg(v) as mean, var_pop(v) as var from t group by vec_id),
e as (select c.vec_id, c.i, (any_value(c.v) - any_value(m.mean)) / nullif(any_value(m.var), 0) * (avg(n.v) - any_value(m.mean)) as z {_PLUS} = 1 join m on m.vec_id = c.vec_id where c.v is not null group by c.vec_id, c.i) {_SUMS}"""
_GRADIENTS = f"""{_PAIRS} g as (select c.vec_id, c.i, sum(coalesce(n.x, c.x) * o.dc * (2 - abs(o.dr))) / 8 as dx, sum(coalesce(n.x, c.x) * o.dr * (2 - abs(o.dc))) / 8 as dy
from c cross join (select a.v as dr, b.v as dc from (values (-1), (0), (1)) a(v), (values (-1), (0), (1)) b(v)) o
left join c n on n.vec_id = c.vec_id and n.i = c.i + 8 * o.dr + o.dc and (c.i - 1) % 8 + o.dc between 0 and 7 group by c.vec_id, c.i),"""
SQL["slope"] = f"{_GRADIENTS} e as (select vec_id, i, degrees(atan(sqrt(dx * dx + dy * dy))) as z from g) {_SUMS}"
SQL["aspect"] = f"{_GRADIENTS} h as (select *, 90 - degrees(atan2(dy, -dx)) as v from g), e as (select vec_id, i, case when dx <> 0 or dy <> 0 then v - 360 * floor(v / 360) end as z from h) {_SUMS}"
SQL["hillshade"] = f"""{_GRADIENTS} e as (select vec_id, i, least(greatest(round(127 * (cos(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy)))
+ sin(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(135) - atan2(dy, -dx)))), 0), 127) as z from g) {_SUMS}"""

# -- resampling -----------------------------------------------------------------------------

_OUT = "select a.r, b.c from range(12) a(r), range(12) b(c)"
for _name, _of in {"median": "median(nx)", "sum": "sum(nx)", "max": "max(nx)", "min": "min(nx)"}.items():
    local(f"resample_{_name}", lambda x, y, n, m=_name: call("rf_resample", n, F.lit(1.5), F.lit(m)), "nx")
    SQL[f"resample_{_name}"] = f"""{_PAIRS} e as (select c.vec_id, o.r * 12 + o.c + 1 as i, {_of} as z from ({_OUT}) o join c on (c.i - 1) // 8 between o.r * 2 // 3 and (o.r * 2 + 4) // 3 - 1
and (c.i - 1) % 8 between o.c * 2 // 3 and (o.c * 2 + 4) // 3 - 1 group by c.vec_id, o.r, o.c) {_SUMS}"""
local("resample_mode", lambda x, y, n: call("rf_resample", _tens(n), F.lit(0.5), F.lit("mode")), "nx")
SQL["resample_mode"] = f"""{_TENS} f as (select vec_id, ((i - 1) // 16) * 4 + ((i - 1) % 8) // 2 + 1 as i, v, count(*) as times from t where v is not null group by all),
e as (select vec_id, i, arg_min(v, (-times) * 1000 + v) as z from f group by all) {_SUMS}"""
_CURVES = {
    "bilinear": (1, "1 - {d}"),
    "cubic_convolution": (2, "case when {d} < 1 then 1.5 * {d} ** 3 - 2.5 * {d} ** 2 + 1 else -0.5 * {d} ** 3 + 2.5 * {d} ** 2 - 4 * {d} + 2 end"),
    "cubic_spline": (2, "case when {d} < 1 then (4 - 6 * {d} ** 2 + 3 * {d} ** 3) / 6 else (2 - {d}) ** 3 / 6 end"),
    "lanczos": (3, "case when {d} = 0 then 1 else sin(pi() * {d}) / (pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d} / 3) end"),
}
for _name, (_reach, _curve) in _CURVES.items():
    _axis = f"""select o, least(greatest(b, 0), 7) as at, {_curve.format(d='d')} as w from (select o, b, abs((o + 0.5::double) * 8 / 12 - 0.5 - b) as d
from (select o, floor((o + 0.5::double) * 8 / 12 - 0.5)::int + s as b from range(12) a(o), range({1 - _reach}, {_reach + 1}) t(s)))"""
    SQL[f"resample_{_name}"] = f"""{_PAIRS} ax as ({_axis}), e as (select c.vec_id, q.o * 12 + p.o + 1 as i, case when abs(sum(q.w * p.w)) > 1e-12 then sum(c.nx * q.w * p.w) / sum(q.w * p.w) end as z
from ax q cross join ax p join c on c.i = q.at * 8 + p.at + 1 where c.nx is not null group by c.vec_id, q.o, p.o) {_SUMS}"""


# -- pictures, overviews, margins, aggregates -----------------------------------------------

SQL["overview"] = f"""select tile_id // 256 as block, count(*) filter (where c in (0, 2, 4, 6) and r in (1, 3, 5, 7)) as n,
coalesce(sum(q) filter (where c in (0, 2, 4, 6) and r in (1, 3, 5, 7)), 0)::double as s from ({_LINES}) group by 1"""
SQL["layer_margins"] = f"""with d as (select tile_id, (tile_id % 16) * 7 + c as gx, (tile_id // 16) * 8 + r as gy from ({_LINES})), t as (select distinct tile_id, tile_id % 16 as tc, tile_id // 16 as tr from d),
near as (select t.tile_id, t.tc, t.tr, d.gx, d.gy from t join t o on abs(o.tc - t.tc) <= 1 and abs(o.tr - t.tr) <= 1 join d on d.tile_id = o.tile_id where d.gx between t.tc * 7 - 1 and t.tc * 7 + 7 and d.gy between t.tr * 8 - 1 and t.tr * 8 + 8),
seen as (select distinct tile_id, gx + ox as x, gy + oy as y from near, range(-1, 2) a(ox), range(-1, 2) b(oy) where gx + ox between tc * 7 - 1 and tc * 7 + 7 and gy + oy between tr * 8 - 1 and tr * 8 + 8)
select tile_id, count(*) as n from seen group by tile_id"""


@query(f"""{_PAIRS} m as (select vec_id, i, substr('.:-=+*#%@', 1 + floor(8 * (x - min(x) over p) / (max(x) over p - min(x) over p))::int, 1) as ch from c window p as (partition by vec_id)),
l as (select vec_id, (i - 1) // 8 as r, string_agg(ch, '' order by i) as line from m group by all) select vec_id, string_agg(line, chr(10) order by r) as told from l group by vec_id""")
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("vec_id", rf.rf_render_ascii("x").alias("told"))


SQL["agg_stats_column"] = SQL["agg_stats"]


@query(SQL["agg_stats"])
def agg_stats_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _masked(spark, sf_dir).groupBy("label").agg(rf.rf_agg_stats("t").alias("s")).select("label", "s.*")
    return held.withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 6))


@query(_LONG + " select label, count(nx) as n, true as within from m group by label")
def agg_histogram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the approximate histogram hold every cell once, at values that the cells have between them."""
    masked = _masked(spark, sf_dir)
    h = C.agg_approx_histogram(masked, ["label"], "t", 20).select("label", F.col("histogram.bins").alias("b"))
    ends = C.agg_stats(masked, ["label"], "t").select("label", "min", "max")
    total = F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x["count"])
    return h.join(ends, "label").select("label", total.alias("n"), F.forall("b", lambda x: (x["value"] >= F.col("min") - 1e-9) & (x["value"] <= F.col("max") + 1e-9)).alias("within"))


# -- the raster join at other sizes and projections -----------------------------------------


def _quarters(spark: SparkSession, sf_dir: str, crs: str) -> DataFrame:
    """Four tiles of 4x4 equal cells for each quantity tile, cut at 0.4 of its width and height from the top left."""
    left = quantity_tiles(spark, sf_dir)
    e, tiny = F.col("extent"), 1e-3
    x, y = e["xmin"] + 400, e["ymax"] - 400
    boxes = [(e["xmin"] + tiny, y + tiny, x - tiny, e["ymax"] - tiny), (x + tiny, y + tiny, e["xmax"] - tiny, e["ymax"] - tiny), (e["xmin"] + tiny, e["ymin"] + tiny, x - tiny, y - tiny), (x + tiny, e["ymin"] + tiny, e["xmax"] - tiny, y - tiny)]
    names = ("xmin", "ymin", "xmax", "ymax")
    parts = F.array(*(F.struct(F.lit(float(i + 1)).alias("v"), F.struct(*(v.alias(n) for v, n in zip(b, names, strict=True))).alias("extent")) for i, b in enumerate(boxes)))
    rows = left.select(F.explode(parts).alias("q")).select("q.*")
    box = F.col("extent")
    if crs == "EPSG:4326":
        box = F.struct(call("rf_mercator_lng", box["xmin"]).alias("xmin"), call("rf_mercator_lat", box["ymin"]).alias("ymin"), call("rf_mercator_lng", box["xmax"]).alias("xmax"), call("rf_mercator_lat", box["ymax"]).alias("ymax"))
    return rows.select(rf.rf_make_constant_tile(F.col("v"), F.lit(4), F.lit(4), F.lit("float64")).alias("u"), box.alias("extent"), F.lit(crs).alias("crs"))


def _joined(crs: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from cellweave.operators.joins import raster_join

        joined = raster_join(quantity_tiles(spark, sf_dir), _quarters(spark, sf_dir, crs))
        return joined.select("tile_id", rf.rf_data_cells("t").alias("n"), rf.rf_data_cells("u").alias("m"), rf.rf_tile_sum("u").alias("s"), rf.rf_tile_sum(rf.rf_mask("u", "t")).alias("under"))

    return run


_QUARTER = f"""with l as ({_LINES}), g as (select c, r, case when r < 3 then case when c < 3 then 1 else 2 end else case when c < 3 then 3 else 4 end end as v from range(7) a(c), range(8) b(r))
select tile_id, count(*) as n, 56::bigint as m, (select sum(v) from g)::double as s, sum(v)::double as under from l join g using (c, r) group by tile_id"""
for _name, _crs in {"raster_join_sizes": "EPSG:3857", "raster_join_projections": "EPSG:4326"}.items():
    QUERIES[_name], SQL[_name] = _joined(_crs), _QUARTER
