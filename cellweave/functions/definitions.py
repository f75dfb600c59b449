"""Operators on tiles as SQL functions: name -> (parameters, type, body).

Each body is an expression over its parameters, so Catalyst inlines it: there is no
Python in the plan, and columns are pruned through it. Names that end in ``_double``
and ``_int`` take a number in place of the second tile.
"""

from __future__ import annotations

import re

from cellweave.tiles import BASES, CELL_TYPES, EXTENT, PROJ_RASTER, TILE

QUOTED = "'float64'"
Definition = tuple[str, str, str]
DEFINITIONS: dict[str, Definition] = {}

_BASE = r"regexp_extract({0}, '^(bool|u?int8|u?int16|int32|float32|float64)', 1)"
_ORDER = "array(" + ", ".join(f"'{b}'" for b in BASES) + ")"


def _wider(a: str, b: str) -> str:
    """The larger of two cell types; of equal bases the right one."""
    rank = f"array_position({_ORDER}, {_BASE})"
    return f"if({rank.format(b)} >= {rank.format(a)}, {b}, {a})"


def _float(ct: str) -> str:
    return f"if({ct} like 'float%', {ct}, 'float64')"


def tile(cells: str, cell_type: str = "a.cell_type", of: str = "a") -> str:
    """The tile ``of`` with other cells; null if it is null."""
    return f"if({of} is null, null, named_struct('cell_type', {cell_type}, 'cols', {of}.cols, 'rows', {of}.rows, 'cells', {cells}))"


def _cut(cell_type: str, x: str) -> str:
    """Without a fraction where cells are whole numbers."""
    return f"if({cell_type} like 'float%', {x}, if({x} < 0, ceil({x}), floor({x})))"


def define(name: str, params: str, returns: str, body: str) -> None:
    DEFINITIONS[name] = (params, returns, body)


def _binary(name: str, op: str, result: str | None = None, whole: bool = False) -> None:
    """``op`` over x and y; ``result`` is the cell type, else the wider one."""
    both = result or _wider("a.cell_type", "b.cell_type")
    fit = (lambda ct, x: f"double({_cut(ct, x)})") if whole else (lambda ct, x: x)
    swap = lambda v: re.sub(r"\by\b", v, op)
    cells = f"zip_with(a.cells, b.cells, (x, y) -> {fit(both, op)})"
    define(name, f"a {TILE}, b {TILE}", TILE, f"if(b is null, null, {tile(cells, both)})")
    scalar = f"transform(a.cells, x -> {swap('v')})"
    define(f"{name}_double", f"a {TILE}, v DOUBLE", TILE, tile(scalar, result or _float("a.cell_type")))
    cut = f"transform(a.cells, x -> {fit('a.cell_type', swap('double(v)'))})"
    define(f"{name}_int", f"a {TILE}, v INT", TILE, tile(cut, result or "a.cell_type"))


_binary("rf_local_add", "x + y")
_add = DEFINITIONS["rf_local_add"]
define("rf_local_add", _add[0], TILE, f"case when a is null then b when b is null then a else {_add[2]} end")
_binary("rf_local_subtract", "x - y")
_binary("rf_local_multiply", "x * y")
_binary("rf_local_divide", "try_divide(x, y)", whole=True)
define("rf_local_biased_add", f"a {TILE}, b {TILE}", TILE, tile("zip_with(a.cells, b.cells, (x, y) -> coalesce(x + y, x, y))", _wider("a.cell_type", "b.cell_type")))
define("rf_normalized_difference", f"a {TILE}, b {TILE}", TILE, f"if(b is null, null, {tile('zip_with(a.cells, b.cells, (x, y) -> try_divide(x - y, x + y))', QUOTED)})")
for _name, _op in {"less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">=", "equal": "=", "unequal": "<>"}.items():
    _binary(f"rf_local_{_name}", f"double(x {_op} y)", "'bool'")
# least and greatest skip nulls, so missing data is asked for
_binary("rf_local_min", "if(x is null or y is null, null, least(x, y))")
_binary("rf_local_max", "if(x is null or y is null, null, greatest(x, y))")
define(
    "rf_local_clamp", f"a {TILE}, low {TILE}, high {TILE}", TILE,
    f"if(low is null or high is null, null, {tile('zip_with(zip_with(a.cells, high.cells, (x, y) -> if(x is null or y is null, null, least(x, y))), low.cells, (x, y) -> if(x is null or y is null, null, greatest(x, y)))')})",
)
define("rf_local_clamp_double", f"a {TILE}, low DOUBLE, high DOUBLE", TILE, tile("transform(a.cells, x -> if(x is null, null, greatest(least(x, high), low)))"))
define("rf_where", f"c {TILE}, a {TILE}, b {TILE}", TILE, f"if(c is null or b is null, null, {tile('transform(c.cells, (w, i) -> if(coalesce(w, 0D) <> 0D, a.cells[i], b.cells[i]))')})")
define("rf_local_is_in", f"a {TILE}, vs ARRAY<INT>", TILE, tile("transform(a.cells, x -> double(coalesce(array_contains(vs, int(x)), false)))", "'bool'"))
define("rf_local_no_data", f"a {TILE}", TILE, tile("transform(a.cells, x -> double(x is null))", "'bool'"))
define("rf_local_data", f"a {TILE}", TILE, tile("transform(a.cells, x -> double(x is not null))", "'bool'"))


def _unary(name: str, op: str, to_float: bool = False) -> None:
    define(name, f"a {TILE}", TILE, tile(f"transform(a.cells, x -> {op})", _float("a.cell_type") if to_float else "a.cell_type"))


_unary("rf_identity", "x")
_unary("rf_abs", "abs(x)")
_unary("rf_round", "double(floor(x + 0.5D))")
_unary("rf_sqrt", "if(x < 0, null, sqrt(x))", True)
# ln of 0 is minus infinity; of less there is no data
for _name, _op, _at in (("log", "ln(x)", "x"), ("log10", "log10(x)", "x"), ("log2", "log2(x)", "x"), ("log1p", "log1p(x)", "x + 1D")):
    _unary(f"rf_{_name}", f"if({_at} = 0, double('-Infinity'), if({_at} < 0, null, {_op}))", True)
_unary("rf_exp", "exp(x)", True)
_unary("rf_exp10", "pow(10D, x)", True)
_unary("rf_exp2", "pow(2D, x)", True)
_unary("rf_expm1", "expm1(x)", True)
define("rf_rescale", f"a {TILE}, low DOUBLE DEFAULT NULL, high DOUBLE DEFAULT NULL", TILE, tile("transform(a.cells, x -> if(x is null, null, try_divide(least(greatest(x, coalesce(low, array_min(a.cells))), coalesce(high, array_max(a.cells))) - coalesce(low, array_min(a.cells)), coalesce(high, array_max(a.cells)) - coalesce(low, array_min(a.cells)))))", "'float32'"))
define("rf_local_extract_bits", f"a {TILE}, low INT, num INT DEFAULT 1", TILE, tile("transform(a.cells, x -> double(shiftright(int(x), low) & (shiftleft(1, num) - 1)))"))
DEFINITIONS["rf_local_extract_bit"] = DEFINITIONS["rf_local_extract_bits"]

# masking: no data where the mask says so, or where it does not if ``inverse``
def _masked(name: str, more: str, where: str) -> None:
    define(name, f"a {TILE}, m {TILE}{more}", TILE, f"if(m is null, null, {tile(f'zip_with(a.cells, m.cells, (x, y) -> if({where}, null, x))')})")


_masked("rf_mask", ", inverse BOOLEAN DEFAULT false", "(y is null) <> inverse")
_masked("rf_inverse_mask", "", "y is not null")
_masked("rf_mask_by_value", ", v INT, inverse BOOLEAN DEFAULT false", "(int(y) <=> v) <> inverse")
_masked("rf_inverse_mask_by_value", ", v INT", "not (int(y) <=> v)")
define("rf_mask_by_values", f"a {TILE}, m {TILE}, vs ARRAY<INT>", TILE, f"if(m is null, null, {tile('zip_with(a.cells, m.cells, (x, y) -> if(coalesce(array_contains(vs, int(y)), false), null, x))')})")
define("rf_mask_by_bits", f"a {TILE}, m {TILE}, low INT, num INT, vs ARRAY<INT>", TILE, "rf_mask_by_values(a, rf_local_extract_bits(m, low, num), vs)")
define("rf_mask_by_bit", f"a {TILE}, m {TILE}, pos INT, v BOOLEAN", TILE, "rf_mask_by_values(a, rf_local_extract_bits(m, pos, 1), array(int(v)))")

# structure and cell types
define("rf_cell_type", f"a {TILE}", "STRING", "a.cell_type")
define("rf_cell_types", "", "ARRAY<STRING>", "array(" + ", ".join(f"'{c}'" for c in CELL_TYPES) + ")")
define("rf_dimensions", f"a {TILE}", "STRUCT<cols: INT, rows: INT>", "if(a is null, null, named_struct('cols', a.cols, 'rows', a.rows))")
define("rf_tile", f"p {PROJ_RASTER}", TILE, "p.tile")
define("rf_extent", f"p {PROJ_RASTER}", EXTENT, "p.extent")
define("rf_crs", f"p {PROJ_RASTER}", "STRING", "p.crs")
define("rf_proj_raster", f"t {TILE}, e {EXTENT}, c STRING", PROJ_RASTER, "named_struct('tile', t, 'extent', e, 'crs', c)")
_case = lambda ct, n: "case " + " ".join(f"when {ct} like '{b}%' then {v[n]}D" for b, v in BASES.items() if v[n] is not None and v[n] == v[n]) + " end"
#: The value that stands for missing data in a cell type; null if none does (raw) or NaN does.
define("rf_no_data_value", "ct STRING", "DOUBLE", f"case when ct like '%raw' or ct like 'bool%' then null when ct rlike 'ud-?[0-9]' then double(regexp_extract(ct, 'ud(-?[0-9.]+)', 1)) else {_case('ct', 2)} end")
_fit = f"case when ct like 'float32%' then double(float(x)) when ct like 'float%' then x when if(x < 0, ceil(x), floor(x)) between {_case('ct', 0)} and {_case('ct', 1)} then double(if(x < 0, ceil(x), floor(x))) end"
define("rf_convert_cell_type", f"a {TILE}, ct STRING", TILE, tile(f"transform(a.cells, x -> nullif({_fit}, rf_no_data_value(ct)))", "ct"))
define("rf_interpret_cell_type_as", f"a {TILE}, ct STRING", TILE, tile("transform(a.cells, x -> nullif(coalesce(x, rf_no_data_value(a.cell_type)), rf_no_data_value(ct)))", "ct"))
define(
    "rf_with_no_data", f"a {TILE}, v DOUBLE", TILE,
    tile("transform(a.cells, x -> nullif(if(a.cell_type like 'float%', x, coalesce(x, rf_no_data_value(a.cell_type))), v))", f"concat({_BASE.format('a.cell_type')}, 'ud', if(v = floor(v), string(bigint(v)), string(v)))"),
)

# construction and conversion
define("rf_make_constant_tile", "v DOUBLE, cols INT, rows INT, ct STRING", TILE, f"named_struct('cell_type', ct, 'cols', cols, 'rows', rows, 'cells', transform(array_repeat(v, cols * rows), x -> nullif({_fit}, rf_no_data_value(ct))))")
define("rf_make_zeros_tile", "cols INT, rows INT, ct STRING", TILE, "rf_make_constant_tile(0D, cols, rows, ct)")
define("rf_make_ones_tile", "cols INT, rows INT, ct STRING", TILE, "rf_make_constant_tile(1D, cols, rows, ct)")
define("rf_array_to_tile", "xs ARRAY<DOUBLE>, cols INT, rows INT", TILE, "case when xs is null or size(xs) = 0 then null when size(xs) <> cols * rows then raise_error('an array of another size than cols x rows') else named_struct('cell_type', 'float64', 'cols', cols, 'rows', rows, 'cells', transform(xs, x -> nanvl(x, null))) end")
define("rf_tile_to_array_double", f"a {TILE}", "ARRAY<DOUBLE>", "transform(a.cells, x -> coalesce(x, double('NaN')))")
define("rf_tile_to_array_int", f"a {TILE}", "ARRAY<INT>", "transform(a.cells, x -> int(coalesce(x, rf_no_data_value(a.cell_type), -2147483648D)))")
define("rf_render_matrix", f"a {TILE}", "STRING", "array_join(transform(sequence(0, a.rows - 1), r -> concat('[', array_join(transform(slice(a.cells, r * a.cols + 1, a.cols), x -> coalesce(format_string('%.6g', x), 'NaN')), ', '), ']')), '\\n')")
define("rf_render_ascii", f"a {TILE}", "STRING", "array_join(transform(sequence(0, a.rows - 1), r -> array_join(transform(slice(a.cells, r * a.cols + 1, a.cols), x -> case when x is null then '?' else substring('.:-=+*#%@', 1 + int(8 * coalesce(try_divide(x - array_min(a.cells), array_max(a.cells) - array_min(a.cells)), 0D)), 1) end), '')), '\\n')")
_band = lambda t: f"transform({t}.cells, x -> if(x is null, null, bigint(floor(255 * coalesce(try_divide(x - array_min({t}.cells), array_max({t}.cells) - array_min({t}.cells)), 0D)))))"
define("rf_rgb_composite", f"a {TILE}, g {TILE}, b {TILE}", TILE, tile(f"zip_with(zip_with({_band('a')}, {_band('g')}, (x, y) -> x * 16777216L + y * 65536L), {_band('b')}, (x, y) -> double(x + y * 256L + 255L))", "'float64'"))

# statistics of a tile
define("rf_tile_sum", f"a {TILE}", "DOUBLE", "aggregate(a.cells, 0D, (s, x) -> s + coalesce(x, 0D))")
define("rf_data_cells", f"a {TILE}", "BIGINT", "coalesce(bigint(size(array_compact(a.cells))), 0L)")
define("rf_no_data_cells", f"a {TILE}", "BIGINT", "if(a is null, 0L, bigint(size(a.cells) - size(array_compact(a.cells))))")
define("rf_tile_mean", f"a {TILE}", "DOUBLE", "coalesce(try_divide(aggregate(a.cells, 0D, (s, x) -> s + coalesce(x, 0D)), double(size(array_compact(a.cells)))), double('NaN'))")
define("rf_tile_min", f"a {TILE}", "DOUBLE", "if(a is null, 1.7976931348623157E308D, coalesce(array_min(a.cells), double('NaN')))")
define("rf_tile_max", f"a {TILE}", "DOUBLE", "if(a is null, -1.7976931348623157E308D, coalesce(array_max(a.cells), double('NaN')))")
define("rf_is_no_data_tile", f"a {TILE}", "BOOLEAN", "coalesce(forall(a.cells, x -> x is null), true)")
define("rf_exists", f"a {TILE}", "BOOLEAN", "exists(a.cells, x -> coalesce(x, 0D) <> 0D)")
define("rf_for_all", f"a {TILE}", "BOOLEAN", "forall(a.cells, x -> coalesce(x, 0D) <> 0D)")
STATS = "STRUCT<data_cells: BIGINT, no_data_cells: BIGINT, min: DOUBLE, max: DOUBLE, mean: DOUBLE, variance: DOUBLE>"
define(
    "rf_tile_stats", f"a {TILE}", STATS,
    f"aggregate(a.cells, named_struct('n', 0L, 's', 0D, 'q', 0D), (t, x) -> if(x is null, t, named_struct('n', t.n + 1, 's', t.s + x, 'q', t.q + x * x)), "
    "t -> if(t.n = 0, null, named_struct('data_cells', t.n, 'no_data_cells', bigint(size(a.cells)) - t.n, 'min', array_min(a.cells), 'max', array_max(a.cells), 'mean', t.s / t.n, 'variance', greatest(0D, t.q / t.n - pow(t.s / t.n, 2)))))",
)
define(
    "rf_standardize", f"a {TILE}, mean DOUBLE DEFAULT NULL, stddev DOUBLE DEFAULT NULL", TILE,
    f"aggregate(array(rf_tile_stats(a)), cast(null as {TILE}), (t, s) -> {tile("transform(a.cells, x -> try_divide(x - coalesce(mean, s.mean), coalesce(stddev, sqrt(s.variance))))", "'float32'")})",
)
define(
    "rf_tile_histogram", f"a {TILE}", "STRUCT<bins: ARRAY<STRUCT<value: DOUBLE, count: BIGINT>>>",
    "named_struct('bins', get(transform(array(sort_array(array_compact(a.cells))), s -> get(transform(array(filter(transform(s, (v, i) -> named_struct('v', v, 'n', i + 1)), e -> coalesce(get(s, e.n) <> e.v, true))), "
    "ends -> transform(ends, (e, i) -> named_struct('value', e.v, 'count', bigint(e.n - coalesce(get(ends, i - 1).n, 0))))), 0)), 0))",
)

# boxes, keys and indexes
define("st_makeBBox", "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", EXTENT, "named_struct('xmin', least(x0, x1), 'ymin', least(y0, y1), 'xmax', greatest(x0, x1), 'ymax', greatest(y0, y1))")
define("rf_extents_intersect", f"p {EXTENT}, q {EXTENT}", "BOOLEAN", "p.xmin <= q.xmax and q.xmin <= p.xmax and p.ymin <= q.ymax and q.ymin <= p.ymax")
define("rf_extents_contain", f"p {EXTENT}, q {EXTENT}", "BOOLEAN", "p.xmin <= q.xmin and q.xmax <= p.xmax and p.ymin <= q.ymin and q.ymax <= p.ymax")
_spread = lambda v: f"aggregate(array(struct(16, 281470681808895L), struct(8, 71777214294589695L), struct(4, 1085102592571150095L), struct(2, 3689348814741910323L), struct(1, 6148914691236517205L)), {v}, (z, s) -> (z | shiftleft(z, s.col1)) & s.col2)"
_cell = lambda v, low, width: f"bigint(least(floor(({v} - ({low})) / {width} * pow(2, res)), pow(2, res) - 1))"
define("rf_z2_of", "lng DOUBLE, lat DOUBLE, res INT", "BIGINT", f"({_spread(_cell('lng', '-180D', '360D'))}) | shiftleft({_spread(_cell('lat', '-90D', '180D'))}, 1)")
define("rf_mercator_lng", "x DOUBLE", "DOUBLE", "x / 20037508.342789244D * 180")
define("rf_mercator_lat", "y DOUBLE", "DOUBLE", "degrees(2 * atan(exp(y / 6378137D)) - pi() / 2)")
define("rf_z2_index", f"e {EXTENT}, crs STRING, res INT DEFAULT 31", "BIGINT", "case crs when 'EPSG:4326' then rf_z2_of((e.xmin + e.xmax) / 2, (e.ymin + e.ymax) / 2, res) when 'EPSG:3857' then rf_z2_of(rf_mercator_lng((e.xmin + e.xmax) / 2), rf_mercator_lat((e.ymin + e.ymax) / 2), res) else raise_error(concat('no closed form for ', crs)) end")
define("st_distanceSphere_of", "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", "DOUBLE", "2 * 6371008.7714D * asin(least(1D, sqrt(pow(sin(radians(y1 - y0) / 2), 2) + cos(radians(y0)) * cos(radians(y1)) * pow(sin(radians(x1 - x0) / 2), 2))))")
