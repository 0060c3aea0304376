"""Named queries over the driver's tables and the SQL that they are checked against.

Cells are the orders: o_orderkey counts from 0 and is a cell's index in a grid of 10 by 15 by as many layers as it takes.
Blocks of 5 by 5 by 10 cells are features; cells of every eleventh customer are bad and belong to feature 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import orientation, scalar
from gridloom.functions.calculator import calculate
from gridloom.functions.distance import distance
from gridloom.grid import Grid
from gridloom.operators import aggregates, cluster, iterate, mesh, neighbors, segment, stencil, threshold
from gridloom.plans.pipeline import Pipeline
from gridloom.plans.structure import append_grids, concatenate
from gridloom.session import shared_dir, table
from gridloom.sources import binary, text

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
NX, NY = 10, 15
LAYER = NX * NY

CELLS = f"""cells AS (
  SELECT o_orderkey AS idx, o_orderkey % {NX} AS x, (o_orderkey // {NX}) % {NY} AS y, o_orderkey // {LAYER} AS z, o_totalprice AS value,
    CASE WHEN o_custkey % 11 = 0 THEN 0 ELSE 1 + (o_orderkey % {NX}) // 5 + 2 * (((o_orderkey // {NX}) % {NY}) // 5) + 6 * ((o_orderkey // {LAYER}) // 10) END AS fid,
    1 + substr(o_orderpriority, 1, 1)::INTEGER % 3 AS phase, o_totalprice > 100000 AS mask, (o_totalprice / 1000)::INTEGER % 50 AS level FROM orders
)"""
FACES = "(VALUES (0, 0, -1), (0, -1, 0), (-1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)) d(dx, dy, dz)"
BOX = "(SELECT a AS dx, b AS dy, c AS dz FROM range(-1, 2) p(a), range(-1, 2) q(b), range(-1, 2) r(c)) d"
NEAR = "JOIN cells n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def grid_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    grid = Grid((NX, NY, (last or 0) // LAYER + 1), (1.0, 2.0, 3.0), (0.0, 0.0, 0.0))
    cells = grid.with_xyz(orders.select(F.col("o_orderkey").alias("idx"), "o_custkey", "o_totalprice", "o_orderpriority"))
    fid = 1 + F.floor(F.col("x") / 5) + 2 * F.floor(F.col("y") / 5) + 6 * F.floor(F.col("z") / 10)
    cells = cells.select(
        "idx", "x", "y", "z", F.col("o_totalprice").alias("value"), F.when(F.col("o_custkey") % 11 == 0, 0).otherwise(fid).cast("long").alias("fid"),
        (1 + F.substring("o_orderpriority", 1, 1).cast("int") % 3).alias("phase"), (F.col("o_totalprice") > 100000).alias("mask"),
        (F.rint(F.col("o_totalprice") / 1000).cast("int") % 50).alias("level"),  # halves go to the even number, as in SQL
    )
    return cells, grid


def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


# Pipelines, predicates, element-wise functions


@query("""
WITH m AS (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.08)
SELECT l_returnflag, count(*)::BIGINT AS length, round(min(net), 4) AS low, round(max(net), 4) AS high, round(avg(net), 3) AS mean, round(stddev_pop(net), 3) AS stddev FROM m GROUP BY l_returnflag
""")
def group_statistics(spark, sf_dir):
    """The flagship: a pipeline of a threshold tree, an expression and statistics by group."""
    steps = [
        {"filter": "threshold", "args": {"where": {"all": [{"column": "l_quantity", "op": ">", "value": 10}, {"column": "l_discount", "op": "<", "value": 0.08}]}}},
        {"filter": "calculate", "args": {"expression": "l_extendedprice * (1 - l_discount)", "name": "net"}},
        {"filter": "statistics", "args": {"column": "net", "by": "l_returnflag", "mask": "mask"}},
    ]
    out = Pipeline(steps).run(lineitem(spark, sf_dir).select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice"))
    return out.select("l_returnflag", "length", F.round("min", 4).alias("low"), F.round("max", 4).alias("high"), F.round("mean", 3).alias("mean"), F.round("stddev", 3).alias("stddev"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN (l_quantity > 10 AND NOT (l_discount < 0.05)) OR l_linenumber = 2 THEN 7 ELSE 3 END AS mask FROM lineitem")
def multi_threshold_objects(spark, sf_dir):
    c = threshold.Compare
    tree = threshold.AnyOf((threshold.AnyOf((c("l_quantity", ">", 10), c("l_discount", "<", 0.05, True)), True), c("l_linenumber", "==", 2.7)))
    df = threshold.threshold_mask(lineitem(spark, sf_dir), tree, true=7, false=3, kind="int")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "mask")


@query("""WITH t AS (SELECT sum(l_extendedprice * l_quantity) / sum(l_quantity) AS t FROM lineitem)
SELECT l_linenumber, count(*)::BIGINT AS n, count(*) FILTER (l_extendedprice >= t)::BIGINT AS above FROM lineitem, t GROUP BY l_linenumber""")
def robust_automatic_threshold(spark, sf_dir):
    df = threshold.robust_automatic_threshold(lineitem(spark, sf_dir), "l_extendedprice", "l_quantity")
    return df.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(F.col("mask").cast("long")).alias("above"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(-pow(l_quantity, 2) / 3 + sqrt(l_extendedprice) - ln(l_quantity) / ln(2), 5) AS a,
round(sin(radians(l_quantity)) + degrees(atan(l_discount)), 6) AS b FROM lineitem""")
def array_calculator(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    a = calculate("0 - l_quantity ^ 2 / 3 + sqrt(l_extendedprice) - log(2, l_quantity)", df.columns)
    b = calculate("sin(l_quantity) + atan(l_discount)", df.columns, degrees=True)
    return df.select("l_orderkey", "l_linenumber", "l_quantity", F.round(a, 5).alias("a"), F.round(b, 6).alias("b"))


@query("""SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::BIGINT AS whole, (trunc(l_extendedprice)::BIGINT % 256)::SMALLINT AS small,
(((trunc(l_extendedprice)::BIGINT + 128) % 256) - 128)::TINYINT AS signed, l_discount <> 0 AS flag FROM lineitem""")
def convert_data(spark, sf_dir):
    p = F.col("l_extendedprice")
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", scalar.convert(p, "int64").alias("whole"), scalar.convert(p, "uint8").alias("small"), scalar.convert(p, "int8").alias("signed"), scalar.convert(F.col("l_discount"), "boolean").alias("flag"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE l_quantity END AS l_quantity FROM lineitem")
def conditional_set(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("m", F.col("l_returnflag") == "R")
    return threshold.conditional_set(df, "l_quantity", -1, "m").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 0.0 ELSE l_quantity END AS l_quantity FROM lineitem")
def replace_element_attributes(spark, sf_dir):
    return threshold.replace_element_attributes(lineitem(spark, sf_dir), "l_quantity", 5, 45, 0).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT idx, floor(0.2125 * (idx % 256) + 0.7154 * (idx // 256 % 256) + 0.0721 * (idx * 7 % 256) + 0.5)::SMALLINT AS luminosity,
floor((idx % 256 + idx // 256 % 256 + idx * 7 % 256) / 3 + 0.5)::SMALLINT AS average,
floor((greatest(idx % 256, idx // 256 % 256, idx * 7 % 256) + least(idx % 256, idx // 256 % 256, idx * 7 % 256)) / 2 + 0.5)::SMALLINT AS lightness FROM (SELECT o_orderkey AS idx FROM orders)""")
def color_to_gray_scale(spark, sf_dir):
    i = F.col("o_orderkey")
    color = F.array(i % 256, F.floor(i / 256) % 256, i * 7 % 256)
    return table(spark, sf_dir, "orders").select(i.alias("idx"), *(scalar.gray_scale(color, h).alias(h) for h in ("luminosity", "average", "lightness")))


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(abs(l_quantity - l_extendedprice), 6) AS difference FROM lineitem")
def differences_map(spark, sf_dir):
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", F.round(scalar.differences_map(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("difference"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 9) AS scaled FROM lineitem")
def combine_and_split_arrays(spark, sf_dir):
    df = scalar.combine_arrays(lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice"], "both", normalize=True)
    df = scalar.split_array(df, "both", [1])
    return df.select("l_orderkey", "l_linenumber", "l_quantity", F.round("both_1", 9).alias("scaled"))


@query("SELECT o_orderkey, round(radians(o_totalprice), 6) AS r FROM orders")
def change_angle_representation(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scalar.change_angle_representation(F.col("o_totalprice"), False), 6).alias("r"))


@query("SELECT o_orderkey AS idx, 5 + 2.5 * o_orderkey AS step, 7 AS same FROM orders")
def initialize_data(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    df = scalar.initialize_data(df, "step", "incremental", start=5, step=2.5)
    return scalar.initialize_data(df, "same", "value", value=7, kind="int")


_PIXEL_SQL = {"abs": "abs({})", "acos": "acos({})", "asin": "asin({})", "atan": "atan({})", "cos": "cos({})", "sin": "sin({})", "tan": "tan({})", "exp": "exp({})", "log": "ln({} + 2)", "log10": "log10({} + 2)", "sqrt": "sqrt({} + 2)", "square": "{0} * {0}", "not": "CASE WHEN {} = 0 THEN 1 ELSE 0 END", "bounded_reciprocal": "1 / (1 + {} + 2)"}
for _name, _f in scalar.PIXEL.items():
    _moved = _name in ("log", "log10", "sqrt", "bounded_reciprocal")

    def _pixel(spark, sf_dir, f=_f, moved=_moved):
        v = F.col("l_discount") * 10 - 0.5
        return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", F.round(f(v + 2 if moved else v).cast("double"), 9).alias("made"))

    query(f"SELECT l_orderkey, l_linenumber, l_quantity, round(({_PIXEL_SQL[_name].format('(l_discount * 10 - 0.5)')})::DOUBLE, 9) AS made FROM lineitem", f"pixel_{_name}")(_pixel)


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(exp(-0.5 * l_quantity), 12) AS exp_negative, 255 - l_quantity AS inverted,
round(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity > 40 THEN 100 ELSE (l_quantity - 10) * (100.0 / 30) END::DOUBLE, 6) AS windowed,
round(255 / (1 + exp(-(l_quantity - 25) / 5)), 6) AS sigmoid FROM lineitem""")
def pixel_maps(spark, sf_dir):
    q = F.col("l_quantity")
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", F.round(scalar.exp_negative(q, 0.5), 12).alias("exp_negative"), scalar.invert_intensity(q).alias("inverted"), F.round(scalar.intensity_window(q, 10, 40, 0, 100).cast("double"), 6).alias("windowed"), F.round(scalar.sigmoid(q, 5, 25, 0, 255), 6).alias("sigmoid"))


@query("""WITH s AS (SELECT min(l_quantity) lo, max(l_quantity) hi, avg(l_quantity) m, stddev_samp(l_quantity) d, sum(l_quantity) t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, round((l_quantity - lo) * 255 / (hi - lo), 6) AS rescaled, round((l_quantity - m) / d, 6) AS normalized, round(l_quantity * 1000000 / t, 6) AS shared FROM lineitem, s""")
def pixel_totals(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    df = scalar.normalize_to_constant(scalar.normalize(scalar.rescale_intensity(df, "l_quantity", 0, 255, "rescaled"), "l_quantity", "normalized"), "l_quantity", 1e6, "shared")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", *(F.round(c, 6).alias(c) for c in ("rescaled", "normalized", "shared")))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END AS masked, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 1 ELSE 0 END AS inside,
CASE WHEN l_quantity BETWEEN 10 AND 20 THEN l_quantity ELSE -1 END AS kept FROM lineitem""")
def image_thresholds(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", "l_quantity", threshold.mask_image(F.col("l_quantity"), F.col("l_discount") > 0.05, 0.0).alias("masked"), threshold.binary_threshold("l_quantity", 10, 20).alias("inside"), threshold.threshold_image("l_quantity", 10, 20, -1.0).alias("kept"))


# Aggregates


@query("""WITH r AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) + 1 hi FROM lineitem), b AS (SELECT unnest(range(10)) AS bin),
c AS (SELECT floor((l_extendedprice - lo) / ((hi - lo) / 10))::INTEGER AS bin, count(*) AS n FROM lineitem, r GROUP BY 1)
SELECT 'l_extendedprice' AS name, b.bin::INTEGER AS bin, round(lo + b.bin * ((hi - lo) / 10), 4) AS bin_min, coalesce(n, 0)::BIGINT AS count, 0::BIGINT AS overflow FROM b CROSS JOIN r LEFT JOIN c ON c.bin = b.bin""")
def array_histogram(spark, sf_dir):
    return aggregates.array_histogram(lineitem(spark, sf_dir), ["l_extendedprice"], 10).select("name", "bin", F.round("bin_min", 4).alias("bin_min"), "count", "overflow")


_STATS = """count(*)::BIGINT AS length, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.5) AS median,
round(stddev_pop(l_quantity), 6) AS stddev, sum(l_quantity) AS sum, count(DISTINCT l_quantity)::BIGINT AS n_unique"""


def _statistics(df, by=None, mask=None):
    out = aggregates.array_statistics(df, "l_quantity", by, mask)
    keys = [by] if by else []
    return out.select(*keys, "length", "min", "max", F.round("mean", 6).alias("mean"), "median", F.round("stddev", 6).alias("stddev"), "sum", "n_unique")


@query(f"SELECT {_STATS} FROM lineitem")
def array_statistics(spark, sf_dir):
    return _statistics(lineitem(spark, sf_dir))


@query(f"SELECT l_linenumber, {_STATS} FROM lineitem GROUP BY l_linenumber")
def array_statistics_by_index(spark, sf_dir):
    return _statistics(lineitem(spark, sf_dir), "l_linenumber")


@query(f"SELECT l_linenumber, {_STATS} FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_linenumber")
def array_statistics_masked(spark, sf_dir):
    return _statistics(lineitem(spark, sf_dir).withColumn("m", F.col("l_returnflag") == "N"), "l_linenumber", "m")


@query("""WITH c AS (SELECT l_linenumber, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_linenumber, l_quantity AS mode FROM c QUALIFY n = max(n) OVER (PARTITION BY l_linenumber)""")
def array_modes(spark, sf_dir):
    out = aggregates.array_statistics(lineitem(spark, sf_dir), "l_quantity", "l_linenumber")
    return out.select("l_linenumber", F.explode("modes").alias("mode"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, round((l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w, 6) AS z FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def standardize(spark, sf_dir):
    df = aggregates.standardize(lineitem(spark, sf_dir), "l_quantity", "l_returnflag", "z")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", F.round("z", 6).alias("z"))


@query("""WITH s AS (SELECT label, unnest(embedding)::DOUBLE AS v, vec_id FROM embeddings)
SELECT vec_id, count(*)::BIGINT AS length, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS stddev, round(sum(v), 6) AS sum FROM s GROUP BY vec_id""")
def neighbor_list_statistics(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    made = aggregates.list_statistics("embedding")
    return df.select("vec_id", *(c.alias(n) if n == "length" else F.round(c, 6).alias(n) for n, c in made.items()))


def _on_cells(f):
    def run(spark, sf_dir):
        cells, grid = grid_of(spark, sf_dir)
        return f(cells, grid)

    run.__name__ = f.__name__
    return run


def cell_query(sql: str | None):
    def add(f):
        return query(f"WITH {CELLS}{sql}" if sql else None)(_on_cells(f))

    return add


@cell_query(" SELECT fid, count(*)::BIGINT AS num_elements, count(*) * 6.0 AS volume, round(2 * pow(count(*) * 6.0 * 0.75 / pi(), 1.0::DOUBLE / 3), 6) AS equivalent_diameter FROM cells WHERE fid > 0 GROUP BY fid")
def feature_sizes(cells, grid):
    return aggregates.feature_sizes(cells, grid).withColumn("equivalent_diameter", F.round("equivalent_diameter", 6))


@cell_query(" SELECT phase, round(count(*)::DOUBLE / (SELECT count(*) FROM cells), 9) AS volume_fraction FROM cells GROUP BY phase")
def volume_fractions(cells, grid):
    return aggregates.volume_fractions(cells).withColumn("volume_fraction", F.round("volume_fraction", 9))


@cell_query(", f AS (SELECT fid, arg_max(phase, idx) AS phase FROM cells GROUP BY fid) SELECT phase, count(*)::BIGINT AS num_features FROM f WHERE fid > 0 GROUP BY phase")
def num_features(cells, grid):
    return aggregates.num_features(aggregates.feature_phases(cells))


@cell_query(" SELECT fid, arg_max(phase, idx) AS phase, min(phase) <> max(phase) AS disagrees FROM cells GROUP BY fid")
def feature_phases(cells, grid):
    return aggregates.feature_phases(cells)


@cell_query(" SELECT fid, arg_max(mask, idx)::INTEGER AS phase FROM cells GROUP BY fid")
def feature_phases_binary(cells, grid):
    return aggregates.feature_phases_binary(cells, "mask")


@cell_query(" SELECT fid, arg_max(value, idx) AS value FROM cells GROUP BY fid")
def feature_array_from_element_array(cells, grid):
    return aggregates.last_value(cells, "value").select("fid", "value")


@cell_query(" SELECT fid, round(avg(x + 0.5), 6) AS centroid_x, round(avg((y + 0.5) * 2), 6) AS centroid_y, round(avg((z + 0.5) * 3), 6) AS centroid_z FROM cells GROUP BY fid")
def feature_centroids(cells, grid):
    return aggregates.feature_centroids(cells, grid).select("fid", *(F.round(f"centroid_{a}", 6).alias(f"centroid_{a}") for a in "xyz"))


@cell_query(" SELECT fid, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM cells WHERE fid > 0 GROUP BY fid")
def feature_rects(cells, grid):
    return aggregates.feature_rects(cells, grid)


@cell_query(f", b AS (SELECT c.idx, c.fid, count(*) FILTER (n.fid <> c.fid AND n.fid > 0 AND c.fid > 0) AS b FROM cells c CROSS JOIN {FACES} {NEAR} GROUP BY c.idx, c.fid) SELECT fid, round(avg((b > 0)::INTEGER), 9) AS boundary_fraction FROM b WHERE fid > 0 GROUP BY fid")
def boundary_element_fractions(cells, grid):
    b = cells.join(neighbors.boundary_cells(cells, grid), "idx")
    return aggregates.boundary_fractions(b, "boundary").withColumn("boundary_fraction", F.round("boundary_fraction", 9))


@cell_query(", s AS (SELECT fid, z, count(*) * 2.0 AS a FROM cells WHERE fid > 0 GROUP BY fid, z) SELECT fid, max(a) AS largest_cross_section FROM s GROUP BY fid")
def largest_cross_sections(cells, grid):
    return aggregates.largest_cross_sections(cells, grid)


_AREA = "CASE WHEN dx <> 0 THEN 6.0 WHEN dy <> 0 THEN 3.0 ELSE 2.0 END"


@cell_query(f", v AS (SELECT fid, count(*) * 6.0 AS v FROM cells WHERE fid > 0 GROUP BY fid), a AS (SELECT c.fid, sum({_AREA}) AS a FROM cells c CROSS JOIN {FACES} {NEAR} WHERE c.fid > 0 AND n.fid <> c.fid GROUP BY c.fid) SELECT v.fid, round(a / v, 9) AS surface_area_volume_ratio, round(pow(pi(), 1.0::DOUBLE / 3) * pow(6 * v, 2.0::DOUBLE / 3) / a, 9) AS sphericity FROM v JOIN a USING (fid)")
def surface_area_to_volume(cells, grid):
    out = aggregates.surface_area_to_volume(cells, grid)
    return out.select("fid", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@cell_query(", s AS (SELECT fid, row_number() OVER (ORDER BY count(*) DESC, fid) AS new FROM cells WHERE fid > 0 GROUP BY fid) SELECT idx, coalesce(new, 0)::BIGINT AS fid FROM cells LEFT JOIN s USING (fid)")
def relabel_component_image(cells, grid):
    return aggregates.relabel_components(cells).select("idx", F.col("fid").cast("long").alias("fid"))


@cell_query(" SELECT x, y, max(value) AS high, min(value) AS low, round(avg(value), 4) AS mean, round(sum(value), 2) AS total, max((phase = 1)::INTEGER) AS any_one FROM cells GROUP BY x, y")
def projections(cells, grid):
    made = [aggregates.project(cells, grid, "value", "z", h).withColumnRenamed("value", n) for h, n in (("max", "high"), ("min", "low"), ("mean", "mean"), ("sum", "total"))]
    out = aggregates.project(cells, grid, "phase", "z", "binary").withColumnRenamed("phase", "any_one")
    for m in made:
        out = out.join(m, ["x", "y"])
    return out.select("x", "y", "high", "low", F.round("mean", 4).alias("mean"), F.round("total", 2).alias("total"), "any_one")


# Gathers and neighborhoods


@cell_query(", f AS (SELECT fid, count(*)::BIGINT AS num_elements FROM cells WHERE fid > 0 GROUP BY fid) SELECT idx, coalesce(num_elements, 0) AS num_elements FROM cells LEFT JOIN f USING (fid)")
def copy_feature_array_to_element_array(cells, grid):
    return neighbors.copy_feature_to_element(cells, aggregates.feature_sizes(cells, grid), ["num_elements"]).select("idx", F.coalesce("num_elements", F.lit(0)).alias("num_elements"))


@cell_query(f", p AS (SELECT c.fid, n.fid AS o, sum({_AREA}) AS a FROM cells c CROSS JOIN {FACES} {NEAR} WHERE c.fid > 0 AND n.fid > 0 AND n.fid <> c.fid GROUP BY ALL) SELECT fid, count(*)::BIGINT AS num_neighbors, string_agg(o::VARCHAR || ':' || a::DOUBLE::VARCHAR, ',' ORDER BY o) AS neighbors FROM p GROUP BY fid")
def feature_neighbors(cells, grid):
    out = neighbors.feature_neighbors(cells, grid)
    pairs = F.zip_with("neighbors", "shared_areas", lambda n, a: F.concat(n.cast("string"), F.lit(":"), a.cast("string")))
    return out.select("fid", "num_neighbors", F.array_join(pairs, ",").alias("neighbors"))


@cell_query(f" SELECT c.idx, count(*) FILTER (n.fid <> c.fid AND n.fid > 0 AND c.fid > 0)::BIGINT AS boundary FROM cells c CROSS JOIN {FACES} {NEAR} GROUP BY c.idx")
def boundary_cells(cells, grid):
    return neighbors.boundary_cells(cells, grid)


@cell_query(f", e AS (SELECT fid, bool_or(x IN (0, 9) OR y IN (0, 14) OR z IN (0, (SELECT max(z) FROM cells))) AS s FROM cells WHERE fid > 0 GROUP BY fid), t AS (SELECT DISTINCT c.fid FROM cells c CROSS JOIN {FACES} {NEAR} WHERE c.fid > 0 AND n.fid = 0) SELECT fid, s OR fid IN (SELECT fid FROM t) AS surface FROM e")
def surface_features(cells, grid):
    return neighbors.surface_features(cells, grid)


@cell_query(", f AS (SELECT fid, avg(x + 0.5) AS px, avg((y + 0.5) * 2) AS py, avg((z + 0.5) * 3) AS pz, 2 * pow(count(*) * 6.0 * 0.75 / pi(), 1.0::DOUBLE / 3) AS d FROM cells WHERE fid > 0 GROUP BY fid), m AS (SELECT sum(d) / (count(*) + 1) AS m, min(px) AS lx, min(py) AS ly, min(pz) AS lz FROM f), b AS (SELECT fid, floor((px - lx) / m) AS bx, floor((py - ly) / m) AS by, floor((pz - lz) / m) AS bz, floor(d * 2 / m) AS r FROM f, m) SELECT a.fid, count(o.fid)::BIGINT AS num_neighborhood FROM b a LEFT JOIN b o ON a.fid <> o.fid AND abs(a.bx - o.bx) < a.r AND abs(a.by - o.by) < a.r AND abs(a.bz - o.bz) < a.r GROUP BY a.fid")
def neighborhoods(cells, grid):
    f = aggregates.feature_sizes(cells, grid).join(aggregates.feature_centroids(cells, grid), "fid")
    return neighbors.neighborhoods(f, 2.0).select("fid", "num_neighborhood")


@cell_query(", q AS (SELECT fid, avg(x + 0.5) AS px, avg((y + 0.5) * 2) AS py, avg((z + 0.5) * 3) AS pz FROM cells WHERE fid > 0 GROUP BY fid), d AS (SELECT sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2)) AS d FROM q a JOIN q b ON a.fid < b.fid), l AS (SELECT min(d) AS lo, max(d) AS hi FROM d) SELECT least(floor((d - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, count(*)::BIGINT AS count FROM d, l GROUP BY 1")
def feature_clustering(cells, grid):
    f = aggregates.feature_centroids(cells, grid).where("fid > 0").withColumn("phase", F.lit(1))
    return neighbors.feature_clustering(f, 10, "phase", 1).select("bin", "count")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN floor(c_acctbal / 500)::BIGINT + 10 * c_nationkey ELSE -1 END AS voxel FROM customer")
def map_points_to_grid(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return neighbors.map_points_to_grid(points, Grid((10, 25, 1), (500.0, 1.0, 1.0))).select("c_custkey", "voxel")


@query("""WITH p AS (SELECT floor(c_acctbal / 500)::BIGINT AS x, c_nationkey AS y, c_acctbal AS v FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000)
SELECT x + a + 10 * (y + b) AS voxel, count(*)::BIGINT AS n, round(sum(v), 2) AS total FROM p, range(-1, 2) q(a), range(-1, 2) r(b) WHERE x + a BETWEEN 0 AND 9 AND y + b BETWEEN 0 AND 24 GROUP BY 1""")
def interpolate_point_cloud(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    out = neighbors.interpolate_points(points, Grid((10, 25, 1), (500.0, 1.0, 1.0)), "c_acctbal", (1000.0, 2.0, 0.0))
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return out.select("voxel", F.size("values").cast("long").alias("n"), F.round(total, 2).alias("total"))


@cell_query(" SELECT x // 2 + (y // 3) * 5 + (z // 10) * 25 AS part, count(*)::BIGINT AS n FROM cells GROUP BY 1")
def partition_geometry(cells, grid):
    points = mesh.cell_centres(cells, grid, [])
    parts = Grid((5, 5, (grid.dims[2] - 1) // 10 + 1), (2.0, 6.0, 30.0))
    return neighbors.partition_geometry(points, parts, ("x", "y", "z"), start=0).groupBy(F.col("partition").alias("part")).agg(F.count("*").alias("n"))


@cell_query(" SELECT (x // 2) + 5 * (y // 3) + 25 * z AS idx, value FROM cells WHERE x % 2 = 1 AND y % 3 = 1")
def resample_image_geometry(cells, grid):
    out, _ = neighbors.resample_grid(cells, grid, (2.0, 6.0, 3.0), ["value"])
    return out.select("idx", "value")


@cell_query(" SELECT (x - 2) + 5 * (y - 3) + 40 * (z - 1) AS idx, value FROM cells WHERE x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 10 AND z BETWEEN 1 AND 8")
def crop_image_geometry(cells, grid):
    return neighbors.crop(cells, grid, (2, 3, 1), (6, 10, 8))[0].select("idx", "value")


@cell_query(""", b AS (SELECT 3.0::DOUBLE * max(z) + 3 AS top FROM cells),
 s AS (SELECT x // 4 AS i, y // 5 AS j, z // 7 AS k, sum(level)::BIGINT AS sampled FROM cells GROUP BY ALL)
 SELECT c.idx, s.sampled FROM cells c LEFT JOIN s ON s.i = (CASE WHEN c.x < 4 THEN 0 WHEN c.x < 8 THEN 1 ELSE 2 END) AND s.j = c.y // 5 AND s.k = c.z // 7""")
def resample_rectilinear_grid(cells, grid):
    i, j, k = F.floor(F.col("x") / 4), F.floor(F.col("y") / 5), F.floor(F.col("z") / 7)
    coarse = cells.groupBy((i + 3 * j + 9 * k).alias("idx")).agg(F.sum("level").alias("sampled"))
    layers = [21.0 * k for k in range((grid.dims[2] - 1) // 7 + 1)] + [3.0 * grid.dims[2]]
    return neighbors.resample_rectilinear(coarse, ([0.0, 4.0, 8.0, 10.0], [0.0, 10.0, 20.0, 30.0], layers), grid, ["sampled"]).select("idx", "sampled")


@cell_query(" SELECT c.idx, coalesce(s.value, 0) AS fused FROM cells c LEFT JOIN cells s ON s.x = floor(c.x / 2) AND s.y = c.y AND s.z = c.z")
def fuse_regular_grids(cells, grid):
    other = Grid(grid.dims, (2.0, 2.0, 3.0))
    return neighbors.fuse_regular_grids(cells.select("idx"), grid, cells.select("idx", F.col("value").alias("fused")), other, ["fused"]).select("idx", "fused")


@query("SELECT n_nationkey + n * 25 AS idx, n_name FROM nation, range(2) r(n)")
def concatenate_data_arrays(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), "n_name")
    return concatenate([nation, nation], ["n_name"])


@cell_query(" SELECT x + 20 * y + 300 * z AS idx, value FROM cells UNION ALL SELECT x + 10 + 20 * y + 300 * z, value FROM cells")
def append_image_geometry(cells, grid):
    return append_grids([(cells, grid), (cells, grid)], 0, ["value"])[0]


# Stencils


def _stencil_sql(places, expression):
    return f" SELECT c.idx, {expression} AS made FROM cells c CROSS JOIN {places} {NEAR} GROUP BY c.idx, c.value, c.level, c.fid"



@cell_query(_stencil_sql(BOX, "max(n.value)"))
def grayscale_dilate(cells, grid):
    return stencil.grayscale_dilate(cells, grid, "value", name="made").select("idx", "made")


@cell_query(_stencil_sql(BOX, "min(n.value)"))
def grayscale_erode(cells, grid):
    return stencil.grayscale_erode(cells, grid, "value", name="made").select("idx", "made")


@cell_query(_stencil_sql(BOX, "CASE WHEN bool_or(n.level = 1) THEN 1 ELSE c.level END"))
def binary_dilate(cells, grid):
    return stencil.binary_dilate(cells, grid, "level", shape="box", name="made").select("idx", "made")


@cell_query(_stencil_sql(BOX, "CASE WHEN c.fid = 1 AND bool_or(n.fid <> 1) THEN 0 ELSE c.fid END"))
def binary_erode(cells, grid):
    return stencil.binary_erode(cells, grid, "fid", shape="box", name="made").select("idx", "made")


@cell_query(", e AS (SELECT c.idx, c.x, c.y, c.z, c.value, min(n.value) AS m FROM cells c CROSS JOIN " + BOX + " " + NEAR + " GROUP BY ALL) SELECT c.idx, round(c.value - max(n.m), 4) AS made FROM e c CROSS JOIN " + BOX + " JOIN e n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz GROUP BY c.idx, c.value")
def white_top_hat(cells, grid):
    return stencil.white_top_hat(cells, grid, "value", name="made").select("idx", F.round("made", 4).alias("made"))


@cell_query(", e AS (SELECT c.idx, c.x, c.y, c.z, c.value, max(n.value) AS m FROM cells c CROSS JOIN " + BOX + " " + NEAR + " GROUP BY ALL) SELECT c.idx, round(min(n.m) - c.value, 4) AS made FROM e c CROSS JOIN " + BOX + " JOIN e n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz GROUP BY c.idx, c.value")
def black_top_hat(cells, grid):
    return stencil.black_top_hat(cells, grid, "value", name="made").select("idx", F.round("made", 4).alias("made"))


_CLAMP = "JOIN cells n ON n.x = least(greatest(c.x + dx, 0), 9) AND n.y = least(greatest(c.y + dy, 0), 14) AND n.z = least(greatest(c.z + dz, 0), (SELECT max(z) FROM cells))"


@cell_query(f" SELECT c.idx, median(n.value) AS made FROM cells c CROSS JOIN {BOX} {_CLAMP} GROUP BY c.idx")
def median_image(cells, grid):
    return stencil.median(cells, grid, "value", name="made").select("idx", "made")


@cell_query(f" SELECT c.idx, round(sqrt(pow(sum(dx * n.value) / 2, 2) + pow(sum(dy * n.value) / 4, 2) + pow(sum(dz * n.value) / 6, 2)), 4) AS made FROM cells c CROSS JOIN {FACES} {_CLAMP} GROUP BY c.idx")
def gradient_magnitude(cells, grid):
    return stencil.gradient_magnitude(cells, grid, "value", name="made").select("idx", F.round("made", 4).alias("made"))


@cell_query(f" SELECT c.idx, CASE WHEN bool_or(n.fid <> c.fid) THEN c.fid ELSE 0 END AS made FROM cells c CROSS JOIN {FACES} {NEAR} GROUP BY c.idx, c.fid")
def label_contour(cells, grid):
    return stencil.label_contour(cells, grid, "fid", name="made").select("idx", "made")


@cell_query(f" SELECT c.idx, CASE WHEN c.fid = 1 AND bool_or(n.fid <> 1) THEN 1 ELSE 0 END::BIGINT AS made FROM cells c CROSS JOIN {FACES} {NEAR} GROUP BY c.idx, c.fid")
def binary_contour(cells, grid):
    return stencil.binary_contour(cells, grid, "fid", name="made").select("idx", "made")


@cell_query(f", s AS (SELECT *, level - 25 AS s FROM cells), k AS (SELECT *, d.dx + d.dy + d.dz > 0 AS up FROM {FACES}) SELECT c.idx, max(CASE WHEN ((c.s < 0 AND n.s > 0) OR (c.s > 0 AND n.s < 0) OR (c.s = 0 AND n.s <> 0) OR (c.s <> 0 AND n.s = 0)) AND (abs(c.s) < abs(n.s) OR (abs(c.s) = abs(n.s) AND up)) THEN 1 ELSE 0 END) AS made FROM s c CROSS JOIN k JOIN s n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz GROUP BY c.idx")
def zero_crossing(cells, grid):
    return stencil.zero_crossing(cells.withColumn("s", F.col("level") - 25), grid, "s", name="made").select("idx", "made")


@cell_query(f" SELECT c.idx, c.mask OR bool_or(n.mask) AS made FROM cells c CROSS JOIN {FACES} {NEAR} GROUP BY c.idx, c.mask")
def erode_dilate_mask(cells, grid):
    return stencil.erode_dilate_mask(cells, grid, "mask", "dilate", name="made").select("idx", "made")


@cell_query(f", k AS (SELECT row_number() OVER () AS k, * FROM {FACES}), n AS (SELECT c.idx, c.fid, n.fid AS o, k FROM cells c CROSS JOIN k LEFT JOIN cells n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz), r AS (SELECT idx, o, k, count(*) OVER (PARTITION BY idx, o ORDER BY k) AS run FROM n WHERE o > 0 AND fid = 0), b AS (SELECT idx, arg_min(o, (-run, k)) AS o FROM r GROUP BY idx) SELECT cells.idx, CASE WHEN fid = 0 THEN coalesce(o, 0) ELSE fid END AS fid FROM cells LEFT JOIN b USING (idx)")
def erode_dilate_bad_data(cells, grid):
    return stencil.erode_dilate_bad_data(cells, grid, "fid", "erode").select("idx", "fid")


@cell_query(None)
def discrete_gaussian(cells, grid):
    return stencil.discrete_gaussian(cells, grid, "value").select("idx", "value_smooth")


@cell_query(None)
def curvature_flow(cells, grid):
    return stencil.curvature_flow(cells, grid, "value").select("idx", "value_flow")


@cell_query(None)
def erode_dilate_coordination_number(cells, grid):
    return stencil.erode_dilate_coordination(cells, grid, "fid", 4).select("idx", "fid")


# Components and iterative operators

_REACH = """, m AS (SELECT * FROM cells WHERE {where}), e AS (SELECT a.idx AS a, b.idx AS b FROM m a CROSS JOIN """ + FACES + """ JOIN m b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE {link}),
r(idx, root) AS (SELECT idx, idx FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.idx WHERE e.b > r.root), c AS (SELECT idx, min(root) AS root FROM r GROUP BY idx), k AS (SELECT root, row_number() OVER (ORDER BY root) AS id FROM (SELECT DISTINCT root FROM c))"""


def reach_query(where: str, link: str, tail: str):
    return query(f"WITH RECURSIVE {CELLS}" + _REACH.format(where=where, link=link) + tail)


@reach_query("value > 400000", "true", " SELECT cells.idx, coalesce(id, 0)::BIGINT AS label FROM cells LEFT JOIN c USING (idx) LEFT JOIN k USING (root)")
@_on_cells
def connected_component_image(cells, grid):
    return segment.connected_component_image(cells.withColumn("b", (F.col("value") > 400000).cast("int")), grid, "b").select("idx", "label")


@reach_query("mask", "abs(a.value - b.value) <= 20000", " SELECT cells.idx, coalesce(id, 0)::BIGINT AS segment FROM cells LEFT JOIN c USING (idx) LEFT JOIN k USING (root)")
@_on_cells
def scalar_segment_features(cells, grid):
    return segment.scalar_segment(cells, grid, "value", 20000, "mask", "segment").select("idx", "segment")


@reach_query("value BETWEEN 300000 AND 400000", "true", ", s AS (SELECT root, count(*) AS n FROM c GROUP BY root), b AS (SELECT arg_max(root, (n, root)) AS root FROM s) SELECT cells.idx, coalesce(c.root = b.root, false) AS b FROM cells CROSS JOIN b LEFT JOIN c USING (idx)")
@_on_cells
def identify_sample(cells, grid):
    return segment.identify_sample(cells.withColumn("b", F.col("value").between(300000, 400000)), grid, "b").select("idx", "b")


@reach_query("value >= 350000", "true", ", s AS (SELECT DISTINCT root FROM c JOIN cells USING (idx) WHERE value >= 450000) SELECT cells.idx, CASE WHEN c.root IN (SELECT root FROM s) THEN 1 ELSE 0 END AS mask FROM cells LEFT JOIN c USING (idx)")
@_on_cells
def double_threshold(cells, grid):
    return segment.double_threshold(cells.drop("mask"), grid, "value", (350000, 450000, 1e12, 1e12)).select("idx", "mask")


@cell_query(None)
def fill_bad_data(cells, grid):
    return segment.fill_bad_data(cells, grid, "fid", 50).select("idx", "fid")


@cell_query(None)
def euclidean_distance_map(cells, grid):
    return iterate.euclidean_distance_map(cells, grid).select("idx", F.round("distance", 6).alias("distance"))


@cell_query(None)
def require_minimum_size_features(cells, grid):
    return iterate.require_minimum_size(cells, grid, 200).select("idx", "fid")


@cell_query(None)
def require_minimum_neighbors(cells, grid):
    return iterate.require_minimum_neighbors(cells, grid, 3).select("idx", "fid")


@cell_query(None)
def grayscale_fill_hole(cells, grid):
    return iterate.grayscale_fill_hole(cells, grid, "value").select("idx", "value")


@cell_query(None)
def grayscale_grind_peak(cells, grid):
    return iterate.grayscale_grind_peak(cells, grid, "value").select("idx", "value")


@cell_query(None)
def h_maxima(cells, grid):
    return iterate.h_maxima(cells, grid, "value", 50000.0).select("idx", F.round("value", 4).alias("value"))


@cell_query(f" SELECT c.idx, CASE WHEN bool_and(n.value < c.value) THEN 1 ELSE 0 END AS regional_maxima FROM cells c CROSS JOIN {FACES} {NEAR} GROUP BY c.idx")
def regional_maxima(cells, grid):
    """Prices hardly repeat, so that flat zones are single cells and SQL can tell."""
    return iterate.regional_extrema(cells, grid, "value").select("idx", "regional_maxima")


@cell_query(f" SELECT c.idx, CASE WHEN bool_and(n.value > c.value) THEN 1 ELSE 0 END AS regional_minima FROM cells c CROSS JOIN {FACES} {NEAR} GROUP BY c.idx")
def regional_minima(cells, grid):
    return iterate.regional_extrema(cells, grid, "value", True).select("idx", "regional_minima")


@cell_query(None)
def align_sections_feature_centroid(cells, grid):
    return iterate.align_sections_feature_centroid(cells, grid, "mask", ["value"])[0].select("idx", "value")


# Clustering

_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label", F.col("embedding").cast("array<double>").alias("v"))


@query(f"WITH {_VEC} SELECT a.vec_id AS idx, round(list_distance(a.e, b.e), 9) AS euclidean, round(1 - list_cosine_similarity(a.e, b.e), 9) AS cosine FROM v a, v b WHERE b.vec_id = 0")
def vector_distances(spark, sf_dir):
    p = _vectors(spark, sf_dir)
    first = F.broadcast(p.where("idx = 0").select(F.col("v").alias("w")))  # one row
    return p.crossJoin(first).select("idx", F.round(distance(F.col("v"), F.col("w")), 9).alias("euclidean"), F.round(distance(F.col("v"), F.col("w"), "cosine"), 9).alias("cosine"))


@query(f"WITH {_VEC}, k AS (SELECT vec_id AS c, e FROM v WHERE vec_id < 4) SELECT v.vec_id AS idx, (arg_min(k.c, (list_distance(v.e, k.e), k.c)) + 1)::INTEGER AS cluster FROM v, k GROUP BY v.vec_id")
def k_means_assignment(spark, sf_dir):
    p = _vectors(spark, sf_dir)
    centres = [list(r["v"]) for r in p.where("idx < 4").orderBy("idx").collect()]
    return cluster.assign(p, "v", centres).select("idx", "cluster")


@query()
def k_means(spark, sf_dir):
    return cluster.k_means(_vectors(spark, sf_dir), "v", 4)[0].select("idx", "cluster")


@query()
def k_medoids(spark, sf_dir):
    return cluster.k_medoids(_vectors(spark, sf_dir), "v", 3)[0].select("idx", "cluster")


@query(f"WITH {_VEC}, d AS (SELECT a.vec_id, a.label, b.label AS k, avg(list_distance(a.e, b.e)) AS m FROM v a, v b GROUP BY ALL) SELECT vec_id AS idx, round((min(m) FILTER (k <> label) - max(m) FILTER (k = label)) / greatest(min(m) FILTER (k <> label), max(m) FILTER (k = label)), 6) AS silhouette FROM d GROUP BY vec_id, label")
def silhouette(spark, sf_dir):
    return cluster.silhouette(_vectors(spark, sf_dir), "v", "label").withColumn("silhouette", F.round("silhouette", 6))


@query(f"WITH {_VEC} SELECT a.vec_id AS idx, count(*) FILTER (list_distance(a.e, b.e) < 1.2)::BIGINT AS n FROM v a, v b GROUP BY a.vec_id")
def eps_neighbors(spark, sf_dir):
    return cluster.eps_neighbors(_vectors(spark, sf_dir), "v", 1.2)


_DB = """WITH RECURSIVE p AS (SELECT c_custkey AS idx, c_acctbal / 100 AS x, c_nationkey::DOUBLE AS y FROM customer), n AS (SELECT a.idx AS i, b.idx AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 1.0),
core AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 3), e AS (SELECT i, j, d FROM n WHERE j IN (SELECT i FROM core)), r(idx, root) AS (SELECT i, i FROM core UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.idx WHERE e.j > r.root), c AS (SELECT idx, min(root) AS root FROM r GROUP BY idx), k AS (SELECT root, row_number() OVER (ORDER BY root) AS id FROM (SELECT DISTINCT root FROM c))
SELECT p.idx, coalesce(b.id, 0)::INTEGER AS cluster FROM p LEFT JOIN (SELECT e.i, arg_min(k.id, (e.d, e.j)) AS id FROM e JOIN c ON c.idx = e.j JOIN k USING (root) GROUP BY e.i) b ON b.i = p.idx"""


@query(_DB)
def dbscan(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.array(F.col("c_acctbal") / 100, F.col("c_nationkey").cast("double")).alias("v"))
    return cluster.dbscan(p, "v", 1.0, 3, 2).select("idx", "cluster")


# Meshes

_MESH = """vert AS (SELECT c_custkey AS idx, c_acctbal / 100 AS x, c_nationkey::DOUBLE AS y, (c_custkey * 7 % 31)::DOUBLE AS z FROM customer), tri AS (SELECT a.idx, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM vert a JOIN vert b ON b.idx = a.idx + 1 JOIN vert c ON c.idx = a.idx + 2),
cr AS (SELECT *, (b_y - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) AS nz FROM tri)"""


def _mesh(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    vertices = c.select(k.alias("idx"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"), (k * 7 % 31).cast("double").alias("z"))
    return vertices, c.select(k.alias("idx"), k.alias("v0"), (k + 1).alias("v1"), (k + 2).alias("v2"))


@query(f"WITH {_MESH} SELECT idx, round(0.5 * sqrt(nx * nx + ny * ny + nz * nz), 6) AS area FROM cr")
def triangle_areas(spark, sf_dir):
    v, t = _mesh(spark, sf_dir)
    return mesh.triangle_areas(t, v).select("idx", F.round("area", 6).alias("area"))


@query(f"WITH {_MESH} SELECT idx, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0 AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0 AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0 AS nz FROM cr WHERE nx * nx + ny * ny + nz * nz > 0")
def triangle_normals(spark, sf_dir):
    v, t = _mesh(spark, sf_dir)
    out = mesh.triangle_normals(t, v).where(~F.isnan(F.col("normal")[0]))
    return out.select("idx", *((F.round(F.col("normal")[i], 6) + F.lit(0)).alias(f"n{a}") for i, a in enumerate("xyz")))


@query(f"WITH {_MESH} SELECT idx, round((ax + bx + cx) / 3, 6) AS x, round((ay + b_y + cy) / 3, 6) AS y, round((az + bz + cz) / 3, 6) AS z FROM tri")
def triangle_centroids(spark, sf_dir):
    v, t = _mesh(spark, sf_dir)
    return mesh.triangle_centroids(t, v).select("idx", *(F.round(F.col("centroid")[i], 6).alias(a) for i, a in enumerate("xyz")))


@query(f"WITH {CELLS}, f AS (SELECT least(c.fid, n.fid) AS lo, greatest(c.fid, n.fid) AS hi FROM cells c CROSS JOIN (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) d(dx, dy, dz) {NEAR} WHERE c.fid <> n.fid UNION ALL SELECT -1, fid FROM cells CROSS JOIN {FACES} WHERE (dx = -1 AND x = 0) OR (dx = 1 AND x = 9) OR (dy = -1 AND y = 0) OR (dy = 1 AND y = 14) OR (dz = -1 AND z = 0) OR (dz = 1 AND z = (SELECT max(z) FROM cells))) SELECT lo, hi, (count(*) * 2)::BIGINT AS triangles FROM f GROUP BY lo, hi")
@_on_cells
def quick_surface_mesh(cells, grid):
    _, t = mesh.quick_surface_mesh(cells, grid)
    return t.groupBy(F.least("label_a", "label_b").alias("lo"), F.greatest("label_a", "label_b").alias("hi")).agg(F.count("*").alias("triangles"))


@query(f"WITH {CELLS} SELECT fid, round(count(*) * 6.0, 6) AS volume FROM cells WHERE fid > 0 GROUP BY fid")
@_on_cells
def triangle_geometry_sizes(cells, grid):
    """Volumes from the surface mesh are those of the cells."""
    v, t = mesh.quick_surface_mesh(cells, grid)
    return mesh.triangle_feature_volumes(t, v, "label_a", "label_b").withColumn("volume", F.round("volume", 6))


@query("SELECT c_custkey AS idx, round(-c_nationkey * 2.0, 6) + 0 AS x, round(c_acctbal / 100 + 5, 6) AS y FROM customer")
def apply_transformation(spark, sf_dir):
    v, _ = _mesh(spark, sf_dir)
    out = mesh.transform_vertices(v, [[0.0, -2.0, 0.0, 0.0], [1.0, 0.0, 0.0, 5.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]])
    return out.select("idx", (F.round("x", 6) + F.lit(0)).alias("x"), F.round("y", 6).alias("y"))


@cell_query(" SELECT (14 - y) + 15 * x + 150 * z AS idx, value FROM cells")
def rotate_sample_ref_frame(cells, grid):
    out, _ = mesh.rotate_grid(cells, grid, mesh.rotation_matrix((0, 0, 1), 90), ["value"])
    return out.select("idx", "value")


@cell_query(" SELECT idx, fid FROM cells")
def sample_triangle_geometry_on_grid(cells, grid):
    """The surface mesh of the cells, sampled at the cells' centres, gives the cells back."""
    v, t = mesh.quick_surface_mesh(cells, grid)
    return mesh.sample_mesh_on_grid(t, v, grid)


@cell_query(", f AS (SELECT fid, count(*)::DOUBLE AS mass, count(*) * (var_pop(x) + 1.0::DOUBLE / 12) AS m20, count(*) * (var_pop(y) + 1.0::DOUBLE / 12) AS m02, count(*) * covar_pop(x, y) AS m11 FROM cells WHERE fid > 0 GROUP BY fid) SELECT fid, mass, round(2 * mass * mass / (m20 + m02), 6) AS omega1, round(mass * mass * mass * mass / (m20 * m02 - m11 * m11), 3) AS omega2 FROM f")
def moment_invariants(cells, grid):
    out = aggregates.moment_invariants(cells, grid)
    return out.select("fid", "mass", F.round("omega1", 6).alias("omega1"), F.round("omega2", 3).alias("omega2"))


@query("SELECT c_custkey AS idx, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 20")
def crop_vertex_geometry(spark, sf_dir):
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return mesh.crop_vertices(v, (0, 3, 0), (5000, 20, 0)).select(F.col("key").alias("idx"), F.col("x").alias("c_acctbal"))


# Orientations


@query("SELECT o_orderkey AS idx, round(cos(b / 2) * cos((a + c) / 2) * sign(cos(b / 2) * cos((a + c) / 2)), 6) AS w FROM (SELECT o_orderkey, (o_custkey % 360) * pi() / 180 AS a, (o_orderkey % 180) * pi() / 180 AS b, (o_orderkey * 7 % 360) * pi() / 180 AS c FROM orders)")
def convert_orientations(spark, sf_dir):
    e = F.array(F.radians(F.col("o_custkey") % 360), F.radians(F.col("o_orderkey") % 180), F.radians(F.col("o_orderkey") * 7 % 360))
    q = orientation.convert(e, "euler", "quaternion")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.round(q[3], 6).alias("w"))


@query()
def fundamental_zone_quaternions(spark, sf_dir):
    e = F.array(F.radians(F.col("o_custkey") % 360), F.radians(F.col("o_orderkey") % 180), F.radians(F.col("o_orderkey") * 7 % 360))
    q = orientation.fundamental_zone(orientation.convert(e, "euler", "quaternion"), "cubic")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), q.alias("q"))


# Sources and sinks: round trips through files in the shared folder


@query("SELECT n_nationkey::BIGINT AS idx, n_nationkey, n_name FROM nation")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    nation = table(spark, sf_dir, "nation").withColumn("idx", F.col("n_nationkey").cast("long"))
    nation.repartition(1).sortWithinPartitions("idx").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value")).write.text(path)
    return text.read_csv(spark, path, {"n_nationkey": "int32", "n_name": "string"}, start_line=1)


@query("SELECT l_orderkey % 100 AS k, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1")
def table_round_trip(spark, sf_dir):
    from gridloom.sources import store

    path = scratch(spark, "store")
    store.save({"cells": lineitem(spark, sf_dir).select("l_orderkey", "l_quantity")}, path, {"unit": "none"}, [{"filter": "select"}])
    df = store.load(spark, path)["cells"]
    return df.groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"))


@cell_query(" SELECT idx, round(value, 4) AS value FROM cells")
def vtk_round_trip(cells, grid):
    path = scratch(cells.sparkSession, "vtk")
    binary.write_lines(binary.vtk_structured_points(cells, grid, ["value"]), path)
    back, _ = binary.read_vtk_structured_points(cells.sparkSession, path)
    return back.where("value is not null").select("idx", F.round(F.col("value").cast("double"), 4).alias("value"))


# Rows, components and directions

@query("SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS c FROM embeddings")
def extract_component(spark, sf_dir):
    out = scalar.extract_component(table(spark, sf_dir, "embeddings"), "embedding", 3, "c")
    return out.select("vec_id", F.round(F.col("c").cast("double"), 6).alias("c"))


_QUAT = "(SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y, l_tax AS z, l_extendedprice AS w FROM lineitem)"


def _quaternions(spark, sf_dir):
    return lineitem(spark, sf_dir).withColumn("q", F.array("l_quantity", "l_discount", "l_tax", "l_extendedprice"))


def _numbers(df, columns):
    return df.select("l_orderkey", "l_linenumber", *columns)


@query(f"SELECT l_orderkey, l_linenumber, w AS a, x AS b, y AS c, z AS d FROM {_QUAT}")
def convert_quaternion(spark, sf_dir):
    q = orientation.reorder_quaternion(F.col("q"))
    return _numbers(_quaternions(spark, sf_dir), [q[i].alias(n) for i, n in enumerate("abcd")])


@query(f"SELECT l_orderkey, l_linenumber, 0 - x AS a, 0 - y AS b, 0 - z AS c, w AS d FROM {_QUAT}")
def quaternion_conjugate(spark, sf_dir):
    q = orientation.conjugate(F.col("q"))
    return _numbers(_quaternions(spark, sf_dir), [q[i].alias(n) for i, n in enumerate("abcd")])


@query(f"SELECT l_orderkey, l_linenumber, round(x / sqrt(x * x + y * y + z * z), 9) AS a, round(y / sqrt(x * x + y * y + z * z), 9) AS b, round(z / sqrt(x * x + y * y + z * z), 9) AS c, round(sqrt(x * x + y * y + z * z), 9) AS d FROM {_QUAT}")
def rodrigues_convertor(spark, sf_dir):
    r = orientation.rodrigues_convertor(F.col("q"))
    return _numbers(_quaternions(spark, sf_dir), [F.round(r[i], 9).alias(n) for i, n in enumerate("abcd")])


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p < 0.5 THEN 0 ELSE floor(0 * (1 - (p - 0.5) / 0.5) + 200 * ((p - 0.5) / 0.5))::INTEGER END AS r,
CASE WHEN p < 0.5 THEN floor(0 * (1 - p / 0.5) + 100 * (p / 0.5))::INTEGER ELSE 100 END AS g FROM t WHERE p < 1""")
def color_map(spark, sf_dir):
    out = scalar.color_map(lineitem(spark, sf_dir), "l_quantity", [(0.0, 0, 0, 0), (0.5, 0, 100, 0), (1.0, 200, 100, 0)])
    top = out.agg(F.max("l_quantity").alias("top"))
    return out.join(F.broadcast(top), F.col("l_quantity") < F.col("top")).select("l_orderkey", "l_linenumber", F.col("color")[0].alias("r"), F.col("color")[1].alias("g"))


@cell_query(" SELECT idx, CASE WHEN x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 9 AND z BETWEEN 3 AND 11 THEN -1.5 ELSE value END AS value FROM cells")
def initialize_box(cells, grid):
    return scalar.initialize_box(cells, ["value"], (2, 1, 3), (6, 9, 11), -1.5).select("idx", "value")


@cell_query(_stencil_sql(BOX, "max(n.value) - min(n.value)"))
def morphological_gradient(cells, grid):
    return stencil.morphological_gradient(cells, grid, "value", name="made").select("idx", "made")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_acctbal FROM customer WHERE c_nationkey >= 5")
def remove_flagged_vertices(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), "c_acctbal", (F.col("c_nationkey") < 5).alias("flag"))
    return threshold.remove_flagged_vertices(c, "flag")


@query("""WITH t AS (SELECT c_custkey AS k, unnest([c_custkey, c_custkey + 1, c_custkey + 2]) AS v, unnest([0, 1, 2]) AS corner FROM customer WHERE c_nationkey >= 5),
n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM (SELECT DISTINCT v FROM t)), e AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS idx FROM (SELECT DISTINCT k FROM t))
SELECT e.idx, max(n.id) FILTER (corner = 0) AS v0, max(n.id) FILTER (corner = 1) AS v1, max(n.id) FILTER (corner = 2) AS v2 FROM t JOIN n USING (v) JOIN e USING (k) GROUP BY e.idx""")
def remove_flagged_triangles(spark, sf_dir):
    v, t = _mesh(spark, sf_dir)
    flags = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_nationkey") < 5).alias("flag"))
    return threshold.remove_flagged_elements(t.join(flags, "idx"), v, "flag", ["v0", "v1", "v2"])[0].select("idx", "v0", "v1", "v2")


@query("SELECT c_custkey AS idx, c_custkey + 2 AS v0, c_custkey + 1 AS v1, c_custkey AS v2 FROM customer")
def reverse_winding(spark, sf_dir):
    return mesh.reverse_winding(_mesh(spark, sf_dir)[1]).select("idx", "v0", "v1", "v2")


@query("SELECT c_custkey AS key, round(c_acctbal, 2) AS value FROM customer")
def ascii_round_trip(spark, sf_dir):
    path = scratch(spark, "ascii")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("value"))
    text.write_ascii(c, path, ["value"], index=True)
    back = text.read_csv(spark, path, {"key": "int64", "value": "float64"})
    return back.select("key", F.round("value", 2).alias("value"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
