"""Queries on graphs, lines, rasters and calibrated maps, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.operators import coords, frames, grid, records, space
from groundplan.plans.driver_queries import _CELLS, _HOPS, _SEEN, _round, integration_sql
from groundplan.sources import recordings as rec
from groundplan.sources.folders import checkpoints, written

#: Pixels of a cell, and rows and columns of the maps of nations.
CELL, ROWS, COLS = 4, 16, 16


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.visibility_blocks(rec.walkable_cells(spark, sf_dir))


# ---- graphs ----------------------------------------------------------------------------------------------------------


def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.hop_distance(_graph(spark, sf_dir))


def metric_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(space.metric_distance(_graph(spark, sf_dir), 16), "d")


def choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(space.choice(_graph(spark, sf_dir)), "choice")


def choice_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_round(space.choice_sampled(_graph(spark, sf_dir), 40, "s"), "choice"), "standard_error", digits=4)


def syntax_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rec.walkable_cells(spark, sf_dir).withColumnsRenamed({"r": "row", "c": "col"})
    return space.syntax_grid(cells, rec.walkable_calibrations(spark, sf_dir), 16)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    return space.islands(rec.walkable_cells(spark, sf_dir))


def large_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    return space.drop_islands(rec.walkable_cells(spark, sf_dir), 0.1)


def line_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rec.axial_lines(spark, sf_dir)
    return _round(space.line_graph(lines, written(space.line_contacts(lines), "contacts")), "integration_hh", "choice")


def valid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rec.read(spark, sf_dir, "part").selectExpr("p_partkey AS line_id", "p_size - 3 AS connectivity", "cast(p_partkey % 9 - 2 AS double) AS integration_hh", "CASE WHEN p_partkey % 7 = 0 THEN cast('nan' AS double) ELSE cast(p_size % 5 - 1 AS double) END AS choice")
    return records.valid_lines(found)


def simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = rec.read(spark, sf_dir, "orders").selectExpr("o_custkey AS polyline", "o_orderkey AS place", "cast(o_orderkey AS double) AS x", "o_totalprice / 100 AS y")
    return space.simplify(orders, 500)


# ---- polygons and rasters --------------------------------------------------------------------------------------------


def _polygons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(polygons, corners): a slanted quadrilateral for each part."""
    part = rec.read(spark, sf_dir, "part").selectExpr("concat('m', cast(floor(p_partkey / 1024) AS string)) AS map_name", "p_partkey AS poly_id", "p_size + 0.3D AS x", "p_partkey % 50 + 0.37D AS y", "1 + p_size % 4 AS w", "1 + p_partkey % 3 AS h")
    corner = "explode(array(struct(0 AS k, x AS x, y AS y), struct(1 AS k, x + w AS x, y + 1 AS y), struct(2 AS k, x + w AS x, y + h + 1 AS y), struct(3 AS k, x AS x, y + h AS y))) AS p"
    corners = part.selectExpr("map_name", "poly_id", corner).selectExpr("map_name", "poly_id * 4 + p.k AS corner_id", "p.x", "p.y")
    return part.selectExpr("map_name", "poly_id", "transform(sequence(0, 3), k -> poly_id * 4 + k) AS corner_idx"), corners


def polygon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(frames.polygons(frames.polygon_corners(*_polygons(spark, sf_dir)), "poly_id", "place", "x", "y"), "area", "centre_x", "centre_y", digits=4)


def polygon_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = rec.read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.collect_list("l_partkey").alias("corner_idx"))
    return frames.polygon_sizes(polygons.withColumnRenamed("l_returnflag", "map_name"))


def rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = frames.polygon_corners(*_polygons(spark, sf_dir))
    shaped = corners.groupBy("map_name", "poly_id").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("p"))
    return space.rasterise(shaped.select("map_name", F.transform("p", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("corners")), 1)


def _form_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = rec.read(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand AS map_name", "p_size / 64 + 0.003D AS u", "p_partkey % 50 / 64 + 0.004D AS v")
    corners = "array(struct(u AS x, v AS y), struct(u + 0.1D AS x, v AS y), struct(u + 0.1D AS x, v + 0.07D AS y), struct(u AS x, v + 0.07D AS y)) AS corners"
    dots = rec.read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("map_name", "l_orderkey % 32 AS px", "l_suppkey % 32 AS py", "l_linenumber * 40 AS a")
    return coords.form_scores(part.selectExpr("map_name", corners), dots.groupBy("map_name", "px", "py").agg(F.max("a").alias("alpha")), 32)


def form_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_form_scores(spark, sf_dir), "hit")


def detect_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(coords.detect_form(_round(_form_scores(spark, sf_dir), "hit", digits=9)), "hit")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.world_to_px(coords.with_calibration(rec.tracks(spark, sf_dir), rec.calibrations(spark, sf_dir)))


def _in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.to_cell(_placed(spark, sf_dir), CELL, ROWS, COLS)


def world_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_in_cells(spark, sf_dir).select("id", "map_name", "px", "py", "row", "col", "inside"), "px", "py")


def in_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.in_grid(_in_cells(spark, sf_dir).select("id", "map_name", "row", "col"), rec.map_cells(spark, sf_dir))


def enriched_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = records.add_side(_in_cells(spark, sf_dir))
    found = placed.groupBy("map_name", "row", "col").agg(F.count("*").alias("occ_all"), F.count_if(F.col("side") == "CT").alias("occ_ct"))
    return coords.enrich_cells(rec.map_cells(spark, sf_dir), found)


def sample_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _in_cells(spark, sf_dir).withColumn("early", F.col("id") % 3 == 0)
    kills = rec.read(spark, sf_dir, "supplier").selectExpr("concat('n', s_nationkey) AS map_name", "s_acctbal AS x", "cast(s_suppkey * 37 % 9973 AS double) AS y")
    kills = coords.to_cell(coords.world_to_px(coords.with_calibration(kills, rec.calibrations(spark, sf_dir))), CELL, ROWS, COLS)
    return _round(grid.sample_accounting(samples, kills, rec.map_cells(spark, sf_dir)), "inside_share", "in_grid_share", "early_in_grid_share")


def crossfire_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kills = rec.tracks(spark, sf_dir).selectExpr("id", "map_name", "x", "y", "CASE WHEN id % 9 <> 0 THEN x / 2 + 100 END AS vx", "y + 300 AS vy")
    return _round(coords.midpoints(coords.with_calibration(kills, rec.calibrations(spark, sf_dir))).select("id", "map_name", "px", "py"), "px", "py")


def cell_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coords.cell_bounds(coords.with_calibration(rec.map_cells(spark, sf_dir), rec.calibrations(spark, sf_dir)), CELL)
    return out.drop("pos_x", "pos_y", "scale")


def grid_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.grid_shape(rec.map_cells(spark, sf_dir).withColumn("px_left", F.col("col") * CELL))


def px_to_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(coords.px_to_world(_placed(spark, sf_dir), "px", "py", "back_x", "back_y").select("id", "back_x", "back_y"), "back_x", "back_y", digits=4)


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.landmark_px(rec.calibrations(spark, sf_dir), 64).withColumns({c: F.col(c).cast("long") for c in ("px", "py")})


def check_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.check_landmarks(rec.calibrations(spark, sf_dir), rec.pixels(spark, sf_dir), 64)


def raster_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(coords.raster_coverage(_placed(spark, sf_dir), rec.pixels(spark, sf_dir), 64), "share")


def spawn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(coords.spawn_alignment(records.add_side(rec.tracks(spark, sf_dir)), rec.calibrations(spark, sf_dir), 64), "px", "py", "distance", digits=4)


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coords.heat(records.add_side(_placed(spark, sf_dir)).where("side is not null"), ["map_name", "side"], 64, 2)


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_heat(spark, sf_dir), "heat")


def heat_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(_heat(spark, sf_dir), "heat")
    return _round(coords.heat_difference(found.where("side = 'CT'"), found.where("side = 'T'"), ["map_name"]), "difference")


# ---- SQL -------------------------------------------------------------------------------------------------------------

_CHOICE = """ch AS (SELECT a.map_name, a.r2 AS r, a.c2 AS c, sum(a.p * b.p / t.p) / 2 AS choice FROM hop a JOIN hop b ON a.map_name = b.map_name AND a.r2 = b.r AND a.c2 = b.c
JOIN hop t ON t.map_name = a.map_name AND t.r = a.r AND t.c = a.c AND t.r2 = b.r2 AND t.c2 = b.c2 WHERE a.d > 0 AND b.d > 0 AND t.d = a.d + b.d GROUP BY a.map_name, a.r2, a.c2)"""
_METRIC = """len AS (SELECT *, 16 * sqrt((r2 - r) ** 2 + (c2 - c) ** 2) AS l FROM edges),
met(map_name, r, c, r2, c2, d) USING KEY (map_name, r, c, r2, c2) AS (SELECT map_name, r, c, r, c, 0::DOUBLE FROM w
UNION SELECT h.map_name, h.r, h.c, e.r2, e.c2, min(h.d + e.l) FROM met h JOIN len e ON h.map_name = e.map_name AND h.r2 = e.r AND h.c2 = e.c
LEFT JOIN recurring.met k ON k.map_name = h.map_name AND k.r = h.r AND k.c = h.c AND k.r2 = e.r2 AND k.c2 = e.c2 WHERE k.d IS NULL OR k.d > h.d + e.l + 1e-9 GROUP BY h.map_name, h.r, h.c, e.r2, e.c2)"""
_ISLANDS = f"""{_CELLS}, comp(map_name, r, c, island) USING KEY (map_name, r, c) AS (SELECT map_name, r, c, r * 1048576 + c FROM w
UNION SELECT n.map_name, n.r, n.c, min(h.island) FROM comp h JOIN w n ON n.map_name = h.map_name AND abs(n.r - h.r) + abs(n.c - h.c) = 1
JOIN recurring.comp k ON k.map_name = n.map_name AND k.r = n.r AND k.c = n.c WHERE k.island > h.island GROUP BY n.map_name, n.r, n.c)"""
_LINES = """ln AS (SELECT 'm' || CAST(CAST(floor(p_partkey / 64) AS BIGINT) AS VARCHAR) AS map_name, p_partkey AS id, p_size::DOUBLE AS x1, (p_partkey % 100)::DOUBLE AS y1, (p_size * 3 % 50)::DOUBLE AS x2, (p_partkey * 7 % 100)::DOUBLE AS y2 FROM part),
meet AS (SELECT a.map_name, a.id AS p, b.id AS q FROM ln a JOIN ln b ON a.map_name = b.map_name AND a.id <> b.id
WHERE least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
AND sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) <= 0
AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) <= 0),
edges AS (SELECT map_name, p AS r, 0::BIGINT AS c, q AS r2, 0::BIGINT AS c2 FROM meet), w AS (SELECT DISTINCT map_name, r, c FROM edges)"""
_CAL = """cal AS (SELECT 'n' || n_nationkey AS map_name, n_nationkey, n_nationkey * -10.0::DOUBLE AS pos_x, 9000.0::DOUBLE + n_nationkey AS pos_y, 150.0::DOUBLE * (1 + n_nationkey % 2) AS scale FROM nation)"""
_TRACKS = f"""{_CAL}, tr AS (SELECT c_custkey AS id, 'n' || c_nationkey AS map_name, c_acctbal AS x, (c_custkey * 37 % 9973)::DOUBLE AS y, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'T' WHEN 'MACHINERY' THEN 'CT' WHEN 'FURNITURE' THEN 'CT' END AS side FROM customer),
pl AS (SELECT tr.*, (x - pos_x) / scale AS px, (pos_y - y) / scale AS py FROM tr JOIN cal USING (map_name)),
ce AS (SELECT *, CAST(floor(py / 4) AS BIGINT) AS "row", CAST(floor(px / 4) AS BIGINT) AS col, coalesce(floor(py / 4) BETWEEN 0 AND 15 AND floor(px / 4) BETWEEN 0 AND 15, false) AS inside FROM pl)"""
_WALK = """mc AS (SELECT DISTINCT 'n' || l_suppkey % 25 AS map_name, l_partkey % 16 AS "row", CAST(floor(l_quantity / 5) AS BIGINT) AS col FROM lineitem)"""
_PIXELS = "dot AS (SELECT 'n' || l_suppkey % 25 AS map_name, l_orderkey % 64 AS px, l_partkey % 64 AS py, min(l_linenumber % 4 * 60) AS alpha FROM lineitem GROUP BY ALL)"
_MARKS = f"""{_CAL}, lm AS (SELECT map_name, 'CTSpawn' AS landmark, n_nationkey / 25.0::DOUBLE AS u, (n_nationkey % 7) / 7.0::DOUBLE AS v FROM cal UNION ALL SELECT map_name, 'TSpawn', (n_nationkey % 5) / 5.0::DOUBLE, (n_nationkey % 3) / 2.0::DOUBLE FROM cal
UNION ALL SELECT map_name, 'bombA', (n_nationkey % 4) / 4.0::DOUBLE, CASE WHEN n_nationkey % 11 <> 0 THEN 0.5::DOUBLE END FROM cal UNION ALL SELECT map_name, 'bombB', 0.25, 0.75 FROM cal),
lp AS (SELECT map_name, landmark, least(CAST(floor(u * 64) AS BIGINT), 63) AS px, CASE WHEN v IS NOT NULL THEN least(CAST(floor(v * 64) AS BIGINT), 63) END AS py FROM lm)"""
_QUADS = "q AS (SELECT 'm' || CAST(CAST(floor(p_partkey / 1024) AS BIGINT) AS VARCHAR) AS map_name, p_partkey AS poly_id, p_size + 0.3::DOUBLE AS x, p_partkey % 50 + 0.37::DOUBLE AS y, 1 + p_size % 4 AS w, 1 + p_partkey % 3 AS h FROM part)"
_FORMS = """b AS (SELECT p_partkey, p_brand AS map_name, p_size / 64::DOUBLE + 0.003::DOUBLE AS u, p_partkey % 50 / 64::DOUBLE + 0.004::DOUBLE AS v FROM part),
d AS (SELECT map_name, l_orderkey % 32 AS px, l_suppkey % 32 AS py, max(l_linenumber * 40) AS alpha FROM lineitem JOIN b ON l_partkey = p_partkey GROUP BY ALL),
f AS (SELECT map_name, 'uv' AS form, u AS a0, u + 0.1 AS a1, v AS b0, v + 0.07 AS b1 FROM b UNION ALL SELECT map_name, '1-uv', 1 - u - 0.1, 1 - u, v, v + 0.07 FROM b
UNION ALL SELECT map_name, 'u1-v', u, u + 0.1, 1 - v - 0.07, 1 - v FROM b UNION ALL SELECT map_name, '1-u1-v', 1 - u - 0.1, 1 - u, 1 - v - 0.07, 1 - v FROM b
UNION ALL SELECT map_name, 'vu', v, v + 0.07, u, u + 0.1 FROM b UNION ALL SELECT map_name, '1-vu', 1 - v - 0.07, 1 - v, u, u + 0.1 FROM b
UNION ALL SELECT map_name, 'v1-u', v, v + 0.07, 1 - u - 0.1, 1 - u FROM b UNION ALL SELECT map_name, '1-v1-u', 1 - v - 0.07, 1 - v, 1 - u - 0.1, 1 - u FROM b),
g AS (SELECT DISTINCT map_name, form, px, py FROM f, (SELECT unnest(range(-4, 36)) AS px), (SELECT unnest(range(-4, 36)) AS py) WHERE px + 0.5 > a0 * 32 AND px + 0.5 < a1 * 32 AND py + 0.5 > b0 * 32 AND py + 0.5 < b1 * 32),
sc AS (SELECT map_name, form, avg(CASE WHEN alpha > 128 THEN 1.0 ELSE 0.0 END) AS hit FROM g LEFT JOIN d USING (map_name, px, py) GROUP BY map_name, form)"""
_HEAT = f"""{_TRACKS}, cnt AS (SELECT map_name, side, CAST(floor(px) AS BIGINT) AS px, CAST(floor(py) AS BIGINT) AS py, count(*) AS n FROM pl WHERE side IS NOT NULL AND px >= 0 AND px < 64 AND py >= 0 AND py < 64 GROUP BY ALL),
raw AS (SELECT k, exp(-0.5 * (k / 2.0) ** 2) AS g FROM (SELECT unnest(range(-8, 9)) AS k)),
ker AS (SELECT t, CASE WHEN t + k < 0 THEN -1 - t - k WHEN t + k > 63 THEN 127 - t - k ELSE t + k END AS s, sum(g / (SELECT sum(g) FROM raw)) AS w FROM raw, (SELECT unnest(range(64)) AS t) GROUP BY ALL),
along AS (SELECT map_name, side, px, t AS py, sum(n * w) AS n FROM cnt JOIN ker ON s = py GROUP BY map_name, side, px, t),
sm AS (SELECT map_name, side, t AS px, py, sum(n * w) AS n FROM along JOIN ker ON s = px GROUP BY map_name, side, t, py),
he AS (SELECT map_name, side, px, py, n / max(n) OVER (PARTITION BY map_name, side) AS heat FROM sm QUALIFY n / max(n) OVER (PARTITION BY map_name, side) >= 0.05)"""

ORACLES = {
    "hop_distance": f"WITH RECURSIVE {_SEEN}, {_HOPS} SELECT map_name, r, c, r2, c2, d FROM hop WHERE d > 0",
    "metric_distance": f"WITH RECURSIVE {_SEEN}, {_METRIC} SELECT map_name, r, c, r2, c2, round(d, 6) AS d FROM met WHERE d > 0",
    "choice": f"WITH RECURSIVE {_SEEN}, {_HOPS}, {_CHOICE} SELECT map_name, r, c, round(coalesce(choice, 0), 6) AS choice FROM (SELECT DISTINCT map_name, r, c FROM edges) LEFT JOIN ch USING (map_name, r, c)",
    "syntax_grid": f"""WITH RECURSIVE {_SEEN}, {_HOPS}, {_METRIC}, {_CHOICE}, {integration_sql("hop")}, {integration_sql("met", "im")}, deg AS (SELECT map_name, r, c, count(*) AS k FROM edges GROUP BY ALL),
mcal AS (SELECT 'm' || k AS map_name, k * -100.5::DOUBLE AS pos_x, 3000.25::DOUBLE + k AS pos_y, 4.5::DOUBLE + k % 3 AS scale FROM (SELECT DISTINCT CAST(floor(p_partkey / 1024) AS BIGINT) AS k FROM part)),
vis AS (SELECT map_name, r, c, r2, c2 FROM edges UNION SELECT map_name, r, c, r, c FROM w), b AS (SELECT map_name, r, c, r2 - i AS r2, c2 - j AS c2 FROM vis, (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) AS d(i, j)),
per AS (SELECT map_name, r, c, count(*) AS k FROM b WHERE NOT EXISTS (SELECT 1 FROM vis s WHERE s.map_name = b.map_name AND s.r = b.r AND s.c = b.c AND s.r2 = b.r2 AND s.c2 = b.c2) GROUP BY map_name, r, c)
SELECT w.map_name, w.c AS col, w.r AS "row", w.c * 16 AS px_left, w.r * 16 AS px_top, (w.c + 1) * 16 AS px_right, (w.r + 1) * 16 AS px_bottom,
round(pos_x + w.c * 16 * scale, 1) AS world_x_min, round(pos_x + (w.c + 1) * 16 * scale, 1) AS world_x_max, round(pos_y - (w.r + 1) * 16 * scale, 1) AS world_y_min, round(pos_y - w.r * 16 * scale, 1) AS world_y_max, 1 AS walkable,
coalesce(deg.k, 0) AS connectivity, round(coalesce(deg.k, 0) * 256.0, 1)::DOUBLE AS isovist_area_px, round(coalesce(per.k, 0), 1)::DOUBLE AS isovist_perimeter, round(integ.v, 4) AS integration_hh_t, round(im.v, 4) AS integration_hh_m, round(coalesce(ch.choice, 0), 4) AS choice_t
FROM w JOIN mcal USING (map_name) LEFT JOIN deg USING (map_name, r, c) LEFT JOIN per USING (map_name, r, c) JOIN integ USING (map_name, r, c) JOIN im USING (map_name, r, c) LEFT JOIN ch USING (map_name, r, c)""",
    "choice_sampled": f"""WITH RECURSIVE {_SEEN}, {_HOPS}, src AS (SELECT map_name, r, c FROM w QUALIFY row_number() OVER (PARTITION BY map_name ORDER BY md5('s|' || map_name || '|' || r || '|' || c)) <= 40),
dep AS (SELECT a.map_name, a.r AS sr, a.c AS sc, a.r2 AS r, a.c2 AS c, sum(a.p * b.p / t.p) AS dep FROM hop a SEMI JOIN src ON src.map_name = a.map_name AND src.r = a.r AND src.c = a.c JOIN hop b ON a.map_name = b.map_name AND a.r2 = b.r AND a.c2 = b.c
JOIN hop t ON t.map_name = a.map_name AND t.r = a.r AND t.c = a.c AND t.r2 = b.r2 AND t.c2 = b.c2 WHERE a.d > 0 AND b.d > 0 AND t.d = a.d + b.d GROUP BY ALL),
tot AS (SELECT map_name, r, c, sum(dep) AS s, sum(dep * dep) AS q FROM dep GROUP BY ALL), nk AS (SELECT map_name, count(*) AS n, least(count(*), 40) AS k FROM w GROUP BY map_name)
SELECT map_name, r, c, round(coalesce(s, 0) * n / k / 2, 6) AS choice, round(n * sqrt((1 - k / n) * greatest((coalesce(q, 0) - coalesce(s, 0) * coalesce(s, 0) / k) / (k - 1), 0) / k) / 2, 4) AS standard_error FROM w JOIN nk USING (map_name) LEFT JOIN tot USING (map_name, r, c)""",
    "components": f"WITH RECURSIVE {_ISLANDS} SELECT map_name, r, c, island FROM comp",
    "large_islands": f"""WITH RECURSIVE {_ISLANDS}, z AS (SELECT map_name, island, count(*) AS k FROM comp GROUP BY ALL), t AS (SELECT map_name, count(*) AS n FROM w GROUP BY map_name)
SELECT map_name, r, c FROM comp JOIN z USING (map_name, island) JOIN t USING (map_name) WHERE k >= n * 0.1""",
    "line_graph": f"""WITH RECURSIVE {_LINES}, {_HOPS}, {_CHOICE}, {integration_sql("hop")}, deg AS (SELECT map_name, r, count(*) AS k FROM edges GROUP BY ALL)
SELECT ln.map_name, ln.id AS line_id, coalesce(deg.k, -1) AS connectivity, round(coalesce(integ.v, -1), 6) AS integration_hh, round(CASE WHEN deg.k IS NULL THEN -1 ELSE coalesce(ch.choice, 0) END, 6) AS choice
FROM ln LEFT JOIN deg ON deg.map_name = ln.map_name AND deg.r = ln.id LEFT JOIN integ ON integ.map_name = ln.map_name AND integ.r = ln.id LEFT JOIN ch ON ch.map_name = ln.map_name AND ch.r = ln.id""",
    "simplify": """WITH RECURSIVE pt AS (SELECT o_custkey AS polyline, o_orderkey AS place, o_orderkey::DOUBLE AS x, o_totalprice / 100 AS y FROM orders),
seg AS (SELECT polyline, min(place) AS a, max(place) AS b, NULL::BIGINT AS k FROM pt GROUP BY polyline
UNION ALL SELECT polyline, CASE WHEN side = 0 THEN a ELSE k END, CASE WHEN side = 0 THEN k ELSE b END, CASE WHEN side = 0 THEN k END FROM (
SELECT s.polyline, s.a, s.b, arg_max(p.place, (d, -p.place)) AS k FROM (SELECT seg.polyline, seg.a, seg.b, p.place, CASE WHEN l > 0 THEN abs(dx * (p.y - pa.y) - dy * (p.x - pa.x)) / l ELSE abs(dx * (p.y - pa.y) - dy * (p.x - pa.x)) END AS d
 FROM seg JOIN pt pa ON pa.polyline = seg.polyline AND pa.place = seg.a JOIN pt pb ON pb.polyline = seg.polyline AND pb.place = seg.b JOIN pt p ON p.polyline = seg.polyline AND p.place > seg.a AND p.place < seg.b,
 LATERAL (SELECT pb.x - pa.x AS dx, pb.y - pa.y AS dy), LATERAL (SELECT sqrt(dx * dx + dy * dy) AS l)) s(polyline, a, b, place, d) JOIN pt p USING (polyline, place) GROUP BY s.polyline, s.a, s.b HAVING max(d) > 500), (VALUES (0), (1)) v(side)),
ends AS (SELECT polyline, min(place) AS place FROM pt GROUP BY polyline UNION SELECT polyline, max(place) FROM pt GROUP BY polyline UNION SELECT polyline, k FROM seg WHERE k IS NOT NULL)
SELECT polyline, place, x, y FROM ends JOIN pt USING (polyline, place)""",
    "valid_lines": """WITH l AS (SELECT p_partkey AS line_id, p_size - 3 AS connectivity, (p_partkey % 9 - 2)::DOUBLE AS integration_hh, CASE WHEN p_partkey % 7 = 0 THEN 'nan'::DOUBLE ELSE (p_size % 5 - 1)::DOUBLE END AS choice FROM part)
SELECT * FROM l WHERE connectivity > 0 AND integration_hh > 0 AND choice >= 0 AND NOT isnan(choice)""",
    "polygon_stats": f"""WITH {_QUADS}, c AS (SELECT poly_id, 0 AS k, x, y FROM q UNION ALL SELECT poly_id, 1, x + w, y + 1 FROM q UNION ALL SELECT poly_id, 2, x + w, y + h + 1 FROM q UNION ALL SELECT poly_id, 3, x, y + h FROM q)
SELECT a.poly_id, count(*) AS corners, round(abs(sum(a.x * b.y - a.y * b.x)) / 2, 4) AS area, round(avg(a.x), 4) AS centre_x, round(avg(a.y), 4) AS centre_y FROM c a JOIN c b ON a.poly_id = b.poly_id AND b.k = (a.k + 1) % 4 GROUP BY a.poly_id""",
    "polygon_sizes": "SELECT l_returnflag AS map_name, corners, count(*) AS polygons FROM (SELECT l_returnflag, l_orderkey, count(*) AS corners FROM lineitem GROUP BY ALL) GROUP BY ALL",
    "rasterise": f"""WITH {_QUADS}, g AS (SELECT *, CAST(floor(x) AS BIGINT) + i AS c, CAST(floor(y) AS BIGINT) + j AS r FROM q, (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(range(0, 6)) AS j))
SELECT DISTINCT map_name, r, c FROM g WHERE c + 0.5 > x AND c + 0.5 < x + w AND r + 0.5 > y + (c + 0.5 - x) / w AND r + 0.5 < y + h + (c + 0.5 - x) / w""",
    "form_score": f"WITH {_FORMS} SELECT map_name, form, round(hit, 6) AS hit FROM sc",
    "detect_form": f"WITH {_FORMS} SELECT map_name, form, round(hit, 6) AS hit, hit < 0.85 AS poor FROM sc QUALIFY row_number() OVER (PARTITION BY map_name ORDER BY round(hit, 9) DESC, form DESC) = 1",
    "world_to_cell": f'WITH {_TRACKS} SELECT id, map_name, round(px, 6) AS px, round(py, 6) AS py, "row", col, inside FROM ce',
    "in_grid": f'WITH {_TRACKS}, {_WALK} SELECT id, map_name, "row", col FROM ce SEMI JOIN mc USING (map_name, "row", col)',
    "enriched_cells": f"""WITH {_TRACKS}, {_WALK}, o AS (SELECT map_name, "row", col, count(*) AS occ_all, count(*) FILTER (side = 'CT') AS occ_ct FROM ce GROUP BY ALL)
SELECT map_name, "row", col, coalesce(occ_all, 0) AS occ_all, coalesce(occ_ct, 0) AS occ_ct FROM mc LEFT JOIN o USING (map_name, "row", col)""",
    "sample_accounting": f"""WITH {_TRACKS}, {_WALK}, x AS (SELECT ce.*, id % 3 = 0 AS early, mc.map_name IS NOT NULL AS found FROM ce LEFT JOIN mc USING (map_name, "row", col)),
s AS (SELECT map_name, count(*) AS samples, count(*) FILTER (inside) / count(*) AS inside_share, count(*) FILTER (found) / count(*) AS in_grid_share, count(*) FILTER (early) AS early, count(*) FILTER (early AND found) / nullif(count(*) FILTER (early), 0) AS early_in_grid_share FROM x GROUP BY map_name),
k AS (SELECT 'n' || s_nationkey AS map_name, CAST(floor((9000 + s_nationkey - s_suppkey * 37 % 9973) / (150.0 * (1 + s_nationkey % 2)) / 4) AS BIGINT) AS "row", CAST(floor((s_acctbal + s_nationkey * 10) / (150.0 * (1 + s_nationkey % 2)) / 4) AS BIGINT) AS col FROM supplier),
kk AS (SELECT k.map_name, count(*) AS kills, count(mc.map_name) AS kills_in_grid FROM k LEFT JOIN mc ON mc.map_name = k.map_name AND mc."row" = k."row" AND mc.col = k.col GROUP BY k.map_name), m AS (SELECT map_name, count(*) AS cells FROM mc GROUP BY map_name)
SELECT map_name, samples, round(inside_share, 6) AS inside_share, round(in_grid_share, 6) AS in_grid_share, early, round(early_in_grid_share, 6) AS early_in_grid_share, coalesce(kills, 0) AS kills, coalesce(kills_in_grid, 0) AS kills_in_grid, coalesce(cells, 0) AS cells
FROM s LEFT JOIN kk USING (map_name) LEFT JOIN m USING (map_name)""",
    "crossfire_points": f"""WITH {_TRACKS} SELECT id, map_name, round(((x - pos_x) / scale + ((CASE WHEN id % 9 <> 0 THEN x / 2 + 100 END) - pos_x) / scale) / 2, 6) AS px, round(((pos_y - y) / scale + (pos_y - (y + 300)) / scale) / 2, 6) AS py FROM tr JOIN cal USING (map_name)""",
    "cell_bounds": f"""WITH {_CAL}, {_WALK} SELECT map_name, "row", col, col * 4 AS px_left, "row" * 4 AS px_top, (col + 1) * 4 AS px_right, ("row" + 1) * 4 AS px_bottom, round(pos_x + col * 4 * scale, 1) AS world_x_min, round(pos_x + (col + 1) * 4 * scale, 1) AS world_x_max,
round(pos_y - ("row" + 1) * 4 * scale, 1) AS world_y_min, round(pos_y - "row" * 4 * scale, 1) AS world_y_max FROM mc JOIN cal USING (map_name)""",
    "grid_shape": f"""WITH {_WALK}, d AS (SELECT DISTINCT map_name, col * 4 AS p FROM mc), s AS (SELECT map_name, p, row_number() OVER (PARTITION BY map_name ORDER BY p) AS k FROM d), t AS (SELECT map_name, max("row") + 1 AS "rows", max(col) + 1 AS cols FROM mc GROUP BY map_name)
SELECT map_name, (SELECT max(p) - min(p) FROM s WHERE s.map_name = t.map_name AND k <= 2) AS cell_px, "rows", cols FROM t""",
    "px_to_world": f"WITH {_TRACKS} SELECT id, round(x, 4) AS back_x, round(y, 4) AS back_y FROM pl",
    "landmarks": f"WITH {_MARKS} SELECT * FROM lp",
    "check_landmarks": f"WITH {_MARKS}, {_PIXELS} SELECT map_name, bool_and(coalesce(alpha > 0, false)) AS ok FROM lp LEFT JOIN dot USING (map_name, px, py) GROUP BY map_name",
    "raster_coverage": f"""WITH {_TRACKS}, {_PIXELS}, a AS (SELECT map_name, greatest(least(CAST(floor(px) AS BIGINT), 63), 0) AS px, greatest(least(CAST(floor(py) AS BIGINT), 63), 0) AS py FROM pl)
SELECT map_name, count(*) AS points, round(avg(CASE WHEN alpha > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM a LEFT JOIN dot USING (map_name, px, py) GROUP BY map_name""",
    "spawn_alignment": f"""WITH {_MARKS}, tr AS (SELECT 'n' || c_nationkey AS map_name, c_acctbal AS x, (c_custkey * 37 % 9973)::DOUBLE AS y, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'T' ELSE 'CT' END AS side FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY', 'FURNITURE')),
m AS (SELECT map_name, side, (avg(x) - any_value(pos_x)) / any_value(scale) AS px, (any_value(pos_y) - avg(y)) / any_value(scale) AS py FROM tr JOIN cal USING (map_name) GROUP BY map_name, side)
SELECT m.map_name, side, round(m.px, 4) AS px, round(m.py, 4) AS py, round(sqrt((m.px - lp.px) ** 2 + (m.py - lp.py) ** 2), 4) AS distance FROM m JOIN lp ON lp.map_name = m.map_name AND landmark = side || 'Spawn'""",
    "heat": f"WITH {_HEAT} SELECT map_name, side, px, py, round(heat, 6) AS heat FROM he",
    "heat_difference": f"""WITH {_HEAT}, a AS (SELECT * FROM he WHERE side = 'CT'), b AS (SELECT * FROM he WHERE side = 'T'),
d AS (SELECT map_name, px, py, coalesce(a.heat, 0) - coalesce(b.heat, 0) AS difference FROM a FULL JOIN b USING (map_name, px, py))
SELECT map_name, px, py, round(difference, 6) AS difference FROM d QUALIFY abs(difference) >= max(abs(difference)) OVER (PARTITION BY map_name) * 0.1""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
