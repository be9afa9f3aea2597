"""Queries on frames, polygons and comparisons, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.operators import frames, space
from groundplan.plans.driver_queries import _SEEN, _round
from groundplan.sources import recordings as rec

FLAGS = ["A", "N", "R"]
METRICS = ["lines", "quantity", "price"]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS brand", "cast(p_size AS double) / 64 AS u", "cast(p_retailprice AS double) / 3000 AS v")


def axis_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = frames.from_frame(1024)
    out = frames.to_frame(_points(spark, sf_dir).select("id", "u", "v"), "u", "v", 1024)
    return _round(out.select("id", "form", "px", "py", u.alias("back_u"), v.alias("back_v")), "px", "py", "back_u", "back_v")


def best_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = frames.to_frame(_points(spark, sf_dir), "u", "v", 1024)
    return _round(frames.best_form(framed, (F.col("px") < 512) & (F.col("py") > 256), ["brand"]), "hit")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = rec.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS polygon", "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS place", "cast(l_quantity AS double) AS x", "cast(l_discount AS double) * 100 AS y")
    return _round(frames.polygons(corners, "polygon", "place", "x", "y"), "area", "centre_x", "centre_y", digits=4)


def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(frames.configuration(_points(spark, sf_dir), "u", "v", "id", ["brand"]), "low", "high", "ratio")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = rec.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").cast("double").alias("lines"), F.avg(F.col("l_quantity").cast("double")).alias("quantity"), F.avg(F.col("l_extendedprice").cast("double")).alias("price"))
    return frames.transposed(sizes, "flag", FLAGS, METRICS)


def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_sizes(spark, sf_dir), *FLAGS, digits=4)


def map_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(frames.map_ratio(_sizes(spark, sf_dir), "A", "R"), "ratio")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = rec.read(spark, sf_dir, "orders")
    side = lambda status, origin: orders.where(F.col("o_orderstatus") == status).select("o_custkey").distinct().withColumn("origin", F.lit(origin))
    return frames.manifest(side("F", "old"), side("O", "new"), "o_custkey")


def maps_with_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, used = rec.read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), rec.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return nations.join(used, "n_nationkey", "left_semi")


def isovist_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.isovist_perimeter(space.visibility_blocks(rec.walkable_cells(spark, sf_dir)))


_POINTS = "p AS (SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS DOUBLE) / 64 AS u, CAST(p_retailprice AS DOUBLE) / 3000 AS v FROM part)"
_FRAMED = f"""{_POINTS}, f AS (SELECT id, brand, u, v, 'uv' AS form, u AS a, v AS b FROM p UNION ALL SELECT id, brand, u, v, '1-uv', 1 - u, v FROM p UNION ALL SELECT id, brand, u, v, 'u1-v', u, 1 - v FROM p
UNION ALL SELECT id, brand, u, v, '1-u1-v', 1 - u, 1 - v FROM p UNION ALL SELECT id, brand, u, v, 'vu', v, u FROM p UNION ALL SELECT id, brand, u, v, '1-vu', 1 - v, u FROM p
UNION ALL SELECT id, brand, u, v, 'v1-u', v, 1 - u FROM p UNION ALL SELECT id, brand, u, v, '1-v1-u', 1 - v, 1 - u FROM p)"""
_SIZES = """s AS (SELECT l_returnflag AS flag, CAST(count(*) AS DOUBLE) AS lines, avg(CAST(l_quantity AS DOUBLE)) AS quantity, avg(CAST(l_extendedprice AS DOUBLE)) AS price FROM lineitem GROUP BY l_returnflag),
m AS (SELECT flag, 'lines' AS metric, lines AS v FROM s UNION ALL SELECT flag, 'quantity', quantity FROM s UNION ALL SELECT flag, 'price', price FROM s),
t AS (SELECT metric, max(v) FILTER (flag = 'A') AS A, max(v) FILTER (flag = 'N') AS N, max(v) FILTER (flag = 'R') AS R FROM m GROUP BY metric)"""

ORACLES = {
    "axis_forms": f"WITH {_FRAMED} SELECT id, form, round(a * 1024, 6) AS px, round(b * 1024, 6) AS py, round(u, 6) AS back_u, round(v, 6) AS back_v FROM f",
    "best_form": f"""WITH {_FRAMED}, h AS (SELECT brand, form, avg(CASE WHEN a < 0.5 AND b > 0.25 THEN 1.0 ELSE 0.0 END) AS hit FROM f GROUP BY brand, form)
SELECT brand, form, round(hit, 6) AS hit FROM h QUALIFY row_number() OVER (PARTITION BY brand ORDER BY hit DESC, form DESC) = 1""",
    "polygons": """WITH p AS (SELECT l_orderkey AS polygon, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) * 100 AS y,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT a.polygon, count(*) AS corners, round(abs(sum(a.x * b.y - a.y * b.x)) / 2, 4) AS area, round(avg(a.x), 4) AS centre_x, round(avg(a.y), 4) AS centre_y FROM p a JOIN p b ON a.polygon = b.polygon AND b.place = a.place % a.n + 1 GROUP BY a.polygon""",
    "configuration": f"""WITH {_POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY u, id) AS place, count(*) OVER (PARTITION BY brand) AS n FROM p),
m AS (SELECT brand, count(*) AS n, avg(v) FILTER (place <= greatest(n // 5, 1)) AS low, avg(v) FILTER (place > n - greatest(n // 5, 1)) AS high FROM k GROUP BY brand)
SELECT brand, n, round(low, 6) AS low, round(high, 6) AS high, round(high / nullif(low, 0), 6) AS ratio FROM m""",
    "transposed": f"WITH {_SIZES} SELECT metric, round(A, 4) AS A, round(N, 4) AS N, round(R, 4) AS R FROM t",
    "map_ratio": f"WITH {_SIZES} SELECT metric, round(A / nullif(R, 0), 6) AS ratio FROM t",
    "manifest": """WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, 'old' AS origin FROM o UNION ALL SELECT o_custkey, 'new' FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM o)""",
    "maps_with_behaviour": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
    "isovist_perimeter": f"""WITH {_SEEN}, vis AS (SELECT map_name, r, c, r2, c2 FROM edges UNION SELECT map_name, r, c, r, c FROM w),
b AS (SELECT map_name, r, c, r2 - i AS r2, c2 - j AS c2 FROM vis, (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) AS d(i, j))
SELECT map_name, r, c, count(*) AS perimeter FROM b WHERE NOT EXISTS (SELECT 1 FROM vis s WHERE s.map_name = b.map_name AND s.r = b.r AND s.c = b.c AND s.r2 = b.r2 AND s.c2 = b.c2) GROUP BY map_name, r, c""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
