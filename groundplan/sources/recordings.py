"""Recordings, cells and lines read from the given tables: what the operators take as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of the clock of ticks (one per minute), in microseconds.
CLOCK = 1704067200000000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def game_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 5).alias("demo"),
        (F.col("user_id") % 5 % 2).alias("map_id"),
        (F.floor(F.col("user_id") / 5) % 4).alias("player"),
        "event_type",
        F.floor((micros - CLOCK) / 60000000).alias("tick"),
        F.get_json_object("props", "$.k").try_cast("double").alias("x"),
        F.col("value").alias("y"),
    )


def starts(ev: DataFrame) -> DataFrame:
    return ev.where("event_type = 'signup'").select("demo", "tick", "event_id")


def ends(ev: DataFrame) -> DataFrame:
    return ev.where("event_type = 'error'").select("demo", "tick")


def freezes(ev: DataFrame) -> DataFrame:
    return ev.where("event_type = 'purchase'").select("demo", "tick")


def samples(ev: DataFrame) -> DataFrame:
    team = F.when(F.col("event_type") == "click", 2).otherwise(3)
    return ev.where("event_type IN ('click', 'view')").withColumn("team_num", team).drop("event_type")


def kills(ev: DataFrame) -> DataFrame:
    """Attackers at (x, y), victims at (vx, vy)."""
    return ev.where("event_type = 'purchase'").selectExpr("event_id", "demo", "map_id", "tick", "x", "y", "(x * 7 + 13) % 100 AS vx", "y / 2 AS vy", "cast(2 + event_id % 3 AS int) AS team_num")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with kills, as the walkable ones of the maps of events: (map_name, row, col)."""
    at = kills(game_events(spark, sf_dir)).selectExpr("cast(map_id AS string) AS map_name", "floor(y / 20) AS row", "floor(x / 10) AS col")
    return at.where("row is not null and col is not null").distinct()


def walkable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 16 x 16 maps with walls, 1024 parts a map, so the number of maps grows with the table."""
    part = read(spark, sf_dir, "part").selectExpr("concat('m', cast(floor(p_partkey / 1024) AS string)) AS map_name", "cast(p_size % 16 AS bigint) AS r", "cast(p_partkey % 16 AS bigint) AS c")
    return part.where("NOT (r % 6 = 3 AND c % 8 NOT IN (1, 5))").distinct()


def walkable_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each map of walkable_cells."""
    maps = read(spark, sf_dir, "part").selectExpr("cast(floor(p_partkey / 1024) AS bigint) AS k").distinct()
    return maps.selectExpr("concat('m', cast(k AS string)) AS map_name", "k * -100.5D AS pos_x", "3000.25D + k AS pos_y", "4.5D + k % 3 AS scale")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct lines that parts draw on two maps."""
    keys = read(spark, sf_dir, "part").selectExpr("cast(p_size AS bigint) AS s", "cast(p_partkey % 100 AS bigint) AS k").distinct()
    return keys.selectExpr("k % 2 AS map_id", "s * 100 + k AS line_id", "cast(s AS double) AS x1", "cast(k AS double) AS y1", "cast(s * 3 % 50 AS double) AS x2", "cast(k * 7 % 100 AS double) AS y2")


def axial_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each part, 64 a map."""
    return read(spark, sf_dir, "part").selectExpr("concat('m', cast(floor(p_partkey / 64) AS string)) AS map_name", "p_partkey AS line_id", "cast(p_size AS double) AS x1", "cast(p_partkey % 100 AS double) AS y1", "cast(p_size * 3 % 50 AS double) AS x2", "cast(p_partkey * 7 % 100 AS double) AS y2")


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr(
        "concat('n', n_nationkey) AS map_name", "n_nationkey * -10.0D AS pos_x", "9000.0D + n_nationkey AS pos_y", "150.0D * (1 + n_nationkey % 2) AS scale",
        "n_nationkey / 25.0D AS CTSpawn_x", "n_nationkey % 7 / 7.0D AS CTSpawn_y", "n_nationkey % 5 / 5.0D AS TSpawn_x", "n_nationkey % 3 / 2.0D AS TSpawn_y",
        "n_nationkey % 4 / 4.0D AS bombA_x", "CASE WHEN n_nationkey % 11 <> 0 THEN 0.5D END AS bombA_y", "0.25D AS bombB_x", "0.75D AS bombB_y",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of customers on the maps of their nations."""
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "concat('n', c_nationkey) AS map_name", "c_acctbal AS x", "cast(c_custkey * 37 % 9973 AS double) AS y", "cast(c_custkey % 5 AS int) AS health",
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 3 WHEN 'FURNITURE' THEN 3 ELSE 1 END AS team_num",
    )


def map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walkable cells of 4 pixels on the maps of nations."""
    return read(spark, sf_dir, "lineitem").selectExpr("concat('n', l_suppkey % 25) AS map_name", "l_partkey % 16 AS row", "cast(floor(l_quantity / 5) AS bigint) AS col").distinct()


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 64 x 64 pixels on the maps of nations."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("concat('n', l_suppkey % 25) AS map_name", "cast(l_orderkey % 64 AS int) AS px", "cast(l_partkey % 64 AS int) AS py", "l_linenumber % 4 * 60 AS a")
    return rows.groupBy("map_name", "px", "py").agg(F.min("a").alias("alpha"))
