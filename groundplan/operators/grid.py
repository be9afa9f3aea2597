"""Counts per grid cell: occupancy, kills, moves, flow, visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["map_id", "row", "col"]


def side(team: str = "team_num") -> Column:
    return F.when(F.col(team) == 2, "T").when(F.col(team) == 3, "CT")


def with_cell(df: DataFrame, width: float = 10, height: float = 20) -> DataFrame:
    return df.withColumns({"row": F.floor(F.col("y") / height), "col": F.floor(F.col("x") / width)})


def occupancy(samples: DataFrame, window: float = 120) -> DataFrame:
    early = F.col("seconds_after_freeze").between(0, window)
    counts = [F.count("*").alias("occ_all"), F.count_if(side() == "CT").alias("occ_ct"), F.count_if(side() == "T").alias("occ_t"), F.count_if(early).alias("occ_early")]
    return samples.groupBy(*CELL).agg(*counts)


def kills_grid(kills: DataFrame) -> DataFrame:
    return kills.groupBy(*CELL).agg(F.count("*").alias("kills"), F.count_if(side() == "CT").alias("kills_ct"), F.count_if(side() == "T").alias("kills_t"))


def steps(samples: DataFrame, max_gap: int = 480) -> DataFrame:
    """Pairs of consecutive samples of a player in a round, in different cells and at most max_gap ticks apart."""
    w = Window.partitionBy("demo", "player", "round").orderBy("tick", "event_id")
    prev = samples.withColumns({"gap": F.col("tick") - F.lag("tick").over(w), "from_row": F.lag("row").over(w), "from_col": F.lag("col").over(w)})
    return prev.where((F.col("gap") > 0) & (F.col("gap") <= max_gap) & ((F.col("from_row") != F.col("row")) | (F.col("from_col") != F.col("col"))))


def moves(samples: DataFrame, max_gap: int = 480) -> DataFrame:
    return steps(samples, max_gap).groupBy("map_id", "from_row", "from_col", "row", "col").agg(F.count("*").alias("moves"))


def flow(samples: DataFrame, max_gap: int = 480) -> DataFrame:
    """Moves into and out of each cell."""
    both = F.explode(F.array(F.struct("row", "col"), F.struct(F.col("from_row").alias("row"), F.col("from_col").alias("col"))))
    return steps(samples, max_gap).select("map_id", both.alias("c")).groupBy("map_id", "c.row", "c.col").agg(F.count("*").alias("flow"))


def visits(samples: DataFrame) -> DataFrame:
    """Rounds in which anyone was in the cell."""
    return samples.groupBy(*CELL).agg(F.count_distinct("demo", "round").alias("visits_rounds"))


def presence(samples: DataFrame, window: float = 120) -> DataFrame:
    """Occupancy and visits in one pass: counts per (cell, round) first, then per cell."""
    early = F.col("seconds_after_freeze").between(0, window)
    counts = [F.count("*").alias("occ_all"), F.count_if(side() == "CT").alias("occ_ct"), F.count_if(side() == "T").alias("occ_t"), F.count_if(early).alias("occ_early")]
    once = samples.groupBy(*CELL, "demo", "round").agg(*counts)
    return once.groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in ("occ_all", "occ_ct", "occ_t", "occ_early")), F.count("*").alias("visits_rounds"))


def behaviour_grid(samples: DataFrame, kills: DataFrame) -> DataFrame:
    """All counts of each cell, from one union of partial counts, so the cells are shuffled once."""
    parts = [presence(samples), kills_grid(kills), flow(samples)]
    names = [c for df in parts for c in df.columns if c not in CELL]
    both = parts[0]
    for df in parts[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    return both.groupBy(*CELL).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))


def coarse_grid(kills: DataFrame, samples: DataFrame, n: int = 16) -> DataFrame:
    """All n * n cells of each map, also those without counts."""
    spark = kills.sparkSession
    axis = lambda name: spark.range(n).withColumnRenamed("id", name)
    spine = samples.select("map_id").distinct().crossJoin(F.broadcast(axis("row"))).crossJoin(F.broadcast(axis("col")))
    occ = samples.groupBy(*CELL).agg(F.count_if(side() == "CT").alias("occupancy_ct"), F.count_if(side() == "T").alias("occupancy_t"))
    return spine.join(kills_grid(kills), CELL, "left").join(occ, CELL, "left").fillna(0)


def top_cells(grid: DataFrame, by: str, k: int = 8) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc(by), "row", "col")).cast("long")
    return grid.withColumn("place", place).where(F.col("place") <= k).select("map_id", "place", "row", "col", by)


def territory(grid: DataFrame) -> DataFrame:
    ct, t = F.col("occ_ct") > 0, F.col("occ_t") > 0
    counts = {"ct_only": ct & ~t, "t_only": t & ~ct, "both": ct & t, "with_kills": F.col("kills") > 0, "with_occupancy": F.col("occ_all") > 0}
    return grid.groupBy("map_id").agg(*(F.count_if(c).alias(k) for k, c in counts.items()), F.floor(F.sum("flow") / 2).alias("moves"))


def coverage(grid: DataFrame) -> DataFrame:
    """By map: cells with occupancy, their share of all cells, and moves."""
    used = F.count_if(F.col("occ_all") > 0)
    return grid.groupBy("map_id").agg(used.alias("with_occupancy"), (used / F.count("*")).alias("share"), F.floor(F.sum("flow") / 2).alias("moves"))


def ranges(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """The smallest and largest value of each column; values that are no numbers are ignored."""
    value = lambda c: F.col(c).try_cast("double")
    return df.groupBy(*by).agg(*(f(value(c)).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))))


def sample_accounting(samples: DataFrame, kills: DataFrame, cells: DataFrame, by: str = "map_name") -> DataFrame:
    """By map: samples in all, shares within the frame and the grid, early ones and their share in the grid, kills in all and in the grid, cells.

    samples have inside and early; both have row and col. Rows without a place count in the totals.
    """
    known = cells.select(by, "row", "col", F.lit(True).alias("found"))
    key = [by, "row", "col"]
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    # counts by cell first: a cell is then one row whatever it holds
    s = samples.groupBy(*key, "inside", "early").agg(F.count("*").alias("k")).join(known, key, "left")
    total = lambda on: F.sum(F.when(F.coalesce(on, F.lit(False)), F.col("k")).otherwise(0))
    s = s.groupBy(by).agg(F.sum("k").alias("samples"), total(F.col("inside")).alias("inside"), total(F.col("found")).alias("in_grid"), total(F.col("early")).alias("early"), total(F.col("early") & F.col("found")).alias("early_in_grid"))
    k = kills.join(known, key, "left").groupBy(by).agg(F.count("*").alias("kills"), count(F.col("found")).alias("kills_in_grid"))
    out = s.join(k, by, "left").join(cells.groupBy(by).agg(F.count("*").alias("cells")), by, "left").fillna(0, ["kills", "kills_in_grid", "cells"])
    return out.select(by, "samples", (F.col("inside") / F.col("samples")).alias("inside_share"), (F.col("in_grid") / F.col("samples")).alias("in_grid_share"), "early", F.try_divide("early_in_grid", "early").alias("early_in_grid_share"), "kills", "kills_in_grid", "cells")
