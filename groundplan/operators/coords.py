"""World, pixels and cells: calibrations, rasters, spawns and heat surfaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.operators import frames, kernels, space

#: Landmarks of a calibration, fixed values; each has columns name_x and name_y from 0 to 1.
LANDMARKS = ["CTSpawn", "TSpawn", "bombA", "bombB"]


def with_calibration(df: DataFrame, calibration: DataFrame) -> DataFrame:
    """Adds pos_x, pos_y and scale of the row's map; rows of other maps leave. calibration has one row per map, so Spark broadcasts it while it is small."""
    return df.join(calibration.select("map_name", "pos_x", "pos_y", "scale"), "map_name")


def world_to_px(df: DataFrame, x: str = "x", y: str = "y", px: str = "px", py: str = "py") -> DataFrame:
    """px and py from world x and y; y runs the other way. df has pos_x, pos_y and scale."""
    return df.withColumns({px: (F.col(x) - F.col("pos_x")) / F.col("scale"), py: (F.col("pos_y") - F.col(y)) / F.col("scale")})


def px_to_world(df: DataFrame, px: str = "px", py: str = "py", x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({x: F.col("pos_x") + F.col(px) * F.col("scale"), y: F.col("pos_y") - F.col(py) * F.col("scale")})


def to_cell(df: DataFrame, cell: float, rows: int, cols: int) -> DataFrame:
    """row, col and inside; rows without a place are outside, and stay."""
    row, col = F.floor(F.col("py") / cell), F.floor(F.col("px") / cell)
    inside = (row >= 0) & (row < rows) & (col >= 0) & (col < cols)
    return df.withColumns({"row": row, "col": col, "inside": F.coalesce(inside, F.lit(False))})


def grid_shape(cells: DataFrame) -> DataFrame:
    """By map: cell_px, the step between the two smallest px_left, and rows and cols, one more than the largest of each."""
    least = cells.groupBy("map_name").agg(F.min("px_left").alias("least"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    second = cells.join(least, "map_name").where(F.col("px_left") > F.col("least")).groupBy("map_name").agg(F.min("px_left").alias("second"))
    return least.join(second, "map_name", "left").select("map_name", (F.col("second") - F.col("least")).alias("cell_px"), "rows", "cols")


def in_grid(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows whose cell is one of cells."""
    return df.join(cells.select("map_name", "row", "col"), ["map_name", "row", "col"], "left_semi")


def enrich_cells(cells: DataFrame, *aggregates: DataFrame) -> DataFrame:
    """All cells with the aggregates' columns, 0 where there are none."""
    out = cells
    for found in aggregates:
        out = out.join(found, ["map_name", "row", "col"], "left").fillna(0, [c for c in found.columns if c not in cells.columns])
    return out


def midpoints(kills: DataFrame) -> DataFrame:
    """px and py halfway between the attacker at (x, y) and the victim at (vx, vy), in pixels; kills without one of them have nulls."""
    both = world_to_px(world_to_px(kills, "x", "y", "ax", "ay"), "vx", "vy", "bx", "by")
    return both.withColumns({"px": (F.col("ax") + F.col("bx")) / 2, "py": (F.col("ay") + F.col("by")) / 2}).drop("ax", "ay", "bx", "by")


def cell_bounds(cells: DataFrame, cell: float) -> DataFrame:
    """The pixels of each cell and its bounds in the world, to one digit. cells has row, col, pos_x, pos_y and scale."""
    px = {"px_left": F.col("col") * cell, "px_top": F.col("row") * cell, "px_right": (F.col("col") + 1) * cell, "px_bottom": (F.col("row") + 1) * cell}
    out = cells.withColumns(px)
    world_x = lambda p: F.col("pos_x") + F.col(p) * F.col("scale")
    world_y = lambda p: F.col("pos_y") - F.col(p) * F.col("scale")
    return out.withColumns({"world_x_min": F.round(world_x("px_left"), 1), "world_x_max": F.round(world_x("px_right"), 1), "world_y_min": F.round(world_y("px_bottom"), 1), "world_y_max": F.round(world_y("px_top"), 1)})


def landmark_px(calibration: DataFrame, size: int = 1024) -> DataFrame:
    """(map_name, landmark, px, py): the pixel of each landmark, the last one for 1; nulls where the calibration lacks it."""
    pixel = lambda c: F.when(F.col(c).isNotNull(), F.least((F.col(c) * size).cast("int"), F.lit(size - 1)))
    marks = F.array(*(F.struct(F.lit(m).alias("landmark"), pixel(f"{m}_x").alias("px"), pixel(f"{m}_y").alias("py")) for m in LANDMARKS))
    return calibration.select("map_name", F.explode(marks).alias("m")).select("map_name", "m.*")


def check_landmarks(calibration: DataFrame, pixels: DataFrame, size: int = 1024) -> DataFrame:
    """By map: whether all landmarks are there and on pixels with alpha > 0."""
    found = landmark_px(calibration, size).join(pixels, ["map_name", "px", "py"], "left")
    return found.groupBy("map_name").agg(F.bool_and(F.coalesce(F.col("alpha") > 0, F.lit(False))).alias("ok"))


def raster_coverage(points: DataFrame, pixels: DataFrame, size: int = 1024, threshold: int = 0) -> DataFrame:
    """By map: the share of points on pixels with alpha > threshold; points beyond the border count at the border."""
    edge = lambda c: F.greatest(F.least(F.floor(c), F.lit(size - 1)), F.lit(0)).alias(c)
    at = points.where("px is not null and py is not null").select("map_name", edge("px"), edge("py"))
    counted = at.groupBy("map_name", "px", "py").agg(F.count("*").alias("n")).join(pixels, ["map_name", "px", "py"], "left")
    return counted.groupBy("map_name").agg(F.sum("n").alias("points"), (F.sum(F.when(F.col("alpha") > threshold, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))


def spawn_alignment(samples: DataFrame, calibration: DataFrame, size: int = 1024) -> DataFrame:
    """By map and side: pixels between the side's mean place and its declared spawn."""
    mean = samples.where("side is not null").groupBy("map_name", "side").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    spawns = landmark_px(calibration, size).where(F.col("landmark").isin("CTSpawn", "TSpawn")).select("map_name", F.regexp_replace("landmark", "Spawn$", "").alias("side"), F.col("px").alias("sx"), F.col("py").alias("sy"))
    at = world_to_px(with_calibration(mean, calibration)).join(spawns, ["map_name", "side"])
    return at.select("map_name", "side", "px", "py", F.hypot(F.col("px") - F.col("sx"), F.col("py") - F.col("sy")).alias("distance"))


def form_scores(polygons: DataFrame, pixels: DataFrame, size: int, cell: float = 1, threshold: int = 128) -> DataFrame:
    """(map_name, form, hit): for each of the eight axis forms, the share of cells of the polygons on pixels with alpha > threshold.

    polygons has corners, an array of (x, y) that run from 0 to 1 as u and v.
    """
    name = {"u": "x", "v": "y"}

    def framed_corners(form: str) -> Column:
        a, flip_a, b, flip_b = frames._axes(form)
        side = lambda p, axis, flip: (1 - p[name[axis]] if flip else p[name[axis]]) * size
        return F.transform("corners", lambda p: F.struct(side(p, a, flip_a).alias("x"), side(p, b, flip_b).alias("y")))

    rows = [F.struct(F.lit(form).alias("form"), framed_corners(form).alias("corners")) for form in frames.FORMS]
    framed = polygons.select("map_name", F.explode(F.array(*rows)).alias("f")).select(F.struct("map_name", "f.form").alias("map_name"), "f.corners")
    cells = space.rasterise(framed, cell).select("map_name.map_name", "map_name.form", F.col("c").alias("px"), F.col("r").alias("py"))
    return cells.join(pixels, ["map_name", "px", "py"], "left").groupBy("map_name", "form").agg(F.avg(F.when(F.col("alpha") > threshold, 1.0).otherwise(0.0)).alias("hit"))


def detect_form(scores: DataFrame, warn: float = 0.85) -> DataFrame:
    """The form with the largest hit of each map (ties: the greater name), and whether that is under warn."""
    best = scores.groupBy("map_name").agg(F.max_by("form", F.struct("hit", "form")).alias("form"), F.max("hit").alias("hit"))
    return best.withColumn("poor", F.col("hit") < warn)


def heat(points: DataFrame, by: list[str], size: int = 1024, sigma: float = 18, least: float = 0.05) -> DataFrame:
    """(by, px, py, heat): pixel counts, smoothed and divided by the group's largest; only where at least `least`. Points beyond the border are left out.

    Counts are made first, so a group is size * size numbers at most.
    """
    at = points.where((F.col("px") >= 0) & (F.col("px") < size) & (F.col("py") >= 0) & (F.col("py") < size))
    counts = at.groupBy(*by, F.floor("px").alias("px"), F.floor("py").alias("py")).agg(F.count("*").alias("n"))

    def run(t: pa.Table) -> pa.Table:
        grid = np.zeros((size, size))
        grid[t.column("py").to_numpy(), t.column("px").to_numpy()] = t.column("n").to_numpy()
        grid = kernels.smoothed(grid, sigma)
        grid /= grid.max()
        y, x = np.nonzero(grid >= least)
        return pa.table({k: pa.array([t.column(k)[0].as_py()] * len(x), t.schema.field(k).type) for k in by} | {"px": x, "py": y, "heat": grid[y, x]})

    fields = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in by)
    return counts.groupBy(*by).applyInArrow(run, f"{fields}, px long, py long, heat double")


def heat_difference(a: DataFrame, b: DataFrame, by: list[str], least: float = 0.1) -> DataFrame:
    """(by, px, py, difference) of two surfaces, each divided by its own largest; only where it is at least `least` of the largest difference."""
    key = [*by, "px", "py"]
    both = a.select(*key, F.col("heat").alias("a")).join(b.select(*key, F.col("heat").alias("b")), key, "full").fillna(0.0, ["a", "b"]).withColumn("difference", F.col("a") - F.col("b"))
    largest = both.groupBy(*by).agg(F.max(F.abs("difference")).alias("largest"))
    return both.join(largest, by).where(F.abs("difference") >= F.col("largest") * least).select(*key, "difference")
