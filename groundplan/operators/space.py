"""Integration, syntax grids, islands; morphology; lines and points. What needs a map's graph is in graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan.operators import coords, graphs
from groundplan.operators.graphs import blocks_of, choice, choice_sampled, connectivity, distance_sums, distances, edges_of, isovist_perimeter, visibility_blocks  # noqa: F401
from groundplan.sources.folders import written


def visibility_edges(cells: DataFrame, block: int = graphs.BLOCK) -> DataFrame:
    """(map_name, r, c, r2, c2) of visibility_blocks, both ways."""
    return edges_of(visibility_blocks(cells, block))


def hop_distance(edges: DataFrame, whole: int = graphs.WHOLE) -> DataFrame:
    return distances(edges, None, whole)


def metric_distance(edges: DataFrame, cell: float = 16, whole: int = graphs.WHOLE) -> DataFrame:
    return distances(edges, cell, whole)


def integration_hh(sums: DataFrame, cells: DataFrame, name: str = "integration_hh", fill: bool = True) -> DataFrame:
    """Integration of each cell; with fill, cells that can't be reached count as the map's largest distance, else they are left out.

    NaN on maps of under four cells, inf where the mean distance is one.
    """
    n = cells.groupBy("map_name").agg(F.count("*").alias("n"))
    far = sums.groupBy("map_name").agg(F.max("far").alias("far"))
    x = cells.join(sums.drop("far").hint("merge"), ["map_name", "r", "c"], "left").join(n, "map_name").join(far, "map_name", "left").fillna(0, ["s", "m", "far"])
    missing = (F.col("n") - 1 - F.col("m")) * F.col("far") if fill else F.lit(0.0)
    md = (F.col("s") + missing) / F.nullif(F.col("n") - 1, F.lit(0))
    ra = 2 * (md - 1) / F.nullif(F.col("n") - 2, F.lit(0))
    dn = 2 * (F.col("n") * (F.log2((F.col("n") + 2) / 3) - 1) + 1) / F.nullif((F.col("n") - 1) * (F.col("n") - 2), F.lit(0))
    value = F.when(F.col("n") < 4, F.lit(float("nan"))).when(ra == 0, F.lit(float("inf"))).otherwise(dn / F.nullif(ra, F.lit(0.0)))
    return x.select("map_name", "r", "c", value.alias(name))


def syntax_grid(cells: DataFrame, calibration: DataFrame, cell: int = 16, sources: int | None = None, seed: str = "") -> DataFrame:
    """The table of all measures: one row for each walkable cell, with its bounds, as the exports round them. Maps without a calibration leave.

    cells has map_name, row and col; choice_t comes from so many sources of each map, or else from all. The graph is made once and read by all measures.
    """
    nodes = written(cells.select("map_name", F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c")).distinct(), "cells")
    blocks, key = visibility_blocks(nodes), ["map_name", "r", "c"]
    out = nodes.join(connectivity(blocks), key, "left").fillna(0, ["connectivity"])
    out = out.join(isovist_perimeter(blocks).withColumnRenamed("perimeter", "isovist_perimeter"), key)
    for name, size in (("integration_hh_t", None), ("integration_hh_m", cell)):
        out = out.join(integration_hh(distance_sums(blocks, size), nodes, name), key)
    found = choice(blocks) if sources is None else choice_sampled(blocks, sources, seed)
    out = out.join(found.select(*key, F.col("choice").alias("choice_t")), key)
    out = coords.cell_bounds(coords.with_calibration(out.withColumnsRenamed({"r": "row", "c": "col"}), calibration), cell)
    measures = [F.round(F.col("connectivity") * float(cell * cell), 1).alias("isovist_area_px"), F.round(F.col("isovist_perimeter").cast("double"), 1).alias("isovist_perimeter"), *(F.round(m, 4).alias(m) for m in ("integration_hh_t", "integration_hh_m", "choice_t"))]
    bounds = ["px_left", "px_top", "px_right", "px_bottom", "world_x_min", "world_x_max", "world_y_min", "world_y_max"]
    return out.select("map_name", "col", "row", *bounds, F.lit(1).alias("walkable"), "connectivity", *measures)


def islands(cells: DataFrame) -> DataFrame:
    """(map_name, r, c, island): the smallest cell number r * 2**20 + c of the cells that are connected by sides. Each round is checkpointed.

    A cell takes the smallest number of its neighbours, and then that cell's own number, so rounds grow with the logarithm of a path.
    """
    key = ["map_name", "r", "c"]
    number = lambda r, c: F.col(r).cast("long") * (1 << 20) + F.col(c)
    sides = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    own = cells.select(*key, number("r", "c").alias("node")).distinct()
    beside = own.withColumn("s", F.explode(sides)).select("map_name", F.col("node").alias("a"), (number("r", "c") + F.col("s.i") * (1 << 20) + F.col("s.j")).alias("b"))
    links = beside.join(own.select("map_name", F.col("node").alias("b")), ["map_name", "b"]).checkpoint()
    roots = own.withColumn("island", F.col("node")).checkpoint()
    while True:
        near = links.join(roots.select("map_name", F.col("node").alias("b"), "island"), ["map_name", "b"]).groupBy("map_name", F.col("a").alias("node")).agg(F.min("island").alias("m"))
        step = roots.join(near, ["map_name", "node"], "left").withColumn("m", F.least("island", F.coalesce("m", "island")))
        hook = step.groupBy("map_name", F.col("island").alias("m")).agg(F.min("m").alias("h"))
        step = step.join(hook, ["map_name", "m"], "left").withColumn("m", F.least("m", F.coalesce("h", "m")))
        step = step.checkpoint()
        if step.where("m <> island").isEmpty():
            return step.select(*key, "island")
        roots = step.select(*key, "node", F.col("m").alias("island"))


def drop_islands(cells: DataFrame, min_share: float = 0.01) -> DataFrame:
    """Cells of islands that have at least min_share of their map's cells."""
    found = islands(cells)
    size = found.groupBy("map_name", "island").agg(F.count("*").alias("size"))
    total = found.groupBy("map_name").agg(F.count("*").alias("total"))
    return found.join(size.join(total, "map_name").where(F.col("size") >= F.col("total") * min_share), ["map_name", "island"]).select("map_name", "r", "c")


def _around(cells: DataFrame) -> DataFrame:
    offsets = F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return cells.withColumn("o", F.explode(offsets)).select("map_name", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))


def erode_cells(cells: DataFrame, times: int = 1) -> DataFrame:
    """Cells whose 3 x 3 neighbourhood is walkable; what is left is eroded again."""
    for _ in range(times):
        cells = _around(cells).groupBy("map_name", "r", "c").count().where("count = 9").drop("count")
    return cells


def close_cells(cells: DataFrame) -> DataFrame:
    return erode_cells(_around(cells).distinct())


def _to_segment(px: Column, py: Column) -> Column:
    """Distance of a point to the row's segment."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt((px - F.col("x1") - t * dx) ** 2 + (py - F.col("y1") - t * dy) ** 2)


def nearest_segment(points: DataFrame, lines: DataFrame, sizes: tuple[float, ...] = (32, 8, 2)) -> DataFrame:
    """The line of the same map next to each point (ties: smallest line_id) and the distance; points without a place or lines have no row.

    Points fall into squares. A square keeps the lines that can be next to any point in it: those no further from its centre than the
    nearest one plus the square's diagonal. Smaller squares begin with the lines of the square around them, so points only meet few lines.
    """
    points = points.where("px is not null and py is not null and not isnan(px) and not isnan(py)")
    square = lambda size: (F.floor(F.col("px") / size), F.floor(F.col("py") / size))
    found, key = lines.select("map_id", "line_id", "x1", "y1", "x2", "y2"), ["map_id"]
    for size in sizes:
        gx, gy = (c.alias(n) for c, n in zip(square(size), (f"gx{size:g}", f"gy{size:g}"), strict=True))
        keyed = points.select("map_id", *([] if len(key) == 1 else [c.alias(n) for c, n in zip(square(last), key[1:], strict=True)]), gx, gy).distinct()
        inner = ["map_id", f"gx{size:g}", f"gy{size:g}"]
        centre = _to_segment((F.col(inner[1]) + 0.5) * size, (F.col(inner[2]) + 0.5) * size)
        met = keyed.join(found, key).withColumn("d", centre)
        met = met.withColumn("least", F.min("d").over(Window.partitionBy(*inner)))
        found = met.where(F.col("d") <= F.col("least") + size * 2**0.5 + 1e-6).select(*inner, "line_id", "x1", "y1", "x2", "y2")
        key, last = inner, size
    own = points.select("point_id", "map_id", "px", "py", *(c.alias(n) for c, n in zip(square(last), key[1:], strict=True)))
    met = own.join(found, key).select("point_id", F.struct(F.round(_to_segment(F.col("px"), F.col("py")), 9).alias("d"), "line_id").alias("s"))
    return met.groupBy("point_id").agg(F.min("s").alias("s")).select("point_id", "s.line_id", F.col("s.d").alias("distance"))


def line_density(lines: DataFrame, assigned: DataFrame, scale: float = 0.01905) -> DataFrame:
    count = assigned.groupBy("line_id").agg(F.count("*").alias("crossfire"))
    metres = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * scale
    out = lines.join(count, "line_id", "left").fillna(0, ["crossfire"]).withColumn("length_m", F.when(metres > 0, metres).otherwise(1e-9))
    return out.select("line_id", "crossfire", "length_m", (F.col("crossfire") / F.col("length_m")).alias("crossfire_per_m"))


def _squares(lines: DataFrame, size: float) -> DataFrame:
    """lines with (gx, gy): the squares of size units that a segment passes, column by column. With low_x and so on, only those within."""
    x1, x2, y1, y2 = (F.col(c) for c in ("x1", "x2", "y1", "y2"))
    clip = "low_x" in lines.columns
    part = lambda c: F.floor(c / size)
    first, last = part(F.least(x1, x2)), part(F.greatest(x1, x2))
    if clip:
        first, last = F.greatest(first, F.col("low_x")), F.least(last, F.col("high_x"))
    columns = lines.where(first <= last).withColumn("gx", F.explode(F.sequence(first, last)))
    at = lambda x: y1 + (x - x1) * (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))
    left, right = F.greatest(F.col("gx") * size, F.least(x1, x2)), F.least((F.col("gx") + 1) * size, F.greatest(x1, x2))
    slack = 1e-9 * (1 + F.abs(y1) + F.abs(y2))
    low = F.greatest(F.coalesce(F.least(at(left), at(right)), F.least(y1, y2)) - slack, F.least(y1, y2))
    high = F.least(F.coalesce(F.greatest(at(left), at(right)), F.greatest(y1, y2)) + slack, F.greatest(y1, y2))
    bottom, top = part(low), part(high)
    if clip:
        bottom, top = F.greatest(bottom, F.col("low_y")), F.least(top, F.col("high_y"))
    return columns.where(bottom <= top).withColumn("gy", F.explode(F.sequence(bottom, top)))


def line_contacts(lines: DataFrame, size: float = 16, crowd: int = 256, finer: int = 8) -> DataFrame:
    """(map_name, r, c, r2, c2) as of graphs, with r the line's id and c 0: lines of a map whose segments cross or touch.

    Lines meet only within squares that both pass. A square that over crowd lines pass is cut into finer times finer ones first.
    """
    own, square = ["map_name", "line_id", "x1", "y1", "x2", "y2"], ["map_name", "gx", "gy"]
    spread = written(_squares(lines.select(*own), size), "squares")
    crowded = spread.groupBy(*square).count().where(F.col("count") > crowd).drop("count")
    fine = spread.join(crowded, square).selectExpr(*own, f"gx * {finer} AS low_x", f"gx * {finer} + {finer - 1} AS high_x", f"gy * {finer} AS low_y", f"gy * {finer} + {finer - 1} AS high_y")
    fine = _squares(fine, size / finer).select(*own, "gx", "gy", F.lit(True).alias("fine"))
    spread = spread.join(crowded, square, "left_anti").select(*own, "gx", "gy", F.lit(False).alias("fine")).union(fine)
    a, b = spread.alias("a"), spread.alias("b")
    # merged: Spark would broadcast all squares wherever their compressed file is small
    both = a.join(b.hint("merge"), [*square, "fine"]).where("a.line_id < b.line_id")

    def turn(p: str, q: str, r: str) -> Column:
        """Sign of the turn p -> q -> r; points are named by line and end."""
        at = lambda name: (F.col(f"{name[0]}.x{name[1]}"), F.col(f"{name[0]}.y{name[1]}"))
        (px, py), (qx, qy), (rx, ry) = at(p), at(q), at(r)
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    overlap = F.lit(True)
    for k in "xy":
        low, high = (lambda t, k=k: F.least(f"{t}.{k}1", f"{t}.{k}2")), (lambda t, k=k: F.greatest(f"{t}.{k}1", f"{t}.{k}2"))
        overlap &= (low("a") <= high("b")) & (low("b") <= high("a"))
    meet = overlap & (turn("a1", "a2", "b1") * turn("a1", "a2", "b2") <= 0) & (turn("b1", "b2", "a1") * turn("b1", "b2", "a2") <= 0)
    pairs = both.where(meet).select("map_name", F.col("a.line_id").alias("r"), F.col("b.line_id").alias("r2")).distinct()
    zero = F.lit(0).cast("long")
    edge = lambda p, q: pairs.select("map_name", F.col(p).alias("r"), zero.alias("c"), F.col(q).alias("r2"), zero.alias("c2"))
    return edge("r", "r2").union(edge("r2", "r"))


def line_graph(lines: DataFrame, contacts: DataFrame) -> DataFrame:
    """connectivity, integration_hh and choice of each line on the graph of contacts; lines without a contact have -1 in all.

    Integration counts the lines of the map that have contacts. contacts is read several times: pass a saved table. The graph is made
    once and read by all measures; tables with a row for each line are merged, never broadcast.
    """
    blocks, key = blocks_of(contacts), ["map_name", "r", "c"]
    sums = written(distance_sums(blocks), "sums")
    integration = integration_hh(sums, graphs.nodes_of(blocks).drop("i"))
    found = connectivity(blocks).join(integration.hint("merge"), key).join(choice(blocks).hint("merge"), key)
    out = lines.select("map_name", F.col("line_id").alias("r")).join(found.drop("c").hint("merge"), ["map_name", "r"], "left").fillna(-1, ["connectivity", "integration_hh", "choice"])
    return out.withColumnRenamed("r", "line_id")


def simplify(points: DataFrame, tolerance: float) -> DataFrame:
    """(polyline, place, x, y): the points of each polyline that stay: its ends, and wherever it is more than tolerance off, the furthest point between two that stay.

    Every round splits all open stretches of all polylines at once, at the point furthest off (of equals, the first); a stretch is a
    group that is summed up on the map side, so a polyline of any length is spread over tasks. Each round is written. Points without a place leave;
    of points of equal place, any one counts.
    """
    own = points.select("polyline", F.col("place").cast("long").alias("place"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("place is not null and x is not null and y is not null")
    own = written(own.dropDuplicates(["polyline", "place"]), "points")
    point = F.struct("place", "x", "y")
    ends = own.groupBy("polyline").agg(F.min_by(point, "place").alias("a"), F.max_by(point, "place").alias("b"))
    kept = [ends.select("polyline", "a.*"), ends.where("a.place < b.place").select("polyline", "b.*")]
    inner = (F.col("place") > F.col("a.place")) & (F.col("place") < F.col("b.place"))
    open_ = written(own.join(ends, "polyline").where(inner), "stretches")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    length = F.sqrt(dx * dx + dy * dy)
    off = F.abs(dx * (F.col("y") - F.col("a.y")) - dy * (F.col("x") - F.col("a.x"))) / F.when(length > 0, length).otherwise(1.0)
    while True:
        far = open_.withColumn("off", off).groupBy("polyline", F.col("a.place").alias("from"), F.col("b.place").alias("to")).agg(F.max_by(point, F.struct("off", -F.col("place"))).alias("k"), F.max("off").alias("off"))
        far = written(far.where(F.col("off") > tolerance).drop("off"), "splits")
        if far.isEmpty():
            break
        kept.append(far.select("polyline", "k.*"))
        met = open_.withColumns({"from": F.col("a.place"), "to": F.col("b.place")}).join(far, ["polyline", "from", "to"]).where(F.col("place") != F.col("k.place"))
        before = F.col("place") < F.col("k.place")
        open_ = written(met.select("polyline", "place", "x", "y", F.when(before, F.col("a")).otherwise(F.col("k")).alias("a"), F.when(before, F.col("k")).otherwise(F.col("b")).alias("b")), "stretches")
    return reduce(DataFrame.union, kept)


def rasterise(polygons: DataFrame, cell: float) -> DataFrame:
    """(map_name, r, c): cells whose centre is within a polygon, by even and odd crossings. polygons has map_name and corners, an array of (x, y) in pixels.

    By scan lines: each edge gives its crossing with each row of cell centres that it passes; a row's crossings, sorted, are the ends of its spans.
    """
    after = F.concat(F.slice("corners", 2, F.size("corners") - 1), F.slice("corners", 1, 1))
    edges = polygons.where(F.size("corners") > 2).withColumn("_id", F.monotonically_increasing_id()).select("map_name", "_id", F.explode(F.arrays_zip(F.col("corners").alias("p"), after.alias("q"))).alias("e")).select("map_name", "_id", "e.p", "e.q")
    low, high = F.least("p.y", "q.y"), F.greatest("p.y", "q.y")
    rows = edges.where(low < high).withColumn("r", F.explode(F.sequence(F.floor(low / cell) - 1, F.floor(high / cell) + 1)))
    y = (F.col("r") + 0.5) * cell
    at = F.col("p.x") + (y - F.col("p.y")) * (F.col("q.x") - F.col("p.x")) / (F.col("q.y") - F.col("p.y"))
    lines = rows.where(((F.col("p.y") > y) != (F.col("q.y") > y))).groupBy("map_name", "_id", "r").agg(F.array_sort(F.collect_list(at)).alias("at"))
    spans = lines.select("map_name", "r", F.explode(F.transform(F.sequence(F.lit(1), F.size("at") - 1, F.lit(2)), lambda k: F.struct(F.get("at", k - 1).alias("from"), F.get("at", k).alias("to")))).alias("s")).select("map_name", "r", "s.*")
    cells = spans.withColumn("c", F.explode(F.sequence(F.floor(F.col("from") / cell) - 1, F.floor(F.col("to") / cell) + 1)))
    x = (F.col("c") + 0.5) * cell
    return cells.where((x >= F.col("from")) & (x < F.col("to"))).select("map_name", "r", "c").distinct()
