"""Map frames and polygons: the eight axis forms of a point, their inverses, areas; and comparisons of maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan.operators import statistics
from groundplan.operators.ordering import with_places

#: Axis forms, fixed values: which of u, v, 1-u and 1-v gives the column and which the row.
FORMS = ["uv", "1-uv", "u1-v", "1-u1-v", "vu", "1-vu", "v1-u", "1-v1-u"]


def _axes(form: str) -> tuple[str, bool, str, bool]:
    """(axis of the column, whether it is flipped, axis of the row, whether it is flipped)."""
    flip_col = form.startswith("1-")
    rest = form.removeprefix("1-")
    return rest[0], flip_col, rest[-1], rest[1:].startswith("1-")


def to_frame(df: DataFrame, u: str, v: str, size: int) -> DataFrame:
    """Each row once for each form, with form, px and py in a frame of size pixels."""
    side = lambda axis, flip: (1 - F.col({"u": u, "v": v}[axis]) if flip else F.col({"u": u, "v": v}[axis])) * size
    forms = [F.struct(F.lit(f).alias("form"), side(a, fa).alias("px"), side(b, fb).alias("py")) for f in FORMS for a, fa, b, fb in [_axes(f)]]
    return df.withColumn("at", F.explode(F.array(*forms))).select(*df.columns, "at.form", "at.px", "at.py")


def from_frame(size: int) -> tuple[Column, Column]:
    """u and v from form, px and py: the inverse of to_frame."""

    def inverse(axis: str) -> Column:
        cases = []
        for form in FORMS:
            a, fa, b, fb = _axes(form)
            pixel, flip = (F.col("px"), fa) if a == axis else (F.col("py"), fb)
            cases.append((F.col("form") == form, 1 - pixel / size if flip else pixel / size))
        return reduce(lambda out, c: F.when(c[0], c[1]).otherwise(out), cases, F.lit(None))

    return inverse("u"), inverse("v")


def best_form(framed: DataFrame, hit: Column, by: list[str]) -> DataFrame:
    """The form with the largest share of hits; of equal ones, the greater name."""
    shares = framed.groupBy(*by, "form").agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("hit"))
    return shares.groupBy(*by).agg(F.max_by("form", F.struct("hit", "form")).alias("form"), F.max("hit").alias("hit"))


def polygons(corners: DataFrame, key: str, place: str, x: str, y: str) -> DataFrame:
    """Number of corners, shoelace area and mean corner of each polygon; the last corner is joined to the first."""
    w = Window.partitionBy(key).orderBy(place)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    turn = F.col(x) * after(y) - F.col(y) * after(x)
    return corners.withColumn("turn", turn).groupBy(key).agg(F.count("*").alias("corners"), (F.abs(F.sum("turn")) / 2).alias("area"), F.avg(x).alias("centre_x"), F.avg(y).alias("centre_y"))


def configuration(df: DataFrame, metric: str, density: str, tie: str, by: list[str], choice: str | None = None, count: str | None = None) -> DataFrame:
    """Mean density of the top and the bottom fifth by metric, and their ratio (null if the lower mean is 0).

    With choice and count, also rho and r of metric and density, rho of choice and density, and of metric and count.
    """
    ranked = with_places(df.select(*dict.fromkeys([*by, metric, density, tie])), by, [metric, tie]).withColumn("k", F.greatest(F.floor(F.col("n") / 5), F.lit(1)))
    low, high = F.avg(F.when(F.col("place") <= F.col("k"), F.col(density))), F.avg(F.when(F.col("place") > F.col("n") - F.col("k"), F.col(density)))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), low.alias("low"), high.alias("high")).withColumn("ratio", F.try_divide("high", "low"))
    if choice is None or count is None:
        return out
    for c in (metric, density, choice, count):
        df = statistics.with_average_rank(df, c, by, f"_rank_{c}")
    rho = lambda a, b: statistics.corr(f"_rank_{a}", f"_rank_{b}")
    found = df.groupBy(*by).agg(rho(metric, density).alias("rho"), statistics.corr(metric, density).alias("r"), rho(choice, density).alias("choice_rho"), rho(metric, count).alias("count_rho"))
    return out.join(found, by)


def polygon_sizes(polygons: DataFrame) -> DataFrame:
    """By map: how many polygons have so many corners. polygons has corner_idx, an array."""
    return polygons.groupBy("map_name", F.size("corner_idx").cast("long").alias("corners")).agg(F.count("*").alias("polygons"))


def polygon_corners(polygons: DataFrame, corners: DataFrame) -> DataFrame:
    """(map_name, poly_id, place, x, y): the places of each polygon's corners, in order."""
    at = polygons.select("map_name", "poly_id", F.posexplode("corner_idx").alias("place", "corner_id"))
    return at.join(corners.select("map_name", "corner_id", "x", "y"), ["map_name", "corner_id"]).select("map_name", "poly_id", "place", "x", "y")


def transposed(df: DataFrame, group: str, groups: list[str], metrics: list[str]) -> DataFrame:
    """Metrics as rows, one column for each group."""
    return df.unpivot([group], metrics, "metric", "value").groupBy("metric").pivot(group, groups).agg(F.first("value"))


def map_ratio(table: DataFrame, a: str, b: str) -> DataFrame:
    return table.select("metric", F.try_divide(a, b).alias("ratio"))


def manifest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old records, and the new ones with a key not seen before, each key once."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)
