"""Places of rows in their groups' order, running sums and quantiles, exact, without a group in one task.

Rows are partitioned by ranges of (group, order) and written with the number of their range, so a group of any size is spread over
tasks. Within a range, places and sums come from a window; what lies in the ranges before comes from sums over ranges, one row for each
group and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan.sources.folders import written


def with_places(df: DataFrame, by: list[str], order: list[Column | str], value: str | None = None, only: Column | None = None) -> DataFrame:
    """Adds place (from 1) and n, the size of the group; with value, also run, the sum of value up to the row, and total.

    order must decide between all rows of a group, or else the places of equal ones are any. Null is a group of its own. only is a condition on n, first_place
    and last_place of a group's part in a range: rows of other parts leave before they are sorted.
    """
    ranged = written(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = [F.count("*").alias("_rows"), *([F.sum(value).alias("_sum")] if value else [])]
    parts = ranged.groupBy(*by, "_range").agg(*sums)
    before, all_ = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(by)), F.col("_range").alias("_at"), earlier("_rows").alias("_earlier"), "_rows", F.sum("_rows").over(all_).alias("n"), *([earlier("_sum").alias("_run"), F.sum("_sum").over(all_).alias("total")] if value else []))
    parts = parts.withColumns({"first_place": F.col("_earlier") + 1, "last_place": F.col("_earlier") + F.col("_rows")})
    same = reduce(lambda x, y: x & y, [F.col("_range") == F.col("_at"), *(F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by))])
    rows = ranged
    if only is not None:
        parts = parts.where(only)
        rows = ranged.join(parts.select("_at", *(f"_{k}" for k in range(len(by)))), same, "left_semi")
    own = Window.partitionBy(*by, "_range").orderBy(*order)
    rows = rows.withColumn("_in", F.row_number().over(own))
    if value:
        rows = rows.withColumn("_in_sum", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.join(parts, same).select(*df.columns, (F.col("_in") + F.col("_earlier")).alias("place"), "n", *([(F.coalesce("_in_sum", F.lit(0)) + F.col("_run")).alias("run"), "total"] if value else []))
    return out


def tile(tiles: int) -> Column:
    """Which of so many equal groups a place is in, from 1; the first groups take one row more where they don't come out even. Needs place and n."""
    small, larger = F.floor(F.col("n") / tiles), F.col("n") % tiles
    edge = larger * (small + 1)
    return F.when(F.col("place") <= edge, F.ceil(F.col("place") / (small + 1))).otherwise(larger + F.ceil((F.col("place") - edge) / F.nullif(small, F.lit(0))))


def quantiles(df: DataFrame, value: str, by: list[str], qs: dict[str, float]) -> DataFrame:
    """By group, the quantiles of value by their names, between the two nearest values in proportion; nulls do not count. A group of nulls has no row."""
    at = {name: (F.col("n") - 1) * q for name, q in qs.items()}
    low = {name: F.floor(c) + 1 for name, c in at.items()}
    high = {name: F.ceil(c) + 1 for name, c in at.items()}
    either = lambda conditions: reduce(lambda a, b: a | b, conditions)
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    placed = with_places(known, by, ["_v"], only=either([(F.col("first_place") <= high[k]) & (F.col("last_place") >= low[k]) for k in qs]))
    needed = placed.where(either([F.col("place").between(low[k], high[k]) for k in qs]))
    pick = lambda c: F.max(F.when(F.col("place") == c, F.col("_v")))
    found = needed.groupBy(*by).agg(F.max("n").alias("n"), *(pick(low[k]).alias(f"_low_{k}") for k in qs), *(pick(high[k]).alias(f"_high_{k}") for k in qs))
    value_of = lambda k: F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * (at[k] - F.floor(at[k]))
    return found.select(*by, *(value_of(k).alias(k) for k in qs))


def columns_as_rows(df: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """(by, name, v): a row for each of the named columns."""
    return df.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()))).alias("m")).select(*by, "m.name", "m.v")


def quantile_columns(df: DataFrame, by: list[str], columns: dict[str, Column], qs: dict[str, float]) -> DataFrame:
    """By group, a column `name_q` for each of the named columns and quantiles, null if it has no values."""
    found = quantiles(columns_as_rows(df, by, columns), "v", [*by, "name"], qs)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col(q))).alias(f"{n}_{q}") for n in columns for q in qs))
