"""Statistics per group: correlations, regressions, curves, hot spots, shares, histograms."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundplan.operators.ordering import columns_as_rows, quantile_columns, quantiles, tile, with_places


def corr(x: str, y: str) -> Column:
    """Pearson's r over rows where both are known; null where a side is constant."""
    own = lambda a, b: F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a)))
    return F.try_divide(F.covar_pop(x, y), own(x, y) * own(y, x))


def with_average_rank(df: DataFrame, x: str, by: list[str], name: str, nulls: bool = False) -> DataFrame:
    """Adds the rank of x among its group's values, the mean of them for ties. Rows without x leave, or with nulls, stay without a rank.

    Only the distinct values of a group meet in a window; the rows find their rank by an equi-join.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = values.select(*by, x, (before + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, [*by, x], "left" if nulls else "inner")


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_average_rank(with_average_rank(known, x, by, "rx"), y, by, "ry")
    enough = lambda c: F.when(F.col("n") >= 8, c)
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), corr(x, y).alias("r"), corr("rx", "ry").alias("rho"))
    return out.select(*by, "n", enough(F.col("r")).alias("pearson_r"), enough(F.col("rho")).alias("spearman_rho"))


def correlation_matrix(df: DataFrame, behaviours: list[str], metrics: list[str], by: list[str]) -> DataFrame:
    """(by, behaviour, metric, n, spearman_rho, pearson_r) for all pairs; null where n < 8 or a side is nearly constant.

    A pair goes over the rows where both of its columns are known, and is ranked among these. Pairs of columns without nulls share one rank a column and
    one aggregation; the others are worked out pair by pair. A side is constant if it spans no more than 1e-8 plus 1e-5 of its least value
    (rows have no first one to compare with).
    """
    columns = list(dict.fromkeys([*behaviours, *metrics]))
    holes = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    pairs = [(b, m) for b in behaviours for m in metrics]
    flat = lambda c: F.max(c) - F.min(c) <= 1e-8 + 1e-5 * F.abs(F.min(c))
    ok = lambda c: F.when((F.col("n") >= 8) & ~F.col("p.flat"), F.col(c))
    result = [*by, "p.behaviour", "p.metric", "n"]
    out = []
    if whole := [(b, m) for b, m in pairs if not holes[b] and not holes[m]]:
        ranked = df
        for c in dict.fromkeys(x for p in whole for x in p):
            ranked = with_average_rank(ranked, c, by, f"_rank_{c}")
        aggregates = [F.struct(F.lit(b).alias("behaviour"), F.lit(m).alias("metric"), corr(f"_rank_{b}", f"_rank_{m}").alias("rho"), corr(b, m).alias("r"), (flat(b) | flat(m)).alias("flat")) for b, m in whole]
        found = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.array(*aggregates).alias("all")).select(*by, "n", F.explode("all").alias("p"))
        out.append(found.select(*result, ok("p.rho").alias("spearman_rho"), ok("p.r").alias("pearson_r")))
    if part := [p for p in pairs if p not in whole]:
        rows = F.explode(F.array(*(F.struct(F.lit(b).alias("behaviour"), F.lit(m).alias("metric"), F.col(b).cast("double").alias("x"), F.col(m).cast("double").alias("y")) for b, m in part)))
        key = [*by, "behaviour", "metric"]
        long = df.select(*by, rows.alias("p")).select(*by, "p.*")
        known = long.where("x is not null and y is not null")
        ranked = with_average_rank(with_average_rank(known, "x", key, "rx"), "y", key, "ry")
        found = ranked.groupBy(*key).agg(F.count("*").alias("n"), F.struct(corr("rx", "ry").alias("rho"), corr("x", "y").alias("r"), (flat("x") | flat("y")).alias("flat")).alias("p"))
        every = long.select(*key).distinct().join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        out.append(every.select(*key, "n", ok("p.rho").alias("spearman_rho"), ok("p.r").alias("pearson_r")))
    return reduce(DataFrame.union, out)


def source_comparison(matrix: DataFrame, by: list[str], sources: list[str], source: str = "source", values: dict[str, str] | None = None) -> DataFrame:
    """The correlations of a matrix made by map and source, one column for each source: rho, or with values, each of them as `source_name`."""
    pivoted = matrix.groupBy(*by, "behaviour", "metric").pivot(source, sources)
    return pivoted.agg(F.first("spearman_rho")) if values is None else pivoted.agg(*(F.first(c).alias(name) for c, name in values.items()))


def metric_correlations(df: DataFrame, pairs: list[tuple[str, str]], by: list[str], more_than: int = 10) -> DataFrame:
    """Pearson's r of each pair of columns, one column each; groups of no more than more_than rows are left out."""
    found = df.groupBy(*by).agg(F.count("*").alias("n"), *(corr(a, b).alias(f"{a}_vs_{b}") for a, b in pairs))
    return found.where(F.col("n") > more_than)


#: Degrees of freedom up to which Student's t is a finite sum here.
SUMMED = 20_000


def correlation_tail(r: Column, free: Column) -> Column:
    """The two-sided p of a correlation r with free whole degrees of freedom (n - 2) by Student's t, as column expressions; null where r is null or free < 1.

    t**2 / (t**2 + free) is r**2, so the tail is a finite sum of powers of 1 - r**2. Beyond SUMMED degrees the normal tail of a
    transformed t takes its place, within 1e-9. Absolute errors are about 1e-15, so smaller values of p are not told apart.
    """
    free = free.cast("double")
    size, rest = F.least(F.abs(r), F.lit(1.0)), F.greatest(1 - r * r, F.lit(0.0))

    def series(last: Column, step) -> Column:
        """1 and the products step(1), step(1) * step(2), ... up to step(last), added up."""
        places = F.when(last >= 1, F.sequence(F.lit(1), F.least(F.greatest(last, F.lit(1)), F.lit(SUMMED)).cast("int"))).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        return F.aggregate(places, start, lambda a, j: F.struct((a["term"] * step(j)).alias("term"), (a["sum"] + a["term"] * step(j)).alias("sum")), lambda a: a["sum"])

    even = size * series(free / 2 - 1, lambda j: (2 * j - 1) / (2 * j) * rest)
    odd = (F.asin(size) + F.when(free > 1, size * F.sqrt(rest) * series((free - 3) / 2, lambda j: 2 * j / (2 * j + 1) * rest)).otherwise(0.0)) * (2 / math.pi)
    z = F.sqrt(free * -F.log1p(-F.least(r * r, F.lit(1 - 1e-16)))) * (8 * free + 1) / (8 * free + 3)
    normal = F.when(z < 8.5, 2 * z * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series(F.lit(300), lambda j: z * z / (2 * j + 1))).otherwise(1.0)
    inside = F.when(free > SUMMED, normal).when(free % 2 == 0, even).otherwise(odd)
    return F.when(r.isNotNull() & (free >= 1), F.greatest(1 - inside, F.lit(0.0)))


def with_p_value(df: DataFrame, r: str, n: str, name: str) -> DataFrame:
    """The two-sided p of a correlation r of n rows; null where either is null or n < 3. For results, one row each."""
    return df.withColumn(name, correlation_tail(F.col(r), F.col(n) - 2))


def linregress(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """y by x: slope, intercept, r, r2, stderr of the slope, and p that there is none."""
    out = df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), corr(x, y).alias("r"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    error = F.sqrt((1 - F.col("r2")) * F.col("syy") / F.nullif(F.col("sxx"), F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0)))
    return with_p_value(out.withColumn("r2", F.col("r") ** 2).withColumn("stderr", error).drop("sxx", "syy"), "r", "n", "p")


def finite_positive(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok &= F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    return ok


def intelligibility(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """y by x over rows where both are finite and over 0, and the correlation of their logarithms."""
    out = df.where(finite_positive(x, y)).withColumns({"_ln_x": F.ln(x), "_ln_y": F.ln(y)}).groupBy(*by).agg(F.count("*").alias("n"), corr(x, y).alias("r"), corr("_ln_x", "_ln_y").alias("log_r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return with_p_value(out.withColumns({"r2": F.col("r") ** 2, "log_r2": F.col("log_r") ** 2}), "r", "n", "p")


def hotspots(df: DataFrame, metric: str, behaviour: str, by: list[str], q: float = 0.9) -> DataFrame:
    """Cells at or above the q-quantile of both, how many to expect if they were independent, and medians over hot and all cells."""
    at = quantile_columns(df, by, {"m": F.col(metric), "b": F.col(behaviour)}, {"q": q, "median": 0.5})
    marked = df.join(at, by)
    a, b = F.col(metric) >= F.col("m_q"), F.col(behaviour) >= F.col("b_q")
    hot = quantile_columns(marked, by, {"m": F.when(b, F.col(metric)), "b": F.when(a, F.col(behaviour))}, {"hot": 0.5})
    counts = marked.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a).alias("hot_metric"), F.count_if(b).alias("hot_behaviour"), F.count_if(a & b).alias("overlap"), F.first("m_median").alias("metric_in_all"), F.first("b_median").alias("behaviour_in_all"))
    out = counts.join(hot.withColumnsRenamed({"m_hot": "metric_in_hot", "b_hot": "behaviour_in_hot"}), by)
    return out.withColumn("expected", F.col("hot_metric") * F.col("hot_behaviour") / F.col("n"))


def top_share(df: DataFrame, value: str, tie: str, by: list[str], share: float = 0.05) -> DataFrame:
    ranked = with_places(df.select(*dict.fromkeys([*by, value, tie])), by, [F.desc(value), F.asc(tie)])
    top = F.col("place") <= F.greatest(F.floor(F.col("n") * share), F.lit(1))
    return ranked.groupBy(*by).agg(F.count_if(top).alias("k"), (F.sum(F.when(top, F.col(value))) / F.sum(value)).alias("share"))


def decile_curve(df: DataFrame, x: str, y: str, tie: str, by: list[str], n: int = 10, sample: bool = True) -> DataFrame:
    """Means of n equal groups by rising x, with the standard error of y: of a sample, or else of all rows."""
    spread = F.stddev_samp if sample else F.stddev_pop
    tiles = with_places(df.select(*dict.fromkeys([*by, x, y, tie])), by, [x, tie]).withColumn("tile", tile(n).cast("long"))
    return tiles.groupBy(*by, "tile").agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (spread(y) / F.sqrt(F.count("*"))).alias("se"))


def cumulative_share(df: DataFrame, x: str, y: str, tie: str, by: list[str], percents: tuple[int, ...] = (10, 20, 30, 50)) -> DataFrame:
    """The share of y that the first p percent of rows by falling x hold."""
    run = with_places(df.select(*dict.fromkeys([*by, x, y, tie])), by, [F.desc(x), F.asc(tie)], y)
    run = run.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    return run.where(F.col("place") == F.greatest(F.rint(F.col("n") * F.col("percent") / 100), F.lit(1))).select(*by, F.col("percent").cast("long"), (F.col("run") / F.col("total")).alias("share"))


def metric_summary(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    long = columns_as_rows(df, by, {m: F.col(m) for m in metrics}).withColumnRenamed("name", "metric")
    plain = long.groupBy(*by, "metric").agg(F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    return plain.join(quantiles(long, "v", [*by, "metric"], {"median": 0.5, "p95": 0.95}), [*by, "metric"], "left").select(*by, "metric", "min", "median", "mean", "p95", "max")


def compare_maps(df: DataFrame, metrics: list[str], pair: tuple[str, str], share_of: str, tie: str, by: list[str]) -> DataFrame:
    """One row per map: its cells, median, mean and p95 of each metric, the correlation of a pair, and the share of share_of that its top 5 % hold."""
    out = df.groupBy(*by).agg(F.count("*").alias("cells"), *(F.avg(m).alias(f"{m}_mean") for m in metrics), corr(*pair).alias("pair_corr"))
    out = out.join(quantile_columns(df, by, {m: F.col(m) for m in metrics}, {"median": 0.5, "p95": 0.95}), by)
    out = out.join(top_share(df, share_of, tie, by).select(*by, F.col("share").alias("top_share")), by)
    return out.select(*by, "cells", *(f"{m}_{k}" for m in metrics for k in ("median", "mean", "p95")), "pair_corr", "top_share")


def histogram(df: DataFrame, x: str, by: list[str], bins: int = 40, log_shift: bool = False) -> DataFrame:
    """Equal bins over each group's range, the last one closed; density sums to one over the range. With log_shift, of log10(x - min + 1)."""
    if log_shift:
        least = df.groupBy(*by).agg(F.min(x).alias("_least"))
        df = df.join(least, by).withColumn(x, F.log10(F.col(x) - F.col("_least") + 1)).drop("_least")
    span = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.floor((F.col(x) - F.col("lo")) / width), F.lit(bins - 1)).alias("bin")
    counted = df.where(F.col(x).isNotNull()).join(span, by).groupBy(*by, bin_, "n", width.alias("width")).agg(F.count("*").alias("count"))
    return counted.select(*by, "bin", "count", (F.col("count") / F.col("n") / F.col("width")).alias("density"))
