"""Queries by name, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.operators import grid, records, rounds, space, statistics
from groundplan.sources import recordings as rec


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ---- rounds and the grid ---------------------------------------------------------------------------------------------


def _rounds(ev: DataFrame) -> DataFrame:
    return rounds.round_windows(rec.starts(ev), rec.ends(ev), rec.freezes(ev))


def _placed(ev: DataFrame) -> DataFrame:
    return grid.with_cell(rounds.assign_rounds(rec.samples(ev), _rounds(ev)).where("x is not null and y is not null and round >= 0"))


def _kills(ev: DataFrame) -> DataFrame:
    return grid.with_cell(rec.kills(ev)).where("row is not null and col is not null")


def round_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounds(rec.game_events(spark, sf_dir))


def assign_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rec.game_events(spark, sf_dir)
    return rounds.assign_rounds(rec.samples(ev).select("event_id", "demo", "tick"), _rounds(ev))


def global_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.global_rounds(_rounds(rec.game_events(spark, sf_dir)))


def behaviour_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rec.game_events(spark, sf_dir)
    return grid.behaviour_grid(_placed(ev), _kills(ev))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.moves(_placed(rec.game_events(spark, sf_dir)))


def coarse_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rec.game_events(spark, sf_dir)
    return grid.coarse_grid(_kills(ev), grid.with_cell(rec.samples(ev)))


def top_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.top_cells(behaviour_grid(spark, sf_dir), "occ_all")


def territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.territory(behaviour_grid(spark, sf_dir))


def count_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.coalesce(grid.side(), F.lit("none")).alias("side")
    return rec.kills(rec.game_events(spark, sf_dir)).groupBy("map_id", side).agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def volume_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rec.read(spark, sf_dir, "lineitem").selectExpr("cast(floor(l_quantity / 5) AS bigint) AS col", "cast(floor(l_extendedprice / 5000) AS bigint) AS row", "l_returnflag AS flag", "l_orderkey AS round")
    return cells.groupBy("row", "col").agg(F.count("*").alias("occ_all"), F.count_if(F.col("flag") == "A").alias("occ_ct"), F.count_if(F.col("flag") == "R").alias("occ_t"), F.count_distinct("round").alias("visits_rounds"))


# ---- statistics ------------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS brand", "cast(p_size AS double) AS x", "cast(p_retailprice AS double) AS y")


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.correlations(_parts(spark, sf_dir), "x", "y", ["brand"]), "pearson_r", "spearman_rho")


def linregress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.linregress(_parts(spark, sf_dir), "x", "y", ["brand"]), "slope", "intercept", "r", "r2", "stderr", "p")


def intelligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.intelligibility(_parts(spark, sf_dir), "x", "y", ["brand"]), "r", "log_r", "r2", "log_r2", "slope", "intercept", "p")


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.hotspots(_parts(spark, sf_dir), "x", "y", ["brand"]), "expected", "metric_in_hot", "metric_in_all", "behaviour_in_hot", "behaviour_in_all")


def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.top_share(_parts(spark, sf_dir), "y", "id", ["brand"]), "share")


def decile_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.decile_curve(_parts(spark, sf_dir), "x", "y", "id", ["brand"]), "mean_x", "mean_y", "se")


def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.cumulative_share(_parts(spark, sf_dir), "x", "y", "id", ["brand"]), "share")


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.metric_summary(_parts(spark, sf_dir), ["x", "y"], ["brand"]), "min", "median", "mean", "p95", "max")


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.histogram(_parts(spark, sf_dir), "x", ["brand"]), "density")


# ---- space -----------------------------------------------------------------------------------------------------------


def visibility_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.visibility_edges(rec.walkable_cells(spark, sf_dir))


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.connectivity(space.visibility_blocks(rec.walkable_cells(spark, sf_dir)))


def integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rec.walkable_cells(spark, sf_dir)
    return _round(space.integration_hh(space.distance_sums(space.visibility_blocks(cells)), cells), "integration_hh")


def closed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.close_cells(rec.walkable_cells(spark, sf_dir))


def eroded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.erode_cells(rec.walkable_cells(spark, sf_dir))


def _midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.kills(rec.game_events(spark, sf_dir)).where("x is not null and y is not null").selectExpr("map_id", "event_id AS point_id", "(x + vx) / 2 AS px", "(y + vy) / 2 AS py")


def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(space.nearest_segment(_midpoints(spark, sf_dir), rec.lines(spark, sf_dir)), "distance")


def line_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rec.lines(spark, sf_dir)
    return _round(space.line_density(lines, space.nearest_segment(_midpoints(spark, sf_dir), lines)), "length_m", "crossfire_per_m", digits=4)


def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page, distinct and in order, and the slug of its address."""
    links = records.extract_links("html", r'href="(/[^"]*)"')
    address = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    return rec.read(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"), records.slug(address).alias("slug"))


# ---- SQL -------------------------------------------------------------------------------------------------------------

_EV = """ev AS (SELECT event_id, user_id % 5 AS demo, (user_id % 5) % 2 AS map_id, CAST(floor(user_id / 5) AS BIGINT) % 4 AS player, event_type,
 CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS BIGINT) AS tick, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x, value AS y FROM events)"""
_ROUNDS = f"""{_EV}, s AS (SELECT demo, tick, row_number() OVER (PARTITION BY demo ORDER BY tick, event_id) - 1 AS round,
 lead(tick) OVER (PARTITION BY demo ORDER BY tick, event_id) AS nxt FROM ev WHERE event_type = 'signup' AND tick IS NOT NULL),
rounds AS (SELECT demo, round, tick AS start, coalesce(least((SELECT min(e.tick) FROM ev e WHERE e.event_type = 'error' AND e.demo = s.demo AND e.tick > s.tick), nxt), tick + 12800) AS stop,
 (SELECT min(f.tick) FROM ev f WHERE f.event_type = 'purchase' AND f.demo = s.demo AND f.tick > s.tick) AS freeze_tick FROM s)"""
_PLACED = f"""{_ROUNDS}, smp AS (SELECT *, CASE event_type WHEN 'click' THEN 'T' ELSE 'CT' END AS side, CAST(floor(y / 20) AS BIGINT) AS "row", CAST(floor(x / 10) AS BIGINT) AS col FROM ev WHERE event_type IN ('click', 'view')),
kil AS (SELECT event_id, map_id, x, y, CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'CT' END AS side, CAST(floor(y / 20) AS BIGINT) AS "row", CAST(floor(x / 10) AS BIGINT) AS col FROM ev WHERE event_type = 'purchase'),
placed AS (SELECT smp.*, r.round, tick - freeze_tick AS after FROM smp JOIN rounds r ON smp.demo = r.demo AND tick >= start AND tick < stop WHERE x IS NOT NULL AND y IS NOT NULL),
lagged AS (SELECT *, tick - lag(tick) OVER w AS gap, lag("row") OVER w AS from_row, lag(col) OVER w AS from_col FROM placed WINDOW w AS (PARTITION BY demo, player, round ORDER BY tick, event_id)),
steps AS (SELECT * FROM lagged WHERE gap > 0 AND gap <= 480 AND (from_row <> "row" OR from_col <> col))"""
_GRID = f"""{_PLACED}, o AS (SELECT map_id, "row", col, count(*) AS occ_all, count(*) FILTER (side = 'CT') AS occ_ct, count(*) FILTER (side = 'T') AS occ_t, count(*) FILTER (after BETWEEN 0 AND 120) AS occ_early, count(DISTINCT (demo, round)) AS visits_rounds FROM placed GROUP BY ALL),
k AS (SELECT map_id, "row", col, count(*) AS kills, count(*) FILTER (side = 'CT') AS kills_ct, count(*) FILTER (side = 'T') AS kills_t FROM kil WHERE "row" IS NOT NULL AND col IS NOT NULL GROUP BY ALL),
f AS (SELECT map_id, "row", col, count(*) AS flow FROM (SELECT map_id, "row", col FROM steps UNION ALL SELECT map_id, from_row, from_col FROM steps) GROUP BY ALL),
g AS (SELECT map_id, "row", col, coalesce(occ_all, 0) AS occ_all, coalesce(occ_ct, 0) AS occ_ct, coalesce(occ_t, 0) AS occ_t, coalesce(occ_early, 0) AS occ_early, coalesce(kills, 0) AS kills, coalesce(kills_ct, 0) AS kills_ct,
 coalesce(kills_t, 0) AS kills_t, coalesce(flow, 0) AS flow, coalesce(visits_rounds, 0) AS visits_rounds FROM o FULL JOIN k USING (map_id, "row", col) FULL JOIN f USING (map_id, "row", col))"""
_PARTS = "p AS (SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part)"
_CELLS = "w AS (SELECT DISTINCT 'm' || CAST(CAST(floor(p_partkey / 1024) AS BIGINT) AS VARCHAR) AS map_name, CAST(p_size % 16 AS BIGINT) AS r, CAST(p_partkey % 16 AS BIGINT) AS c FROM part WHERE NOT ((p_size % 16) % 6 = 3 AND (p_partkey % 16) % 8 NOT IN (1, 5)))"
_SEEN = f"""{_CELLS}, pairs AS (SELECT a.map_name, a.r, a.c, b.r AS r2, b.c AS c2, greatest(abs(b.r - a.r), abs(b.c - a.c)) AS n FROM w a JOIN w b ON a.map_name = b.map_name AND (a.r <> b.r OR a.c <> b.c)),
pts AS (SELECT map_name, r, c, r2, c2, n, CAST(round_even(r + (r2 - r) * k / n, 0) AS BIGINT) AS pr, CAST(round_even(c + (c2 - c) * k / n, 0) AS BIGINT) AS pc FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM pairs)),
seen AS (SELECT map_name, r, c, r2, c2 FROM pts JOIN (SELECT map_name, r AS pr, c AS pc FROM w) USING (map_name, pr, pc) GROUP BY map_name, r, c, r2, c2, n HAVING count(*) = n),
edges AS (SELECT map_name, r, c, r2, c2 FROM seen UNION SELECT map_name, r2, c2, r, c FROM seen)"""
#: Hops and numbers of shortest paths between all pairs, by levels; needs w (nodes) and edges.
_HOPS = """hop(map_name, r, c, r2, c2, d, p) USING KEY (map_name, r, c, r2, c2) AS (SELECT map_name, r, c, r, c, 0::BIGINT, 1::DOUBLE FROM w
UNION SELECT h.map_name, h.r, h.c, e.r2, e.c2, h.d + 1, sum(h.p) FROM hop h JOIN edges e ON h.map_name = e.map_name AND h.r2 = e.r AND h.c2 = e.c
WHERE NOT EXISTS (SELECT 1 FROM recurring.hop k WHERE k.map_name = h.map_name AND k.r = h.r AND k.c = h.c AND k.r2 = e.r2 AND k.c2 = e.c2) GROUP BY h.map_name, h.r, h.c, e.r2, e.c2, h.d + 1)"""


def integration_sql(dist: str, name: str = "integ") -> str:
    """The measure v of all nodes w from distances, the longest one for pairs without a path."""
    return f"""{name}_n AS (SELECT map_name, count(*) AS n FROM w GROUP BY map_name), {name}_far AS (SELECT map_name, max(d) AS far FROM {dist} GROUP BY map_name),
{name}_s AS (SELECT map_name, r, c, sum(d) AS s, count(*) FILTER (d > 0) AS m FROM {dist} GROUP BY ALL),
{name}_v AS (SELECT map_name, r, c, n, 2 * ((s + (n - 1 - m) * far) / (n - 1) - 1) / (n - 2) AS ra, 2 * (n * (log2((n + 2) / 3) - 1) + 1) / ((n - 1) * (n - 2)) AS dn FROM {name}_s JOIN {name}_n USING (map_name) JOIN {name}_far USING (map_name)),
{name} AS (SELECT map_name, r, c, CASE WHEN n < 4 THEN 'nan'::DOUBLE WHEN ra = 0 THEN 'inf'::DOUBLE ELSE dn / ra END AS v FROM {name}_v)"""


def tail_sql(r: str, free: str) -> str:
    """The two-sided p of a correlation r with so many degrees of freedom."""
    term = lambda top, low: f"list_sum(list_transform(range(0, CAST(({free}) // 2 AS BIGINT)), lambda j: exp(lgamma(j + {top}) - lgamma({top}) - lgamma(j + {low}) + lgamma({low}) + j * ln(greatest(1 - ({r}) ** 2, 1e-300)))))"
    odd = f"2 / pi() * (asin(least(abs({r}), 1)) + CASE WHEN {free} > 1 THEN abs({r}) * sqrt(1 - ({r}) ** 2) * {term(1, 1.5)} ELSE 0 END)"
    return f"CASE WHEN {r} IS NOT NULL AND {free} >= 1 THEN greatest(1 - CASE WHEN ({free}) % 2 = 0 THEN abs({r}) * {term(0.5, 1)} ELSE {odd} END, 0) END"


_INTEGRATION = integration_sql("hop")
_ERODE = "SELECT map_name, r, c FROM (SELECT map_name, r + i AS r, c + j AS c FROM {} , (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) GROUP BY ALL HAVING count(*) = 9"
_NEAR = f"""{_EV}, pt AS (SELECT map_id, event_id AS point_id, (x + (x * 7 + 13) % 100) / 2 AS px, (y + y / 2) / 2 AS py FROM ev WHERE event_type = 'purchase' AND x IS NOT NULL AND y IS NOT NULL),
lk AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS s, CAST(p_partkey % 100 AS BIGINT) AS k FROM part),
ln AS (SELECT k % 2 AS map_id, s * 100 + k AS line_id, s::DOUBLE AS x1, k::DOUBLE AS y1, (s * 3 % 50)::DOUBLE AS x2, (k * 7 % 100)::DOUBLE AS y2 FROM lk),
t AS (SELECT *, least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / greatest((x2 - x1) ** 2 + (y2 - y1) ** 2, 1e-9), 0), 1) AS t FROM pt JOIN ln USING (map_id)),
d AS (SELECT point_id, line_id, round(sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2), 9) AS d FROM t),
near AS (SELECT point_id, min(line_id) AS line_id, min(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY point_id) AS m FROM d) WHERE d = m GROUP BY point_id)"""

ORACLES = {
    "round_windows": f"WITH {_ROUNDS} SELECT demo, round, start, stop, freeze_tick FROM rounds",
    "assign_rounds": f"""WITH {_ROUNDS} SELECT event_id, ev.demo, tick, coalesce(round, -1) AS round, CAST(tick - start AS DOUBLE) AS seconds_into_round, CAST(tick - freeze_tick AS DOUBLE) AS seconds_after_freeze
FROM ev LEFT JOIN rounds r ON ev.demo = r.demo AND tick >= start AND tick < stop WHERE event_type IN ('click', 'view')""",
    "global_rounds": f"WITH {_ROUNDS} SELECT demo % 2 AS map_id, demo, round, row_number() OVER (PARTITION BY demo % 2 ORDER BY demo, round) - 1 AS round_index FROM rounds",
    "behaviour_grid": f"WITH {_GRID} SELECT * FROM g",
    "moves": f'WITH {_PLACED} SELECT map_id, from_row, from_col, "row", col, count(*) AS moves FROM steps GROUP BY ALL',
    "coarse_grid": f"""WITH {_GRID}, oc AS (SELECT map_id, "row", col, count(*) FILTER (side = 'CT') AS occupancy_ct, count(*) FILTER (side = 'T') AS occupancy_t FROM smp GROUP BY ALL),
sp AS (SELECT map_id, r.range AS "row", c.range AS col FROM (SELECT DISTINCT map_id FROM smp), range(16) r, range(16) c)
SELECT map_id, "row", col, coalesce(kills, 0) AS kills, coalesce(kills_ct, 0) AS kills_ct, coalesce(kills_t, 0) AS kills_t, coalesce(occupancy_ct, 0) AS occupancy_ct, coalesce(occupancy_t, 0) AS occupancy_t
FROM sp LEFT JOIN k USING (map_id, "row", col) LEFT JOIN oc USING (map_id, "row", col)""",
    "top_cells": f'WITH {_GRID} SELECT map_id, place, "row", col, occ_all FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY occ_all DESC, "row", col) AS place FROM g) WHERE place <= 8',
    "territory": f"""WITH {_GRID} SELECT map_id, count(*) FILTER (occ_ct > 0 AND occ_t = 0) AS ct_only, count(*) FILTER (occ_t > 0 AND occ_ct = 0) AS t_only, count(*) FILTER (occ_t > 0 AND occ_ct > 0) AS "both",
count(*) FILTER (kills > 0) AS with_kills, count(*) FILTER (occ_all > 0) AS with_occupancy, CAST(floor(sum(flow) / 2) AS BIGINT) AS moves FROM g GROUP BY map_id""",
    "count_by_side": f"WITH {_PLACED} SELECT map_id, coalesce(side, 'none') AS side, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM kil GROUP BY ALL",
    "volume_grid": """SELECT CAST(floor(l_extendedprice / 5000) AS BIGINT) AS "row", CAST(floor(l_quantity / 5) AS BIGINT) AS col, count(*) AS occ_all, count(*) FILTER (l_returnflag = 'A') AS occ_ct,
count(*) FILTER (l_returnflag = 'R') AS occ_t, count(DISTINCT l_orderkey) AS visits_rounds FROM lineitem GROUP BY ALL""",
    "correlations": f"""WITH {_PARTS}, k AS (SELECT *, rank() OVER (PARTITION BY brand ORDER BY x) + (count(*) OVER (PARTITION BY brand, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY brand ORDER BY y) + (count(*) OVER (PARTITION BY brand, y) - 1) / 2 AS ry FROM p)
SELECT brand, count(*) AS n, CASE WHEN count(*) >= 8 THEN round(corr(x, y), 6) END AS pearson_r, CASE WHEN count(*) >= 8 THEN round(corr(rx, ry), 6) END AS spearman_rho FROM k GROUP BY brand""",
    "linregress": f"""WITH {_PARTS} SELECT brand, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r, round(corr(x, y) ** 2, 6) AS r2,
round(sqrt((1 - corr(x, y) ** 2) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2)), 6) AS stderr, round({tail_sql('corr(x, y)', 'count(*) - 2')}, 6) AS p FROM p GROUP BY brand""",
    "intelligibility": f"WITH {_PARTS} SELECT brand, count(*) AS n, round(corr(x, y), 6) AS r, round(corr(ln(x), ln(y)), 6) AS log_r, round(corr(x, y) ** 2, 6) AS r2, round(corr(ln(x), ln(y)) ** 2, 6) AS log_r2, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round({tail_sql('corr(x, y)', 'count(*) - 2')}, 6) AS p FROM p WHERE x > 0 AND y > 0 GROUP BY brand",
    "hotspots": f"""WITH {_PARTS}, q AS (SELECT brand, quantile_cont(x, 0.9) AS mq, quantile_cont(y, 0.9) AS bq FROM p GROUP BY brand)
SELECT brand, count(*) AS n, count(*) FILTER (x >= mq) AS hot_metric, count(*) FILTER (y >= bq) AS hot_behaviour, count(*) FILTER (x >= mq AND y >= bq) AS overlap,
round(quantile_cont(x, 0.5) FILTER (y >= bq), 6) AS metric_in_hot, round(quantile_cont(x, 0.5), 6) AS metric_in_all, round(quantile_cont(y, 0.5) FILTER (x >= mq), 6) AS behaviour_in_hot, round(quantile_cont(y, 0.5), 6) AS behaviour_in_all,
round(count(*) FILTER (x >= mq) * count(*) FILTER (y >= bq) / count(*), 6) AS expected FROM p JOIN q USING (brand) GROUP BY brand, mq, bq""",
    "top_share": f"""WITH {_PARTS}, k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY y DESC, id) AS place, count(*) OVER (PARTITION BY brand) AS n FROM p)
SELECT brand, count(*) FILTER (place <= greatest(floor(n * 0.05), 1)) AS k, round(sum(y) FILTER (place <= greatest(floor(n * 0.05), 1)) / sum(y), 6) AS share FROM k GROUP BY brand""",
    "decile_curve": f"""WITH {_PARTS}, k AS (SELECT *, ntile(10) OVER (PARTITION BY brand ORDER BY x, id) AS tile FROM p)
SELECT brand, tile, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(stddev_samp(y) / sqrt(count(*)), 6) AS se FROM k GROUP BY brand, tile""",
    "cumulative_share": f"""WITH {_PARTS}, k AS (SELECT *, row_number() OVER w AS place, sum(y) OVER w AS run, count(*) OVER (PARTITION BY brand) AS n, sum(y) OVER (PARTITION BY brand) AS total FROM p WINDOW w AS (PARTITION BY brand ORDER BY x DESC, id))
SELECT brand, CAST(percent AS BIGINT) AS percent, round(run / total, 6) AS share FROM k, (SELECT unnest([10, 20, 30, 50]) AS percent) WHERE place = greatest(round_even(n * percent / 100, 0), 1)""",
    "metric_summary": f"""WITH {_PARTS}, m AS (SELECT brand, 'x' AS metric, x AS v FROM p UNION ALL SELECT brand, 'y', y FROM p)
SELECT brand, metric, round(min(v), 6) AS "min", round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS "max" FROM m GROUP BY brand, metric""",
    "histogram": f"""WITH {_PARTS}, s AS (SELECT brand, min(x) AS lo, max(x) AS hi, count(x) AS n FROM p GROUP BY brand HAVING max(x) > min(x))
SELECT brand, CAST(least(floor((x - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS "count", round(count(*) / n / ((hi - lo) / 40), 6) AS density FROM p JOIN s USING (brand) GROUP BY brand, bin, n, hi, lo""",
    "visibility_edges": f"WITH {_SEEN} SELECT map_name, r, c, r2, c2 FROM edges",
    "connectivity": f"WITH {_SEEN} SELECT map_name, r, c, count(*) AS connectivity FROM edges GROUP BY map_name, r, c",
    "integration": f"""WITH RECURSIVE {_SEEN}, {_HOPS}, {_INTEGRATION} SELECT map_name, r, c, round(v, 6) AS integration_hh FROM integ""",
    "closed_cells": f"WITH {_CELLS}, dil AS (SELECT DISTINCT map_name, r + i AS r, c + j AS c FROM w, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) {_ERODE.format('dil')}",
    "eroded_cells": f"WITH {_CELLS} {_ERODE.format('w')}",
    "nearest_segment": f"WITH {_NEAR} SELECT point_id, line_id, round(d, 6) AS distance FROM near",
    "line_density": f"""WITH {_NEAR}, m AS (SELECT line_id, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * 0.01905 AS m FROM ln), c AS (SELECT line_id, count(*) AS n FROM near GROUP BY line_id),
l AS (SELECT line_id, coalesce(n, 0) AS crossfire, CASE WHEN m > 0 THEN m ELSE 1e-9 END AS m FROM m LEFT JOIN c USING (line_id))
SELECT line_id, crossfire, round(m, 4) AS length_m, round(crossfire / m, 4) AS crossfire_per_m FROM l""",
    "page_slugs": """WITH l AS (SELECT page_id, url, list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS d, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS a FROM pages)
SELECT page_id, len(d)::BIGINT AS n_links, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS links,
substr(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1), '[^\\pL\\pM\\pN_]+', '-', 'g'), 1, 60) AS slug FROM l""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
