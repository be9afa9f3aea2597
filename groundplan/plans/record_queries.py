"""Queries on rounds, recordings, match pages, manifests and correlations, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.operators import coords, frames, grid, records, rounds, statistics
from groundplan.plans.driver_queries import _GRID, _PARTS, _PLACED, _ROUNDS, _parts, _placed, _round, _rounds, behaviour_grid, tail_sql
from groundplan.sources import recordings as rec
from groundplan.sources import tables
from groundplan.sources.folders import new_folder

# ---- rounds and samples ----------------------------------------------------------------------------------------------


def sample_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rec.game_events(spark, sf_dir)
    return rounds.sample_ticks(_placed(ev), _rounds(ev), 4).select("event_id", "demo", "round", "tick")


def post_freeze_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.post_freeze_ticks(_rounds(rec.game_events(spark, sf_dir)), 15, 4, 1)


def sample_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rec.game_events(spark, sf_dir)
    return rounds.sample_at_offset(rec.samples(ev).select("event_id", "demo", "tick"), _rounds(ev), 3)


def early_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.early_samples(_placed(rec.game_events(spark, sf_dir)), 120).select("event_id", "round")


def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.occupancy(_placed(rec.game_events(spark, sf_dir)))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.flow(_placed(rec.game_events(spark, sf_dir)))


def visits_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.visits(_placed(rec.game_events(spark, sf_dir)))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(grid.coverage(behaviour_grid(spark, sf_dir)), "share")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rec.game_events(spark, sf_dir).selectExpr("map_id", "event_type", "CASE WHEN event_id % 7 = 0 THEN 'none' ELSE cast(x AS string) END AS x", "y")
    return grid.ranges(ev, ["x", "y"], ["map_id", "event_type"])


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = rec.read(spark, sf_dir, "events").selectExpr("user_id", "CASE event_type WHEN 'signup' THEN 'round_start' WHEN 'purchase' THEN 'player_death' ELSE event_type END AS event_name")
    return records.complete_matches(records.event_counts(ev, ["user_id"]), 2)


def side_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = rec.read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "1 + p_size % 4 AS attacker_team_num", "1 + p_partkey % 4 AS user_team_num")
    return records.add_side(part, ("attacker_", "user_", "assister_")).select("id", "attacker_side", "user_side")


def live_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rec.tracks(spark, sf_dir).withColumn("x", F.expr("CASE WHEN id % 7 = 0 THEN 'bad' WHEN id % 11 <> 0 THEN cast(x AS string) END"))
    return records.to_double(records.live_samples(rows), ["x", "y"]).select("id", "x", "y", "team_num")


# ---- recordings and pages --------------------------------------------------------------------------------------------


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = "CASE o_orderstatus WHEN 'F' THEN 'demos' WHEN 'O' THEN 'Pug_2024' ELSE 'misc' END"
    return rec.read(spark, sf_dir, "orders").selectExpr("o_orderpriority AS map_name", f"concat('/data/', {top}, '\\\\', o_orderkey, '_x.dem') AS path", "o_orderkey", "o_custkey % 40 AS rounds", "o_orderkey % 90 AS kills", "o_custkey * 10 AS rows", "cast(floor(o_totalprice) AS bigint) AS size_bytes")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recordings(spark, sf_dir).withColumn("demo_id", records.demo_id("path", "/data"))
    return rows.withColumns({"source": records.source_label("demo_id"), "path": F.col("demo_id")})


def recording_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("o_orderkey", "demo_id", "source", records.match_id(F.element_at(F.split("demo_id", "/"), -1)).alias("match_id"))


def source_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.source_roots(_labelled(spark, sf_dir))


def map_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.map_totals(_labelled(spark, sf_dir))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    geometry = rec.map_cells(spark, sf_dir).groupBy("map_name").agg(F.count("*").alias("cells"))
    behaviour = rec.tracks(spark, sf_dir).where("x > 9000").groupBy("map_name").agg(F.count("*").alias("samples"))
    return records.inventory(geometry, behaviour)


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_rows(rec.read(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "weapon", "o_orderstatus"], ["o_orderdate", "o_orderkey"])


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.sample_rows(rec.read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", ["p_brand"], 12)


def union_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rec.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "c_mktsegment AS segment")
    return records.union_frames(a, rec.read(spark, sf_dir, "supplier").selectExpr("cast(s_nationkey AS bigint) AS nation", "s_suppkey AS id", "s_acctbal AS balance"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match pages, one for each order, some without a recording, an event or a number."""
    return rec.read(spark, sf_dir, "orders").selectExpr(
        "concat(CASE WHEN o_orderkey % 13 = 0 THEN '/other/' ELSE '/matches/' END, o_orderkey, '/a-b') AS link",
        """concat('<div class="mapname"> ', CASE o_custkey % 3 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE 'Gamma' END, ' </div><div class="mapname">', CASE o_orderkey % 2 WHEN 0 THEN 'Alpha' ELSE 'Delta' END, '</div>',
        CASE WHEN o_orderkey % 5 <> 0 THEN concat('<a data-demo-link="/download/demo/', o_orderkey * 7, '">') ELSE '' END, CASE WHEN o_orderkey % 4 <> 0 THEN concat('<div class="event text-ellipsis">', o_orderpriority, ' Cup</div>') ELSE '' END,
        '<div class="date" data-x="1"> day ', o_orderkey % 30, ' </div><div class="teamName a">Reds</div><div class="teamName">', o_orderstatus, '</div><div class="teamName">Reds</div>') AS html""",
    )


def parse_match_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_match_page(_pages(spark, sf_dir)).withColumn("maps", F.array_join("maps", ","))


def select_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = rec.read(spark, sf_dir, "nation").groupBy(F.expr("CASE WHEN n_regionkey < 2 THEN 'map_a' ELSE 'map_b' END").alias("map_name")).agg(F.count("*").alias("have"))
    found = records.select_candidates(records.parse_match_page(_pages(spark, sf_dir)), have, {"map_a": "Alpha", "map_b": "Beta"}, 60, ("urgent", "high"))
    return found.withColumn("wanted", F.array_join("wanted", ","))


def parse_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """concat('"pos_x"  "-', s_nationkey, '"\\n"scale" "', s_suppkey % 7, '.5"\\n"name" "x"\\n"pos_y"\\t"', s_suppkey, '"\\n"pos_x" "', s_suppkey, '"') AS text"""
    rows = tables.parse_key_values(tables.first_key_values(rec.read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", text), "text"), "text")
    return rows.select("id", "pos_x", "pos_y", "scale", "rotate", F.col("values")["pos_x"].alias("last_pos_x"), F.size("values").cast("long").alias("n"))


# ---- tables written and read again -----------------------------------------------------------------------------------


def map_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rec.tracks(spark, sf_dir).select("id", "map_name", "x", "y", "health")
    tables.write_by_map(rows, path := new_folder(spark, "by-map"), "id")
    return tables.read_table(spark, path, rows.schema)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rec.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    tables.write_csv(rows, path := new_folder(spark, "csv"))
    return records.snake_columns(tables.read_metrics_csv(spark, path, rows.schema).withColumnRenamed("p_name", " P Name [x]"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select("map_name", "demo_id", "rounds", "size_bytes")
    tables.write_json(rows, path := new_folder(spark, "json"), ["map_name"], "demos")
    schema = "map_name string, demos array<struct<demo_id: string, rounds: long, size_bytes: long>>"
    return tables.read_meta(spark, path, schema, whole=False)


# ---- correlations ----------------------------------------------------------------------------------------------------


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS map_name", "p_type AS source", "cast(p_size AS double) AS a", "cast(p_partkey * 7 % 101 AS double) AS b", "p_retailprice / 3 AS u", "cast(p_size * p_partkey % 37 AS double) AS v", "1.0D AS flat")


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.correlation_matrix(_metrics(spark, sf_dir), ["a", "b"], ["u", "v", "flat"], ["map_name"]), "spearman_rho", "pearson_r")


def correlation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.correlation_matrix(_metrics(spark, sf_dir), ["a", "b"], ["u", "v", "flat"], ["map_name"])
    found = statistics.with_p_value(statistics.with_p_value(found, "spearman_rho", "n", "spearman_p"), "pearson_r", "n", "pearson_p")
    return _round(found, "spearman_rho", "pearson_r", "spearman_p", "pearson_p")


def correlation_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with nulls: each pair goes over the rows where both are known."""
    holes = _metrics(spark, sf_dir).withColumns({"u": F.expr("CASE WHEN id % 3 <> 0 THEN u END"), "b": F.expr("CASE WHEN id % 5 <> 0 THEN b END")})
    return _round(statistics.correlation_matrix(holes, ["a", "b"], ["u", "v"], ["map_name"]), "spearman_rho", "pearson_r")


def source_comparison_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["ECONOMY", "SMALL"]
    found = statistics.correlation_matrix(_metrics(spark, sf_dir).where(F.col("source").isin(kinds)), ["a", "b"], ["u", "v"], ["map_name", "source"])
    out = statistics.source_comparison(found, ["map_name"], kinds, values={"spearman_rho": "rho", "pearson_r": "r"})
    return _round(out, *(f"{k}_{v}" for k in kinds for v in ("rho", "r")))


def flow_in_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow and visits of samples in walkable cells only: the others leave before samples are paired."""
    placed = _placed(rec.game_events(spark, sf_dir)).withColumn("map_name", F.col("map_id").cast("string"))
    cells = rec.event_cells(spark, sf_dir)
    inside = coords.in_grid(placed, cells)
    return grid.visits(inside).join(grid.flow(inside), ["map_id", "row", "col"], "left").fillna(0, ["flow"])


def prefixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "p_partkey AS CCSPlayerPawn_X, p_size AS pawn_Y, p_size + 1 AS other_Y, p_partkey % 7 AS Z, p_partkey % 5 AS body_Z, p_partkey % 100 AS m_iHealth_health, p_brand AS name"
    return records.unprefix(rec.read(spark, sf_dir, "part").selectExpr(*names.split(", ")))


def one_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one map, with the guard that fails at any other."""
    tracks = rec.tracks(spark, sf_dir).select("id", "map_name", "x", "y")
    return records.assert_same_map(records.only_map(tracks, "n7"), "n7")


def source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["ECONOMY", "SMALL"]
    found = statistics.correlation_matrix(_metrics(spark, sf_dir).where(F.col("source").isin(kinds)), ["a", "b"], ["u", "v"], ["map_name", "source"])
    return _round(statistics.source_comparison(found, ["map_name"], kinds), *kinds)


def metric_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.metric_correlations(_metrics(spark, sf_dir), [("a", "u"), ("a", "v"), ("b", "u")], ["map_name"], 75), "a_vs_u", "a_vs_v", "b_vs_u")


def compare_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.compare_maps(_metrics(spark, sf_dir), ["a", "u"], ("a", "u"), "v", "id", ["map_name"])
    return _round(out, *(c for c in out.columns if c not in ("map_name", "cells")))


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(frames.configuration(_metrics(spark, sf_dir), "a", "u", "id", ["map_name"], "b", "v"), "low", "high", "ratio", "rho", "r", "choice_rho", "count_rho")


def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(statistics.histogram(_parts(spark, sf_dir), "x", ["brand"], 17, log_shift=True), "density")


# ---- SQL -------------------------------------------------------------------------------------------------------------

_TRACKED = "tr AS (SELECT c_custkey AS id, 'n' || c_nationkey AS map_name, c_acctbal AS x, (c_custkey * 37 % 9973)::DOUBLE AS y, c_custkey % 5 AS health, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 3 WHEN 'FURNITURE' THEN 3 ELSE 1 END AS team_num FROM customer)"
_LABELLED = """re AS (SELECT o_orderpriority AS map_name, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'demos' WHEN 'O' THEN 'Pug_2024' ELSE 'misc' END AS top, CASE o_orderstatus WHEN 'F' THEN 'pro' WHEN 'O' THEN 'pug' ELSE 'unknown' END AS source,
o_custkey % 40 AS rounds, o_orderkey % 90 AS kills, o_custkey * 10 AS n_rows, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders)"""
_PAGES = """pg AS (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN '/other/' || o_orderkey || '/a-b' ELSE CAST(o_orderkey AS VARCHAR) END AS match_id, CASE o_custkey % 3 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE 'Gamma' END AS m1, CASE o_orderkey % 2 WHEN 0 THEN 'Alpha' ELSE 'Delta' END AS m2,
CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 7 AS VARCHAR) END AS demo_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority || ' Cup' ELSE '' END AS event FROM orders)"""
_METRICS = "me AS (SELECT p_partkey AS id, p_brand AS map_name, p_type AS source, p_size::DOUBLE AS a, (p_partkey * 7 % 101)::DOUBLE AS b, p_retailprice / 3 AS u, (p_size * p_partkey % 37)::DOUBLE AS v FROM part)"


def _ranks(columns: str, by: str = "map_name") -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2 AS r{c}"
    return f"rk AS (SELECT *, {', '.join(map(rank, columns))} FROM me)"


def _pairs(pairs: list[tuple[str, str]], by: str = "map_name", exact: bool = False) -> str:
    if exact:
        return _pairs(pairs, by).replace("round(corr(", "(corr(").replace("), 6)", "))")
    return " UNION ALL ".join(f"SELECT {by}, '{b}' AS behaviour, '{m}' AS metric, count(*) AS n, " + ("NULL::DOUBLE AS spearman_rho, NULL::DOUBLE AS pearson_r" if m == "flat" else f"CASE WHEN count(*) >= 8 THEN round(corr(r{b}, r{m}), 6) END AS spearman_rho, CASE WHEN count(*) >= 8 THEN round(corr({b}, {m}), 6) END AS pearson_r") + f" FROM rk GROUP BY {by}" for b, m in pairs)


#: Columns of _METRICS with nulls.
_HOLES = {"u": "CASE WHEN id % 3 <> 0 THEN u END", "b": "CASE WHEN id % 5 <> 0 THEN b END"}

ORACLES = {
    "sample_lattice": f"WITH {_PLACED} SELECT event_id, p.demo, p.round, p.tick FROM placed p JOIN rounds r ON p.demo = r.demo AND p.round = r.round WHERE (p.tick - r.start) % 4 = 0",
    "post_freeze_ticks": f"WITH {_ROUNDS} SELECT demo, round, unnest(range(freeze_tick + 4, freeze_tick + 4 + 15, 4)) AS tick FROM rounds WHERE freeze_tick IS NOT NULL",
    "sample_at_offset": f"WITH {_ROUNDS} SELECT event_id, ev.demo, ev.tick, round AS of_round FROM ev JOIN rounds r ON ev.demo = r.demo AND ev.tick = freeze_tick + 3 WHERE event_type IN ('click', 'view')",
    "early_samples": f"WITH {_PLACED} SELECT event_id, round FROM placed WHERE after BETWEEN 0 AND 120",
    "occupancy": f'WITH {_GRID} SELECT map_id, "row", col, occ_all, occ_ct, occ_t, occ_early FROM o',
    "flow": f'WITH {_GRID} SELECT map_id, "row", col, flow FROM f',
    "visits_rounds": f'WITH {_GRID} SELECT map_id, "row", col, visits_rounds FROM o',
    "coverage": f"WITH {_GRID} SELECT map_id, count(*) FILTER (occ_all > 0) AS with_occupancy, round(count(*) FILTER (occ_all > 0) / count(*), 6) AS share, CAST(floor(sum(flow) / 2) AS BIGINT) AS moves FROM g GROUP BY map_id",
    "ranges": f"WITH {_ROUNDS} SELECT map_id, event_type, min(x) FILTER (event_id % 7 <> 0) AS min_x, max(x) FILTER (event_id % 7 <> 0) AS max_x, min(y) AS min_y, max(y) AS max_y FROM ev GROUP BY ALL",
    "event_counts": "SELECT user_id, count(*) FILTER (event_type = 'signup') AS rounds, count(*) FILTER (event_type = 'purchase') AS kills FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'signup') >= 2",
    "side_labels": "SELECT p_partkey AS id, CASE 1 + p_size % 4 WHEN 2 THEN 'T' WHEN 3 THEN 'CT' END AS attacker_side, CASE 1 + p_partkey % 4 WHEN 2 THEN 'T' WHEN 3 THEN 'CT' END AS user_side FROM part",
    "live_samples": f"WITH {_TRACKED} SELECT id, x, y, team_num FROM tr WHERE health > 0 AND team_num IN (2, 3) AND id % 7 <> 0 AND id % 11 <> 0",
    "recording_labels": f"WITH {_LABELLED} SELECT o_orderkey, top || '/' || o_orderkey || '_x' AS demo_id, source, CAST(o_orderkey AS VARCHAR) AS match_id FROM re",
    "source_roots": f"WITH {_LABELLED} SELECT map_name, array_to_string(list_sort(list(DISTINCT top)), ', ') AS roots FROM re GROUP BY map_name",
    "map_totals": f"""WITH {_LABELLED} SELECT map_name, count(*) AS demo_count, CAST(sum(rounds) AS BIGINT) AS rounds, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(n_rows) AS BIGINT) AS "rows", CAST(sum(size_bytes) AS BIGINT) AS bytes_total,
arg_min(source, top || '/' || o_orderkey || '_x') AS source FROM re GROUP BY map_name""",
    "inventory": f"""WITH {_TRACKED}, g AS (SELECT map_name, count(*) AS cells FROM (SELECT DISTINCT 'n' || l_suppkey % 25 AS map_name, l_partkey % 16, floor(l_quantity / 5) FROM lineitem) GROUP BY map_name)
SELECT map_name, cells, samples FROM g LEFT JOIN (SELECT map_name, count(*) AS samples FROM tr WHERE x > 9000 GROUP BY map_name) USING (map_name)""",
    "first_rows": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 6",
    "union_frames": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, CAST(s_nationkey AS BIGINT), NULL, s_acctbal FROM supplier",
    "parse_match_page": f"""WITH {_PAGES} SELECT CASE WHEN o_orderkey % 13 = 0 THEN '/other/' ELSE '/matches/' END || o_orderkey || '/a-b' AS link, match_id, m1 || ',' || m2 AS maps, demo_id, event, 'day ' || o_orderkey % 30 AS date, 'Reds vs ' || o_orderstatus AS teams FROM pg""",
    "select_candidates": f"""WITH {_PAGES}, h AS (SELECT CASE WHEN n_regionkey < 2 THEN 'map_a' ELSE 'map_b' END AS map_name, count(*) AS have FROM nation GROUP BY ALL),
x AS (SELECT match_id, map_name FROM pg, (VALUES ('map_a', 'Alpha'), ('map_b', 'Beta')) AS l(map_name, label) WHERE demo_id IS NOT NULL AND (lower(event) LIKE '%urgent%' OR lower(event) LIKE '%high%') AND label IN (m1, m2)),
y AS (SELECT *, row_number() OVER (PARTITION BY map_name ORDER BY match_id) AS k FROM x)
SELECT match_id, array_to_string(list_sort(list(map_name)), ',') AS wanted FROM y JOIN h USING (map_name) WHERE have + k <= 60 GROUP BY match_id""",
    "parse_key_values": "SELECT s_suppkey AS id, (-s_nationkey)::DOUBLE + 0.0 AS pos_x, s_suppkey::DOUBLE AS pos_y, s_suppkey % 7 + 0.5::DOUBLE AS scale, NULL::DOUBLE AS rotate, s_suppkey::DOUBLE AS last_pos_x, 3::BIGINT AS n FROM supplier",
    "map_round_trip": f"WITH {_TRACKED} SELECT id, map_name, x, y, health FROM tr",
    "csv_round_trip": "SELECT p_partkey, p_name AS p_name_x, p_retailprice FROM part",
    "json_round_trip": f"WITH {_LABELLED} SELECT map_name, top || '/' || o_orderkey || '_x' AS demo_id, rounds, size_bytes FROM re",
    "correlation_matrix": f"WITH {_METRICS}, {_ranks('abuv')} {_pairs([(b, m) for b in 'ab' for m in ('u', 'v', 'flat')])}",
    "correlation_nulls": f"WITH {_METRICS}, " + ", ".join(f"h{b}{m} AS (SELECT map_name, x, y, rank() OVER (PARTITION BY map_name ORDER BY x) + (count(*) OVER (PARTITION BY map_name, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY map_name ORDER BY y) + (count(*) OVER (PARTITION BY map_name, y) - 1) / 2 AS ry FROM (SELECT map_name, {_HOLES.get(b, b)} AS x, {_HOLES.get(m, m)} AS y FROM me) WHERE x IS NOT NULL AND y IS NOT NULL)" for b in "ab" for m in "uv")
    + " " + " UNION ALL ".join(f"SELECT map_name, '{b}' AS behaviour, '{m}' AS metric, count(*) AS n, CASE WHEN count(*) >= 8 THEN round(corr(rx, ry), 6) END AS spearman_rho, CASE WHEN count(*) >= 8 THEN round(corr(x, y), 6) END AS pearson_r FROM h{b}{m} GROUP BY map_name" for b in "ab" for m in "uv"),
    "correlation_p": f"WITH {_METRICS}, {_ranks('abuv')}, c AS ({_pairs([(b, m) for b in 'ab' for m in ('u', 'v', 'flat')], exact=True)}) SELECT map_name, behaviour, metric, n, round(spearman_rho, 6) AS spearman_rho, round(pearson_r, 6) AS pearson_r, round({tail_sql('spearman_rho', 'n - 2')}, 6) AS spearman_p, round({tail_sql('pearson_r', 'n - 2')}, 6) AS pearson_p FROM c",
    "source_comparison_r": f"""WITH {_METRICS}, {_ranks('abuv', 'map_name, source')}, p AS ({_pairs([(b, m) for b in 'ab' for m in 'uv'], 'map_name, source')})
SELECT map_name, behaviour, metric, max(spearman_rho) FILTER (source = 'ECONOMY') AS ECONOMY_rho, max(pearson_r) FILTER (source = 'ECONOMY') AS ECONOMY_r, max(spearman_rho) FILTER (source = 'SMALL') AS SMALL_rho, max(pearson_r) FILTER (source = 'SMALL') AS SMALL_r
FROM p WHERE source IN ('ECONOMY', 'SMALL') GROUP BY map_name, behaviour, metric""",
    "flow_in_grid": f"""WITH {_PLACED}, gc AS (SELECT DISTINCT map_id, "row", col FROM kil WHERE "row" IS NOT NULL AND col IS NOT NULL), ins AS (SELECT placed.* FROM placed SEMI JOIN gc USING (map_id, "row", col)),
lg AS (SELECT *, tick - lag(tick) OVER w AS gap, lag("row") OVER w AS from_row, lag(col) OVER w AS from_col FROM ins WINDOW w AS (PARTITION BY demo, player, round ORDER BY tick, event_id)),
st AS (SELECT * FROM lg WHERE gap > 0 AND gap <= 480 AND (from_row <> "row" OR from_col <> col)), fl AS (SELECT map_id, "row", col, count(*) AS flow FROM (SELECT map_id, "row", col FROM st UNION ALL SELECT map_id, from_row, from_col FROM st) GROUP BY ALL),
vi AS (SELECT map_id, "row", col, count(DISTINCT (demo, round)) AS visits_rounds FROM ins GROUP BY ALL) SELECT map_id, "row", col, visits_rounds, coalesce(flow, 0) AS flow FROM vi LEFT JOIN fl USING (map_id, "row", col)""",
    "sample_rows": "SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('1|' || p_partkey), p_partkey) <= 12",
    "prefixed_columns": 'SELECT p_partkey AS "X", p_size AS "Y", p_size + 1 AS "other_Y", p_partkey % 7 AS "Z", p_partkey % 5 AS "body_Z", p_partkey % 100 AS health, p_brand AS name FROM part',
    "one_map": "SELECT c_custkey AS id, 'n7' AS map_name, c_acctbal AS x, (c_custkey * 37 % 9973)::DOUBLE AS y FROM customer WHERE c_nationkey = 7",
    "source_comparison": f"""WITH {_METRICS}, {_ranks('abuv', 'map_name, source')}, p AS ({_pairs([(b, m) for b in 'ab' for m in 'uv'], 'map_name, source')})
SELECT map_name, behaviour, metric, max(spearman_rho) FILTER (source = 'ECONOMY') AS ECONOMY, max(spearman_rho) FILTER (source = 'SMALL') AS SMALL FROM p WHERE source IN ('ECONOMY', 'SMALL') GROUP BY map_name, behaviour, metric""",
    "metric_correlations": f"WITH {_METRICS} SELECT map_name, count(*) AS n, round(corr(a, u), 6) AS a_vs_u, round(corr(a, v), 6) AS a_vs_v, round(corr(b, u), 6) AS b_vs_u FROM me GROUP BY map_name HAVING count(*) > 75",
    "compare_maps": f"""WITH {_METRICS}, k AS (SELECT *, row_number() OVER (PARTITION BY map_name ORDER BY v DESC, id) AS place, count(*) OVER (PARTITION BY map_name) AS n FROM me)
SELECT map_name, count(*) AS cells, round(quantile_cont(a, 0.5), 6) AS a_median, round(avg(a), 6) AS a_mean, round(quantile_cont(a, 0.95), 6) AS a_p95, round(quantile_cont(u, 0.5), 6) AS u_median, round(avg(u), 6) AS u_mean, round(quantile_cont(u, 0.95), 6) AS u_p95,
round(corr(a, u), 6) AS pair_corr, round(sum(v) FILTER (place <= greatest(floor(n * 0.05), 1)) / sum(v), 6) AS top_share FROM k GROUP BY map_name""",
    "experiment": f"""WITH {_METRICS}, {_ranks('abuv')}, k AS (SELECT *, row_number() OVER (PARTITION BY map_name ORDER BY a, id) AS place, count(*) OVER (PARTITION BY map_name) AS n FROM rk),
m AS (SELECT map_name, count(*) AS n, avg(u) FILTER (place <= greatest(n // 5, 1)) AS low, avg(u) FILTER (place > n - greatest(n // 5, 1)) AS high, corr(ra, ru) AS rho, corr(a, u) AS r, corr(rb, ru) AS choice_rho, corr(ra, rv) AS count_rho FROM k GROUP BY map_name)
SELECT map_name, n, round(low, 6) AS low, round(high, 6) AS high, round(high / nullif(low, 0), 6) AS ratio, round(rho, 6) AS rho, round(r, 6) AS r, round(choice_rho, 6) AS choice_rho, round(count_rho, 6) AS count_rho FROM m""",
    "log_histogram": f"""WITH {_PARTS}, l AS (SELECT brand, log10(x - min(x) OVER (PARTITION BY brand) + 1) AS x FROM p), s AS (SELECT brand, min(x) AS lo, max(x) AS hi, count(x) AS n FROM l GROUP BY brand HAVING max(x) > min(x))
SELECT brand, CAST(least(floor((x - lo) / ((hi - lo) / 17)), 16) AS BIGINT) AS bin, count(*) AS "count", round(count(*) / n / ((hi - lo) / 17), 6) AS density FROM l JOIN s USING (brand) GROUP BY brand, bin, n, hi, lo""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
