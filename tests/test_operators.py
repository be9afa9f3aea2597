import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundplan.operators import coords, frames, graphs, grid, kernels, ordering, records, space, statistics
from groundplan.plans import QUERIES
from groundplan.sources import tables
from groundplan.sources.folders import checkpoints, written


# ---- graphs: five shapes ---------------------------------------------------------------------------------------------


def shape(name):
    mask = np.zeros((41, 41), bool)
    if name == "room":
        mask[:21, :21] = True
    elif name == "corridor":
        mask[15, :31] = True
    elif name == "cross":
        mask[20, 5:36] = mask[5:36, 20] = True
    elif name == "l":
        mask[5, 2:20] = mask[5:22, 19] = True
    else:
        mask[2:19, 2:19] = mask[2:19, 22:39] = True
        mask[10, 19:22] = True
    return list(zip(*(x.tolist() for x in np.nonzero(mask))))


@pytest.fixture(scope="module")
def shapes(spark):
    """Connectivity, integration and choice by shape and cell."""
    names = ["room", "corridor", "cross", "l", "rooms"]
    cells = spark.createDataFrame([(n, r, c) for n in names for r, c in shape(n)], "map_name string, r long, c long")
    edges = space.visibility_edges(cells).checkpoint() if checkpoints(spark) else None
    key = ["map_name", "r", "c"]
    out = space.connectivity(edges).join(space.integration_hh(space.distance_sums(edges), cells), key).join(space.choice(edges), key)
    found = {n: {} for n in names}
    for x in out.collect():
        found[x.map_name][x.r, x.c] = x
    return found


def test_room(shapes):
    assert {x.connectivity for x in shapes["room"].values()} == {440} and len({x.integration_hh for x in shapes["room"].values()}) == 1


def test_corridor(shapes):
    assert sum(x.connectivity for x in shapes["corridor"].values()) == 930
    assert {(x.choice, x.integration_hh) for x in shapes["corridor"].values()} == {(0.0, math.inf)}


def test_cross(shapes):
    got = shapes["cross"]
    assert sum(x.connectivity for x in got.values()) == 1884
    assert max(got, key=lambda k: got[k].choice) == (20, 20) and math.isclose(got[20, 20].choice, 732.2667, abs_tol=1e-4)
    assert math.isinf(got[20, 20].integration_hh) and math.isclose(min(x.integration_hh for x in got.values()), 6.931, abs_tol=1e-3)


def test_l(shapes):
    got = shapes["l"]
    assert sum(x.connectivity for x in got.values()) == 580
    assert max(got, key=lambda k: got[k].choice) == (5, 19) and got[5, 19].choice == 255.5
    assert math.isclose(min(x.integration_hh for x in got.values()), 5.2287, abs_tol=1e-4)


def test_rooms(shapes):
    got = shapes["rooms"]
    assert sum(x.connectivity for x in got.values()) == 174_812
    top = sorted(got, key=lambda k: -got[k].choice)[:5]
    assert all(r == 10 and 15 <= c < 26 for r, c in top)
    assert math.isclose(got[10, 19].choice, 1028.8775, abs_tol=1e-4) and math.isclose(got[10, 19].integration_hh, 17.7638, abs_tol=1e-4)
    assert got[10, 19].choice > got[10, 20].choice
    assert math.isclose(min(x.integration_hh for x in got.values()), 9.4975, abs_tol=1e-4)


def test_maps_larger_than_a_task_give_the_same(spark):
    """Maps of over 60 nodes go by parts of their matrix, step by step; no task has more than a part of the sources and a part of the rows."""
    mask = np.ones((18, 17), bool)
    mask[5, :12] = mask[11, 5:] = mask[12:16, 8] = False
    mask[3, 15] = mask[2, 15] = False
    rows = [("big", int(r), int(c)) for r, c in zip(*np.nonzero(mask))] + [("big", 40, 40), ("big", 40, 41)] + [("small", 0, c) for c in range(9)] + [("one", 3, 3)]
    blocks = space.visibility_blocks(spark.createDataFrame(rows, "map_name string, r long, c long"), 4)
    same = lambda f: [sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in x) for x in f(w).collect()), key=str) for w in (graphs.WHOLE, 60)]
    for f in (
        lambda w: space.hop_distance(blocks, w), lambda w: space.metric_distance(blocks, 16, w), lambda w: space.distance_sums(blocks, None, w), lambda w: space.distance_sums(blocks, 16, w),
        lambda w: space.choice(blocks, w), lambda w: space.choice_sampled(blocks, 50, "x", w),
    ):
        whole, parts = same(f)
        assert whole == parts and len(whole) > 100
    n = len(rows) - 10
    large = graphs.Large(blocks.where("n > 60"))
    parts = large.rows.selectExpr("octet_length(bits) AS b", "at").collect()
    row = -(-n // 8)
    blocks_in_map = -(-n // graphs.BLOCK)
    assert len(parts) == min(graphs.GROUPS, blocks_in_map) and sum(x.b for x in parts) == n * row and max(x.b for x in parts) <= row * graphs.BLOCK * -(-blocks_in_map // graphs.GROUPS)
    state = graphs._hop_states(large)[0]
    assert state.count() == graphs.GROUPS and state.selectExpr("max(octet_length(x)) AS b").first().b <= row * -(-n // graphs.GROUPS)


def test_all_sources_give_the_choice_itself(spark):
    cells = spark.createDataFrame([("m", r, c) for r in range(7) for c in range(7) if (r, c) != (3, 3)], "map_name string, r long, c long")
    blocks = space.visibility_blocks(cells)
    exact = {(x.r, x.c): x.choice for x in space.choice(blocks).collect()}
    for k in (48, 1000):
        got = space.choice_sampled(blocks, k).collect()
        assert all(math.isclose(x.choice, exact[x.r, x.c], abs_tol=1e-9) and x.standard_error == 0 for x in got) and len(got) == 48
    some = space.choice_sampled(blocks, 12, "a").collect()
    assert any(x.standard_error > 0 for x in some) and sum(x.choice for x in some) > 0
    assert {x.standard_error for x in space.choice_sampled(blocks, 1).collect()} == {None}


def test_shortest_lengths_equal_plain_relaxation():
    rng = np.random.default_rng(4)
    for k in range(6):
        mask = rng.random((9, 11)) > 0.12 * k
        cells = np.argwhere(mask)
        a = kernels.visible(cells, 0, len(cells), 50)
        want = np.where(a, np.hypot(*(cells[:, None] - cells[None]).transpose(2, 0, 1)), np.inf)
        np.fill_diagonal(want, 0)
        for v in range(len(cells)):
            want = np.minimum(want, want[:, v, None] + want[v])
        got = kernels.Turns(a, cells).distances(np.arange(len(cells)))
        assert (np.isinf(got) == np.isinf(want)).all() and np.allclose(np.where(np.isinf(got), 0, got), np.where(np.isinf(want), 0, want), atol=1e-9)


def test_a_chain_of_many_hops(spark):
    n = 90
    chain = spark.createDataFrame([("a", i, 0, j, 0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "map_name string, r long, c long, r2 long, c2 long")
    got = {(x.r, x.r2): x.d for x in space.hop_distance(chain).collect()}
    assert got == {(i, j): abs(i - j) for i in range(n) for j in range(n) if i != j}
    metric = {(x.r, x.r2): x.d for x in space.metric_distance(chain, 2).collect()}
    assert all(math.isclose(metric[k], 2 * got[k]) for k in got) and len(metric) == len(got)


def test_small_and_split_maps(spark):
    edges = spark.createDataFrame([("a", 0, 0, 0, 1), ("a", 5, 5, 5, 6), ("a", 5, 6, 5, 7)], "map_name string, r long, c long, r2 long, c2 long")
    cells = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 5, 5), ("a", 5, 6), ("a", 5, 7), ("b", 1, 1), ("b", 1, 2)], "map_name string, r long, c long")
    got = {(x.map_name, x.r, x.c): x.integration_hh for x in space.integration_hh(space.distance_sums(edges), cells).collect()}
    mean = lambda *d: sum(d) / 4  # noqa: E731  pairs without a path count as the longest path, 2
    dn = 2 * (5 * (math.log2(7 / 3) - 1) + 1) / 12
    assert math.isclose(got["a", 0, 0], dn / (2 * (mean(1, 2, 2, 2) - 1) / 3)) and math.isclose(got["a", 5, 6], dn / (2 * (mean(1, 1, 2, 2) - 1) / 3))
    assert math.isnan(got["b", 1, 1])
    assert space.hop_distance(edges.limit(0)).count() == 0 and space.visibility_edges(cells.limit(0)).count() == 0


def test_nearest_segment_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    lines = [(int(i % 2), int(i), *map(float, rng.integers(-50, 200, 4))) for i in range(300)] + [(0, 900, 5.0, 5.0, 5.0, 5.0), (0, 901, 5.0, 5.0, 5.0, 5.0)]
    points = [(int(i % 3), int(i), *map(float, rng.normal(60, 120, 2))) for i in range(400)] + [(0, 999, None, 1.0), (0, 998, 5.0, 5.0)]
    got = {x.point_id: (x.line_id, x.distance) for x in space.nearest_segment(spark.createDataFrame(points, "map_id long, point_id long, px double, py double"), spark.createDataFrame(lines, "map_id long, line_id long, x1 double, y1 double, x2 double, y2 double")).collect()}

    def distance(px, py, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = min(max(((px - x1) * dx + (py - y1) * dy) / max(dx * dx + dy * dy, 1e-9), 0), 1)
        return round(math.hypot(px - x1 - t * dx, py - y1 - t * dy), 9)

    want = {i: min((distance(px, py, *c), n) for q, n, *c in lines if q == m)[::-1] for m, i, px, py in points if m < 2 and px is not None}
    assert got == want


def test_long_lines_pass_few_squares_and_crowded_ones_are_cut(spark):
    schema = "map_name string, line_id long, x1 double, y1 double, x2 double, y2 double"
    long = spark.createDataFrame([("m", 1, 0.0, 0.0, 4096.0, 4096.0), ("m", 2, 0.0, 0.0, 0.0, 4096.0), ("m", 3, 7.0, -3.0, 7.0, -3.0)], schema)
    count = {x.line_id: x["count"] for x in space._squares(long, 16).groupBy("line_id").count().collect()}
    assert count[1] <= 3 * 257 and count[2] == 257 and count[3] == 1
    rng = np.random.default_rng(9)
    lines = [("m", int(i), *map(float, np.round(rng.normal(100, 60, 4) if i % 3 else rng.integers(90, 120, 4)))) for i in range(150)]
    lines += [("m", 900, 16.0, 16.0, 32.0, 16.0), ("m", 901, 32.0, 16.0, 32.0, 64.0), ("m", 902, 24.0, 16.0, 24.0, 16.0), ("m", 903, 16.0, 16.0, 48.0, 16.0), ("n", 904, 16.0, 16.0, 48.0, 16.0)]

    def turn(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    def meet(s, t):
        a, b, c, d = s[:2], s[2:], t[:2], t[2:]
        box = all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1))
        return box and turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0

    want = {(p[1], q[1]) for p in lines for q in lines if p[1] != q[1] and p[0] == q[0] and meet(p[2:], q[2:])}
    df = spark.createDataFrame(lines, schema)
    for crowd in (256, 20):
        assert {(x.r, x.r2) for x in space.line_contacts(df, 16, crowd).collect()} == want


@pytest.fixture
def broadcast_rows(spark):
    """A function that gives the rows of each broadcast since it was last called."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    every = lambda found: [found.apply(k) for k in range(found.size())]
    seen = set()

    def since():
        bus.waitUntilEmpty()
        out = []
        for k in {e.executionId() for e in every(store.executionsList())} - seen:
            seen.add(k)
            values = store.executionMetrics(k)
            rows = [m for n in every(store.planGraph(k).allNodes()) if n.name() == "BroadcastExchange" for m in every(n.metrics()) if m.name() == "number of output rows"]
            out += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in rows if values.contains(m.accumulatorId())]
        return out

    since()
    return since


def test_line_graph_broadcasts_no_table_of_lines_or_contacts(spark, broadcast_rows):
    """What a file or the output of a task's Python unpacks to is far larger than Spark takes it for; the driver must not get these rows."""
    maps, own = 320, 4
    lines = [(f"m{k}", own * k + i, float(i), 0.0, float(i % 3), 9.0) for k in range(maps) for i in range(own)]
    df = spark.createDataFrame(lines, "map_name string, line_id long, x1 double, y1 double, x2 double, y2 double")
    got = space.line_graph(df, written(space.line_contacts(df), "contacts")).collect()
    sent = broadcast_rows()
    assert all(x <= maps for x in sent), sent
    # line 3 touches line 0 and crosses 1 and 2, which are parallel
    assert len(got) == maps * own and {(x.line_id % own, x.connectivity) for x in got} == {(0, 1), (1, 1), (2, 1), (3, 3)}


def test_states_of_larger_maps_are_not_broadcast(spark, broadcast_rows):
    n = 80
    band = [(m, i, 0, j, 0) for m in ("a", "b") for i in range(n) for j in (*range(i - 30, i), *range(i + 1, i + 31)) if 0 <= j < n]
    blocks = written(graphs.blocks_of(spark.createDataFrame(band, "map_name string, r long, c long, r2 long, c2 long"), 16), "blocks")
    broadcast_rows()
    for found in (space.distance_sums(blocks, None, 60), space.choice(blocks, 60)):
        assert found.count() == 2 * n
    assert broadcast_rows() == []


def test_many_small_maps_take_few_tasks(spark):
    edges = spark.createDataFrame([(f"m{k}", 0, 0, 1, 0) for k in range(1600)], "map_name string, r long, c long, r2 long, c2 long")
    blocks = written(graphs.blocks_of(edges), "blocks")
    for found in (space.distance_sums(blocks), graphs._shares(blocks, graphs.WHOLE)):
        assert found.rdd.getNumPartitions() <= 8 and found.count() == 3200


def test_scan_lines_equal_crossing_counts(spark):
    rng = np.random.default_rng(11)
    shapes = [[tuple(map(float, p)) for p in np.round(rng.uniform(-8, 30, (n, 2)), rng.integers(0, 3))] for n in (3, 4, 5, 9, 30, 2)]
    shapes += [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(0.5, 0.5), (4.5, 0.5), (4.5, 3.5), (0.5, 3.5)], [(1.0, 1.0), (5.0, 1.0), (9.0, 1.0)]]
    df = spark.createDataFrame([(f"m{k}", s) for k, s in enumerate(shapes)], "map_name string, corners array<struct<x: double, y: double>>")
    for cell in (1.0, 2.5):
        want = set()
        for k, s in enumerate(shapes):
            for r in range(-20, 40):
                for c in range(-20, 40):
                    x, y = (c + 0.5) * cell, (r + 0.5) * cell
                    odd = sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in zip(s, s[1:] + s[:1])) % 2
                    if odd and len(s) > 2:
                        want.add((f"m{k}", r, c))
        assert {tuple(x) for x in space.rasterise(df, cell).collect()} == want


def test_simplify_equals_a_plain_recursion(spark):
    def plain(p):
        if len(p) < 3:
            return p
        (x1, y1), (x2, y2) = p[0], p[-1]
        d = [abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / (math.hypot(x2 - x1, y2 - y1) or 1.0) for x, y in p[1:-1]]
        k = max(range(len(d)), key=d.__getitem__)
        return plain(p[: k + 2])[:-1] + plain(p[k + 1 :]) if d[k] > 3 else [p[0], p[-1]]

    rng = np.random.default_rng(1)
    polylines = {k: [tuple(map(float, p)) for p in rng.integers(0, 40, (n, 2))] for k, n in enumerate((1, 2, 3, 30, 200))}
    rows = [(k, i, *p) for k, line in polylines.items() for i, p in enumerate(line)]
    got = {}
    for x in space.simplify(spark.createDataFrame(rows, "polyline long, place long, x double, y double"), 3).orderBy("polyline", "place").collect():
        got.setdefault(x.polyline, []).append((x.x, x.y))
    assert got == {k: plain(v) for k, v in polylines.items()}


# ---- statistics ------------------------------------------------------------------------------------------------------


def test_p_values(spark):
    def p(t, free):
        r = t / math.sqrt(t * t + free)
        return spark.range(1).select(statistics.correlation_tail(F.lit(r), F.lit(free)).alias("p")).first().p

    t, n = 20.679044253704944 / 13.912414050907168, 156  # a fixed value: slope, its error and p of a regression of the goldens
    assert math.isclose(p(t, n - 2), 0.1392247594525253, rel_tol=1e-9)
    # one degree of freedom: the arctangent; two: a root
    assert np.allclose([p(x, 1) for x in (0.0, 0.5, 3.0, 50.0)], [1 - 2 / math.pi * math.atan(x) for x in (0, 0.5, 3, 50)])
    assert np.allclose([p(x, 2) for x in (0.0, 0.5, 3.0, 50.0)], [1 - x / math.sqrt(2 + x * x) for x in (0, 0.5, 3, 50)])
    # many degrees: the sum, and the normal tail of a transformed t beside it
    for x in (0.3, 1.7, 4.2):
        assert abs(p(x, statistics.SUMMED) - p(x, statistics.SUMMED + 2)) < 1e-8 and abs(p(x, 10**9) - math.erfc(x / math.sqrt(2))) < 1e-9
    assert p(40.0, 10**6) == 0
    df = spark.createDataFrame([(0.0, 10), (1.0, 10), (None, 10), (0.5, 2), (-0.5, 3), (-1.0, 4)], "r double, n long")
    got = [x.p for x in statistics.with_p_value(df, "r", "n", "p").collect()]
    assert got[0] == 1 and got[1] < 1e-15 and got[5] < 1e-15 and got[2:4] == [None, None] and math.isclose(got[4], 1 - 2 / math.pi * math.atan(0.5 / math.sqrt(0.75)))


def test_correlations_of_columns_with_nulls(spark):
    rng = np.random.default_rng(7)
    rows = [("g", k, float(rng.integers(0, 9)), float(rng.normal()), None if k % 2 else float(rng.integers(0, 5)), 3.0) for k in range(40)] + [("h", k, 1.0 * k, 2.0 * k, None, 1.0) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, k long, a double, b double, c double, flat double")
    got = {(x.g, x.behaviour, x.metric): (x.n, x.spearman_rho, x.pearson_r) for x in statistics.correlation_matrix(df, ["a", "c"], ["b", "c", "flat"], ["g"]).collect()}
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["g", "k", "a", "b", "c", "flat"])
    assert len(got) == 12 and got["g", "a", "b"][0] == 40 and got["h", "a", "c"] == (0, None, None) and got["g", "a", "flat"][1:] == (None, None)
    for x, y in (("a", "b"), ("a", "c"), ("c", "b")):
        own = frame[frame.g == "g"][[x, y]].dropna()
        n, rho, r = got["g", x, y]
        assert n == len(own) and math.isclose(r, own[x].corr(own[y])) and math.isclose(rho, own[x].rank().corr(own[y].rank()))
    assert math.isclose(got["h", "a", "b"][1], 1)


def test_correlation_p_query(spark):
    got = QUERIES["correlation_p"](spark, "/root/testdata/sf0.01").collect()
    assert all((x.pearson_p is None) == (x.pearson_r is None) and (x.pearson_p is None or 0 <= x.pearson_p <= 1) for x in got) and any(x.pearson_p for x in got)


def test_constant_sides_and_few_rows(spark):
    df = spark.createDataFrame([("a", float(i), 1.0) for i in range(9)] + [("b", float(i), float(i)) for i in range(3)] + [("c", None, 2.0)], "g string, x double, y double")
    got = {x.g: (x.n, x.pearson_r, x.spearman_rho) for x in statistics.correlations(df, "x", "y", ["g"]).collect()}
    assert got == {"a": (9, None, None), "b": (3, None, None)}
    assert {x.g: x.r for x in statistics.linregress(df, "x", "y", ["g"]).collect()}["a"] is None


def test_seeded_sample_is_the_same_and_whole(spark, monkeypatch):
    df = spark.range(200).selectExpr("id", "id % 3 AS g")
    a, b = (sorted(tuple(x) for x in records.sample_rows(d, "id", ["g"], 7).collect()) for d in (df, df.repartition(5)))
    assert a == b and len(a) == 21 and records.sample_rows(df, "id", ["g"], 500).count() == 200
    assert "WindowGroupLimit" in records.sample_rows(df, "id", ["g"], 7)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(records, "LIMITED", 3)
    assert sorted(tuple(x) for x in records.sample_rows(df, "id", ["g"], 7).collect()) == a
    least = sorted((hashlib.md5(f"1|{i}".encode()).hexdigest(), i) for i in range(0, 200, 3))[:7]
    assert sorted(i for _, i in least) == [i for i, g in a if g == 0]


def test_sums_of_flow_and_territory(spark):
    moves, cells = (QUERIES[k](spark, "/root/testdata/sf0.001").collect() for k in ("moves", "behaviour_grid"))
    assert 2 * sum(x.moves for x in moves) == sum(x.flow for x in cells)


def test_places_in_one_group_that_is_spread_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.choice([*np.round(rng.normal(size=40), 2)], 3000)
    rows = [("a", int(k), float(x), float(k % 7)) for k, x in enumerate(v)] + [(None, -1, 2.0, 1.0), (None, -2, 1.0, None), ("b", -3, None, 5.0)]
    df = spark.createDataFrame(rows, "g string, id long, v double, w double").repartition(6)
    seen, real_one = [], ordering.written
    monkeypatch.setattr(ordering, "written", lambda d, n: seen.append(real_one(d, n)) or seen[-1])
    names = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, x in names.items():
            spark.conf.set(k, x)
        got = ordering.with_places(df, ["g"], [F.desc("v"), "id"], "w").withColumn("tile", ordering.tile(11)).collect()
        q = {x.g: (x.low, x.mid, x.top) for x in ordering.quantiles(df, "v", ["g"], {"low": 0.0, "mid": 0.5, "top": 0.937}).collect()}
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    ranges = seen[0].where("g = 'a'").groupBy("_range").count().collect()
    assert len(ranges) >= 7 and max(x["count"] for x in ranges) < 1000
    order = sorted((r for r in rows if r[0] == "a"), key=lambda r: (-r[2], r[1]))
    tiles = [k for k, part in enumerate(np.array_split(np.arange(len(order)), 11), 1) for _ in part]
    want = {r[1]: (k, len(order), sum(x[3] for x in order[:k]), t) for k, (r, t) in enumerate(zip(order, tiles), 1)}
    assert {x.id: (x.place, x.n, x.run, x.tile) for x in got if x.g == "a"} == want and {x.total for x in got if x.g == "a"} == {sum(r[3] for r in order)}
    assert sorted((x.id, x.place, x.n, x.run) for x in got if x.g is None) == [(-2, 2, 2, 1.0), (-1, 1, 2, 1.0)]
    assert set(q) == {"a", None} and np.allclose(q["a"], np.quantile(v, [0, 0.5, 0.937])) and np.allclose(q[None], [1, 1.5, 1.937])


# ---- coordinates -----------------------------------------------------------------------------------------------------


def test_world_to_pixel_and_back(spark):
    df = spark.createDataFrame([("m", -2476.0, 3239.0, 4.4, 100.0, -50.0), ("m", -2476.0, 3239.0, 4.4, None, 1.0)], "map_name string, pos_x double, pos_y double, scale double, x double, y double")
    got = coords.to_cell(coords.px_to_world(coords.world_to_px(df), "px", "py", "bx", "by"), 16, 64, 64).collect()
    assert math.isclose(got[0].px, 2576 / 4.4) and math.isclose(got[0].py, 3289 / 4.4) and math.isclose(got[0].bx, 100) and math.isclose(got[0].by, -50)
    assert (got[0].row, got[0].col, got[0].inside) == (46, 36, True) and (got[1].col, got[1].inside) == (None, False)


def test_forms_round_trip(spark):
    u, v = frames.from_frame(1024)
    df = spark.createDataFrame([(0.2, 0.7)], "u double, v double")
    got = frames.to_frame(df, "u", "v", 1024).select("form", "px", "py", u.alias("bu"), v.alias("bv")).collect()
    assert len(got) == 8 == len({(x.px, x.py) for x in got}) and all(math.isclose(x.bu, 0.2) and math.isclose(x.bv, 0.7) for x in got)


# ---- sources and sinks -----------------------------------------------------------------------------------------------


def test_tables_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1, 0.5), ("m2", 2, None), ("m1", 3, 1.5)], "map_name string, id long, v double")
    rows = sorted(map(tuple, df.collect()), key=str)
    tables.write_by_map(df, f"file://{tmp_path}/p", "id")
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["map_name=m1", "map_name=m2"]
    assert sorted(map(tuple, tables.read_table(spark, f"file://{tmp_path}/p", df.schema).select(df.columns).collect()), key=str) == rows
    tables.write_csv(df, f"file://{tmp_path}/c")
    assert sorted(map(tuple, tables.read_metrics_csv(spark, f"file://{tmp_path}/c", df.schema).collect()), key=str) == rows
    tables.write_json(df, f"file://{tmp_path}/j", ["map_name"], "demos")
    assert sorted(map(tuple, tables.read_meta(spark, f"file://{tmp_path}/j", "map_name string, demos array<struct<id: long, v: double>>", whole=False).collect()), key=str) == rows
    (tmp_path / "meta.json").write_text('{\n "map": "m1",\n "demos": [{"id": 1},\n {"id": 2}]}')
    assert [tuple(x) for x in tables.read_meta(spark, f"file://{tmp_path}/meta.json").collect()] == [("m1", 1), ("m1", 2)]


def test_key_values(spark):
    text = '"pos_x"  "-3230"\n"scale"\t"5.00" "pos_y" "1713"\n"material" "x"\n"pos_x" "7"'
    got = tables.first_key_values(tables.parse_key_values(spark.createDataFrame([(text,)], "t string"), "t"), "t").first()
    assert got["values"] == {"pos_x": 7.0, "scale": 5.0, "pos_y": 1713.0} and (got.pos_x, got.scale, got.rotate) == (-3230.0, 5.0, None)
    assert tables.parse_key_values(spark.createDataFrame([("",), (None,)], "t string"), "t").count() == 2
    with pytest.raises(Exception, match="no pos_y"):
        tables.first_key_values(spark.createDataFrame([('"pos_x" "1" "scale" "1"',)], "t string"), "t").collect()


def test_file_inventory(spark, tmp_path):
    (tmp_path / "b" / "c").mkdir(parents=True)
    (tmp_path / "b" / "c" / "x.dem").write_bytes(b"abc")
    (tmp_path / "a.dem").write_bytes(b"z")
    (tmp_path / "empty.dem").write_bytes(b"")
    (tmp_path / "b" / "y.txt").write_bytes(b"no")
    (tmp_path / "b" / "é x.dem").write_bytes(b"\x00" * 5000)
    want = [("a.dem", b"z"), ("x.dem", b"abc"), ("é x.dem", b"\x00" * 5000), ("empty.dem", b"")]
    for limit in (1 << 30, 2):  # all at once, or all but one in parts
        out = tables.file_inventory(spark, f"file://{tmp_path}", limit=limit).collect()
        assert [(x.path.rsplit("/", 1)[1], x.size_bytes, x.sha256) for x in out] == [(n, len(b), hashlib.sha256(b).hexdigest()) for n, b in want]
    sizes = [(x.path.rsplit("/", 1)[1], x.size_bytes, x.sha256) for x in tables.file_inventory(spark, f"file://{tmp_path}", hashed=False).collect()]
    assert sizes == [(n, len(b), None) for n, b in want]


# ---- records ---------------------------------------------------------------------------------------------------------


def test_names_of_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Integration [HH]` long, ` Choice  [Norm]` long, `x-y_` long")
    assert records.snake_columns(df).columns == ["integration_hh", "choice_norm", "x_y"]
    df = spark.createDataFrame([(1, 2, 3, 4)], "CCSPlayer_X long, other_X long, Z long, a_health long")
    assert records.unprefix(df).columns == ["X", "other_X", "Z", "health"]


def test_wrong_map_fails(spark):
    df = spark.createDataFrame([("m1", 1), ("m2", 2)], "map_name string, id long")
    assert records.assert_same_map(records.only_map(df, "m1"), "m1").count() == 1
    with pytest.raises(Exception, match="expected map m1, got m2"):
        records.assert_same_map(df, "m1").collect()


def test_labels(spark):
    df = spark.createDataFrame([("/d/demos/a/1_x.dem",), ("/d\\PUG_9\\2.dem",), ("else.dem",)], "path string").withColumn("demo", records.demo_id("path", "/d"))
    assert [tuple(x) for x in df.select("demo", records.source_label("demo"), records.source_label("demo", "own")).collect()] == [("demos/a/1_x", "pro", "own"), ("PUG_9/2", "pug", "own"), ("else", "unknown", "own")]
    assert spark.range(1).select(records.slug(F.lit("http://x.y/a/tëam_1--vs  b!")).alias("s")).first().s == "tëam_1-vs-b-"


def test_heat_of_one_point(spark):
    got = {(x.px, x.py): x.heat for x in coords.heat(spark.createDataFrame([("m", 0.5, 10.2), ("m", -1.0, 3.0)], "map_name string, px double, py double"), ["map_name"], 32, 2).collect()}
    assert max(got, key=got.get) == (0, 10) and got[0, 10] == 1 and min(got.values()) >= 0.05 and math.isclose(got[0, 9], got[0, 11])


def test_grid_counts_without_sides(spark):
    df = spark.createDataFrame([(0, 1, 1, 0, 1, 2, 5.0), (0, 1, 1, 0, 2, 9, None)], "map_id long, row long, col long, demo long, round long, team_num int, seconds_after_freeze double")
    assert [tuple(x) for x in grid.presence(df).collect()] == [(0, 1, 1, 2, 0, 1, 1, 2)]
