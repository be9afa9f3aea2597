import numpy as np

from groundplan.llm import embedding_dedup
from groundplan.llm.embedding_dedup import forest, near_vectors, op5_embedding_near_dedup, quantised

from .helpers import SF, real, roots


def brute(rows, least=0.95):
    ok = {}
    for i, v in rows:
        x = None if v is None or any(y is None for y in v) else np.array(v, float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            ok[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least]
    root = roots([i for i, _ in rows], links)
    return {i: (sum(i in p for p in links), root[i], root[i] == i) for i, _ in rows}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark):
    e = real("embeddings")
    assert got(op5_embedding_near_dedup(spark, SF)) == brute(list(zip(e.vec_id, e.embedding)))


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [5.0, 0.1]), (10, [1.0, 0.0, 0.0]), (11, [1e200, 1e199]), (12, [0.0, -1.0]), (13, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as block", "2 as rep")
    assert got(near_vectors(df)) == brute(rows)
    assert got(near_vectors(df.union(df))) == brute(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_rows_without_an_id_leave(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01]), (None, None)]
    assert got(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute([rows[0], rows[2]])


def test_many_blocks_and_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(5)
    hub = rng.normal(size=8)
    x = np.vstack([rng.normal(size=(150, 8)), hub + 0.15 * rng.normal(size=(150, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (25, 43, 300):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        assert got(near_vectors(df)) == brute(rows)


def test_error_bound_and_forest():
    u = np.random.default_rng(1).normal(size=(200, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, s, e = quantised(u)
    near = q * s[:, None].astype(float)
    assert (np.abs(u @ u.T - near @ near.T) <= e[:, None] * (1 + e) + e * (1 + e[:, None]) + e * e[:, None] + 1e-12).all()
    r, c = np.nonzero(np.ones((30, 40), bool))
    few = forest(r, c)
    assert len(few) <= 140 and len(set(roots(range(70), [(a, 30 + b) for a, b in few]).values())) == 1
