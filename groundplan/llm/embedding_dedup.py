"""Near duplicates of embeddings: int8 tile products with an error bound per vector, then full precision for what may be linked.

A unit vector u is held as scale * q with q in int8; its error |u - scale * q| is known, so a product of two such vectors differs
from the cosine by at most e_u * (1 + e_v) + e_v * (1 + e_u) + e_u * e_v. Tiles are multiplied, and only pairs whose product
could reach the threshold within that bound are computed again in double precision: no pair is lost, none is wrong.

Equal vectors are one class from the start. The classes are dealt into blocks by hash; block i meets blocks i .. i + G/2 (around the
circle), so every two blocks meet once and all have the same work. A tile gives the number of links of each vector and
a spanning forest of its links, never the list of all pairs within a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, saved, table

#: Vectors of a block: at most about this many, and fewer while that leaves under BLOCKS blocks.
BLOCK, BLOCKS = 32768, 24
#: Partners of a block that one task meets.
CHUNK = 4
ROWS, COLUMNS = 1024, 2048


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, padded with zeros; lengths), all valid."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(lengths), lengths.max(initial=0)))
    x[np.arange(x.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return x, lengths


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, scales, errors): |u - scale * q| <= error."""
    scale = (np.abs(u).max(axis=1) / 127).astype(np.float32)
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - scale[:, None].astype(np.float64) * q) ** 2).sum(axis=1))


def _blocks(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    x, lengths = vectors_of(t.column("v").chunk(0))
    q, scale, error = quantised(unit_vectors(x))
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    full = single if (single == x).all() else x  # vectors that were given in single precision travel in it
    parts = {"ids": t.column("rep").to_numpy(), "weights": t.column("w").to_numpy(), "lengths": lengths, "q": q, "scale": scale, "error": error, "full": full}
    return pa.table({"block": t.column("block").slice(0, 1)} | {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in parts.items()})


FIELDS = "ids binary, weights binary, lengths binary, q binary, scale binary, error binary, full binary"
TYPES = {"ids": np.int64, "weights": np.int64, "lengths": np.int64, "q": np.int8, "scale": np.float32, "error": np.float64, "full": np.uint8}


class Block:
    def __init__(self, row: dict, suffix: str):
        got = {k: np.frombuffer(row[k + suffix], t) for k, t in TYPES.items()}
        self.ids, self.weights, self.lengths, self.error = got["ids"], got["weights"], got["lengths"], got["error"]
        n = len(self.ids)
        q = got["q"].reshape(n, -1)
        self.unit = unit_vectors(got["full"].view(np.float32 if got["full"].nbytes == 4 * q.size else np.float64).reshape(q.shape).astype(np.float64))
        self.q, self.scale = q, got["scale"]


def linked(a: Block, b: Block, rows: slice, columns: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all pairs of the tile with cosine >= least."""
    d = min(a.q.shape[1], b.q.shape[1])
    # products of int8 values; single precision adds such integers exactly up to 1,040 dimensions, and the slack covers more
    product = a.q[rows, :d].astype(np.float32) @ b.q[columns, :d].astype(np.float32).T
    sa, sb = a.scale[rows], b.scale[columns]
    ea, eb = a.error[rows], b.error[columns]
    slack = (d + 8) * 2.0**-22  # rounding of the products
    bound = lambda x, y: least - x * (1 + y) - y * (1 + x) - x * y - slack
    if not product.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = bound(ea, eb.max())
    some = np.flatnonzero(product.max(axis=1) >= (low - slack) / (sa * np.where(low < slack, sb.min(), sb.max())))  # only rows that may hold a link are scaled
    r, c = np.nonzero(product[some] * sa[some][:, None] * sb >= bound(ea[some][:, None], eb[None, :]))
    r, c = some[r] + rows.start, c + columns.start
    ok = np.zeros(len(r), bool)
    for i in range(0, len(r), 1 << 15):
        part = slice(i, i + (1 << 15))
        ok[part] = np.einsum("ij,ij->i", a.unit[r[part], :d], b.unit[c[part], :d]) >= least
    ok &= a.lengths[r] == b.lengths[c]
    return r[ok], c[ok]


def forest(r: np.ndarray, c: np.ndarray) -> list[tuple[int, int]]:
    """Few (row, column) pairs that connect what the pairs given connect: at most twice the rows and columns."""
    rows, r1 = np.unique(r, return_inverse=True)
    columns, c1 = np.unique(c, return_inverse=True)
    if len(r) <= 2 * (len(rows) + len(columns)):
        return list(zip(r.tolist(), c.tolist(), strict=True))
    grid = np.zeros((len(rows), len(columns)), bool)
    grid[r1, c1] = True
    out, open_ = [], np.ones(len(rows), bool)
    for i in range(len(rows)):
        if not open_[i]:
            continue
        new, seen = np.array([i]), np.zeros(len(columns), bool)
        open_[i] = False
        while len(new):
            reached = grid[new]
            fresh = np.flatnonzero(reached.any(axis=0) & ~seen)
            if not len(fresh):
                break
            out += [(rows[new[k]], columns[j]) for j, k in zip(fresh, reached[:, fresh].argmax(axis=0), strict=True)]
            seen[fresh] = True
            found = grid[:, fresh] & open_[:, None]
            new = np.flatnonzero(found.any(axis=1))
            out += [(rows[k], columns[fresh[j]]) for k, j in zip(new, found[new].argmax(axis=1), strict=True)]
            open_[new] = False
    return out


def _tiles(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b, same = Block(row, ""), Block(row, "_b"), row["i"] == row["j"]
                na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
                edges: list[tuple[int, int]] = []
                for i in range(0, len(a.ids), ROWS):
                    for j in range(i // COLUMNS * COLUMNS if same else 0, len(b.ids), COLUMNS):
                        r, c = linked(a, b, slice(i, min(i + ROWS, len(a.ids))), slice(j, min(j + COLUMNS, len(b.ids))), least)
                        if same:
                            r, c = r[r < c], c[r < c]
                        if len(r):
                            np.add.at(na, r, b.weights[c])
                            np.add.at(nb, c, a.weights[r])
                            edges += forest(r, c)
                counts = [(x.ids[k], None, n[k]) for x, n in ((a, na), (b, nb)) for k in np.flatnonzero(n)]
                out = counts + [(a.ids[p], b.ids[q], 0) for p, q in edges]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal length with a cosine of least or more are linked. Vectors that are null, empty, zero, or hold null or non-finite
    components are linked with nothing. Rows without a vec_id are left out; rows of equal vec_id must be equal and count as one vector, which
    gives one row. Columns other than vec_id and embedding are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = saved(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null").dropDuplicates(["vec_id"]), "vectors")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.coalesce(finite, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 to 0.0
    classes = saved(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")), "vector-classes")
    total = classes.count()
    g = max(-(-total // BLOCK), min(BLOCKS, -(-total // ROWS)), 1)
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(g)).cast("int"))
    blocks = saved(dealt.groupBy("block").applyInArrow(_blocks, f"block int, {FIELDS}"), "vector-blocks")

    # block i meets i, i + 1, .. around the circle; where G is even, the opposite one from one side only
    far = F.when((F.lit(g % 2 == 0)) & (F.col("i") >= g // 2), F.lit((g - 1) // 2)).otherwise(F.lit(g // 2))
    step = F.explode(F.sequence(F.lit(0), far)).alias("step")
    left = blocks.withColumnRenamed("block", "i").select("*", step).withColumn("j", F.pmod(F.col("i") + F.col("step"), F.lit(g))).withColumn("part", F.floor(F.col("step") / CHUNK)).drop("step")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g // 2 // CHUNK).cast("long"))).alias("part")
    right = blocks.select(F.col("block").alias("j"), *(F.col(c).alias(f"{c}_b") for c in TYPES), parts)
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(tasks, "j", "part").hint("shuffle_hash").join(right.repartition(tasks, "j", "part"), ["j", "part"])
    found = saved(pairs.mapInArrow(_tiles(least), "a long, b long, n long"), "vector-links")

    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "rep")
    of_class = classes.join(links, "rep", "left").join(roots, "rep", "left").select("v", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    key = rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))
    out = key.join(of_class, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_embedding_near_dedup": op5_embedding_near_dedup}
ORACLES = {
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM root LEFT JOIN n USING (vec_id)
"""
}
