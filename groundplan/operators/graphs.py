"""The graph of each map as blocks of rows of bits, and what is worked out on it.

A block is BLOCK rows of a map's adjacency matrix, a bit for each node, as a table row: (map_name, n, start, nodes, bits). It is made once,
by the visibility kernel or from edges, and written to the shared folder; all measures read it. Nodes are the sorted (r, c) of a map.

Maps of up to `whole` nodes are worked out in numpy, by GROUPS groups of sources, each in a task that has all bits of its map. Of larger maps
no task has more than two of GROUPS parts of the matrix: the rows of the sources' state (what they have reached so far) meet the rows
of the matrix part by part, in a join; each round of it is one step of all sources, and is written. What is shuffled for a step is
2 * GROUPS times the bits of the matrix, so it grows with them and not with their product by the number of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundplan.operators import kernels
from groundplan.sources.folders import written

#: Rows of a block.
BLOCK = 64
#: Nodes of a map that a task takes whole: two megabytes of bits.
WHOLE = 4096
#: Parts of a map's matrix, and of its sources.
GROUPS = 16

BLOCKS = "map_name string, n long, start long, nodes binary, bits binary"
KEY = ["map_name", "r", "c"]


# ---- blocks ----------------------------------------------------------------------------------------------------------


def _tasks(spark, rows: int, weight: float | None = None) -> int:
    """Tasks for so many rows that take about a second each. weight counts rows that are less work by less than one."""
    return max(1, min(rows, max(2 * spark.sparkContext.defaultParallelism, int(rows if weight is None else weight) // 16)))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _maps(cells: DataFrame) -> DataFrame:
    """(map_name, n, nodes): one row for each map."""
    longs = F.struct(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    sets = cells.groupBy("map_name").agg(F.array_sort(F.collect_set(longs)).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(1).slice(i, 1).flatten()
                nodes = np.stack([own.field(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).cast(pa.string()), pa.array([len(nodes)], pa.int64()), pa.array([nodes.tobytes()], pa.binary())], names=["map_name", "n", "nodes"])

    return written(sets.mapInArrow(run, "map_name string, n long, nodes binary"), "maps")


def _block(row: dict, start: int, matrix: np.ndarray) -> pa.RecordBatch:
    """A block of rows, given as booleans."""
    return pa.RecordBatch.from_arrays([pa.array([row["map_name"]], pa.string()), pa.array([row["n"]], pa.int64()), pa.array([start], pa.int64()), pa.array([row["nodes"]], pa.binary()), pa.array([np.packbits(matrix, axis=1).tobytes()], pa.binary())], names=["map_name", "n", "start", "nodes", "bits"])


def _nodes(row: dict) -> np.ndarray:
    return np.frombuffer(row["nodes"], np.int64).reshape(-1, 2)


def _bits(raw: bytes, n: int) -> np.ndarray:
    """Rows of booleans from rows of bits."""
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, -(-n // 8)), axis=1, count=n).astype(bool) if n else np.zeros((0, 0), bool)


def visibility_blocks(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of the graph of cells that see each other: every point of the straight line from one to the other, one per step of its longer side, is walkable.

    Lines are tried from both ends. A map's cells meet each other, nothing else does.
    """
    maps = _maps(cells)
    total = maps.agg(F.sum(F.ceil(F.col("n") / block))).first()[0] or 0
    starts = maps.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(block))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _block(row, row["start"], kernels.visible(_nodes(row), row["start"], min(row["start"] + block, row["n"])))

    return written(starts.repartition(_tasks(cells.sparkSession, total), "map_name", "start").mapInArrow(run, BLOCKS), "graph")


def blocks_of(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of a graph that is given as edges (map_name, r, c, r2, c2); they go both ways, and loops do not count. Blocks stay as they are."""
    if "bits" in edges.columns:
        return edges
    ends = lambda *c: edges.select("map_name", *(F.col(x).cast("long").alias(y) for x, y in zip(c, ("r", "c", "r2", "c2"))))
    both = ends("r", "c", "r2", "c2").union(ends("r2", "c2", "r", "c"))
    maps = _maps(both)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            nodes = _nodes(row)
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([pa.array([row["map_name"]] * n, pa.string()), pa.array(np.full(n, n)), *(pa.array(np.ascontiguousarray(x)) for x in nodes.T), pa.array(np.arange(n))], names=["map_name", "n", "r", "c", "i"])

    at = maps.mapInArrow(places, "map_name string, n long, r long, c long, i long")
    other = at.select("map_name", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("i").alias("j"))
    # merged: Spark takes the places for no larger than the compressed nodes that they are read from, and would broadcast them
    pairs = both.where("r <> r2 or c <> c2").join(at.hint("merge"), KEY).join(other.hint("merge"), ["map_name", "r2", "c2"]).select("map_name", "n", "i", "j", (F.col("i") - F.col("i") % block).alias("start"))

    def run(t: pa.Table) -> pa.Table:
        n, start = t.column("n")[0].as_py(), t.column("start")[0].as_py()
        matrix = np.zeros((min(block, n - start), n), bool)
        matrix[t.column("i").to_numpy() - start, t.column("j").to_numpy()] = True
        return pa.table({"map_name": t.column("map_name").slice(0, 1).cast(pa.string()), "start": pa.array([start], pa.int64()), "bits": pa.array([np.packbits(matrix, axis=1).tobytes()], pa.binary())})

    rows = pairs.groupBy("map_name", "start").applyInArrow(run, "map_name string, start long, bits binary")
    starts = maps.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(block))).alias("start"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            n = row["n"]
            yield _block(row, row["start"], _bits(row["bits"], n) if row["bits"] is not None else np.zeros((min(block, n - row["start"]), n), bool))

    return written(starts.join(rows.hint("merge"), ["map_name", "start"], "left").mapInArrow(fill, BLOCKS), "graph")


def _by_row(blocks: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, int], dict], schema: str) -> DataFrame:
    """kernel(rows of booleans, nodes, start) gives columns for each block; map_name goes in front of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            columns = kernel(_bits(row["bits"], row["n"]), _nodes(row), row["start"])
            size = len(next(iter(columns.values())))
            yield pa.RecordBatch.from_pydict({"map_name": pa.array([row["map_name"]] * size, pa.string()), **columns})

    return blocks.mapInArrow(run, f"map_name string, {schema}")


def edges_of(blocks: DataFrame) -> DataFrame:
    """(map_name, r, c, r2, c2), both ways."""

    def pairs(rows: np.ndarray, nodes: np.ndarray, start: int) -> dict:
        i, j = np.nonzero(rows)
        a, b = nodes[start + i], nodes[j]
        return {"r": a[:, 0], "c": a[:, 1], "r2": b[:, 0], "c2": b[:, 1]}

    return _by_row(blocks, pairs, "r long, c long, r2 long, c2 long")


def nodes_of(blocks: DataFrame) -> DataFrame:
    """(map_name, i, r, c): all nodes and their places."""

    def listed(rows: np.ndarray, nodes: np.ndarray, start: int) -> dict:
        own = nodes[start : start + len(rows)]
        return {"i": np.arange(start, start + len(rows)), "r": own[:, 0], "c": own[:, 1]}

    return _by_row(blocks, listed, "i long, r long, c long")


def connectivity(blocks: DataFrame) -> DataFrame:
    """The number of nodes beside each node that has any."""

    def degrees(rows: np.ndarray, nodes: np.ndarray, start: int) -> dict:
        k = rows.sum(axis=1)
        at = np.flatnonzero(k)
        return {"r": nodes[start + at, 0], "c": nodes[start + at, 1], "connectivity": k[at].astype(np.int64)}

    return _by_row(blocks_of(blocks), degrees, "r long, c long, connectivity long")


def isovist_perimeter(blocks: DataFrame) -> DataFrame:
    """For each cell, the cells it sees (itself included) whose neighbour against one of four directions it does not see, over all four."""

    def borders(rows: np.ndarray, nodes: np.ndarray, start: int) -> dict:
        at = nodes - nodes.min(axis=0) + 1
        h, w = at.max(axis=0) + 2
        out = np.zeros(len(rows), np.int64)
        for k, row in enumerate(rows):
            seen = np.zeros((h, w), bool)
            seen[tuple(at[row].T)] = seen[tuple(at[start + k])] = True
            for i, j in ((0, 1), (1, 0), (1, 1), (1, -1)):
                out[k] += np.count_nonzero(seen[1:-1, 1:-1] & ~seen[1 - i : h - 1 - i, 1 - j : w - 1 - j])
        own = nodes[start : start + len(rows)]
        return {"r": own[:, 0], "c": own[:, 1], "perimeter": out}

    return _by_row(blocks, borders, "r long, c long, perimeter long")


# ---- maps that a task takes whole ------------------------------------------------------------------------------------


def _by_source(small: DataFrame, prepare: Callable, schema: str, sources: DataFrame | None = None, groups: int = GROUPS, chunk: int = BLOCK) -> DataFrame:
    """prepare(adjacency, nodes) gives a kernel that gives columns for some sources, up to chunk at once; map_name goes in front of them.

    The sources of a map are dealt over up to so many groups. sources, if given, has (map_name, sources): the places of those that
    count, as bytes of long numbers.
    """
    groups = F.least(F.lit(groups), F.ceil(F.col("n") / BLOCK))
    # the groups of maps of under 1,024 nodes count less, so that many small maps don't take as many tasks
    weight = groups * F.greatest(F.lit(1 / 16), F.least(F.lit(1.0), F.col("n") / 1024))
    total, weight = (x or 0 for x in small.where("start = 0").agg(F.sum(groups), F.sum(weight)).first())
    copies = small.withColumn("groups", groups).withColumn("nodes", F.when(F.col("start") == 0, F.col("nodes")))
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    if sources is not None:
        copies = copies.join(sources, "map_name")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        n, part, groups = (t.column(k)[0].as_py() for k in ("n", "part", "groups"))
        nodes = np.frombuffer(t.column("nodes")[0].as_py(), np.int64).reshape(n, 2)
        adjacency = np.concatenate([_bits(x.as_py(), n) for x in t.column("bits")])
        own = np.arange(n) if "sources" not in t.column_names else np.frombuffer(t.column("sources")[0].as_py(), np.int64)
        own = own[part * len(own) // groups : (part + 1) * len(own) // groups]
        kernel, out = prepare(adjacency, nodes), []
        for k in range(0, max(1, len(own)), chunk):
            columns = kernel(own[k : k + chunk])
            size = len(next(iter(columns.values())))
            out.append(pa.table({"map_name": pa.array([t.column("map_name")[0].as_py()] * size, pa.string()), **columns}))
        return pa.concat_tables(out)

    return copies.repartition(_tasks(small.sparkSession, total, weight), "map_name", "part").groupBy("map_name", "part").applyInArrow(run, f"map_name string, {schema}")


# ---- larger maps -----------------------------------------------------------------------------------------------------

STATE = "map_name string, n long, part int, sources binary, x binary, known binary, more boolean"


class Large:
    """Steps of the sources of large maps. State: x, what each source hands on (sources x n), and known, what it has so far.

    Bits and states are written far smaller than they are, so they are merged, never broadcast; a map's nodes meet them part by part.
    """

    def __init__(self, blocks: DataFrame, sources: DataFrame | None = None):
        self.spark = blocks.sparkSession
        of = F.floor(F.floor(F.col("start") / BLOCK) * GROUPS / F.ceil(F.col("n") / BLOCK)).cast("int")
        self.maps = blocks.where("start = 0").select("map_name", "n", "nodes")

        def join_rows(t: pa.Table) -> pa.Table:
            t = t.sort_by("start")
            one = lambda c, kind: pa.array([c], kind)
            return pa.table({"map_name": t.column("map_name").slice(0, 1).cast(pa.string()), "at": t.column("at").slice(0, 1), "first": t.column("start").slice(0, 1), "bits": one(b"".join(x.as_py() for x in t.column("bits")), pa.binary())})

        parts = blocks.select("map_name", "start", "bits", of.alias("at")).groupBy("map_name", "at").applyInArrow(join_rows, "map_name string, at int, first long, bits binary")
        self.rows = written(parts.join(self._by_part("at").hint("merge"), ["map_name", "at"]).select("map_name", "at", "first", "bits", "n", "nodes"), "parts")
        self.tiles = _tasks(self.spark, 16 * self.rows.count() * GROUPS)
        self.sources = sources

    def _by_part(self, name: str) -> DataFrame:
        """The maps once for each part."""
        return self.maps.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))

    def begin(self, make: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """The first state: make(sources, n) gives x and known."""
        own = self.maps if self.sources is None else self.maps.join(self.sources.hint("merge"), "map_name")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                n = row["n"]
                every = np.arange(n) if "sources" not in row else np.frombuffer(row["sources"], np.int64)
                for part in range(GROUPS):
                    s = every[part * len(every) // GROUPS : (part + 1) * len(every) // GROUPS]
                    if len(s):
                        yield _state(row["map_name"], n, part, s, *make(s, n), True)

        return written(own.mapInArrow(run, STATE), "state")

    def step(self, state: DataFrame, multiply: Callable, merge: Callable) -> DataFrame:
        """multiply(x as bytes, rows of booleans, first row, nodes, sources) gives the columns of these rows; merge(columns of all rows, known as bytes, sources, n) the next x, known and whether there is more."""
        wide = state.select("map_name", "part", "sources", "x", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("at"))
        tall = self.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
        met = wide.join(tall.hint("merge"), ["map_name", "part", "at"]).repartition(self.tiles, "map_name", "part", "at")

        def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                y = multiply(row["x"], _bits(row["bits"], row["n"]), row["first"], _nodes(row), np.frombuffer(row["sources"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([row["map_name"]], pa.string()), pa.array([row["part"]], pa.int32()), pa.array([row["first"]], pa.int64()), pa.array([np.ascontiguousarray(y).tobytes()], pa.binary())], names=["map_name", "part", "first", "y"])

        def together(left: pa.Table, right: pa.Table) -> pa.Table:
            row = {k: right.column(k)[0].as_py() for k in ("map_name", "n", "part", "sources", "known")}
            s = np.frombuffer(row["sources"], np.int64)
            left = left.sort_by("first")
            ys = [np.frombuffer(y.as_py(), np.uint8).reshape(len(s), -1) for y in left.column("y")]
            x, known, more = merge(np.concatenate(ys, axis=1), row["known"], s, row["n"])
            return pa.Table.from_batches([_state(row["map_name"], row["n"], row["part"], s, x, known, more)])

        tiles = met.mapInArrow(tile, "map_name string, part int, first long, y binary")
        return written(tiles.groupBy("map_name", "part").cogroup(state.groupBy("map_name", "part")).applyInArrow(together, STATE), "state")

    def until_done(self, state: DataFrame, multiply: Callable, merge: Callable) -> list[DataFrame]:
        """All states from the second on, up to the last that has more."""
        out = []
        while True:
            state = self.step(state, multiply, merge)
            if state.where("more").isEmpty():
                return out
            out.append(state)

    def read(self, states: list[DataFrame], kernel: Callable, schema: str) -> DataFrame:
        """kernel(state row, nodes, number of the state from 1) gives columns; map_name goes in front of them."""
        every = states[0].withColumn("d", F.lit(1))
        for d, s in enumerate(states[1:], 2):
            every = every.union(s.withColumn("d", F.lit(d)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                columns = kernel(row, _nodes(row), row["d"])
                size = len(next(iter(columns.values())))
                yield pa.RecordBatch.from_pydict({"map_name": pa.array([row["map_name"]] * size, pa.string()), **columns})

        # a state's row is large; few of them go to a task
        return every.join(self._by_part("part").drop("n").hint("merge"), ["map_name", "part"]).repartition(self.tiles, "map_name", "part", "d").mapInArrow(run, f"map_name string, {schema}")


def _state(name: str, n: int, part: int, sources: np.ndarray, x: np.ndarray, known: np.ndarray, more: bool) -> pa.RecordBatch:
    binary = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64()), pa.array([part], pa.int32()), binary(sources), binary(x), binary(known), pa.array([bool(more)])], names=["map_name", "n", "part", "sources", "x", "known", "more"])


def _own(sources: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(sources), n), bool)
    out[np.arange(len(sources)), sources] = True
    return out


def _hop_states(large: Large) -> list[DataFrame]:
    """x: the bits of the nodes that are d steps away, in the d-th state."""

    def multiply(x: bytes, rows: np.ndarray, first: int, nodes: np.ndarray, sources: np.ndarray) -> np.ndarray:
        return np.packbits(_bits(x, len(nodes)).astype(np.float32) @ rows.T.astype(np.float32) > 0, axis=1)

    def merge(y: np.ndarray, known: bytes, sources: np.ndarray, n: int) -> tuple:
        before = np.frombuffer(known, np.uint8).reshape(len(sources), -1)
        new = y & ~before
        return new, before | new, new.any()

    own = lambda s, n: (np.packbits(_own(s, n), axis=1),) * 2
    return large.until_done(large.begin(own), multiply, merge)


def _length_state(large: Large, cell: float) -> DataFrame | None:
    """The last state has all shortest lengths in known; None if no node has a neighbour."""

    def multiply(x: bytes, rows: np.ndarray, first: int, nodes: np.ndarray, sources: np.ndarray) -> np.ndarray:
        d = np.ascontiguousarray(np.frombuffer(x, np.float64).reshape(len(sources), -1).T)
        out = np.full((len(rows), len(sources)), np.inf)
        for k, row in enumerate(rows):
            beside = np.flatnonzero(row)
            if len(beside):
                out[k] = (d[beside] + np.hypot(*((nodes[beside] - nodes[first + k]) * cell).T)[:, None]).min(axis=0)
        return np.ascontiguousarray(out.T).view(np.uint8)

    def merge(y: np.ndarray, known: bytes, sources: np.ndarray, n: int) -> tuple:
        before = np.frombuffer(known, np.float64).reshape(len(sources), n)
        d = np.minimum(before, np.ascontiguousarray(y).view(np.float64))
        return d, d, (d < before).any()

    start = lambda s, n: (np.where(_own(s, n), 0.0, np.inf),) * 2
    states = large.until_done(large.begin(start), multiply, merge)
    return states[-1] if states else None


# ---- measures --------------------------------------------------------------------------------------------------------


def _split(edges: DataFrame, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """The blocks of maps that tasks take whole, and those of larger ones, if there are any."""
    blocks = blocks_of(edges)
    large = blocks.where(F.col("n") > whole)
    return blocks.where(F.col("n") <= whole), None if large.isEmpty() else large


def _distances(small: DataFrame, cell: float | None, use: Callable, schema: str) -> DataFrame:
    """use(distances, nodes, sources) of small maps: by hops, or by length where cell is the side of a cell. Unreachable nodes have inf.

    The turns of a map are worked out once, so all its sources are one group.
    """

    def prepare(adjacency: np.ndarray, nodes: np.ndarray) -> Callable:
        if cell is not None:
            turns = kernels.Turns(adjacency, nodes * float(cell))
            return lambda s: use(turns.distances(s), nodes, s)

        def hops(s: np.ndarray) -> dict:
            d = kernels.hops(adjacency, s)
            return use(np.where(d < 0, np.inf, d), nodes, s)

        return hops

    return _by_source(small, prepare, schema, groups=GROUPS if cell is None else 1)


def distances(edges: DataFrame, cell: float | None = None, whole: int = WHOLE) -> DataFrame:
    """(map_name, r, c, r2, c2, d) for all pairs with a path: fewest steps, or with cell, the shortest length in its unit. edges are edges or blocks."""
    small, large = _split(edges, whole)
    kind = "long" if cell is None else "double"
    schema = f"r long, c long, r2 long, c2 long, d {kind}"

    def listed(d: np.ndarray, nodes: np.ndarray, sources: np.ndarray) -> dict:
        d[np.arange(len(sources)), sources] = np.inf
        i, j = np.nonzero(np.isfinite(d))
        a, b = nodes[sources[i]], nodes[j]
        return {"r": a[:, 0], "c": a[:, 1], "r2": b[:, 0], "c2": b[:, 1], "d": d[i, j] if cell is not None else d[i, j].astype(np.int64)}

    out = _distances(small, cell, listed, schema)
    if large is None:
        return out
    steps = Large(large)

    def of_state(row: dict, nodes: np.ndarray, d: int) -> dict:
        sources = np.frombuffer(row["sources"], np.int64)
        return listed(np.where(_bits(row["x"], row["n"]), float(d), np.inf) if cell is None else np.frombuffer(row["known"], np.float64).reshape(len(sources), -1).copy(), nodes, sources)

    states = _hop_states(steps) if cell is None else [s for s in [_length_state(steps, cell)] if s is not None]
    return out.union(steps.read(states, of_state, schema)) if states else out


def distance_sums(edges: DataFrame, cell: float | None = None, whole: int = WHOLE) -> DataFrame:
    """(map_name, r, c, s, m, far): the sum, number and largest of a node's distances. No pairs leave the tasks."""
    small, large = _split(edges, whole)
    schema = "r long, c long, s double, m long, far double"

    def summed(d: np.ndarray, nodes: np.ndarray, sources: np.ndarray) -> dict:
        d = np.where(np.isfinite(d), d, 0)
        d[np.arange(len(sources)), sources] = 0
        return {"r": nodes[sources, 0], "c": nodes[sources, 1], "s": d.sum(axis=1), "m": (d > 0).sum(axis=1), "far": d.max(axis=1)}

    out = _distances(small, cell, summed, schema)
    if large is None:
        return out
    steps = Large(large)

    def of_state(row: dict, nodes: np.ndarray, d: int) -> dict:
        sources = np.frombuffer(row["sources"], np.int64)
        if cell is not None:
            return summed(np.frombuffer(row["known"], np.float64).reshape(len(sources), -1), nodes, sources)
        k = _bits(row["x"], row["n"]).sum(axis=1).astype(np.int64)
        return {"r": nodes[sources, 0], "c": nodes[sources, 1], "s": k * float(d), "m": k, "far": np.where(k > 0, float(d), 0.0)}

    states = _hop_states(steps) if cell is None else [s for s in [_length_state(steps, cell)] if s is not None]
    if not states:
        return out
    found = steps.read(states, of_state, schema).groupBy(*KEY).agg(F.sum("s").alias("s"), F.sum("m").alias("m"), F.max("far").alias("far"))
    return out.union(found)


SHARES = "r long, c long, share double, square double"


def _shares(edges: DataFrame, whole: int, sources: DataFrame | None = None) -> DataFrame:
    """(map_name, r, c, share, square): the sums over sources of a node's share in shortest paths from there, and of their squares, several rows a node."""
    small, large = _split(edges, whole)

    def summed(share: np.ndarray, nodes: np.ndarray) -> dict:
        return {"r": nodes[:, 0], "c": nodes[:, 1], "share": share.sum(axis=0), "square": (share**2).sum(axis=0)}

    out = _by_source(small, lambda a, nodes: lambda s: summed(kernels.dependencies(a, s), nodes), SHARES, sources)
    if large is None:
        return out
    steps = Large(large, sources)
    real = lambda raw, s: np.frombuffer(raw, np.float64).reshape(len(s), -1)

    def multiply(x: bytes, rows: np.ndarray, first: int, nodes: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (real(x, s) @ rows.T.astype(np.float64)).view(np.uint8)

    def onward(y: np.ndarray, known: bytes, s: np.ndarray, n: int) -> tuple:
        """x: the number of shortest paths to the nodes of this step; known: the nodes that have any."""
        before = np.frombuffer(known, bool).reshape(len(s), n)
        paths = np.where(before, 0.0, np.ascontiguousarray(y).view(np.float64))
        return paths, before | (paths > 0), (paths > 0).any()

    begin = lambda s, n: (_own(s, n).astype(np.float64), _own(s, n))
    states = steps.until_done(steps.begin(begin), multiply, onward)

    def add_known(state: DataFrame, before: DataFrame) -> DataFrame:
        """state with the paths of the step before it as known."""
        return state.drop("known").join(before.select("map_name", "part", F.col("x").alias("known")).hint("merge"), ["map_name", "part"]).select("map_name", "n", "part", "sources", "x", "known", "more")

    def handed(paths: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.divide(1 + share, paths, out=np.zeros(paths.shape), where=paths > 0)

    def first_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            s = np.frombuffer(row["sources"], np.int64)
            paths = real(row["x"], s)
            yield _state(row["map_name"], row["n"], row["part"], s, handed(paths, np.zeros(paths.shape)), paths, True)

    def back(y: np.ndarray, known: bytes, s: np.ndarray, n: int) -> tuple:
        """known: the shares of the step; x: what it hands on."""
        paths = real(known, s)
        share = paths * np.ascontiguousarray(y).view(np.float64)
        return handed(paths, share), share, True

    shares = []
    if len(states) > 1:
        state = written(states[-1].repartition(steps.tiles, "map_name", "part").mapInArrow(first_back, STATE), "state")
        for d in range(len(states) - 1, 0, -1):
            state = steps.step(add_known(state, states[d - 1]), multiply, back)
            shares.append(state)
    of_state = lambda row, nodes, d: summed(real(row["known"], np.frombuffer(row["sources"], np.int64)), nodes)
    zero = _by_row(large, lambda rows, nodes, start: {"r": nodes[start : start + len(rows), 0], "c": nodes[start : start + len(rows), 1], "share": np.zeros(len(rows)), "square": np.zeros(len(rows))}, SHARES)
    out = out.union(zero)
    return out.union(steps.read(shares, of_state, SHARES)) if shares else out


def choice(edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(map_name, r, c, choice): for each node, its share in the shortest paths between all others, each pair once."""
    return _shares(edges, whole).groupBy(*KEY).agg((F.sum("share") / 2).alias("choice"))


def choice_sampled(edges: DataFrame, sources: int, seed: str = "", whole: int = WHOLE) -> DataFrame:
    """(map_name, r, c, choice, standard_error) from so many sources of each map, scaled by nodes / sources; all of them give the choice itself.

    The sources are those with the least md5 of `seed|map_name|r|c`. The error is that of a sample without replacement; null for one source.
    """
    blocks = blocks_of(edges)
    nodes = nodes_of(blocks)
    name = F.md5(F.concat_ws("|", F.lit(seed), "map_name", "r", "c"))
    # the least k of k chosen in each of several parts of a map: no map's nodes meet in one task
    kept = nodes.select("map_name", "i", name.alias("name")).groupBy("map_name", (F.col("i") % 64).alias("salt")).agg(F.slice(F.array_sort(F.collect_list(F.struct("name", "i"))), 1, sources).alias("some"))
    chosen = kept.groupBy("map_name").agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("every")).select("map_name", F.array_sort(F.transform(F.slice("every", 1, sources), lambda x: x["i"])).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array([row["map_name"]], pa.string()), pa.array([np.array(row["places"], np.int64).tobytes()], pa.binary())], names=["map_name", "sources"])

    found = _shares(blocks, whole, written(chosen.mapInArrow(run, "map_name string, sources binary"), "sources")).groupBy(*KEY).agg(F.sum("share").alias("share"), F.sum("square").alias("square"))
    sizes = blocks.where("start = 0").select("map_name", "n", F.least("n", F.lit(sources)).alias("k"))
    n, k = F.col("n"), F.col("k")
    variance = F.when(k > 1, F.greatest((F.col("square") - F.col("share") * F.col("share") / k) / (k - 1), F.lit(0.0)))
    return found.join(sizes, "map_name").select(*KEY, (F.col("share") * n / k / 2).alias("choice"), (n * F.sqrt((1 - k / n) * variance / k) / 2).alias("standard_error"))
