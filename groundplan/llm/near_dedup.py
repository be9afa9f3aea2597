"""Near duplicates by MinHash with tensored banding.

A table's key is a pair (left i, right j) of half keys, each of them a few minhashes. M left and M right collections make M * M tables from
2 * M * WIDTH minhashes, where independent tables would take M * M * 2 * WIDTH. Two documents share a key of some table if and only if they
share a left half and a right half, so candidates are found from 2 * M rows a document, and the M * M keys are never written out. A
candidate must also share AGREE halves in all. Candidates are confirmed on the full sets of shingles, so there are no false
links; a pair of similarity 0.8 is missed with a probability of at most 2 * (1 - 0.8**WIDTH)**M = 8e-7 for the keys, and 1e-7 for AGREE; of
0.85, with 2e-9 in all.

Documents with equal sets are one class from the start. Halves that only one class has are left out. Then, in two steps:

1. In each group of a shared half, all members meet the one that shares most halves with others (the text that the copies were made from, as a rule).
2. Groups that lie within one component then have nothing to add. The others are dealt into tiles of two chunks of members; a tile compares its
   members in numpy, each pair only in the first left half that it shares, and gives a spanning forest of confirmed links. No list of pairs is
   ever a table, no group is in one task, and no candidate whose link could matter is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, mixed, pair_hashes, packed, saved, signed, slices, table, word_hashes

M, WIDTH = 28, 4
#: Halves that a candidate shares at least, of 2 * M.
AGREE = 6
#: Members of a chunk of a tile.
CHUNK = 512
#: Ids that are sent to all tasks at most (16 MB); of more, the texts are shuffled.
FEW = 2_000_000
_SEEDS = np.random.default_rng(4).integers(1, 1 << 32, (2 * M * WIDTH, 2), dtype=np.uint32) | np.uint32(1)
BANDS = [f"{side}{i}" for side in "lr" for i in range(M)]


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each row and the end): all runs of so many words; the whole row if it has fewer; none without words."""
    h, _, _, first = word_hashes(buf, offsets)
    n = np.diff(first)
    rolled = h.copy()
    for k in range(1, words):
        if len(h) > k:
            inside = rolled[: len(h) - k]
            rolled = np.concatenate([pair_hashes(inside, h[k:]), rolled[len(h) - k :]])
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    where = np.repeat(first[:-1] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    out, starts = rolled[where], np.r_[0, np.cumsum(count)]
    for d in np.flatnonzero((n > 0) & (n < words)):  # the whole sequence
        x = h[first[d] : first[d] + 1]
        for k in range(1, n[d]):
            x = pair_hashes(x, h[first[d] + k : first[d] + k + 1])
        out[starts[d]] = x[0]
    return out, starts


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    h, starts = shingles(buf, offsets, words)
    return [np.unique(h[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            for i, j in slices(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                size = np.array([len(s) for s in sets])
                out = np.zeros((len(sets), 2 + 2 * M), np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    v = np.concatenate([sets[k] for k in full])
                    at = np.r_[0, np.cumsum(size[full])[:-1]]
                    out[full, 0], out[full, 1] = np.add.reduceat(mixed(v), at), np.add.reduceat(mixed(~v), at)
                    low = v.astype(np.uint32)
                    least = [np.minimum.reduceat((low ^ x) * a, at).astype(np.uint64) for a, x in _SEEDS]
                    for b in range(2 * M):
                        key = least[b * WIDTH]
                        for w in range(1, WIDTH):
                            key = pair_hashes(key, least[b * WIDTH + w])
                        out[full, 2 + b] = (key >> np.uint64(6)) | np.uint64(b << 58)
                columns = [batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), *(pa.array(signed(np.ascontiguousarray(c))) for c in out.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "f1", "f2", *BANDS])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            for i, j in slices(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return run


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    both = int((q[at] == p).sum()) if len(q) else 0
    return 100 * both >= percent * (len(p) + len(q) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


# ---- tiles -----------------------------------------------------------------------------------------------------------

TILE = ["h", "t1", "t2"]
MEMBER = "h long, t1 int, t2 int, chunk int, rep long, root long, n long, halves binary"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles of rows that are sorted by tile, one by one."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in TILE], axis=1)
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = tuple(key[p])
            if held and own != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(t.slice(p, q - p))
            last = own
    if held:
        yield pa.concat_tables(held).combine_chunks()


def candidates(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the tile) of the pairs that share a key of some table, are of different components, and have no left half in common before the tile's own."""
    h, t1, t2 = (t.column(k)[0].as_py() for k in TILE)
    i = h >> 58 & 63
    chunk, root, n = (t.column(k).to_numpy() for k in ("chunk", "root", "n"))
    halves = np.frombuffer(b"".join(x.as_py() for x in t.column("halves")), np.int64).reshape(t.num_rows, 2 * M)
    a, b = np.flatnonzero(chunk == t1), np.flatnonzero(chunk == t2)
    out = []
    step = max(1, (1 << 17) // max(len(b), 1))
    for s in range(0, len(a), step):
        own = a[s : s + step]
        small, large = np.minimum(n[own][:, None], n[b]), np.maximum(n[own][:, None], n[b])
        ok = (root[own][:, None] != root[b]) & (small * 100 >= large * percent)  # else even a subset is not linked
        if t1 == t2:
            ok &= own[:, None] < b
        p, q = np.nonzero(ok)
        p, q = own[p], b[q]
        same = halves[p] == halves[q]
        ok = (same.sum(axis=1) >= AGREE) & same[:, M:].any(axis=1) & ~same[:, :i].any(axis=1)
        out.append((p[ok], q[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (a[:0], b[:0])


def _with_candidates(percent: int):
    """The members of each tile that are in a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches):
            some = np.unique(np.concatenate(candidates(t, percent)))
            if len(some):
                yield from t.take(pa.array(some)).to_batches()

    return run


def _tile_links(percent: int):
    """Confirmed links that connect what a tile's members connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches):
            rep, sets = t.column("rep").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")]
            parent = {r: r for r in t.column("root").to_pylist()}
            root = t.column("root").to_pylist()

            def top(x: int, parent: dict = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            out = []
            for p, q in zip(*(x.tolist() for x in candidates(t, percent)), strict=True):
                x, y = top(root[p]), top(root[q])
                if x != y and alike(sets[p], sets[q], percent):
                    parent[max(x, y)] = min(x, y)
                    out.append((rep[p], rep[q]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of `words`-word shingles have 100 * intersection >= percent * union are linked. Null and empty texts,
    and texts without words, have an empty set and are linked with nothing. Rows without a doc_id are left out; rows of equal
    doc_id must be equal, and give equal rows. Columns other than doc_id and text are not read. An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    fields = ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "f1", "f2", *BANDS))
    signature = saved(docs.mapInArrow(_signatures(words), fields), "minhash")
    # documents with equal sets have equal minhashes: a minimum over the class takes them along
    classes = saved(signature.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in BANDS)), "classes")
    halves = classes.select("rep", F.explode(F.array(*BANDS)).alias("h"))
    # joins that grow with the corpus are merge joins at every size
    several = halves.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").hint("merge")
    shared = saved(halves.join(several, "h"), "halves")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        ids = saved(ids.distinct(), f"{name}-ids")
        ids = F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge")
        return saved(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(words), "doc_id long, shingles binary"), name)

    # step 1
    known = shared.groupBy("rep").agg(F.sum("k").alias("known")).hint("merge")
    centre = shared.join(known, "rep").groupBy("h").agg(F.max(F.struct("known", "rep"))["rep"].alias("centre")).hint("merge")
    is_left = F.shiftrightunsigned("h", 58) < M
    left = F.count_if(is_left)
    star = shared.join(centre, "h").where("rep <> centre").groupBy("centre", "rep").agg(F.count("*").alias("agree"), left.alias("left")).where((F.col("agree") >= AGREE) & (F.col("left") > 0) & (F.col("left") < F.col("agree")))
    star = saved(star.select(F.col("centre").alias("a"), F.col("rep").alias("b")), "star")
    sets = sets_of(star.select(F.col("a").alias("doc_id")).union(star.select("b")), "sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    pairs = star.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
    links = saved(pairs.mapInArrow(_confirm(percent), "a long, b long, linked boolean").where("linked").select("a", "b"), "links")
    found = components(links, "a", "b")

    # step 2
    rooted = shared.where(is_left).join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("h", "rep", "k", F.coalesce("root", "rep").alias("root"))
    open_ = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h").hint("merge")
    chunks = F.ceil(F.col("k") / CHUNK).cast("int")
    member = rooted.join(open_, "h").withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), chunks - 1)))
    whole = classes.select("rep", F.col("n_shingles").alias("n"), *BANDS)
    packed_halves = F.concat(*(F.unhex(F.lpad(F.hex(F.col(c)), 16, "0")) for c in BANDS))
    member = member.join(whole.hint("merge"), "rep").select("h", F.least("chunk", "x").alias("t1"), F.greatest("chunk", "x").alias("t2"), "chunk", "rep", "root", "n", packed_halves.alias("halves"))
    dealt = lambda df: df.repartition(*TILE).sortWithinPartitions(*TILE)
    some = saved(dealt(member).mapInArrow(_with_candidates(percent), MEMBER), "tiles")
    sets = sets_of(some.select(F.col("rep").alias("doc_id")), "tile-sets").withColumnRenamed("doc_id", "rep")
    more = saved(dealt(some.join(sets, "rep").select(*some.columns, "shingles")).mapInArrow(_tile_links(percent), "a long, b long"), "tile-links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b")

    of_class = classes.select("f1", "f2", "n_shingles", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("root", "rep").alias("component"))
    out = signature.select("doc_id", "n_shingles", "f1", "f2").join(of_class.hint("merge"), ["f1", "f2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES = {
    "op4_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, n, unnest(s) AS x FROM s JOIN n USING (doc_id)),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
root(doc_id, r) USING KEY (doc_id) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, min(h.r) FROM root h JOIN near l ON l.a = h.doc_id JOIN recurring.root k ON k.doc_id = l.b WHERE k.r > h.r GROUP BY l.b)
SELECT n.doc_id, n AS n_shingles, r AS component_id, n.doc_id = r AS kept FROM n JOIN root USING (doc_id)
"""
}
