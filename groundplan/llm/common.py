"""What the operators share: reading tables, saved intermediate tables, hashing of words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(made := f"file://{tempfile.mkdtemp(prefix='groundplan-')}")
    return made


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends here, and losing executors costs nothing that came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---- bytes and words -------------------------------------------------------------------------------------------------

#: Bytes of text handled at once in a task; the arrays for it take about 60 times as much. A longer text is handled alone.
SLICE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: What is left of eight bytes, by how many there are.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Longer spans are hashed in parts of so many bytes, and then their hashes.
_PART = 1024


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, up to the end; zeros follow the last byte."""
    buf = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes [start, end), wherever they stand: eight bytes after the other are mixed in, so no sum of bytes can cancel out.

    Spans of equal length up to eight bytes never collide. Other seeds give independent hashes.
    """
    n = ends - starts
    view = eights(buf)
    out = mixed(n.astype(np.uint64) + np.uint64(seed))
    long = np.flatnonzero(n > _PART)
    at = np.flatnonzero((n > 0) & (n <= _PART)) if len(long) else np.flatnonzero(n > 0)
    start, left = starts[at], n[at]
    while len(at):
        out[at] = mixed(out[at] ^ (view[start] & _TAIL[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        at, start, left = at[more], start[more] + 8, left[more] - 8
    if len(long):
        parts = -(-n[long] // _PART)
        first = np.repeat(starts[long], parts) + gathered(np.zeros(len(long), np.int64), parts) * _PART
        inner = span_hashes(buf, first, np.minimum(first + _PART, np.repeat(ends[long], parts)), seed)
        end = 8 * np.cumsum(parts)
        out[long] = mixed(out[long] ^ span_hashes(inner.view(np.uint8), end - 8 * parts, end, seed))
    return out


def packed(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins, with the end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most limit bytes, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_hashes(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cases A-Z; (64-bit hashes, starts, ends, first word of each row and the end) for the words of rows in buf."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = LOWER[buf]
    inside = is_word[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    first[offsets[filled]] = inside[offsets[filled]]
    last[offsets[filled + 1] - 1] = inside[offsets[filled + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0xA0761D6478BD642F) + mixed(b + np.uint64(0xE7037ED1A0B428DB)))


def hash_of(text: str, is_word: np.ndarray = NOT_WHITE) -> list[int]:
    """The word hashes of one text, as word_hashes gives them."""
    buf = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(buf, np.array([0, len(buf)]), is_word)[0].tolist()


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def gathered(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices first[0], first[0]+1, ... of each range, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


# ---- connected components --------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for all nodes of the undirected edges; root is the smallest node that can be reached.

    Every round, a node and its root take the smallest root next to them and then the root's root, so the
    number of rounds grows with the logarithm of the size. Only minima are shuffled (partial sums on the map side) and
    joins which AQE splits where a hub is large; every round is written to the shared folder.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = saved(both.union(both.select("dst", "src")).where("src <> dst").distinct(), "cc-edges")
    roots = saved(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("m"))
        seen = roots.join(near, "node").select("node", "root", F.least("root", "m").alias("m"))
        hook = seen.groupBy("root").agg(F.min("m").alias("h"))
        nxt = seen.join(hook, "root").select("node", F.col("root").alias("old"), F.least("m", "h").alias("root"))
        # the root's new root: a root r points at hook(r), and only roots are pointed at
        jump = hook.select(F.col("root").alias("r"), F.col("h").alias("j"))
        nxt = saved(nxt.join(jump, nxt.root == jump.r, "left").select("node", F.coalesce(F.least("root", "j"), "root").alias("root"), "old"), "cc-roots")
        if nxt.where("root <> old").isEmpty():
            return nxt.select("node", "root")
        roots = nxt.select("node", "root")
