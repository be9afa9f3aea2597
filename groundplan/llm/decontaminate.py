"""Benchmark decontamination: rare pairs of words seed the join of passages to test items, Smith-Waterman alignment scores the pairs.

An alignment with m equal words and e words changed, put in or left out scores m - e / 2. Of its m - 1 steps from one equal word to the
next, at most e / 2 cross more than one such edit, so at least score - 1 steps cross one or none: both words are within two places of
each other in the item and in the passage. A pair with a score of threshold * words therefore shares, whatever the edits are, the pair
(word, next word) or (word, next but one) of at least threshold * words - 1 of the item's places. That many, c, must be shared, so k of any
places - c + k places are: each item is looked up by so many of its rarest places, counted in all documents. Passages are long enough to hold
such an alignment whole, and overlap by half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, mixed, packed, pair_hashes, saved, signed, slices, table, word_hashes

#: Words of an item that is looked up by pairs, at least; shorter ones are looked up whole.
LEAST = 4
#: Words of half a passage, at least; the longest item decides if it needs more.
HALF = 64
#: Bits of the bitmap of seeds, 1 MB whatever the number of items.
BITS = 1 << 23


def pairs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places of the first word) of all pairs of a word and the next or next but one within rows; h and first as word_hashes gives them."""
    end = np.repeat(first[1:], np.diff(first))
    near = [np.flatnonzero(np.arange(len(h)) + n < end) for n in (1, 2)]
    at = np.concatenate(near)
    return pair_hashes(h[at], h[np.concatenate([near[0] + 1, near[1] + 2])]), at


def needed(words: int, threshold: float) -> int:
    """The places of an item that any alignment at the threshold shares."""
    return max(math.ceil(threshold * words - 1e-9) - 1, 1)


def _item_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            h, _, _, first = word_hashes(data, offsets)
            g, at = pairs(h, first)
            row = np.searchsorted(first, at, "right") - 1
            words = np.diff(first)
            ok = np.flatnonzero(words[row] >= LEAST)
            g, at, row = g[ok], at[ok], row[ok]
            need = np.array([needed(int(n), threshold) for n in words], np.int64)
            arrays = [batch.column(0).take(pa.array(row)), pa.array(at - first[row]), pa.array(signed(g)), pa.array(words[row]), pa.array(need[row])]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "at", "gram", "n_words", "need"])

    return run


def _counts(bitmap: bytes):
    """How often the seeds of the bitmap occur."""
    bits = np.frombuffer(bitmap, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(0))
            for i, j in slices(offsets):
                h, _, _, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                g = pairs(h, first)[0]
                slot = (g >> np.uint64(41)).astype(np.int64)
                g, n = np.unique(g[np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


def _passages(bitmap: bytes, half: int):
    """Passages of 2 * half words, one at each half, that hold seeds of the bitmap."""
    bits = np.frombuffer(bitmap, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = packed(batch.column(1))
            for i, j in slices(offsets):
                buf, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, starts, ends, first = word_hashes(buf, own)
                g, at = pairs(h, first)
                slot = (g >> np.uint64(41)).astype(np.int64)
                hit = np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1)
                if not len(hit):
                    continue
                at, g = at[hit], g[hit]
                row = np.searchsorted(first, at, "right") - 1
                place = at - first[row]
                # a seed is in the passage that begins at its half, and in the one before if it isn't the first
                number = np.r_[place // half, place // half - 1]
                row, at, g = np.r_[row, row], np.r_[at, at], np.r_[g, g]
                last = np.maximum((np.diff(first)[row] - 1) // half - 1, 0)  # a passage that another one holds whole isn't made
                ok = np.flatnonzero((number >= 0) & (number <= last))
                row, number, g = row[ok], number[ok], g[ok]
                order = np.lexsort((g, number, row))
                row, number, g = row[order], number[order], g[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
                cut = np.flatnonzero(new)
                out = []
                for s, e in zip(cut, np.r_[cut[1:], len(row)], strict=True):
                    a = first[row[s]] + number[s] * half
                    b = min(a + 2 * half, first[row[s] + 1])
                    out.append((int(ids[i + row[s]]), int(number[s]), signed(np.unique(g[s:e])).tolist(), buf[starts[a] : ends[b - 1]].tobytes().decode("utf-8", "replace")))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.string())], names=["doc_id", "passage", "grams", "text"])

    return run


def align(a: np.ndarray, b: np.ndarray, match: float = 1.0, other: float = -0.5, gap: float = -0.5) -> float:
    """The best Smith-Waterman score of two word sequences, row by row of the shorter one."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    fall = gap * np.arange(len(b) + 1)
    before, best = np.zeros(len(b) + 1), 0.0
    for x in a:
        own = np.zeros(len(b) + 1)
        own[1:] = np.maximum(before[:-1] + np.where(b == x, match, other), before[1:] + gap)
        own = np.maximum(own, 0)
        own = np.maximum.accumulate(own - fall) + fall  # gaps along the row
        best = max(best, float(own.max()))
        before = own
    return best


def _aligned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, item in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                a, b = (word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in (text, item))
                g, at = pairs(b, np.array([0, len(b)]))
                shared = len(np.unique(at[np.isin(g, pairs(a, np.array([0, len(a)]))[0])]))
                out.append(align(a, b) / max(len(b), 1) if shared >= needed(len(b), threshold) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.float64())], names=["doc_id", "passage", "item_id", "score"])

    return run


def _whole(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> str:
    """n words from place at on, A-Z in lower case, with one space between them."""
    return " ".join(LOWER[data[starts[k] : ends[k]]].tobytes().decode("utf-8", "replace") for k in range(at, at + n))


def _runs(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places of the first word) of all runs of n words within rows."""
    at = np.flatnonzero(np.arange(len(h)) + n - 1 < np.repeat(first[1:], np.diff(first)))
    out = mixed(h[at] + np.uint64(n))
    for k in range(1, n):
        out = pair_hashes(out, h[at + k])
    return out, at


def _short_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items of one word to LEAST - 1, as whole phrases."""
    for batch in batches:
        data, offsets = packed(batch.column(1))
        h, starts, ends, first = word_hashes(data, offsets)
        rows = [k for k, n in enumerate(np.diff(first)) if 0 < n < LEAST]
        grams = [int(signed(_runs(h[first[k] : first[k + 1]], np.array([0, first[k + 1] - first[k]]), int(first[k + 1] - first[k]))[0])[0]) for k in rows]
        texts = [_whole(data, starts, ends, first[k], first[k + 1] - first[k]) for k in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(grams, pa.int64())], names=["item_id", "phrase", "gram"])


def _short_hits(bitmap: bytes):
    """(doc_id, phrase, n) of the runs of few words whose hashes are in the bitmap."""
    bits = np.frombuffer(bitmap, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = packed(batch.column(1))
            for i, j in slices(offsets):
                buf = data[offsets[i] : offsets[j]]
                h, starts, ends, first = word_hashes(buf, offsets[i : j + 1] - offsets[i])
                out = []
                for n in range(1, LEAST):
                    g, at = _runs(h, first, n)
                    slot = (g >> np.uint64(41)).astype(np.int64)
                    hit = np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1)
                    row = np.searchsorted(first, at[hit], "right") - 1
                    order = np.lexsort((g[hit], row))
                    hit, row = hit[order], row[order]
                    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (g[hit][1:] != g[hit][:-1])]) if len(hit) else hit
                    out += [(int(ids[i + row[k]]), _whole(buf, starts, ends, at[hit[k]], n), int(c)) for k, c in zip(new, np.diff(np.r_[new, len(hit)]))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "phrase", "n"])

    return run


def _bitmap(seeds: DataFrame) -> bytes:
    slot = F.shiftrightunsigned("gram", 41)
    out = bytearray(BITS // 8)
    for r in seeds.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bits")).collect():  # 256 parts of 4 KB at most
        out[r.part * 4096 : r.part * 4096 + 4096] = r.bits
    return bytes(out)


def rare_places(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """item, at, gram, k: the places of each item whose pairs are rarest in all documents, so many that k of them must be shared."""
    counts = docs.select("text").mapInArrow(_counts(_bitmap(seeds)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    places = seeds.join(counts, "gram", "left").groupBy("item", "at").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.first("n_words").alias("n_words"), F.first("need").alias("need"))
    # items are short, and this is one row for each of their words
    places = places.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("n", "at"))).withColumn("k", F.greatest(F.floor(F.col("need") / 4), F.lit(1)))
    return seeds.select("item", "at", "gram").join(places.where("r <= n_words - 1 - need + k").select("item", "at", "k"), ["item", "at"])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document and test item that it holds, whole or edited: doc_id, item_id, score, n_passages.

    score is the best alignment of the item with a passage of the document: 1 for each equal word, -0.5 for each word that
    is changed, put in or left out, divided by the item's words. All pairs at threshold or more are found, if threshold times the
    item's words is more than 1. Items of under four words are found, with score 1, where all their words stand in a row (an edit would leave one word or
    two, which say nothing); n_passages is how often (of rows of one doc_id, the most). Null and empty texts and rows without an id are never found; repeated rows count once. Other columns than doc_id, item_id and text are not read.
    """
    docs, items = docs.select("doc_id", "text").where("doc_id is not null"), benchmark.select("item_id", "text").where("item_id is not null").distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    seeds = saved(items.select("item", "text").mapInArrow(_item_pairs(threshold), "item long, at long, gram long, n_words long, need long"), "seeds")
    longest = seeds.agg(F.max("n_words")).first()[0] or 0
    half = max(HALF, math.ceil(longest * max(1, 3 - 2 * threshold)))  # all words equal, and as many put in as the threshold allows

    rare = saved(rare_places(docs, seeds), "rare")
    passages = saved(docs.mapInArrow(_passages(_bitmap(rare), half), "doc_id long, passage long, grams array<long>, text string"), "passages")

    held = passages.select("doc_id", "passage", F.explode("grams").alias("gram"))
    near = held.join(rare, "gram").groupBy("doc_id", "passage", "item").agg(F.size(F.collect_set("at")).alias("shared"), F.first("k").alias("k")).where("shared >= k")
    texts = near.select("doc_id", "passage", "item").join(passages.select("doc_id", "passage", "text"), ["doc_id", "passage"]).join(items.withColumnRenamed("text", "own"), "item")
    scored = texts.select("doc_id", "passage", "item_id", "text", "own").mapInArrow(_aligned(threshold), "doc_id long, passage long, item_id long, score double")
    found = scored.where(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.count("*").alias("n_passages"))
    short = saved(items.select("item_id", "text").mapInArrow(_short_items, "item_id long, phrase string, gram long").distinct(), "short-items")
    if short.isEmpty():
        return found
    hits = docs.mapInArrow(_short_hits(_bitmap(short)), "doc_id long, phrase string, n long").groupBy("doc_id", "phrase").agg(F.max("n").alias("n"))
    return found.union(hits.join(short, "phrase").groupBy("doc_id", "item_id").agg(F.lit(1.0).alias("score"), F.sum("n").alias("n_passages")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
ORACLES: dict[str, str] = {}
