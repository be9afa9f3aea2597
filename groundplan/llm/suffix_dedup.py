"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every window of `length` bytes that also starts earlier (smaller doc_id, or earlier in the document) goes. Suffixes are
ordered only through `length` bytes, by most-significant-digit passes, and groups of one leave after each pass:

1. Only suffixes at sampled starts are ordered. In each window, the start of its least ANCHOR-byte string (by hash, the
   leftmost of equals) is taken. The choice depends on the window's bytes alone, so equal windows choose
   the same place, and about one byte in 40 is a sampled start, which stands for all windows that chose it.
2. First digit: the ANCHOR bytes. Second digit: all bytes of the windows that chose the start (its context). Starts that are
   alone in the first digit leave. A start whose whole context came earlier is repeated in all its windows.
3. Last digits, only for starts whose anchor is repeated with another context: the group splits by the bytes that all windows
   of one half share, then by the whole windows; groups that are still equal are exactly the repeated windows.

Within a task, equal contexts collapse before anything is shuffled; so a passage in a third of all documents sends one row per
batch. Groups are dealt by ranges that may cut through them, so a common phrase with very many contexts, or a common part of very many
windows, is split over tasks. What a task can't know of the groups at its two ends goes on: such an anchor counts as repeated, and windows that
are new in such a group meet those of the other tasks by their whole digits. A task reads its groups as a stream.
Digits are 64-bit hashes of their bytes, eight bytes mixed in after the other, compared together with those before them; so windows count as equal if
128 bits are, of hashes that are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import eights, gathered, mixed, packed, saved, signed, slices, span_hashes, table

ANCHOR = 24


def _sampled(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window - first, anchor - first window, anchor's hash, context's hash) of each sampled start."""
    n, w = len(buf), length - ANCHOR + 1
    rows = np.flatnonzero(np.diff(offsets) >= length)
    if not len(rows):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    view = eights(buf)
    anchor = np.zeros(n - ANCHOR + 1, np.uint64)
    for k in range(0, ANCHOR, 8):
        anchor = mixed(anchor ^ view[k : k + len(anchor)])
    bits = np.uint64(n.bit_length())
    low = ((anchor >> bits) << bits) | np.arange(len(anchor), dtype=np.uint64)
    have = 1  # low[i] is the least of have places from i on
    while 2 * have <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[: len(low) - (w - have)], low[w - have :])
    first = offsets[rows]
    count = offsets[rows + 1] - length + 1 - first
    window = gathered(first, count)
    at = (low[window] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    k = np.flatnonzero(new)
    lo, hi, at = window[k], window[np.r_[k[1:], len(window)] - 1], at[k]
    row = np.searchsorted(offsets, lo, "right") - 1
    context = mixed(span_hashes(buf, lo, hi + length) + mixed(((at - lo) * 65536 + (hi - lo)).astype(np.uint64)))
    return row, lo - offsets[row], hi - lo, at - lo, anchor[at], context


def _samples(length: int):
    """Packed: first window << 33 | (last - first) << 17 | (anchor - first) << 1 | repeated within this batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            text = batch.column(1)
            if (order[1:] < order[:-1]).any():
                ids, text = ids[order], text.take(pa.array(order))
            data, offsets = packed(text)
            found = []
            for i, j in slices(offsets):
                row, *rest = _sampled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                found.append((ids[i + row], *rest))
            if not found:
                continue
            doc, lo, span, off, anchor, context = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.argsort(context, kind="stable")
            again = np.zeros(len(by), bool)
            again[by[1:]] = context[by[1:]] == context[by[:-1]]
            head = by[np.maximum.accumulate(np.where(again[by], 0, np.arange(len(by))))]  # the first with the same context
            again[by] &= (doc[by] != doc[head]) | (lo[by] != lo[head])  # a row that is there twice is no copy of itself
            word = (lo << 33) | (span << 17) | (off << 1) | again
            anchor = np.where(again, mixed(mixed(doc.view(np.uint64)) + word.view(np.uint64)), anchor)  # these need no group
            context = np.where(again, np.uint64(0), context)
            for s in range(0, len(doc), 200_000):
                part = slice(s, s + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (signed(anchor), signed(context), doc, word)], names=["anchor", "context", "doc_id", "word"])

    return run


def _first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by anchor, context, place. Repeated contexts come out as whole; first contexts of anchors that have several, as not whole.

    Rows of one anchor and context are never in two tasks. The first and the last anchor of a task may have more contexts in the tasks beside it
    and count as having several.
    """
    border = None  # the task's first anchor
    last = None  # anchor and context of the row before
    held = None  # the only context so far of the last anchor
    before = None  # the row before; the same row again is no copy

    def out(doc, word, whole):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(word), pa.array(whole)], names=["doc_id", "word", "whole"])

    for batch in batches:
        anchor, context, doc, word = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        again = (word & 1).astype(bool)
        yield out(doc[again], word[again], np.ones(again.sum(), bool))
        anchor, context, doc, word = (x[~again] for x in (anchor, context, doc, word))
        if not len(doc):
            continue
        twice = np.zeros(len(doc), bool)
        twice[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1]) & (doc[1:] == doc[:-1]) & (word[1:] == word[:-1])
        twice[0] = (anchor[0], context[0], doc[0], word[0]) == before
        before = anchor[-1], context[-1], doc[-1], word[-1]
        anchor, context, doc, word = (x[~twice] for x in (anchor, context, doc, word))
        if not len(doc):
            continue
        border = anchor[0] if border is None else border
        several = False  # the last anchor had several contexts before this batch
        if held is not None:
            anchor, context, doc, word = (np.r_[h, x] for h, x in zip(held, (anchor, context, doc, word), strict=True))
            last = None
        elif last is not None and anchor[0] == last[0]:
            several = True
        new_anchor, new_context = np.ones(len(doc), bool), np.ones(len(doc), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_context[1:] = new_anchor[1:] | (context[1:] != context[:-1])
        if several:
            new_context[0] = context[0] != last[1]
        run = np.cumsum(new_anchor) - 1
        contexts = np.bincount(run, weights=new_context).astype(np.int64)
        open_ = np.zeros(len(contexts), bool)
        open_[-1] = contexts[-1] == 1 and not (several and len(contexts) == 1) and anchor[-1] != border
        many = contexts > 1
        if several or anchor[0] == border:
            many[0] = True
        last = anchor[-1], context[-1]
        k = int(np.flatnonzero(new_context & open_[run])[0]) if open_[-1] else None
        held = None if k is None else tuple(np.array([x[k]]) for x in (anchor, context, doc, word))
        yield out(doc[~new_context], word[~new_context], np.ones((~new_context).sum(), bool))
        part = new_context & many[run]
        yield out(doc[part], word[part], np.zeros(part.sum(), bool))
    if held is not None:
        yield out(held[2], held[3], np.zeros(1, bool))


def _windows(length: int):
    """The windows of each start that is left, in two parts by what they share: rows (share, doc_id, first, bytes)."""
    half = (length - ANCHOR + 1) // 2
    widest = length - ANCHOR  # the furthest an anchor stands from a window's start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = packed(batch.column(1))
            words = batch.column(2)
            flat, ends = words.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.array([len(x) for x in words], np.int64))]
            for i, j in slices(offsets):
                buf = data[offsets[i] : offsets[j]]
                word = flat[ends[i] : ends[j]]
                row = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
                start = offsets[row] - offsets[i]
                lo = start + (word >> 33)
                hi, at = lo + ((word >> 17) & 0xFFFF), lo + ((word >> 1) & 0xFFFF)
                cut = at - half  # windows up to here hold the half bytes before the anchor, later ones so many behind it
                for first, final, s, e in ((lo, np.minimum(hi, cut), at - half, at + length - widest), (np.maximum(lo, cut + 1), hi, at, at + length - half + 1)):
                    ok = np.flatnonzero(first <= final)
                    if not len(ok):
                        continue
                    f, n = first[ok], final[ok] - first[ok] + length
                    share = span_hashes(buf, s[ok], e[ok], 1)
                    value = pa.Array.from_buffers(pa.large_binary(), len(ok), [None, pa.py_buffer(np.r_[0, np.cumsum(n)].astype(np.int64)), pa.py_buffer(buf[gathered(f, n)])])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(share)), pa.array(ids[row[ok]]), pa.array(f - start[ok]), value.cast(pa.binary())], names=["share", "doc_id", "first", "bytes"])

    return run


def _last_digits(length: int):
    """Rows by share, place: the runs of windows that came before, as (doc_id, lo, hi) in bytes.

    The first and the last share of a task may have more rows in the tasks beside it. Their windows that are new in this task come out too, as
    (doc_id, lo, no hi, share, window's hash).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share_before, before, row_before = None, np.zeros(0, np.uint64), None
        border, held = None, []  # the first share; the new windows of the share read last, if it isn't the first

        def new_windows(doc, lo, share, h):
            none = pa.nulls(len(doc), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), none, pa.array(share), pa.array(signed(h))], names=["doc_id", "lo", "hi", "share", "window"])

        for batch in batches:
            if not batch.num_rows:
                continue
            share, doc, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            twice = np.zeros(len(doc), bool)
            twice[1:] = (share[1:] == share[:-1]) & (doc[1:] == doc[:-1]) & (first[1:] == first[:-1])
            twice[0] = (share[0], doc[0], first[0]) == row_before
            row_before = share[-1], doc[-1], first[-1]
            if twice.any():
                batch = batch.filter(pa.array(~twice))
                share, doc, first = share[~twice], doc[~twice], first[~twice]
                if not len(doc):
                    continue
            border = share[0] if border is None else border
            data, offsets = packed(batch.column(3))
            count = np.diff(offsets) - length + 1
            start = gathered(offsets[:-1], count)
            row = np.repeat(np.arange(len(doc)), count)
            h = span_hashes(data, start, start + length)
            _, at = np.unique(h, return_index=True)
            again = np.ones(len(h), bool)
            again[at] = False
            if share_before is not None and share[0] == share_before:
                own = np.flatnonzero(share[row] == share_before)
                again[own] |= np.isin(h[own], before)
            tail = h[share[row] == share[-1]]
            before = np.unique(np.r_[before, tail] if share_before == share[-1] else tail)
            place = first[row] - offsets[row] + start
            if share[-1] != share_before:
                held = []
            share_before = share[-1]
            new = ~again
            at_border = np.flatnonzero(new & (share[row] == border))
            if len(at_border):
                yield new_windows(doc[row[at_border]], place[at_border], share[row[at_border]], h[at_border])
            if share[-1] != border:
                at_end = np.flatnonzero(new & (share[row] == share[-1]))
                held.append((doc[row[at_end]], place[at_end], share[row[at_end]], h[at_end]))
            k = np.flatnonzero(again)
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1] + 1) | (row[k[1:]] != row[k[:-1]])
            b = np.flatnonzero(new)
            s, e = k[b], k[np.r_[b[1:], len(k)] - 1]
            none = pa.nulls(len(s), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[s]]), pa.array(place[s]), pa.array(place[e] + length), none, none], names=["doc_id", "lo", "hi", "share", "window"])
        for h in held:
            yield new_windows(*h)

    return run


def _cut(text: bool):
    return lambda batches: _cut_batches(batches, text)


def _cut_batches(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for s in range(0, batch.num_rows, 500):
            part = batch.slice(s, 500)
            data, offsets = packed(part.column(1))
            kept, spans = [], []
            for k, (lo, hi) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                text = data[offsets[k] : offsets[k + 1]]
                if lo.is_valid and len(lo):
                    step = np.zeros(len(text) + 1, np.int64)
                    np.add.at(step, lo.values.to_numpy(), 1)
                    np.add.at(step, hi.values.to_numpy(), -1)
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                    text = text[~gone]
                else:
                    spans.append([])
                kept.append(text.tobytes().decode("utf-8", "ignore") if as_text else text.tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(spans, spans_type)], names=["doc_id", "n_bytes", "kept", "spans"])


def repeated_spans_removed(docs: DataFrame, length: int = 100, as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (the bytes that stay), spans (the maximal removed runs, [start, end) in bytes).

    A byte goes if a `length`-byte string that covers it also starts earlier, in a document of smaller doc_id or in the same one.
    With as_text, kept is a string, without characters that were cut in two. Null texts count as empty; shorter texts stay whole. Rows
    without a doc_id are left out; rows of equal doc_id must be equal, and count as one document. Columns other than doc_id and text
    are not read. An empty table gives an empty table.
    """
    if not ANCHOR < length < 60_000:
        raise ValueError(f"length must be over {ANCHOR} and under 60000")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    samples = docs.mapInArrow(_samples(length), "anchor long, context long, doc_id long, word long")
    marks = saved(samples.repartitionByRange("anchor", "context").sortWithinPartitions("anchor", "context", "doc_id", "word").mapInArrow(_first_digits, "doc_id long, word long, whole boolean"), "marks")
    left = marks.where(~F.col("whole")).groupBy("doc_id").agg(F.collect_list("word").alias("words"))
    windows = docs.join(left, "doc_id").mapInArrow(_windows(length), "share long, doc_id long, first long, bytes binary")
    by_place = windows.repartitionByRange("share", "doc_id", "first").sortWithinPartitions("share", "doc_id", "first")
    last = saved(by_place.mapInArrow(_last_digits(length), "doc_id long, lo long, hi long, share long, window long"), "runs")
    # a window of a share that tasks have in common is new in each of them once
    number = F.row_number().over(Window.partitionBy("share", "window").orderBy("doc_id", "lo"))
    late = last.where("hi is null").withColumn("number", number).where("number > 1").select("doc_id", "lo", (F.col("lo") + length).alias("hi"))
    lo = F.shiftright("word", 33)
    whole = marks.where("whole").select("doc_id", lo.alias("lo"), (lo + F.shiftright("word", 17).bitwiseAND(0xFFFF) + length).alias("hi"))
    spans = whole.union(last.where("hi is not null").select("doc_id", "lo", "hi")).union(late).groupBy("doc_id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return docs.join(spans, "doc_id", "left").mapInArrow(_cut(as_text), f"doc_id long, n_bytes long, kept {'string' if as_text else 'binary'}, spans array<struct<start: long, end: long>>")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans_removed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
#: Bytes as pairs of hexadecimal digits.
ORACLES = {
    "op2_suffix_array_dedup": """
WITH d AS (SELECT DISTINCT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
rep AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1),
run AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM rep),
grp AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM run),
span AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM grp GROUP BY doc_id, g),
part AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM span),
cut AS (SELECT doc_id, sum(e - s)::BIGINT AS removed, count(*) AS spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""
}
