"""Collocations: phrases that are much more frequent than their parts would have it, by Misra-Gries summaries and an exact second pass.

1. Documents are packed into blocks, each a table row, bucketed by block, so no later step shuffles texts. A block counts its n-grams by short keys (a
   hash cut to so many bits that few n-grams of the corpus share one) and sends each hash partition the keys that fall to it, sorted, as differences.
2. A hash partition merges these into a Misra-Gries summary: if there are more counters than its capacity, the next largest counter
   is taken off all of them, and those at zero go. The capacity is above the partition's mass divided by the threshold, so all that is ever
   taken off is under the threshold, and every n-gram that reaches it survives, with what it may have lost added. Nothing is lost by
   keys that n-grams share; that only lets more survive. Each block hears a bit for each of its keys.
3. Second pass: of the survivors alone, each block sends 96 bits of hash and its exact count. The hash partition adds these up, and tells one of
   the blocks that hold a frequent n-gram how often it occurs in all; that block hands on its words. Two n-grams are one if 96 bits are.
4. Scores are joins of the frequent n-grams with their parts.

Blocks x hash partitions rows are exchanged at most, and no more than there are distinct n-grams in blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SLICE, gathered, mixed, packed, pair_hashes, saved, span_hashes, table, word_hashes
from .lm_scores import bucketed, squeezed, unsqueezed

#: Bytes of text of a block; a piece without a separator that is longer is a block of its own.
BLOCK = 4 << 20
#: Hash partitions: for so many bytes of text each, from LEAST to MOST, and beyond MOST for each LARGE bytes.
PART, LARGE, LEAST, MOST = 4 << 20, 64 << 20, 64, 1000
#: Buckets of blocks at least, and bytes of text of one.
BUCKETS, BUCKET = 32, 32 << 20
#: Groups that the ranks of a language are first worked out in.
SALTS = 64

#: Bytes that end a piece, `[.,;:!?\x0A-\x0D]`, and bytes of words, `[^\x20\x09]+` within it.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False


# ---- blocks ----------------------------------------------------------------------------------------------------------

BLOCKS = "block binary, langs array<string>, ends array<bigint>, n_bytes bigint, texts binary"


def cut(text: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """text in parts of at most limit bytes if pieces allow it; no piece is cut."""
    if len(text) <= limit:
        yield text
        return
    ends = np.flatnonzero(ENDS[text])
    start = 0
    while len(text) - start > limit:
        k = int(np.searchsorted(ends, start + limit, "right"))
        if k and ends[k - 1] >= start:
            k -= 1
        if k == len(ends):
            break
        yield text[start : ends[k]]
        start = int(ends[k]) + 1
    yield text[start:]


def _blocks(limit: int):
    def pack(held: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        end = np.array([0x0A], np.uint8)
        texts = [np.concatenate([x for part in parts for x in (part, end)]) for parts in held.values()]
        data = np.concatenate(texts)
        row = {"block": [uuid.uuid4().bytes], "langs": [list(held)], "ends": [np.cumsum([len(x) for x in texts]).tolist()], "n_bytes": [len(data)], "texts": [pa.compress(data.tobytes(), codec="zstd", asbytes=True)]}
        kinds = {"block": pa.binary(), "langs": pa.list_(pa.string()), "ends": pa.list_(pa.int64()), "n_bytes": pa.int64(), "texts": pa.binary()}
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in row.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            data, offsets = packed(batch.column(1))
            for k, lang in enumerate(batch.column(0).to_pylist()):
                for part in cut(data[offsets[k] : offsets[k + 1]], limit):
                    if size and size + len(part) > limit:
                        yield pack(held)
                        held, size = {}, 0
                    held.setdefault(lang, []).append(part)
                    size += len(part) + 1
        if held:
            yield pack(held)

    return run


class Words:
    """The words of a block in order, and its n-grams within pieces."""

    def __init__(self, row: dict, longest: int, checked: bool = True):
        self.langs, self.lang_ends = row["langs"], np.array(row["ends"], np.int64)
        self.data = LOWER[np.frombuffer(pa.decompress(row["texts"], decompressed_size=row["n_bytes"], codec="zstd"), np.uint8)]
        ends = ENDS[self.data]
        at = np.flatnonzero(ends)
        parts, n = [0], len(self.data)
        while parts[-1] < n:
            k = int(np.searchsorted(at, parts[-1] + SLICE, "right"))
            k -= bool(k and at[k - 1] >= parts[-1])
            parts.append(int(at[k]) + 1 if k < len(at) else n)
        found = [word_hashes(self.data[i:j], np.array([0, j - i]), WORD)[:3] for i, j in zip(parts, parts[1:])]
        h = np.concatenate([f[0] for f in found])
        self.starts = np.concatenate([f[1] + i for f, i in zip(found, parts)])
        self.stops = np.concatenate([f[2] + i for f, i in zip(found, parts)])
        together = np.searchsorted(at, self.starts[1:]) == np.searchsorted(at, self.stops[:-1])
        self.lang = np.searchsorted(self.lang_ends, self.starts, "right")
        names = [x.encode() for x in self.langs]
        stop = np.cumsum([len(x) for x in names])
        seed = span_hashes(np.frombuffer(b"".join(names), np.uint8), stop - [len(x) for x in names], stop, 11)
        whole, places = np.ones(len(h), bool), [np.arange(len(h), dtype=np.int32)]
        for k in range(1, longest):
            whole = whole[:-1] & together[k - 1 :]
            places.append(np.flatnonzero(whole).astype(np.int32))
        #: of each n-gram in its place, those of one word first: its first word, its number of words, its key and, if checked, half of another hash
        self.first, self.size = np.concatenate(places), np.repeat(np.arange(1, longest + 1, dtype=np.int8), [len(p) for p in places])

        def grams(h: np.ndarray) -> np.ndarray:
            key = mixed(h + seed[self.lang])
            out = [key]
            for k in range(1, longest):
                key = pair_hashes(key[:-1], h[k:])
                out.append(key[places[k]])
            return np.concatenate(out)

        self.keys = grams(h)
        if checked:
            other = np.concatenate([span_hashes(self.data[i:j], s - i, e - i, 13) for i, j, s, e in ((i, j, f[1] + i, f[2] + i) for f, i, j in zip(found, parts, parts[1:]))])
            self.checks = grams(other).astype(np.uint32)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, checks, an n-gram of each, counts) of the distinct n-grams, sorted by key and check."""
        order = np.argsort(self.keys)
        keys, checks = self.keys[order], self.checks[order]
        new = keys[1:] != keys[:-1]
        if (~new & (checks[1:] != checks[:-1])).any():
            order = np.lexsort((self.checks, self.keys))
            keys, checks = self.keys[order], self.checks[order]
            new = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        at = np.flatnonzero(np.r_[True, new]) if len(keys) else np.zeros(0, np.int64)
        return keys[at], checks[at], order[at], np.diff(np.r_[at, len(keys)])

    def texts(self, first: np.ndarray, n: np.ndarray) -> pa.Array:
        """The n words from each first one on, with one space between them."""
        size = self.stops - self.starts + 1
        joined = np.append(self.data, np.uint8(0))[gathered(self.starts, size)]
        ends = np.cumsum(size)
        joined[ends - 1] = 0x20
        begin = ends[first] - size[first]
        length = ends[first + n.astype(np.int32) - 1] - 1 - begin
        offsets = np.r_[0, np.cumsum(length)].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(joined[gathered(begin, length)])).cast(pa.string())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# ---- first pass ------------------------------------------------------------------------------------------------------

ASKED = "block binary, part int, keys binary, checks binary, counts binary"
ANSWERS = "block binary, part int, bits binary, counts binary"


def cuts(keys: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Where the keys of each hash partition begin, with the end; keys are sorted and have so many bits."""
    return np.searchsorted((keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def _sent(row: dict, at: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, counts: np.ndarray) -> pa.RecordBatch:
    full = np.flatnonzero(np.diff(at))
    own = [slice(at[p], at[p + 1]) for p in full]
    binary = lambda x: pa.array(x, pa.binary())
    columns = [binary([row["block"]] * len(full)), pa.array(full.astype(np.int32)), binary([squeezed(np.diff(keys[s], prepend=np.uint64(0))) for s in own])]
    return pa.RecordBatch.from_arrays([*columns, binary([None if checks is None else checks[s].tobytes() for s in own]), binary([squeezed(counts[s]) for s in own])], names=["block", "part", "keys", "checks", "counts"])


def _summaries(longest: int, parts: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, counts = np.unique(Words(row, longest, False).keys >> np.uint64(64 - bits), return_counts=True)
            yield _sent(row, cuts(keys, parts, bits), keys, None, counts)

    return run


def misra_gries(summaries: Iterable[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, counts, lost) of all summaries: at most capacity counters, each short of the true count by at most lost.

    lost is at most mass / (capacity + 1), as each unit of it was taken off capacity + 1 counters at least.
    """
    keys, counts, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        nonlocal keys, counts, lost
        both = np.concatenate([keys, *(k for k, _ in held)])
        order = np.argsort(both, kind="stable")
        both, n = both[order], np.concatenate([counts, *(c for _, c in held)])[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        keys, counts = both[first], np.add.reduceat(n, first) if len(first) else n
        if len(keys) > capacity:
            off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            lost += off
            stay = counts > off
            keys, counts = keys[stay], counts[stay] - off
        held.clear()

    for k, c in summaries:
        held.append((k, c))
        if sum(len(x) for x, _ in held) >= capacity:
            merge()
    merge()
    return keys, counts, lost


def _read(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unsqueezed(t.column("keys")[k].as_py()), dtype=np.uint64), unsqueezed(t.column("counts")[k].as_py()).astype(np.int64)


def _answers(t: pa.Table, bits: list[np.ndarray], counts: list | None = None) -> pa.Table:
    packed_bits = pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())
    return pa.table({"block": t.column("block").cast(pa.binary()), "part": t.column("part"), "bits": packed_bits, "counts": pa.array(counts or [None] * len(bits), pa.binary())})


def _survivors(threshold: int):
    def run(t: pa.Table) -> pa.Table:
        """The bits of each block's keys in a hash partition, set for those that may reach the threshold."""
        rows = range(t.num_rows)
        mass = sum(int(_read(t, k)[1].sum()) for k in rows)
        keys, counts, lost = misra_gries((_read(t, k) for k in rows), mass // threshold + 1)
        keys = keys[counts + lost >= threshold]

        def alive(asked: np.ndarray) -> np.ndarray:
            at = np.searchsorted(keys, asked)
            at[at == len(keys)] = 0
            return keys[at] == asked if len(keys) else np.zeros(len(asked), bool)

        return _answers(t, [alive(_read(t, k)[0]) for k in rows])

    return run


# ---- second pass -----------------------------------------------------------------------------------------------------

GRAMS = "lang string, phrase string, words int, n bigint"


def _heard(answers: list[dict] | None, size: np.ndarray) -> np.ndarray:
    """The bits of all hash partitions, of so many keys each."""
    found = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=int(size[a["part"]])) for a in sorted(answers or [], key=lambda a: a["part"])]
    return np.concatenate([np.zeros(0, np.uint8), *found]).astype(bool)


def _alive(row: dict, words: Words, parts: int, bits: int) -> tuple[np.ndarray, ...]:
    """What words.distinct() gives, of those n-grams whose short keys survived."""
    keys, checks, at, counts = words.distinct()
    short = keys >> np.uint64(64 - bits)
    first = np.r_[True, short[1:] != short[:-1]] if len(short) else np.zeros(0, bool)
    stay = _heard(row["survived"], np.diff(cuts(short[first], parts, bits)))[np.cumsum(first) - 1] if len(short) else first
    return keys[stay], checks[stay], at[stay], counts[stay]


def _shares(longest: int, parts: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, checks, _, counts = _alive(row, Words(row, longest), parts, bits)
            yield _sent(row, cuts(keys, parts), keys, checks, counts)

    return run


def _owners(threshold: int):
    def run(t: pa.Table) -> pa.Table:
        """Exact sums; of each n-gram that reaches the threshold, one block that holds it hears the sum."""
        t = t.sort_by("block")
        read = [_read(t, k) for k in range(t.num_rows)]
        keys, counts = (np.concatenate([r[k] for r in read]) for k in range(2))
        checks = np.concatenate([np.frombuffer(c.as_py(), np.uint32) for c in t.column("checks")])
        order = np.lexsort((checks, keys))  # stable: the first block comes first
        k, c = keys[order], checks[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        n = np.add.reduceat(counts[order], first)
        own, total = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        own[order[first]], total[order[first]] = n >= threshold, n
        ends = np.cumsum([len(r[0]) for r in read])[:-1]
        return _answers(t, np.split(own, ends), [squeezed(x[b]) for x, b in zip(np.split(total, ends), np.split(own, ends))])

    return run


def _phrases(longest: int, parts: int, bits: int):
    """The frequent n-grams that a block was chosen to hand on; a row without a phrase has the number of words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = Words(row, longest)
            langs = pa.array(words.langs, pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.array(np.zeros(len(langs), np.int32)), pa.array(np.bincount(words.lang, minlength=len(langs)))], names=["lang", "phrase", "words", "n"])
            keys, _, at, _ = _alive(row, words, parts, bits)
            at = at[_heard(row["owned"], np.diff(cuts(keys, parts)))]
            n = np.concatenate([np.zeros(0, np.int64), *(unsqueezed(a["counts"]).astype(np.int64) for a in sorted(row["owned"] or [], key=lambda a: a["part"]))])
            place, size = words.first[at], words.size[at]
            for i in range(0, len(at), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(words.lang[place[s]])), words.texts(place[s], size[s]), pa.array(size[s].astype(np.int32)), pa.array(n[s])], names=["lang", "phrase", "words", "n"])

    return run


def frequent_ngrams(docs: DataFrame, longest: int = 3, threshold: int = 10, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, words, n): all runs of up to longest words within pieces that occur threshold times or more in a language, and how often.

    Rows without a phrase, words 0, have numbers of words of a language, in parts. Words are lower-cased (A-Z) and joined by one space. Null languages are
    `und`; null texts are empty. Repeated rows count as often as they are there. Only lang and text are read. An empty table gives an empty table.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST, min(size // PART, MOST), size // LARGE)
    bits = max(36, min(60, size.bit_length() + 6))
    buckets = max(BUCKETS, -(-size // BUCKET))
    known = bucketed(texts.mapInArrow(_blocks(block), BLOCKS), "word_blocks", buckets)

    def ask(asked, answered, name: str) -> DataFrame:
        """known with what its blocks hear from the hash partitions."""
        answers = known.mapInArrow(asked(longest, parts, bits), ASKED).groupBy("part").applyInArrow(answered(threshold), ANSWERS)
        heard = bucketed(answers.repartition(buckets, "block"), f"ngrams_{name}", buckets).groupBy("block").agg(F.collect_list(F.struct("part", "bits", "counts")).alias(name))
        return known.join(heard.hint("merge"), "block", "left")

    known = ask(_summaries, _survivors, "survived")
    known = ask(_shares, _owners, "owned")
    return saved(known.mapInArrow(_phrases(longest, parts, bits), GRAMS), "ngrams")


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, covered: int = 50, top: int = 2000, block: int = BLOCK) -> DataFrame:
    """Each language's top phrases of 2 to longest words: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count; it is cut where floor(10**6 * a * a / (l * r)) is least (of equals, the first place), with l and r the counts of its parts,
    and that is its score. Phrases within a longer one of at least covered per cent of their count are left out. For documents, see frequent_ngrams.
    """
    grams = frequent_ngrams(docs, longest, threshold, block)
    phrases = grams.where("words > 0").select("lang", "phrase", "n")
    whole = grams.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    halves = whole.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    halves = halves.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left")).join(part("left", "l"), ["lang", "left"])
    halves = halves.select("lang", "phrase", "a", "k", "l", F.split("phrase", " ").alias("w"))
    halves = halves.select("lang", "phrase", "a", "k", "l", join(F.col("k") + 1, F.size("w") - F.col("k")).alias("right")).join(part("right", "r"), ["lang", "right"])
    whole_number = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole_number("a") * whole_number("a")), whole_number("l") * whole_number("r"))
    cuts_ = halves.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda s: join(s, m)))))
    longer = whole.where(F.size("w") > 2).select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    found = cuts_.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    best = found.withColumn("rank", first("lang", "salt")).where(F.col("rank") <= top).withColumn("rank", first("lang")).where(F.col("rank") <= top)
    total = grams.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_phrase_collocations": op11_phrase_collocations}
ORACLES = {
    "op11_phrase_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) s(k))),
total AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
h AS (SELECT lang, phrase, c AS a, unnest(range(1, k)) AS cut_at, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT h.lang, h.phrase, a, x.c AS l, y.c AS r, cut_at, ((1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c))::BIGINT AS score FROM h
  JOIN f x ON x.lang = h.lang AND x.phrase = array_to_string(w[:cut_at], ' ') JOIN f y ON y.lang = h.lang AND y.phrase = array_to_string(w[cut_at + 1:], ' ')),
least AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
longer AS (SELECT lang, phrase, max(c) AS c FROM (SELECT lang, c, array_to_string((string_split(phrase, ' '))[i:i + 1], ' ') AS phrase FROM f, (VALUES (1), (2)) s(i) WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * c < 50 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
}
