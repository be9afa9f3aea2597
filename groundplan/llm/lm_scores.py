"""Language-model scores: a trigram model with absolute discounting, as a weighted automaton with failure arcs.

A state is the last two words, the last word, or nothing. A state s that occurs c(s) times in training and has f(s) different next words has an
arc for each of them, with weight log10 of (c(sw) - D) / c(s) + D f(s) / c(s) * p(w | shorter s), and a failure arc of weight
log10 D f(s) / c(s) to the state that is one word shorter. The state without words has an arc for every word (add-0.1 estimates,
unknown words included). Each text is read once from left to right, from the state of its start.

The model grows with the corpus, so it is never sent to all tasks. Texts are packed into blocks, and a block asks for the numbers of its own
words in four steps: counts of words; of pairs; of triples, and next words of words; next words of pairs. What it asks for is sorted
by hash and cut at fixed hash ranges; each range adds up what all blocks ask for and answers each block in its own order, so only numbers
travel back and no key does. Blocks and answers are tables bucketed by block, so texts are never shuffled. A gram that cannot occur elsewhere, as one of its parts does not, is not asked for. An n-gram counts as a new next word
in one of the blocks that hold it, so a frequent word or pair is one key per block in every step.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, packed, pair_hashes, shared_folder, slices, table, word_hashes

#: Bytes of text of a block (a longer text is a block of its own), and of text per hash range.
BLOCK, RANGE = 4 << 20, 16 << 20
#: Hash ranges at least.
RANGES = 64
#: Buckets of blocks at least, and bytes of text of one.
BUCKETS, BUCKET = 32, 32 << 20
ADD, DISCOUNT = 0.1, 0.75
START, END = (mixed(np.array([x], np.uint64))[0] for x in (101, 102))
#: What blocks ask for, in the order of the steps.
WORDS, PAIRS, AFTER_WORD, TRIPLES, AFTER_PAIR = range(5)
STEPS = ((WORDS,), (PAIRS,), (AFTER_WORD, TRIPLES), (AFTER_PAIR,))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token of each row and the end): the words of each row and its end."""
    parts, sizes = [], []
    for i, j in slices(offsets):
        h, _, _, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append(np.insert(h, first[1:], END))
        sizes.append(np.diff(first) + 1)
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return h, np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64)


def squeezed(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes; sorted ones are given as differences."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unsqueezed(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).reshape(-1).view("<u8")


BLOCKS = "block binary, doc_id binary, held_out binary, ends binary, texts binary, n_bytes long"


def _blocks(limit: int):
    """Packs documents, as they come, into rows of about limit bytes of text."""

    def pack(parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts).combine_chunks()
        data, offsets = packed(t.column("text"))
        ids = t.column("doc_id").to_numpy().astype(np.int64)
        row = {"block": uuid.uuid4().bytes, "doc_id": squeezed(ids.view(np.uint64)), "held_out": np.packbits(t.column("held_out").to_numpy(zero_copy_only=False)).tobytes(), "ends": squeezed(np.diff(offsets).astype(np.uint64)), "texts": pa.compress(data.tobytes(), codec="zstd", asbytes=True) if len(data) else b"", "n_bytes": len(data)}
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64() if k == "n_bytes" else pa.binary()) for k, v in row.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            _, offsets = packed(t.column("text"))
            for i, j in slices(offsets, limit):
                n = int(offsets[j] - offsets[i])
                if held and size + n > limit:
                    yield pack(held)
                    held, size = [], 0
                held.append(t.slice(i, j - i))
                size += n
        if held:
            yield pack(held)

    return run


class Asked:
    """Distinct keys of a block. Of each: its share n in the total, and the total once it is known. Those that are open are asked for."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, total: np.ndarray, open_: np.ndarray):
        self.n, self.total, self.own = n, total, n > 0
        at = np.flatnonzero(open_)
        self.order = at[np.argsort(keys[at])]
        self.keys = keys[self.order]

    def hear(self, answer: np.ndarray) -> None:
        self.total[self.order] = answer >> 1
        self.own[self.order] = answer & 1


class Block:
    """The tokens of a packed block, and what it asks for (asked, by kind) after what it has heard."""

    def __init__(self, row: dict, heard: dict[int, np.ndarray]):
        ends = np.r_[0, np.cumsum(unsqueezed(row["ends"]).astype(np.int64))]
        n = row["n_bytes"]
        data = np.frombuffer(pa.decompress(row["texts"], decompressed_size=n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
        self.doc_id = unsqueezed(row["doc_id"]).view(np.int64)
        self.held_out = np.unpackbits(np.frombuffer(row["held_out"], np.uint8), count=len(self.doc_id)).astype(bool)
        h, self.starts = tokens_of(data, ends)
        train = np.repeat(~self.held_out, np.diff(self.starts))
        first = self.starts[:-1]
        self.asked: dict[int, Asked] = {}

        def before(at: np.ndarray, start: int) -> np.ndarray:
            out = np.r_[np.int32(start), at[:-1]]
            out[first] = start
            return out

        def grams(kind: int, keys: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(distinct keys, a token of each, index of each token's key); most: how often each token's gram can occur."""
            found, one, at = np.unique(keys, return_index=True, return_inverse=True)
            at = at.astype(np.int32)
            n = np.bincount(at[train], minlength=len(found))
            self.asked[kind] = Asked(found, n, n.copy(), np.ones(len(found), bool) if most is None else most[one] > n)
            return found, one, at

        def after(kind: int, keys: np.ndarray, count: np.ndarray, of: Asked, context: np.ndarray) -> None:
            """The number of different next words of each context; of: the grams, context: theirs."""
            self.asked[kind] = Asked(keys, np.bincount(context[of.own], minlength=len(keys)), np.minimum(count, 1), count > 1)

        words, one, self.word = grams(WORDS, h)
        if WORDS not in heard:
            return
        self.asked[WORDS].hear(heard[WORDS])
        count = self.asked[WORDS].total
        texts = count[np.searchsorted(words, END)]  # as often does the start of a text occur
        self.last = before(self.word, len(words))
        self.word_count = np.r_[count, texts]
        keys = np.r_[words, START]
        pairs, one, self.pair = grams(PAIRS, pair_hashes(keys[self.last], h), np.minimum(self.word_count[self.last], count[self.word]))
        if PAIRS not in heard:
            return
        self.asked[PAIRS].hear(heard[PAIRS])
        count = self.asked[PAIRS].total
        after(AFTER_WORD, keys, self.word_count, self.asked[PAIRS], self.last[one])
        self.last_pair = before(self.pair, len(pairs))
        self.pair_count = np.r_[count, texts]
        keys = np.r_[pairs, pair_hashes(np.array([START]), np.array([START]))]
        _, one, self.triple = grams(TRIPLES, pair_hashes(keys[self.last_pair], h), np.minimum(self.pair_count[self.last_pair], count[self.pair]))
        if TRIPLES not in heard:
            return
        self.asked[AFTER_WORD].hear(heard[AFTER_WORD])
        self.asked[TRIPLES].hear(heard[TRIPLES])
        after(AFTER_PAIR, keys, self.pair_count, self.asked[TRIPLES], self.last_pair[one])
        if AFTER_PAIR in heard:
            self.asked[AFTER_PAIR].hear(heard[AFTER_PAIR])

    def weights(self, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its count, the base log10 probability, and the weights of the arcs taken from the state before it."""
        c = self.asked[WORDS].total[self.word]
        word = (c + ADD) / (n + ADD * (v + 1))
        p2, w2 = arcs(word, np.log10(word), self.asked[PAIRS].total[self.pair], self.word_count[self.last], self.asked[AFTER_WORD].total[self.last])
        _, w3 = arcs(p2, w2, self.asked[TRIPLES].total[self.triple], self.pair_count[self.last_pair], self.asked[AFTER_PAIR].total[self.last_pair])
        return c, np.log10(word), w3


def arcs(shorter: np.ndarray, weight: np.ndarray, c: np.ndarray, context: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, log10 weights) from states of one word more: an arc where c > 0, else the failure arc and the weight behind it."""
    fail = np.where(context > 0, DISCOUNT * after / np.maximum(context, 1), 1.0)
    p = np.maximum(c - DISCOUNT, 0) / np.maximum(context, 1) + fail * shorter
    return p, np.where(c > 0, np.log10(p), np.log10(fail) + weight)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each key; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


ASKED = "block binary, kind int, part int, keys binary, n binary"


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            heard: dict[int, list] = {}
            for step, kinds in enumerate(STEPS):
                if f"heard{step}" in row:
                    answers = sorted(row[f"heard{step}"] or [], key=lambda a: (a["kind"], a["part"]))
                    heard |= {k: np.concatenate([np.zeros(0, np.int64), *(unsqueezed(a["totals"]).astype(np.int64) for a in answers if a["kind"] == k)]) for k in kinds}
            yield row, Block(row, heard)


def _asked(kinds: tuple[int, ...], ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in _blocks_of(batches):
            for kind in kinds:
                asked = b.asked[kind]
                n = asked.n[asked.order].astype(np.uint64)
                cut = np.searchsorted(range_of(asked.keys, ranges), np.arange(ranges + 1))
                full = np.flatnonzero(np.diff(cut) > 0)
                parts = [slice(cut[k], cut[k + 1]) for k in full]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["block"]] * len(full), pa.binary()), "kind": pa.array(np.full(len(full), kind, np.int32)), "part": pa.array(full.astype(np.int32)),
                    "keys": pa.array([squeezed(np.diff(asked.keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()), "n": pa.array([squeezed(n[p]) for p in parts], pa.binary()),
                })

    return run


ANSWERS = "block binary, kind int, part int, totals binary, n long, v long"


def _answered(t: pa.Table) -> pa.Table:
    """Adds up a hash range's numbers over all blocks; each block gets those it asked for, each with a bit that is set in one of the blocks that have
    a share in it. n (the sum) and v (the keys above 0) are in the first row only."""
    t = t.sort_by("block")
    keys = [np.cumsum(unsqueezed(x.as_py()), dtype=np.uint64) for x in t.column("keys")]
    share = np.concatenate([unsqueezed(x.as_py()) for x in t.column("n")]).astype(np.int64)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, share)
    own = np.zeros(len(at), np.int64)
    having = np.flatnonzero(share)
    own[having[np.unique(at[having], return_index=True)[1]]] = 1
    answer = (total[at] << 1) | own
    parts = np.split(answer, np.cumsum([len(k) for k in keys])[:-1])
    first = np.arange(t.num_rows) == 0
    return pa.table({"block": t.column("block"), "kind": t.column("kind"), "part": t.column("part"), "totals": pa.array([squeezed(x) for x in parts], pa.binary()), "n": pa.array(first * int(total.sum())), "v": pa.array(first * int((total > 0).sum()))})


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by block: joins and groups by block read it without a shuffle."""
    spark = df.sparkSession
    key = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{key}").bucketBy(buckets, "block").format("parquet").saveAsTable(key)
    out = spark.table(key)
    spark.sql(f"DROP TABLE {key}")  # the name goes; the files and the buckets of out stay
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _blocks_of(batches):
            c, base, score = b.weights(n, v)
            total = lambda x: np.add.reduceat(x, b.starts[:-1])  # noqa: B023, E731  every row has its end token
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(b.doc_id), "held_out": pa.array(b.held_out), "n_tokens": pa.array(np.diff(b.starts)), "n_known": pa.array(total((c > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(b.doc_id), n, np.int64)), "base_score": pa.array(total(base)), "score": pa.array(total(score)),
            })

    return run


def lm_scores(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Documents with crc32(doc_id) mod 10 other than 0 are the training data. Null and empty texts have one token, their end. Rows without a
    doc_id are left out; repeated rows count and are returned as often as they occur. Only doc_id and text are read. Without training
    data, all words have the same probability. An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, buckets = max(RANGES, -(-size // RANGE)), max(BUCKETS, -(-size // BUCKET))
    known = bucketed(docs.mapInArrow(_blocks(block), BLOCKS), "blocks", buckets)
    for step, kinds in enumerate(STEPS):
        answers = known.mapInArrow(_asked(kinds, ranges), ASKED).groupBy("kind", "part").applyInArrow(_answered, ANSWERS)
        answers = bucketed(answers.repartition(buckets, "block"), f"answers{step}", buckets)
        if kinds == (WORDS,):
            n, v = answers.agg(F.sum("n"), F.sum("v")).first()
        heard = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "part", "totals")).alias(f"heard{step}"))
        known = known.join(heard.hint("merge"), "block", "left")
    return known.mapInArrow(_scored(n or 0, v or 0), SCORES)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_scores": op10_lm_scores}
#: None: sums of logarithms differ in their last digits by their order. The tests compare all columns with a plain version, to nine digits.
ORACLES: dict[str, str] = {}
