"""Token ids in shards compressed by Re-Pair: frequent pairs of ids become nonterminals, rule by rule.

A shard holds whole documents in ascending doc_id order, one row of a Parquet table: the rules, the compressed sequence, the number
of ids that each rule expands to, and for each document its id and number of ids. Symbols under BASE are ids; symbol BASE + k is
rule k, a pair of smaller symbols. With the lengths, any range of ids is decoded without the rest (`decode`). Rules are made while a round
of them shortens the sequence by 1/256 at least, or pairs of a lower frequency are left to try.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, packed, saved, table

#: Ids of a shard, about; a longer document is a shard of its own.
SHARD = 1 << 17
BASE = 1 << 24
END = 1
#: A pair must occur this often in a shard to become a rule.
FREQUENT = 16
#: Characters encoded at once; longer texts are cut at a space, which never stands within a token.
PIECE = 1 << 23
#: Odd words whose ids a worker keeps from task to task; then it begins anew.
KEPT_WORDS = 1 << 18
#: Parts of words whose ids it keeps, at most (some 200 bytes each).
KEPT_PARTS = 3 << 18
#: Shards whose starts are sent to all tasks at most (32 MB).
FEW = 2_000_000

#: Stands between words that are encoded in one call, and the words of a call.
MARK, MARK_ID, CALL = "<|startoftext|>", 49406, 256

#: Stands in words that aren't plain: control characters, what begins special tokens, and all that normalisation or the classes of Unicode
#: could change. The tokenizer splits plain words, in lower case, by SPLIT; PROBE tells if it does.
ODD = re.compile(r"[^\t-\r\x20-;=-~À-ÖØ-öø-ÿ]")
SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+", re.ASCII)
LATIN = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PROBE = "It's I'LL they've we'd I'm you're can't 'x \t\n\x0b\f\r 'tis '' !'s" + " ".join(f"{chr(k)}{chr(k)}a{chr(k)}1 {chr(k)}" for k in [*range(0x21, 0x3C), *range(0x3D, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])

SCHEMA = "part int, seq int, n_ids long, rules binary, lengths binary, symbols binary, doc_ids binary, doc_sizes binary"


# ---- the grammar -----------------------------------------------------------------------------------------------------


def frequent_pairs(pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the pairs that occur at least so often, in ascending order, their counts, places, which pair stands at each place)."""
    a, b, n = pair >> 32, pair & 0xFFFFFFFF, len(pair)
    high, low, bits = (int(x.max()).bit_length() if n else 0 for x in (a, b, np.array([n])))
    if high + low + bits < 64:  # pairs and places in one number are sorted sooner than places by pairs
        key = np.sort((a << low | b) << bits | np.arange(n))
        place, key = key & ((1 << bits) - 1), key >> bits
    else:
        place = np.argsort(pair)
        key = pair[place]
    first = np.flatnonzero(np.r_[n > 0, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, n])
    often = np.flatnonzero(count >= least)
    first, count = first[often], count[often]
    return pair[place[first]], count, place[gathered(first, count)], np.repeat(np.arange(len(often)), count)


def compressed(ids: np.ndarray, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(rules as rows of two symbols, symbols). The threshold of frequency is halved from round to round.

    Frequent pairs are numbered (0: none, or a rare one). No pair of symbols that are there is more frequent in a later round, so only the pairs that new
    symbols make are looked up.
    """
    both, rules = np.zeros((len(ids), 2), np.int32), []
    seq, own = both.T
    seq[:] = ids
    known = np.zeros(1, np.int64)

    def number(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs, n, near, which = frequent_pairs(seq[at].astype(np.int64) << 32 | seq[at + 1], frequent)
        left = count - np.bincount(own[at], minlength=len(count))
        own[at] = 0
        own[at[near]] = len(known) + which
        return np.concatenate([known, pairs]), np.concatenate([left, n])

    count = np.zeros(1, np.int64)
    known, count = number(np.arange(len(seq) - 1))
    least = max(frequent, len(seq) // 128)
    while len(seq) > 1:
        found = np.flatnonzero(count[1:] >= least) + 1
        if not len(found):
            if least <= frequent:
                break
            least = max(frequent, least // 2)
            continue
        found = found[np.argsort(known[found])]
        order = np.argsort(count[found], kind="stable")
        rank = np.zeros(len(known), np.int32)  # 0: not frequent
        rank[found[order]] = np.arange(1, len(found) + 1)
        value = np.zeros(len(seq) + 2, np.int32)
        rank.take(own, out=value[1:-1], mode="clip")
        # a place is taken if no place beside it has a more frequent pair; of equal ones (aaa), the first
        taken = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] >= value[2:]))
        which = order[value[taken + 1] - 1]
        used = np.zeros(len(found), bool)
        used[which] = True
        seq[taken] = BASE + len(rules) - 1 + np.cumsum(used)[which]
        rules += [(p >> 32, p & 0xFFFFFFFF) for p in known[found[used]].tolist()]
        keep = np.ones(len(seq), bool)
        keep[taken + 1] = False
        count -= np.bincount(own[taken + 1], minlength=len(count))
        both = both.view(np.int64)[keep[:, None]].view(np.int32).reshape(-1, 2)
        seq, own = both.T
        new = np.zeros(len(seq) + 1, bool)
        at = taken - np.arange(len(taken))
        new[at] = new[at - 1] = True  # -1 is behind the end
        if new[len(seq) - 1]:  # no pair begins at the end
            count[own[-1]] -= 1
            own[-1] = 0
        known, count = number(np.flatnonzero(new[: len(seq) - 1]))
        if len(taken) * 256 < len(seq):
            if least <= frequent:
                break
            least = max(frequent, least // 2)
    return np.array(rules, np.int64).reshape(-1, 2), seq


def lengths(rules: np.ndarray) -> np.ndarray:
    """The number of ids that each rule expands to."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - BASE] if a >= BASE else 1) + (out[b - BASE] if b >= BASE else 1))
    return np.array(out, np.int64)


def expanded(rules: np.ndarray, size: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """All ids of the symbols. Rules are expanded once, if that makes less than the symbols do."""
    rule = symbols >= BASE
    which = symbols[rule] - BASE
    if len(rules) < len(symbols) and size.sum() < len(symbols) - len(which) + size[which].sum():
        start, width = np.cumsum(size) - size, np.ones(len(symbols), np.int64)
        at = size.sum() + np.arange(len(symbols))
        at[rule], width[rule] = start[which], size[which]
        return np.concatenate([expanded(rules, size, BASE + np.arange(len(rules))), symbols])[gathered(at, width)]
    while True:
        rule = symbols >= BASE
        if not rule.any():
            return symbols
        width = 1 + rule
        at = np.cumsum(width) - width
        out = np.empty(width.sum(), np.int64)
        out[at] = symbols
        pair = rules[symbols[rule] - BASE]
        out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


def decode(rules: np.ndarray, size: np.ndarray, symbols: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids [start, stop) of a shard, by the lengths of its rules; only the symbols that cover them are expanded."""
    width = np.ones(len(symbols), np.int64)
    rule = symbols >= BASE
    width[rule] = size[symbols[rule] - BASE]
    ends = np.cumsum(width)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, np.int64)
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    skip = start - int(ends[first] - width[first])
    return expanded(rules, size, symbols[first : last + 1])[skip : skip + stop - start]


# ---- writing and reading ---------------------------------------------------------------------------------------------


def pieces(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class Parts(dict):
    """The ids, as bytes, of parts met so far: the strings that the tokenizer's model is given one by one.

    When half of KEPT_PARTS are there, they become old; old ones that are met again stay, the others go when the next half is full.
    """

    def __init__(self, tokenize):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenize, self.old = tokenize, {}
        by_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): by_bytes.pre_tokenize_str(c)[0][0] for c in LATIN}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = array("I", [token.id for token in self.tokenize(part if part.isascii() else part.translate(self.bytes))]).tobytes()
        if 2 * len(self) >= KEPT_PARTS:
            self.old.clear()
            self.old.update(self)
            self.clear()
        if len(part) <= 64:
            self[part] = ids
        return ids


class Words(dict):
    """The ids, as bytes, of odd words met so far. The tokenizer drops spaces before it looks for tokens, so words are encoded one by one.

    Arrow splits texts at spaces and numbers their distinct words; each is encoded once. Words of ASCII and Latin-1 letters are lower-cased and split
    as the tokenizer does it, and its model is given each distinct part once. Other new words go to the tokenizer many at once, with a token between
    them; words that may hold such a token themselves go alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.parts = tokenizer.encode, Parts(tokenizer.model.tokenize)
        # a tokenizer that splits otherwise gets all words itself
        self.splits = self.by_parts(PROBE) == np.array(self.encode(PROBE, add_special_tokens=False).ids, np.uint32).tobytes()

    def by_parts(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, SPLIT.findall(text.lower())))

    def learned(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        plain = [w for w in words if "<" not in w and ">" not in w and "|" not in w]
        for w in set(words).difference(plain):
            yield w, np.array(self.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
        for k in range(0, len(plain), CALL):
            group = plain[k : k + CALL]
            ids = np.array(self.encode(MARK.join(group), add_special_tokens=False).ids, np.uint32)
            ends = np.r_[np.flatnonzero(ids == MARK_ID), len(ids)]
            for w, i, j in zip(group, np.r_[0, ends[:-1] + 1].tolist(), ends.tolist(), strict=True):
                yield w, ids[i:j].tobytes()

    def cut(self, text: str) -> list[str]:
        """The text as a run of plain words, another word, a run of plain words and so on; either may be empty."""
        if not self.splits:
            return [x for w in text.split(" ") for x in ("", w)]
        out, at = [], 0
        while found := ODD.search(text, at):
            i, j = text.rfind(" ", at, found.start()) + 1, text.find(" ", found.end())
            out += [text[at:i], text[i : (j := j if j >= 0 else len(text))]]
            at = j
        return [*out, text[at:]]

    def encoded(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words without spaces."""
        odd = set(self.cut(" ".join(words))[1::2])
        new = [w for w in odd if w not in self]
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
            new = list(odd)
        once = {}
        for w, ids in self.learned(new):
            (self if len(w) <= 64 else once)[w] = ids
        parts = self.parts
        return [(self[w] if w in self else once[w]) if w in odd else parts[w.lower()] if w.isalpha() else self.by_parts(w) for w in words]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        found = self.encoded(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        out, ends = packed(pa.array(found, pa.large_binary()).take(coded.indices))
        at = ends[split.offsets.to_numpy()] // 4
        return [out.view(np.uint32)[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(1)
def words_of(path: str) -> Words:
    """One for all tasks of a worker."""
    return Words(path)


def _shards(path: str, size: int):
    """Encodes texts in the order of their rows, and packs them into shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        words, end = words_of(path), np.array([END], np.uint32)
        docs: list[int] = []
        held: list[np.ndarray] = []
        seq = n = 0

        def encoded() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                i = 0
                while i < len(texts):  # few characters at once
                    cut, chars = [], 0
                    while i + len(cut) < len(texts) and chars < PIECE:
                        cut.append(pieces(texts[i + len(cut)].as_py() or ""))
                        chars += sum(map(len, cut[-1]))
                    found = iter(words.ids([p for parts in cut for p in parts]) if len(cut) > 1 else [x for p in cut[0] for x in words.ids([p])])
                    for parts in cut:
                        yield ids[i], np.concatenate([*(next(found) for _ in parts), end])
                        i += 1

        def shard() -> pa.RecordBatch:
            rules, symbols = compressed(np.concatenate(held))
            sizes = np.array([len(h) for h in held], np.int64)
            small = lambda x: x.astype(np.uint32).tobytes()
            row = {"part": part, "seq": seq, "n_ids": n, "rules": small(rules), "lengths": small(lengths(rules)), "symbols": small(symbols), "doc_ids": np.array(docs, np.int64).tobytes(), "doc_sizes": sizes.tobytes()}
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for doc_id, ids in encoded():
            if n and n + len(ids) > size:
                yield shard()
                docs, held, n, seq = [], [], 0, seq + 1
            docs.append(doc_id)
            held.append(ids)
            n += len(ids)
        if n:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str, path: str, shard: int = SHARD) -> None:
    """Encodes all texts, in ascending doc_id order, into shards at path. Null and empty texts have the end id alone.

    Rows without a doc_id are left out; repeated rows are written as often as they occur. Only doc_id and text are read. Texts are
    ordered first; the tasks that hold a range of them encode, compress and write it.
    """
    ordered = docs.select("doc_id", "text").where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_shards(tokenizer, shard), SCHEMA).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards at path, with the number of ids before each (start); only totals by partition meet in one place."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    within = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0)).alias("inner"))
    starts = saved(within.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("start")), "starts")
    return shards.join(F.broadcast(starts) if starts.count() <= FEW else starts, ["part", "seq"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules, width, symbols = (np.frombuffer(row[k], np.uint32).astype(np.int64) for k in ("rules", "lengths", "symbols"))
            ids = decode(rules.reshape(-1, 2), width, symbols).astype("<u4")
            size = np.frombuffer(row["doc_sizes"], np.int64)
            ends = np.cumsum(size)
            crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            columns = [np.frombuffer(row["doc_ids"], np.int64), row["start"] + ends - size, size, np.array(crc, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards, decoded: doc_id, start, n_tokens, ids_crc32. No shards give no rows."""
    return read_shards(spark, path).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .common import shared_folder

    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_documents(spark, path)


QUERIES = {"op6_token_files": op6_token_files}
#: SQL has no tokenizer; the tests compare with the library's own ids.
ORACLES: dict[str, str] = {}
