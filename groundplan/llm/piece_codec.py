"""Encoding and decoding with a SentencePiece model as a weighted transducer.

The compiled transducer is normaliser, then pieces with byte fallback. The normaliser puts a space in front, and writes spaces as
U+2581. After it, a state is the piece read last, and an arc reads one piece: its weight is 0 if the model's merges leave the
two pieces as they are side by side, and infinite if they would have merged across. So the tropical-semiring shortest path is the one
path of finite weight, and its pieces are those that the merges give; piece scores alone would not do, as in this kind of
model a score is a merge's rank and not a cost. Each place of the input keeps its one best state, which has finite weight. A
character without a piece is read as its bytes, by arcs that fit everywhere.

No piece holds U+2581 behind another character, so an input splits in front of each run of spaces into parts that can be composed one by
one. A task composes each distinct part once; parts and results of earlier batches stay in a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, packed, slices, span_hashes, table

SPACE = "▁"
END = None
#: Parts that a worker remembers, of about 30 bytes each.
REMEMBERED = 2_000_000
#: Pairs of pieces of which a worker remembers whether merging keeps them apart.
PAIRS = 1 << 20


def model_pieces(path: str) -> tuple[list[str], list[float], list[int]]:
    """(pieces, scores, kinds: 0 for ordinary pieces, 1 for bytes, 2 for control and unknown) of a model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize("Ａ  x ") != f"{SPACE}Ａ{SPACE}{SPACE}x{SPACE}":
        raise ValueError("only models whose normaliser keeps all characters and puts a space in front are compiled")
    n = range(model.get_piece_size())
    kinds = [1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in n]
    pieces = [model.id_to_piece(i) for i in n]
    if any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds, strict=True) if k == 0):
        raise ValueError("a piece holds a space behind another character")
    return pieces, [model.get_score(i) for i in n], kinds


class Transducer:
    """The compiled model; parts are byte strings, with plain spaces."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        self.pieces = {p.replace(SPACE, " "): i for i, p in enumerate(pieces) if kinds[i] == 0}
        self.text, self.scores, self.n = [p.replace(SPACE, " ") for p in pieces], scores, len(pieces)
        self.byte = [i for i in range(len(pieces)) if kinds[i] == 1]
        self.apart: dict[int, bool] = {}
        surface = [bytes([self.byte.index(i)]) if k == 1 else self.text[i].encode() if k == 0 else b"" for i, k in enumerate(kinds)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.length = np.array([len(s) for s in surface])
        self.begin = np.r_[0, np.cumsum(self.length)[:-1]]
        #: arcs: pieces that merges leave whole, as a trie of their texts from the end; a node's piece is at END
        self.arcs: dict = {}
        for p, i in self.pieces.items():
            if self.merged(p) == [p]:
                node = self.arcs
                for x in reversed(p):
                    node = node.setdefault(x, {})
                node[END] = i
        self.known = np.zeros(0, np.uint64)  # sorted hashes of parts
        self.known_check = np.zeros(0, np.uint64)  # of each, another hash
        self.known_at = np.zeros(1, np.int64)
        self.known_ids = np.zeros(0, np.int32)

    def merged(self, text: str) -> list[str]:
        """What merging gives: always the pair of the best score, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compose(self, part: bytes) -> list[int]:
        """The ids on the best path through one part."""
        s = part.decode()
        n, apart, arcs, text = len(s), self.apart, self.arcs, self.text
        state, begin = [-1] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            node, b, ending = arcs, e, []
            while b:
                node = node.get(s[b - 1])
                if node is None:
                    break
                b -= 1
                p = node.get(END)
                if p is not None:
                    ending.append((p, b))
            for p, b in reversed(ending):
                q = state[b]
                if q >= 0:
                    fits = apart.get(q << 16 | p)
                    if fits is None:
                        if len(apart) >= PAIRS:
                            apart.clear()
                        fits = apart[q << 16 | p] = self.merged(text[q] + text[p]) == [text[q], text[p]]
                    if not fits:
                        continue
                state[e], begin[e] = p, b
                break
            else:
                begin[e] = e - 1  # bytes: state -1 fits all
        out, e = [], n
        while e:
            b = begin[e]
            if state[e] >= 0:
                out.append(state[e])
            else:
                out.extend(self.byte[x] for x in reversed(s[b:e].encode()))
            e = b
        out.reverse()
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each row's begin, with the end); buf must not hold U+2581."""
        filled = np.diff(offsets) > 0
        own = np.r_[0, np.cumsum(np.diff(offsets) + filled)]
        text = np.full(own[-1], 0x20, np.uint8)
        inside = np.ones(own[-1], bool)
        inside[own[:-1][filled]] = False
        text[inside] = buf
        blank = text == 0x20
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[own[:-1][filled]] = True
        starts = np.flatnonzero(starts)
        ends = np.r_[starts[1:], len(text)][: len(starts)]
        h = span_hashes(text, starts, ends)
        check = span_hashes(text, starts, ends, 7)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        missing = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(missing):
            raw = text.tobytes()
            found = [self.compose(raw[starts[k] : ends[k]]) for k in first[missing]]
            self._remember(distinct, distinct[missing], check[first[missing]], found)
            at = np.searchsorted(self.known, distinct)
        if (self.known_check[at][inverse] != check).any():  # different parts of equal hash: none of this comes from the table
            raw, seen = text.tobytes(), {}
            parts = [raw[a:b] for a, b in zip(starts, ends)]
            lists = [seen[p] if p in seen else seen.setdefault(p, self.compose(p)) for p in parts]
            total = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            return np.array([i for x in lists for i in x], np.int32), total[np.searchsorted(starts, own)]
        size = (self.known_at[at + 1] - self.known_at[at])[inverse]
        ids = self.known_ids[gathered(self.known_at[at][inverse], size)]
        total = np.r_[0, np.cumsum(size)]
        return ids, total[np.searchsorted(starts, own)]

    def _remember(self, needed: np.ndarray, new: np.ndarray, check: np.ndarray, found: list[list[int]]) -> None:
        keep = np.arange(len(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            keep = np.flatnonzero(np.isin(self.known, needed))
        size = np.diff(self.known_at)[keep]
        key = np.r_[self.known[keep], new]
        all_size = np.r_[size, np.array([len(x) for x in found], np.int64)]
        all_at = np.r_[self.known_at[:-1][keep], len(self.known_ids) + np.r_[0, np.cumsum(all_size[len(keep) :])[:-1]]].astype(np.int64)
        ids = np.r_[self.known_ids, np.array([i for x in found for i in x], np.int32)]
        order = np.argsort(key, kind="stable")
        self.known, size, self.known_check = key[order], all_size[order], np.r_[self.known_check[keep], check][order]
        self.known_ids = ids[gathered(all_at[order], size)]
        self.known_at = np.r_[0, np.cumsum(size)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each row's begin, with the end): the pieces' texts without the first space."""
        size = self.length[ids]
        total = np.r_[0, np.cumsum(size)]
        out = self.surface[gathered(self.begin[ids], size)]
        begin, drop = total[at], np.zeros(len(out), bool)
        some = begin[:-1][begin[1:] > begin[:-1]]
        drop[some[out[some] == 0x20]] = True
        return out[~drop], begin - np.r_[0, np.cumsum(drop)][begin]


_compiled: dict[int, Transducer] = {}


def _coded(key: int, model: tuple[list[str], list[float], list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _compiled:
            _compiled.clear()
            _compiled[key] = Transducer(*model)
        codec = _compiled[key]
        mark = SPACE.encode()
        for batch in batches:
            text = batch.column(1)
            data, offsets = packed(text)
            if mark in memoryview(data).tobytes():
                texts = [(t.as_py() or "").replace(SPACE, " ") for t in text]
                data, offsets = packed(pa.array(texts))
            for i, j in slices(offsets):
                ids, at = codec.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                back, ends = codec.decode(ids, at)
                texts = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(back)))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, texts.cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode_pieces(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids array<int>, decoded.

    ids are those of the SentencePiece model at model_path (by default the public piece_bpe_32k.model), decoded is what they stand
    for: the text itself, but for U+2581, which the model doesn't tell from a space. Null and empty texts have no ids and an empty
    decoded text. Rows come out one for one, without a doc_id or repeated as they are. Columns other than doc_id and text are not read. The driver reads the model; executors need no file.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    model = model_pieces(path)
    return docs.select("doc_id", "text").mapInArrow(_coded(hash((tuple(model[0]), tuple(model[1]))), model), "doc_id long, ids array<int>, decoded string")


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_pieces(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_sentencepiece_codec": op7_sentencepiece_codec}
ORACLES: dict[str, str] = {}
