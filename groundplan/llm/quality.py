"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of vote patterns
(3**8 patterns at most, from all documents) estimates how often each labeller is right on good and on bad documents, and
with it the posterior of each pattern: a latent class for good texts and one for each kind of junk. Posteriors of a bounded sample train a linear scorer on hashed byte trigrams and repeated
words, which then scores every document whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_of, packed, slices, table, word_hashes

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it for as with was be on are by at this from or have not "
    "le la les de des du et en un une que qui est pour dans par sur au aux pas avec "
    "der die das und ist nicht ein eine zu von mit sich auf für dem den im auch "
    "el los las y se del al con por su una es para como más lo"
).split()
LABELLERS = ("symbols", "capitals", "runs", "word_ends", "bars", "sentences", "function_words", "repeats")
BUCKETS = 1 << 15

_KNOWN = np.unique(np.array([h for w in FUNCTION_WORDS for h in hash_of(w)], np.uint64))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 0x80)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~!", np.uint8))
_PUNCT = np.isin(np.arange(256), np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~!?.,;:", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between the places of at."""
    total = np.r_[0, np.cumsum(flags)]
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def votes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, labellers): 1 good, -1 bad, 0 no vote. Texts of under five words get no vote. And the words that equal the one before."""
    h, _, ends, first = word_hashes(buf, offsets)
    words = np.diff(first).astype(float)
    w = np.maximum(words, 1)
    black = np.maximum(_sums(~_SPACE[buf], offsets), 1)
    letters = np.maximum(_sums(_LETTER[buf], offsets), 1)
    same = np.zeros(len(buf), bool)
    same[1:] = (buf[1:] == buf[:-1]) & _PUNCT[buf[1:]]
    last = buf[ends - 1]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][words > 0]] = False
    repeats = _sums(again, first)
    symbols = _sums(_SYMBOL[buf], offsets) / black
    capitals = _sums(_UPPER[buf], offsets) / letters
    runs = _sums(same, offsets) / w
    word_ends = _sums(_SYMBOL[last], first) / w
    bars = _sums(buf == ord("|"), offsets) / w
    sentences = _sums(_STOP[last], first) / w
    known = _sums(np.isin(h, _KNOWN), first) / w
    pick = lambda good, bad: np.where(bad, -1, np.where(good, 1, 0))
    out = np.stack(
        [
            pick(symbols < 0.02, symbols > 0.06),
            pick(capitals < 0.15, capitals > 0.35),
            pick(runs < 0.03, runs > 0.2),
            pick(word_ends < 0.05, word_ends > 0.25),
            pick(bars < 0.01, bars > 0.15),
            pick((sentences > 0.01) & (sentences < 0.3), (sentences > 0.6) | ((sentences < 0.003) & (words > 40))),
            pick(known > 0.08, (known < 0.02) & (words > 20)),
            pick(repeats < 0.05 * w, repeats > 0.25 * w),
        ],
        axis=1,
    ).astype(np.int8)
    out[words < 5] = 0
    return out, repeats


def _codes(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = packed(batch.column(0))
        for i, j in slices(offsets):
            code, n = np.unique(_codes(votes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])


def accuracies(code: np.ndarray, n: np.ndarray, labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM on pattern counts: (P(vote | class) as [class, labeller, vote], shares of the classes, posterior of good by pattern).

    Class 0 is good; class 1 + l is the kind of bad that labeller l was first to see, as kinds of junk rarely meet in a
    document. At first, patterns without a bad vote are good. A labeller without a vote says nothing. Counts get 0.1 added.
    """
    v = code[:, None] // 3 ** np.arange(labellers) % 3
    onehot = (v[:, :, None] == np.arange(3)).astype(float)
    onehot[:, :, 1] = 0
    bad = v == 0
    q = np.full((labellers + 1, len(code)), 0.05 / labellers)
    q[np.where(bad.any(1), 1 + bad.argmax(1), 0), np.arange(len(code))] = 0.95
    for _ in range(rounds):
        weight = q * n
        share = (weight.sum(1) + 0.1) / (n.sum() + 0.1 * (labellers + 1))
        p = np.einsum("cp,plv->clv", weight, onehot) + np.array([0.1, 0, 0.1])
        p /= p.sum(2, keepdims=True)
        logs = np.einsum("clv,plv->cp", np.log(np.maximum(p, 1e-12)), onehot) + np.log(share)[:, None]
        new = np.exp(logs - logs.max(0))
        new /= new.sum(0)
        done = not len(code) or np.abs(new - q).max() < 1e-9
        q = new
        if done:
            break
    return p, share, q[0]


def _trigrams(buf: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes that begin at each byte (the last two bytes begin none)."""
    b = buf.astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _features(text: np.ndarray, repeats: float) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams by bucket, and repeated words in the last bucket but one; square roots of counts, of length 1."""
    bucket, n = np.unique(_trigrams(text), return_counts=True) if len(text) > 2 else (np.zeros(0, np.int64), np.zeros(0))
    bucket, value = np.r_[bucket, BUCKETS], np.sqrt(np.r_[n, 3 * repeats])
    return bucket, value / max(np.sqrt((value**2).sum()), 1e-9)


def _train(posterior: np.ndarray, rounds: int = 150):
    """Logistic regression on posteriors, in one task: the sample's size is a parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            data, offsets = packed(batch.column(1))
            for k, i in enumerate(batch.column(0).to_pylist()):
                text, own = data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]])
                vote, repeats = votes(text, own)
                found.append((i, *_features(text, repeats[0]), posterior[_codes(vote)[0]]))
        found.sort(key=lambda x: x[0])
        w = np.zeros(BUCKETS + 2)
        if found:
            size = np.array([len(x[1]) for x in found])
            bucket, value = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
            row, y = np.repeat(np.arange(len(found)), size), np.array([x[3] for x in found])
            m, s = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2)
            for t in range(1, rounds + 1):  # Adam on all rows, with a small ridge
                p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[bucket], len(found)) + w[-1], -40, 40)))
                err = (p - y) / len(found)
                g = np.r_[np.bincount(bucket, value * err[row], BUCKETS + 1), err.sum()] + 1e-6 * w
                m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
                w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    return run


def _score(weights: np.ndarray, posterior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            for i, j in slices(offsets):
                buf, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                score, (vote, repeats) = np.zeros(j - i), votes(buf, own)
                for k in range(j - i):
                    if own[k + 1] > own[k]:
                        bucket, value = _features(buf[own[k] : own[k + 1]], repeats[k])
                        score[k] = 1 / (1 + np.exp(-np.clip((value * weights[bucket]).sum() + weights[-1], -40, 40)))
                columns = [batch.column(0).slice(i, j - i), pa.array(posterior[_codes(vote)]), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "posterior", "score"])

    return run


def classify(docs: DataFrame, sample_rows: int = 4096, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, posterior (of being good, from the votes), score (the scorer's, 0 to 1), kept.

    sample_rows bounds the documents that train the scorer: those with the smallest xxhash64(doc_id). Votes are counted over all
    documents. Rows come out one for one, without a doc_id or repeated as they are. Null and empty texts have score 0 and aren't kept. Columns other than doc_id and text are not read.
    An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    counted = docs.select("text").mapInArrow(_patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    code, n = np.array([r.code for r in counted], np.int64), np.array([r.n for r in counted], float)
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    if len(code):
        posterior[code] = accuracies(code, n, len(LABELLERS))[2]
    sample = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.join(F.broadcast(sample), "doc_id", "left_semi")  # sample_rows ids at most
    trained = chosen.repartition(1).mapInArrow(_train(posterior), "weights binary").first()
    weights = np.frombuffer(trained.weights) if trained else np.zeros(BUCKETS + 2)
    return docs.mapInArrow(_score(weights, posterior), "doc_id long, posterior double, score double").withColumn("kept", F.col("score") >= threshold)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLES: dict[str, str] = {}
