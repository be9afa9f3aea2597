import itertools
import math
import re
from collections import Counter

import numpy as np

from groundplan.llm import quality
from groundplan.llm.common import packed

from .helpers import SF, documents, real


def test_labels_that_it_has_not_seen(spark):
    labels = real("labels").merge(quality.op1_quality_classifier(spark, SF).toPandas(), on="doc_id")
    assert (labels.kept == (labels.quality == 1)).mean() > 0.95
    assert labels[labels.quality == 1].kept.mean() > 0.99
    assert len(labels) == len(real("labels"))


def test_em_finds_kinds_of_junk_and_leaves_good_texts():
    rng = np.random.default_rng(0)
    kind = rng.choice(4, 20_000, p=[0.85, 0.05, 0.05, 0.05])  # 0 is good
    vote = np.where(rng.random((len(kind), 3)) < 0.01, -1, 1)
    for k in (1, 2, 3):
        vote[kind == k, k - 1] = -1
    vote[rng.random(vote.shape) < 0.1] = 0
    code, n = np.unique(quality._codes(vote.astype(np.int8)), return_counts=True)
    p, share, posterior = quality.accuracies(code, n.astype(float), 3)
    assert (p[0, :, 2] > 0.95).all() and 0.75 < share[0] < 0.9
    own = posterior[np.searchsorted(code, quality._codes(vote.astype(np.int8)))] > 0.5
    assert (own == (kind == 0)).mean() > 0.95
    assert (posterior[code == quality._codes(np.zeros((1, 3), np.int8))[0]] > 0.5).all()  # no votes: as most are


def test_votes_stay_in_their_row(spark):
    import pyarrow as pa

    texts = ["a a a a a a", None, "a b c d e. f", "", "THE END!! OF!! IT!! ALL!! NOW!!"]
    both, _ = quality.votes(*packed(pa.array(texts)))
    for k, t in enumerate(texts):
        assert (quality.votes(*packed(pa.array([t])))[0][0] == both[k]).all()


def test_edges(spark):
    texts = [None, "", " ", "x", "ab", "The cat sat on the mat by the door and it was warm."] * 3 + ["word " * 60_000, "A" * 100_000, "\x00" * 50]
    docs = documents(spark, texts).selectExpr("*", "1 as score", "2 as posterior", "3 as code")
    out = {r.doc_id: r for r in quality.classify(docs).collect()}
    assert len(out) == len(texts) and not out[0].kept and out[0].score == 0 and not out[1].kept
    assert out[5].kept
    assert quality.classify(docs.limit(0)).count() == 0


def plain_votes(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), data))
    n = len(words)
    symbols, stops = b"#$%&*+/<=>@[\\]^_`{|}~!", b".!?"
    again = sum(a == b for a, b in itertools.pairwise(words))
    if n < 5:
        return [0] * 8, again
    upper, letters = sum(65 <= b < 91 for b in data), sum(65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in data)
    black = sum(b not in b" \t\n\x0b\x0c\r" for b in data)
    s = sum(b in symbols for b in data) / max(black, 1)
    runs = sum(a == b and b in symbols + b"?.,;:" for a, b in itertools.pairwise(data)) / n
    ends, bars, sentences = sum(w[-1] in symbols for w in words) / n, data.count(b"|") / n, sum(w[-1] in stops for w in words) / n
    known = sum(w.decode("utf-8", "replace") in quality.FUNCTION_WORDS for w in words) / n
    c = upper / max(letters, 1)
    rules = [
        (s < 0.02, s > 0.06), (c < 0.15, c > 0.35), (runs < 0.03, runs > 0.2), (ends < 0.05, ends > 0.25), (bars < 0.01, bars > 0.15),
        (0.01 < sentences < 0.3, sentences > 0.6 or (sentences < 0.003 and n > 40)), (known > 0.08, known < 0.02 and n > 20), (again < 0.05 * n, again > 0.25 * n),
    ]
    return [-1 if bad else 1 if good else 0 for good, bad in rules], again


def plain_em(patterns):
    """Posterior of good by pattern, with loops only."""
    q = {}
    for v in patterns:
        first = next((1 + k for k, x in enumerate(v) if x == -1), 0)
        q[v] = [0.95 if c == first else 0.05 / 8 for c in range(9)]
    total = sum(patterns.values())
    for _ in range(200):
        share = [(sum(q[v][c] * n for v, n in patterns.items()) + 0.1) / (total + 0.9) for c in range(9)]
        p = {}
        for c, k in itertools.product(range(9), range(8)):
            good, bad = (sum(q[v][c] * n for v, n in patterns.items() if v[k] == x) + 0.1 for x in (1, -1))
            p[c, k] = {1: good / (good + bad), -1: bad / (good + bad), 0: 1.0}
        new = {}
        for v in patterns:
            x = [share[c] * math.prod(max(p[c, k][v[k]], 1e-12) for k in range(8)) for c in range(9)]
            new[v] = [y / sum(x) for y in x]
        change = max(abs(a - b) for v in q for a, b in zip(q[v], new[v]))
        q = new
        if change < 1e-9:
            break
    return {v: x[0] for v, x in q.items()}


def test_classifier_equals_a_plain_version(spark):
    docs = real("documents")
    found = [plain_votes(t) for t in docs.text]
    posterior = plain_em(Counter(tuple(v) for v, _ in found))
    x = np.zeros((len(docs), quality.BUCKETS + 2))
    for k, (text, (_, again)) in enumerate(zip(docs.text, found)):
        data = (text or "").encode()
        grams = Counter(((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 17 for i in range(len(data) - 2))
        for bucket, n in grams.items():
            x[k, bucket] = math.sqrt(n)
        x[k, -2] = math.sqrt(3 * again)
        x[k] /= max(np.sqrt((x[k] ** 2).sum()), 1e-9)
        x[k, -1] = 1
    y = np.array([posterior[tuple(v)] for v, _ in found])
    w, m, s = (np.zeros(x.shape[1]) for _ in range(3))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, 151):
        g = x.T @ (sigmoid(x @ w) - y) / len(x) + 1e-6 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    got = {r.doc_id: r for r in quality.op1_quality_classifier(spark, SF).collect()}
    for i, text, p, score in zip(docs.doc_id, docs.text, y, sigmoid(x @ w)):
        score = score if text else 0.0
        assert math.isclose(got[i].posterior, p, abs_tol=1e-6) and math.isclose(got[i].score, score, abs_tol=1e-3), i
        assert got[i].kept == (score >= 0.5) or abs(score - 0.5) < 1e-3
