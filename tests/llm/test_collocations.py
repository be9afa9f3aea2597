import random
import re
from collections import Counter
from functools import partial

import numpy as np
import pytest

from groundplan.llm import collocations as c
from groundplan.llm.collocations import collocations, cut, misra_gries, op11_phrase_collocations

from .helpers import SF, documents, morse, real


def brute(rows, longest=3, threshold=10, covered=50, top=2000):
    counts, words_of, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(w)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        found = []
        cand = {p: a for p, a in f.items() if " " in p and a >= threshold}
        inside = {}
        for p, a in cand.items():
            w = p.split(" ")
            for m in range(2, len(w)):
                for s in range(len(w) - m + 1):
                    q = " ".join(w[s : s + m])
                    inside[q] = max(inside.get(q, 0), a)
        for p, a in cand.items():
            if 100 * inside.get(p, -1) >= covered * a:
                continue
            w = p.split(" ")
            score, _, l, r = min((10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
            found.append((-score, -a, p.encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, words_of[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_brute_force(spark):
    docs = real("documents")
    out = op11_phrase_collocations(spark, SF)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = rows_of(out)
    assert got == brute(list(zip(docs.lang, docs.text))) and len(got) > 100


@pytest.mark.parametrize("block", [60, 3000, 8 << 20])
def test_edges_in_blocks_of_all_sizes(spark, block):
    rng = random.Random(block)
    vocabulary = ["the", "The", "of", "new", "york", "é", "É", "x" * 3000, "\x00", "nb sp", "don't", *morse(9)]
    texts = [None, "", " \t ", "...", "the of. the of\tnew", "a\x0bb\x0cc\rd"]
    for _ in range(150):
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randint(1, 25))))
    langs = [rng.choice(["en", "en", "fr", None, "und", ""]) for _ in texts]
    rows = list(zip(langs, texts)) * 2
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as block", "2 as n", "3 as part", "'x' as phrase").repartition(3)
    for longest, threshold, covered, top in ((3, 10, 50, 2000), (4, 3, 80, 7)):
        assert rows_of(collocations(docs, longest, threshold, covered, top, block)) == brute(rows, longest, threshold, covered, top)


def test_empty_table_and_rows_without_words(spark):
    docs = documents(spark, ["..", None])
    assert collocations(docs).count() == 0 and collocations(docs.limit(0)).count() == 0


def test_every_frequent_key_survives_summaries_that_overflow():
    rng = np.random.default_rng(1)
    for threshold in (2, 10, 50):
        keys = np.where(rng.random(40_000) < 0.5, rng.zipf(1.3, 40_000) % 5000, rng.integers(1 << 40, 1 << 41, 40_000)).astype(np.uint64)
        true = Counter(keys.tolist())
        parts = [np.unique(x, return_counts=True) for x in np.array_split(keys, 37)]
        capacity = len(keys) // threshold + 1
        kept, counts, lost = misra_gries(parts, capacity)
        assert len(kept) <= capacity and lost < threshold
        at = dict(zip(kept.tolist(), counts.tolist()))
        assert all(at.get(k, 0) + lost >= n >= at.get(k, 0) for k, n in true.items())
        assert {k for k, n in true.items() if n >= threshold} <= {k for k, n in at.items() if n + lost >= threshold}
    assert misra_gries([], 5)[2] == 0


def test_cuts_keep_pieces_whole():
    for text in ("", "abc", "a.b.c.d.e", "aaaaaaaaaa.b", "a" * 50, ".....", "ab.cdefghijkl.m", "ab." * 40):
        buf = np.frombuffer(text.encode(), np.uint8)
        for limit in (1, 4, 7, 1000):
            parts = [p.tobytes().decode() for p in cut(buf, limit)]
            pieces = [x for p in parts for x in p.split(".") if x]
            assert pieces == [x for x in text.split(".") if x]
            assert all(len(p) <= limit or "." not in p for p in parts)


def test_products_beyond_64_bits(spark):
    """The score's arithmetic on counts of up to 10**14."""
    a, l, r = 98_765_432_109_876, 99_999_999_999_999, 99_876_543_210_123
    grams = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r), ("en", None, 0, 10**15)], c.GRAMS)
    real_one = c.frequent_ngrams
    try:
        c.frequent_ngrams = partial(lambda g, *_: g, grams)
        got = rows_of(collocations(grams))
    finally:
        c.frequent_ngrams = real_one
    assert got == [("en", 1, "x y", a, l, r, 10**15, 10**6 * a * a // (l * r))]
