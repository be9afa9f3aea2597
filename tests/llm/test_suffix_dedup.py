import hashlib

import numpy as np

from groundplan.llm.suffix_dedup import op2_suffix_array_dedup, repeated_spans_removed

from .helpers import SF, documents, morse, real


def brute(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()
    return out


def test_query_equals_brute_force(spark):
    docs = real("documents")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_array_dedup(spark, SF).collect()}
    assert got == brute(list(zip(docs.doc_id, docs.text)))


def test_edges(spark):
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("abcdé "), 900))
    line = "".join(rng.choice(list("xyz "), 130))
    texts = [None, "", "a" * 99, "a" * 100, "a" * 350, base, base[37:], base[:400] + "Q" + base[400:], base[100:199], base[100:200]]
    texts += ["".join(rng.choice(list("pqrst"), rng.integers(5, 300))) + line + "".join(rng.choice(list("uvw"), rng.integers(5, 200))) for _ in range(60)]
    texts += ["".join(rng.choice(list("01"), 200)) * 3, base * 2, "x" * 20_000 + base, texts[20]]
    ids = [int(x) for x in rng.permutation(len(texts)) - 20]
    docs = documents(spark, texts, ids).selectExpr("*", "1 as anchor", "2 as lo", "3 as words").repartition(5)
    out = repeated_spans_removed(docs).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out}
    assert got == brute(list(zip(ids, texts)))
    assert repeated_spans_removed(docs.limit(0)).count() == 0


def test_rows_that_are_there_twice(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdé "), 600))
    texts = [base, "x" + base[100:400] + "é!", "y" * 200, None]
    twice = documents(spark, texts).union(documents(spark, texts)).union(documents(spark, [base], [None])).repartition(3)
    out = repeated_spans_removed(twice, as_text=True).collect()
    assert len(out) == 8
    for r in out:
        n, removed, spans, _ = brute(list(enumerate(texts)))[r.doc_id]
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans)) == (n, removed, spans)
    assert {r.kept for r in out if r.doc_id == 1} == {"xé!"}


def test_groups_that_are_cut_over_many_tasks(spark):
    """One part of 30 to 99 bytes in all documents, in many contexts, some of which come back; ranges cut through these groups."""
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("abcdefg "), n)) for n in (30, 62, 80, 99)]
    heads = ["".join(rng.choice(list("xyz"), rng.integers(40, 90))) for _ in range(40)]
    texts = [heads[rng.integers(40)] + parts[k % 4] + "".join(rng.choice(list("uvw"), 1 + k % 3)) + heads[rng.integers(40)] for k in range(600)]
    names = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        out = repeated_spans_removed(documents(spark, texts).union(documents(spark, texts[:50])).repartition(7)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out}
    assert len(out) == 650 and got == brute(list(enumerate(texts)))


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = morse()
    texts = [a, b, "x" + a, "y" + b + "z", b[1:] + "q"]
    for length in (100, 1024):
        out = repeated_spans_removed(documents(spark, texts), length).collect()
        got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out}
        assert got == brute(list(enumerate(texts)), length)
