import hashlib
import random
import re

import pytest

from groundplan.llm import line_dedup
from groundplan.llm.line_dedup import keep_bitmaps, kept_lines, op12_line_dedup

from .helpers import SF, documents, real


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    """rows: (doc_id, text), repeated or without an id; what is left of each."""
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                first[key(line)] = min(i, first.get(key(line), i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(out):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = real("documents")
    got = sorted((tuple(r) for r in op12_line_dedup(spark, SF).collect()), key=str)
    assert got == brute(list(zip(docs.doc_id, docs.text)))


@pytest.mark.parametrize("hot_share", [1, 20, 2000])
def test_edges(spark, hot_share):
    """All keys cold, some hot, most hot: the same rows."""
    rng = random.Random(3)
    pool = ["Ärger im Büro!", "ÄRGER IM BÜRO!", "  a line of words\t", "A LINE of words", "short", "ninechars", "ten chars!", "", "\x0b\x0c\r", "é" * 9, "é" * 10, " no-break space ", "x" * 50_000]
    texts = [None, "", "\n", "\n\n", "ten chars!", "ten chars!\nten chars!", "\n".join(pool), "\n".join(pool * 200)]
    texts += ["\n".join(rng.choices(pool + ["only here %d" % k], k=rng.randint(1, 12))) for k in range(80)]
    ids = [x - 30 for x in rng.sample(range(len(texts)), len(texts))]
    docs = documents(spark, texts, ids).selectExpr("*", "1 as key", "2 as keep", "3 as version", "4 as n_lines").repartition(5)
    bitmaps = keep_bitmaps(docs, hot_share=hot_share)
    assert found(kept_lines(docs, bitmaps)) == brute(list(zip(ids, texts)))
    for r in bitmaps.collect():  # runs do not touch, and hold what is left
        assert all(a.start + a.length < b.start for a, b in zip(r.keep, r.keep[1:]))
        assert sum(x.length for x in r.keep) == r.n_lines - r.n_dropped and r.n_dropped > 0


def test_repeated_rows_and_rows_without_an_id(spark):
    texts = ["a line of words\nb", "a line of words\nc", "one more line here", "d\na line of words", None]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (2, texts[3]), (2, texts[1]), (None, texts[0]), (None, None), (3, texts[2]), (4, texts[4])]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    assert found(kept_lines(docs, keep_bitmaps(docs))) == brute(rows)
    none = docs.limit(0)
    assert kept_lines(none, keep_bitmaps(none)).count() == 0


def test_no_exchange_between_ranges_and_first_occurrences(spark):
    """The window streams over the ranges as they are sorted."""
    docs = documents(spark, ["a line of words"] * 4)
    plan = keep_bitmaps(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    window = plan[plan.index("Window"):]
    assert window.index("rangepartitioning") < (window.index("hashpartitioning") if "hashpartitioning" in window else len(window))
    assert line_dedup.HOT_SHARE == 2000
