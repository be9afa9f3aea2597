import math
import re
import zlib
from collections import Counter

from groundplan.llm.lm_scores import lm_scores, op10_lm_scores

from .helpers import SF, documents, morse, real


def plain(rows):
    texts = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    grams, after = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    read = {i: list(zip(["<s>", "<s>", *words], ["<s>", *words], words)) for i, words in texts}  # rows of equal ids have equal texts
    for i, _ in texts:
        if not held[i]:
            for k in range(3):
                grams[k].update(g[2 - k :] for g in read[i])
    context = [Counter(), Counter(), Counter()]
    for k in (1, 2):
        for g, c in grams[k].items():
            after[k][g[:-1]] += 1
            context[k][g[:-1]] += c
    n, v = sum(grams[0].values()), len(grams[0])

    def full(g, k):
        if not k:
            return (grams[0][g] + 0.1) / (n + 0.1 * (v + 1))
        c = context[k][g[:-1]]
        lower = full(g[1:], k - 1)
        return (max(grams[k][g] - 0.75, 0) + 0.75 * after[k][g[:-1]] * lower) / c if c else lower

    out = {}
    for i, words in texts:
        base = [full((w,), 0) for w in words]
        out[i] = (held[i], len(words), sum(grams[0][(w,)] > 0 for w in words), n, sum(map(math.log10, base)), sum(math.log10(full(g, 2)) for g in read[i]))
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][5], rel_tol=1e-9)


def test_query_equals_plain_version_and_beats_the_base(spark):
    docs = real("documents")
    got = op10_lm_scores(spark, SF).collect()
    same(got, plain(list(zip(docs.doc_id, docs.text))))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_blocks_and_edges(spark):
    texts = [None, "", "A b a B", "a b c", "\x00 é É", "a " * 60_000, "new words", *(f"w{i % 7} a b w{i}" for i in range(60))]
    docs = documents(spark, texts).selectExpr("*", "1 as block", "2 as gram", "3 as first")
    for block in (100, 8 << 20):
        same(lm_scores(docs, block).collect(), plain(list(enumerate(texts))))
    assert lm_scores(docs.limit(0)).count() == 0
    same(lm_scores(documents(spark, ["x"], [next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)])).collect(), plain([(next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0), "x")]))


def test_repeated_rows_count_and_rows_without_id_go(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b d"), (3, None), (3, None), (4, "c a b")]
    got = lm_scores(documents(spark, [*(t for _, t in rows), "a b"], [*(i for i, _ in rows), None])).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    want = plain(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4] and math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][5], rel_tol=1e-9)


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = morse()
    texts = [a, b, f"{a} {a}", f"{b} x"]
    same(lm_scores(documents(spark, texts)).collect(), plain(list(enumerate(texts))))
