import random
import re

import numpy as np

from groundplan.llm.decontaminate import _item_pairs, align, contaminated, needed, op8_benchmark_decontamination, rare_places

from .helpers import SF, documents, real


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(a, b):
    """Smith-Waterman cell by cell."""
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
    return h.max()


def coded(*texts):
    ids = {w: k for k, w in enumerate({w for t in texts for w in t})}
    return [np.array([ids[w] for w in t], np.int64) for t in texts]


def test_alignment():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert abs(align(*coded(a, b)) - plain(a, b)) < 1e-9


def test_query_equals_brute_force(spark):
    docs, items = real("documents"), real("benchmark")
    own = [(i, words(t)) for i, t in zip(items.item_id, items.text)]
    expect = {}
    for d, text in zip(docs.doc_id, docs.text):
        t = words(text)
        for i, w in own:
            if set(w) & set(t) and (s := align(*coded(t, w)) / len(w)) >= 0.5:
                expect[d, i] = s
    got = {(r.doc_id, r.item_id): r.score for r in op8_benchmark_decontamination(spark, SF).collect()}
    assert got.keys() == expect.keys() and all(abs(got[k] - expect[k]) < 1e-9 for k in got)


def test_edited_copies_and_edges(spark):
    rng = random.Random(2)
    item = [f"w{k}" for k in range(40)]
    filler = lambda n: " ".join(f"f{rng.randint(0, 10**6)}" for _ in range(n))
    edited = [w if rng.random() > 0.15 else "changed" for w in item]
    texts = [None, "", filler(300), f"{filler(150)} {' '.join(item)} {filler(100)}", f"{filler(70)} {' '.join(edited)}", " ".join(item).upper(), " ".join(item[:12]) + " " + filler(50), f"{filler(61)} {' '.join(item)}", " ".join(item) * 3 + filler(20_000)]
    texts += [f"{' '.join(item)} {filler(5)}" for _ in range(50)]
    bench = spark.createDataFrame([(1, " ".join(item), 5), (1, " ".join(item), 5), (2, None, 5), (3, "", 5), (4, "two words", 5), (5, filler(300), 5)], "item_id long, text string, doc_id int")
    docs = documents(spark, texts).selectExpr("*", "1 as item_id", "2 as score")
    got = {r.doc_id: r.score for r in contaminated(docs, bench).collect()}
    assert set(got) == {3, 4, 5, 7, 8, *range(9, 59)}
    assert got[3] == got[5] == got[7] == 1 and 0.5 <= got[4] < 1
    assert contaminated(docs.limit(0), bench).count() == contaminated(docs, bench.limit(0)).count() == 0


def test_single_edited_copies_equal_brute_force(spark):
    rng = random.Random(5)
    filler = lambda n: [f"f{rng.randint(0, 10**6)}" for _ in range(n)]
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate([45] * 24 + [40] * 7 + [59, 12, 5, 4])]
    texts = []
    for k, item in enumerate(items):
        if k < 24:
            edited = [f"c{rng.random()}" if rng.random() < (0.1, 0.15, 0.2, 0.25)[k % 4] else w for w in item]
        elif k < 31:  # every 3rd to 8th word changed, every other word put in
            edited = [x for j, w in enumerate(item) for x in ([w, f"c{j}"] if k == 30 else [f"c{j}"] if j % (k - 21) == 1 else [w])]
        else:  # each third word left out, words put in
            edited = [x for j, w in enumerate(item) for x in ([] if j % 6 == 2 else [w, f"c{j}"] if j % 3 == 0 else [w])]
        texts.append(" ".join(filler(rng.randint(0, 90)) + edited + filler(rng.randint(0, 90))))
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    expect = {(k, k): s for k, item in enumerate(items) if (s := plain(words(texts[k]), item) / len(item)) >= 0.5}
    assert len(expect) > 28
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(documents(spark, texts), bench).collect()}
    assert got.keys() == expect.keys() and all(abs(got[k] - expect[k]) < 1e-9 for k in got)


def test_items_of_one_to_three_words_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "e", "zeta.", "eta"]
    texts = [None, "", " ".join(vocabulary)] + [rng.choice(["  ", ""]) + rng.choice([" ", "\t", "\n "]).join(rng.choices(vocabulary, k=rng.randint(1, 14))) for _ in range(60)]
    items = ["alpha", "BETA gamma", "délta  e zeta.", "eta eta eta", "nowhere", "alpha nowhere", "  ", "Alpha", "alpha beta gamma délta"]
    ids = list(range(len(texts)))
    rows = list(zip(ids, texts))
    docs = documents(spark, texts + texts[2:9] + ["alpha"], ids + ids[2:9] + [None]).repartition(3)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    expect = {}
    for d, text in rows:
        w = words(text)
        for k, t in enumerate(items):
            own = words(t)
            if 0 < len(own) < 4 and (n := sum(w[i : i + len(own)] == own for i in range(len(w)))):
                expect[d, k] = (1.0, n)
    got = {(r.doc_id, r.item_id): (r.score, r.n_passages) for r in contaminated(docs, bench).collect()}
    assert {k: v for k, v in got.items() if k[1] != 8} == expect and len(expect) > 40
    assert {d for d, k in got if k == 8} == {d for d, t in rows if words(t) and plain(words(t), words(items[8])) >= 2}


def rare(texts, item, threshold=0.5):
    """(at, k) of an item whose words differ, by counting its pairs in all texts."""
    seen = {}
    for t in map(words, texts):
        for pair in [*zip(t, t[1:]), *zip(t, t[2:])]:
            seen[pair] = seen.get(pair, 0) + 1
    count = [sum(seen.get((item[j], x), 0) for x in item[j + 1 : j + 3]) for j in range(len(item) - 1)]
    need = needed(len(item), threshold)
    k = max(need // 4, 1)
    return {(j, k) for j in sorted(range(len(count)), key=lambda j: (count[j], j))[: len(count) - need + k]}


def scraps(rng):
    """Items, and texts that hold parts of them, so often that the rarest places aren't the first."""
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate((9, 12, 20, 33))]
    return items, [None, "", *(" ".join(rng.choice(items)[rng.randint(0, 6) :][: rng.randint(2, 12)]) for _ in range(400))]


def test_rare_places_are_counted_in_all_documents(spark):
    items, texts = scraps(random.Random(11))
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item long, text string")
    seeds = bench.mapInArrow(_item_pairs(0.5), "item long, at long, gram long, n_words long, need long")
    got = rare_places(documents(spark, texts), seeds).collect()
    for k, item in enumerate(items):
        expect = rare(texts, item)
        assert {(r.at, r.k) for r in got if r.item == k} == expect
        assert {at for at, _ in expect} != set(range(len(expect)))  # the choice does depend on the counts
