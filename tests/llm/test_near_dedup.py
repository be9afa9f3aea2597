import itertools
import re

from groundplan.llm.common import components
from groundplan.llm.near_dedup import near_duplicates, op4_minhash_near_dedup

from .helpers import SF, documents, morse, real, roots


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_query_equals_brute_force(spark):
    docs = real("documents")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op4_minhash_near_dedup(spark, SF).collect()}
    assert got == brute(list(zip(docs.doc_id, docs.text)), 2)


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "  \t ", "One", "one", "two words", "TWO words", base, base.replace("w7 ", "x "), base.replace("w50", "y"), "x" * 300_000, "\x00 a", "é É", "é É"]
    docs = documents(spark, texts).withColumnsRenamed({"lang": "rep"}).selectExpr("*", "1 as root", "2 as key")
    for k in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, k).collect()}
        assert got == brute(list(enumerate(texts)), k)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_chain_of_links_within_a_bucket(spark):
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 200]) for i in range(0, 120, 8)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)), 5)


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 64)] + [(100, i) for i in range(101, 140)] + [(139, 300), (7, 7)] + [(1000 - i * 37 % 101, 1000 - (i + 1) * 37 % 101) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {n for e in edges for n in e}
    assert got == roots(nodes, edges)


def test_no_pair_at_the_threshold_is_missed(spark):
    texts = []
    for k in range(8000):  # 8 words in common of 10
        both = " ".join(f"p{k}w{j}" for j in range(8))
        texts += [f"{both} p{k}a", f"{both} p{k}b"]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts), 1).collect()}
    assert [i for i in got if got[i] != i - i % 2] == []


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = morse()
    texts = [a, b, f"{a} {b} c", f"{b} {a} c", f"{a} {b} c"]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, texts), 2).collect()}
    assert got == brute(list(enumerate(texts)), 2)


def test_repeated_rows_and_rows_without_an_id(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (1, base), (2, base + " x"), (2, base + " x"), (3, "something else here"), (4, None), (4, None), (None, base), (None, None)]
    out = near_duplicates(documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3), 2).collect()
    want = brute([(i, t) for i, t in dict(rows).items() if i is not None], 2)
    assert sorted(r.doc_id for r in out) == [1, 1, 2, 2, 3, 4, 4]
    assert all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in out)
