import random
import re

import numpy as np

from groundplan.llm.common import ALNUM, hash_of
from groundplan.llm.license_scan import COVERED, LONG, MATCH, PHRASES, SKIP, Automaton, Scanner, op9_license_scan, scan_licenses
from groundplan.llm.license_texts import BSD_3, GPL_NOTICE, LGPL_NOTICE, MIT, TEMPLATES, UNLICENSE

from .helpers import SF, documents, real


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_columns_of_the_query(spark):
    docs = real("documents")
    got = op9_license_scan(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {d.doc_id: plain(d.text) for d in docs.itertuples()}
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_matches_are_the_longest():
    rng = random.Random(1)
    for _ in range(100):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        query = [rng.randrange(4) for _ in range(12)]
        automaton = Automaton(texts)
        inside = {tuple(t[i:j]): {(k, e) for k, u in enumerate(texts) for e in range(len(u) + 1) if u[max(0, e - j + i) : e] == t[i:j] and e >= j - i} for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = []
        for e in range(1, len(query) + 1):
            n = max((n for n in range(1, e + 1) if tuple(query[e - n : e]) in inside), default=0)
            if n and (e == len(query) or tuple(query[e - n : e + 1]) not in inside):
                want.append((e, n, inside[tuple(query[e - n : e])]))
        assert [(e, n, set(automaton.ends[s])) for e, n, s in automaton.matches(query)] == want


def test_edges(spark):
    mit, apache = TEMPLATES[0][1], TEMPLATES[2][1]
    texts = [None, "", "no licence here", f"x\n{mit}\ny", mit.replace("free of charge", "at no cost").upper(), apache + " " + mit, "MIT\x00license! mit_license", "é " * 100_000 + "the Apache-License", "mit license " * 5000]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, texts).selectExpr("*", "1 as labels", "2 as score")).collect()}
    assert [got[i].labels for i in range(9)] == ["", "", "", "mit", "mit", "apache,mit", "mit", "apache", "mit"]
    assert all(tuple(got[i])[1:6] == plain(t) for i, t in enumerate(texts))
    assert got[3].score == 1.0 and 0.8 < got[4].score < 1 and got[0].score == 0
    assert scan_licenses(documents(spark, []).limit(0)).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_chains(words, templates):
    """Longest matches by comparing all places, then the best chain over all pairs of matches."""
    texts = [words_of(t) for _, t in templates]
    places = []  # end in the file, length, template, end in the template, whether only one label holds it
    before = 0
    lengths = []
    for e in range(1, len(words) + 1):
        n = before + 1
        while n and not any(words[e - n : e] == t[i : i + n] for t in texts for i in range(len(t) - n + 1)):
            n -= 1
        lengths.append(n)
        before = n
    for e, n in enumerate(lengths, 1):
        if n >= MATCH and (e == len(words) or lengths[e] != n + 1):
            found = [(k, i + n) for k, t in enumerate(texts) for i in range(len(t) - n + 1) if t[i : i + n] == words[e - n : e]]
            own = len({templates[k][0] for k, _ in found}) == 1
            places += [(e, n, k, at, own) for k, at in found]
    values, best = [], {}
    for j, (e, n, k, at, own) in enumerate(places):
        value = (n, n * own)
        for i in range(j):
            e2, _, k2, at2, _ = places[i]
            if k2 == k and e2 < e and at2 < at and e - n - e2 <= SKIP:
                more = min(n, at - at2, e - e2)
                value = max(value, (values[i][0] + more, values[i][1] + more * own))
        values.append(value)
        most = best.get(k, (0, 0))
        best[k] = max(most[0], value[0]), max(most[1], value[1])
    return best


def plain_result(text):
    best = plain_chains(words_of(text), TEMPLATES)
    share = {k: min(n / len(words_of(TEMPLATES[k][1])), 1.0) for k, (n, _) in best.items()}
    labels = set(filter(None, plain(text)[4].split(","))) | {TEMPLATES[k][0] for k, (_, own) in best.items() if share[k] >= COVERED or own >= LONG}
    return ",".join(sorted(labels)), max(share.values(), default=0.0)


def test_chains_equal_a_plain_version():
    rng = random.Random(2)
    for _ in range(150):
        templates = [(rng.choice("pq"), " ".join(rng.choice("abc") for _ in range(rng.randrange(4, 25)))) for _ in range(3)]
        text = []
        for _ in range(4):
            t = templates[rng.randrange(3)][1].split()
            i = rng.randrange(len(t))
            text += t[i : i + rng.randrange(2, 14)] + ["z"] * rng.choice([0, 1, 5, 20])
        assert Scanner(templates).chains(np.array(hash_of(" ".join(text), ALNUM), np.uint64)) == plain_chains(text, templates)


def test_labels_and_score_equal_a_plain_version(spark):
    rng = random.Random(3)
    texts = [t for _, t in TEMPLATES]
    for _ in range(25):
        w = rng.choice(texts).split()
        i = rng.randrange(len(w))
        part = w[i : i + rng.randrange(5, 120)]
        texts.append(" ".join("edited" if rng.random() < 0.05 else x for x in part))
    texts += real("documents").text.iloc[:40].str.slice(0, 3000).tolist()
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(documents(spark, texts)).collect()}
    assert got == {i: plain_result(t) for i, t in enumerate(texts)}


def test_whole_texts_and_shared_disclaimers(spark):
    shared = MIT[MIT.index("THE SOFTWARE IS") : MIT.index(" OR COPYRIGHT HOLDERS BE")]  # stands in two licences
    texts = [MIT, BSD_3, LGPL_NOTICE, GPL_NOTICE, UNLICENSE, shared, MIT + UNLICENSE, MIT]
    out = scan_licenses(documents(spark, texts, [0, 1, 2, 3, 4, 5, 6, 0])).collect()
    assert len(out) == 8
    got = {r.doc_id: r for r in out}
    assert [got[i].labels for i in range(7)] == ["mit", "bsd", "gpl,lgpl", "gpl", "unlicense", "", "mit,unlicense"]  # the phrase of gpl stands in the text of lgpl
    assert len(words_of(shared)) > LONG and 0 < got[5].score < COVERED and all(got[i].score == 1 for i in (0, 1, 2, 3, 4, 6))
    no_id = scan_licenses(documents(spark, [MIT, None]).selectExpr("cast(null as long) as doc_id", "text")).collect()
    assert sorted(r.labels for r in no_id) == ["", "mit"]


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = [(1, "the MIT License, and"), (1, "the MIT License, and"), (2, None), (2, None), (None, "apache license"), (3, "x" * 200_000 + " general public license")]
    out = scan_licenses(documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.base_labels) for r in out), key=str)
    assert got == sorted([(1, 4, 1, 1, "mit")] * 2 + [(2, 0, 0, None, "")] * 2 + [(None, 2, 1, 0, "apache"), (3, 4, 1, 1, "gpl")], key=str)
