"""Small tables and plain reference versions for the tests."""

import pandas as pd

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOC)


def real(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def morse(n=10):
    """Two words of 2**n letters whose polynomial hashes modulo 2**64 are equal, whatever the base and the values of the letters."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))
