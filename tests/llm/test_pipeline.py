import random

import sentencepiece

import corpus_pipeline
from groundplan.llm import decontaminate
from groundplan.llm.common import saved
from groundplan.llm.quality import classify

from . import test_decontaminate, test_near_dedup
from .helpers import SF, documents, real
from .test_piece_codec import PATH


def expected(spark, rows, items, good):
    """The stages one by one, by brute force; good: what the classifier keeps, which has a test of its own."""
    rows = [r for r in rows if r[0] in good]
    rows = [r for r, (_, _, kept) in zip(rows, test_near_dedup.brute(rows, 5).values(), strict=True) if kept]
    seen, cut = set(), []
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        cut.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    own = [test_decontaminate.words(t) for t in items]
    leaks = {i for i, t in cut for w in own if set(w) & set(x := test_decontaminate.words(t)) and test_decontaminate.align(*test_decontaminate.coded(x, w)) / len(w) >= 0.5}
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {i: model.encode(t) for i, t in cut if i not in leaks}


def test_run_equals_brute_force(spark):
    docs = real("documents")
    good = {r.doc_id for r in classify(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    want = expected(spark, list(zip(docs.doc_id, docs.text)), real("benchmark").text, good)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(docs)


def test_stages_on_odd_rows(spark):
    texts = [None, "", "A normal text of the kind that is kept by the first stage. It has a few words in it."]
    docs = documents(spark, texts * 3, [0, 1, 2, 0, 1, 2, None, None, None]).selectExpr("*", "1 as kept", "2 as component_id", "3 as score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert 2 in {r.doc_id for r in out.collect()}, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = saved(out, name)
    assert [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()] == [2]


def test_decontamination_counts_in_all_documents(spark, tmp_path, monkeypatch):
    items, texts = test_decontaminate.scraps(random.Random(12))
    spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    taken, own = [], decontaminate.rare_places
    monkeypatch.setattr(decontaminate, "rare_places", lambda docs, seeds: taken.append(own(docs, seeds)) or taken[-1])
    corpus_pipeline.benchmark_decontamination(spark, documents(spark, texts), str(tmp_path)).collect()
    got = {}
    for r in taken[0].collect():
        got.setdefault(r.item, set()).add((r.at, r.k))
    expect = [test_decontaminate.rare(texts, item) for item in items]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect))
