import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from groundplan.llm import piece_codec
from groundplan.llm.common import packed

from .helpers import SF, documents, morse, real

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_query_equals_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = real("documents")
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in piece_codec.op7_sentencepiece_codec(spark, SF).collect()}
    want = {i: (len(x), x, hashlib.sha256(t.encode()).hexdigest()) for i, t, x in zip(docs.doc_id, docs.text, model.encode(docs.text.tolist()))}
    assert got == want


def test_edges(spark):
    texts = [None, "", " ", "   ", " a", "a ", "a  b", "\x00", "▁", "▁▁ x▁y", "<s></s><0x41><unk>", "é😀ｚ x", "\n\t\r", "A" * 50_000, " " * 5000, "word " * 20_000, " x", "é"]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = documents(spark, texts).selectExpr("*", "1 as ids", "2 as decoded")
    for r in piece_codec.encode_pieces(docs).collect():
        t = texts[r.doc_id] or ""
        assert r.ids == model.encode(t) and r.decoded == t.replace("▁", " ")
    assert piece_codec.encode_pieces(docs.limit(0)).count() == 0


def test_words_that_polynomial_hashes_confuse_and_equal_hashes(spark, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*morse(), "x " + morse()[1], "one two", None]
    for r in piece_codec.encode_pieces(documents(spark, texts, [0, 1, None, 3, 3])).collect():
        assert r.ids in [model.encode(t or "") for t in texts] and model.decode(r.ids) == r.decoded
        if r.doc_id in (0, 1):
            assert r.decoded == texts[r.doc_id] and r.ids == model.encode(texts[r.doc_id])
    # the table's key may collide: the other hash tells, and the parts are encoded one by one
    true = piece_codec.span_hashes
    monkeypatch.setattr(piece_codec, "span_hashes", lambda b, s, e, seed=0: true(b, s, e, seed) & np.uint64(7 if seed == 0 else (1 << 64) - 1))
    codec = piece_codec.Transducer(*piece_codec.model_pieces(PATH))
    words = [" ".join(f"w{(i * 7 + k) % 31}é" for k in range(20)) for i in range(30)]
    for _ in range(2):
        ids, at = codec.encode(*packed(pa.array(words)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == model.encode(words)


def test_random_texts_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 50)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    codec = piece_codec.Transducer(*piece_codec.model_pieces(PATH))
    rng = np.random.default_rng(0)
    letters = [*"abteh  .,\n\téÅ😀\x00ｚn1<>", "   ", "the", "tion"]
    for _ in range(40):
        texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(20)]
        ids, at = codec.encode(*packed(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == model.encode(texts)
        assert len(codec.known) <= 50 + 20 * 40
