import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from groundplan.llm import token_files
from groundplan.llm.token_files import BASE, FREQUENT, Words, compressed, decode, frequent_pairs, lengths, op6_token_files, read_documents, write_shards

from .helpers import SF, documents, real

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300), st.integers(0, 320), st.integers(0, 320))
def test_any_range_is_decoded(ids, a, b):
    rules, symbols = compressed(np.array(ids, np.uint32), 2)
    assert (rules < BASE + np.arange(len(rules))[:, None]).all()
    assert decode(rules, lengths(rules), symbols).tolist() == ids
    assert decode(rules, lengths(rules), symbols, a, b).tolist() == ids[a:b]


def test_repeats_shrink():
    ids = np.tile(np.arange(50), 400)
    rules, symbols = compressed(ids)
    assert len(symbols) + 2 * len(rules) < len(ids) / 5 and (decode(rules, lengths(rules), symbols) == ids).all()


def test_query_equals_the_library(spark):
    docs = real("documents")
    assert [tuple(r) for r in op6_token_files(spark, SF).orderBy("doc_id").collect()] == plain(list(zip(docs.doc_id, docs.text)))


@pytest.mark.parametrize("shard", [1, 40, 1 << 17])
def test_edges(spark, tmp_path, shard):
    texts = [None, "", " \n ", "One two", "<|endoftext|> x", "na " * 90_000, "é\x00ß", "y" * 3000, "One two"]
    rows = list(zip([5, 3, 9, -4, 6, 8, 1, 7, 20], texts))
    rows += [(2, "na twice"), (2, "na twice")]
    docs = documents(spark, [t for _, t in rows] + ["no id"], [i for i, _ in rows] + [None]).selectExpr("*", "1 as part", "2 as seq")
    write_shards(docs, PATH, f"file://{tmp_path}/a", shard)
    assert [tuple(r) for r in read_documents(spark, f"file://{tmp_path}/a").orderBy("doc_id").collect()] == plain(rows)
    write_shards(docs.limit(0), PATH, f"file://{tmp_path}/b")
    assert read_documents(spark, f"file://{tmp_path}/b").count() == 0


def test_words_one_by_one_give_the_ids_of_the_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, whole, rng = Words(path), Tokenizer.from_file(path), random.Random(5)
    parts = [" ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", " ", "　", "e", "́", "̧", "É", "İ", "Σ", "ΑΣ", "ß", "ﬁ", "I'LL", "'s", "12", "!?", "<|endoftext|>", "<|start", "oftext|>", "日本", "한", "하", "🙂", "‍", "The", "cat", "\0"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert np.frombuffer(words.ids([text])[0], np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_plain_words_are_split_as_the_tokenizer_does_it():
    words, whole, rng = Words(PATH), Tokenizer.from_file(PATH), random.Random(6)
    assert words.splits
    parts = [*map(chr, range(0x100)), *"  \n''ssT", "'ll", "'RE", "'ve", "'D", "!'", "é", "\u0301", "ſ", "K", "Abc", "the"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(20)))
        assert np.frombuffer(words.ids([text])[0], np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    words.splits = False  # as for a tokenizer that splits otherwise
    text = "It's a 12-word text, isn't it? é\n" * 3
    assert np.frombuffer(words.ids([text])[0], np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_the_model_is_given_each_part_once():
    words, given = Words(PATH), []
    tokenize = words.parts.tokenize
    words.parts.tokenize = lambda part: given.append(part) or tokenize(part)
    words.encode = None  # plain words don't go through the whole tokenizer
    words.ids(["Zyxomat zyxomat, (zyxomat) ZYXOMAT! Çqzyxé\nzyxomat."] * 3)
    assert given.count("zyxomat") == 1 and len(given) == len(set(given))


@pytest.mark.parametrize("kinds", [5, 300, 60_000])
def test_frequent_pairs_equal_sorting(kinds):
    pair = np.random.default_rng(kinds).zipf(1.3, 150_000) % kinds << 32 | 7
    pairs, count, at, which = frequent_pairs(pair, FREQUENT)
    expect = {p: n for p, n in zip(*np.unique(pair, return_counts=True)) if n >= FREQUENT}
    assert {p: n for p, n in zip(pairs, count) if n >= FREQUENT} == expect and (np.diff(pairs) > 0).all()
    assert (pairs[which] == pair[at]).all() and np.isin(pair, list(expect)).sum() == np.isin(pair[at], list(expect)).sum()


def test_each_distinct_word_is_split_once():
    words, whole, given = Words(PATH), Tokenizer.from_file(PATH), []
    own = words.by_parts
    words.by_parts = lambda text: given.append(text) or own(text)
    texts = ["(Qua), it's (Qua),  é́ x\n", "", "日本 (Qua), 日本", " ", "\n(Qua),"] * 4
    got = words.ids(texts)
    assert [list(np.frombuffer(x, np.uint32)) for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(given) == len(set(given)) and "(Qua)," in given


def test_pairs_are_looked_up_when_they_are_new(monkeypatch):
    seen, ids = [], np.random.default_rng(3).zipf(1.3, 60_000) % 5000
    monkeypatch.setattr(token_files, "frequent_pairs", lambda pair, least: seen.append(len(pair)) or frequent_pairs(pair, least))
    rules, symbols = compressed(ids)
    assert (decode(rules, lengths(rules), symbols) == ids).all() and len(symbols) < 0.9 * len(ids)
    assert sum(seen) < 3 * len(ids)  # all places once, then those beside new symbols


@pytest.mark.parametrize("times", [1, 3, 2000])
def test_rules_of_any_length_are_expanded(times):
    rules = np.array([[1, 2], *([BASE + k, k] for k in range(400))], np.int64)
    size, symbols = lengths(rules), np.array([7, BASE + 400, BASE, 8, BASE + 3, 9] * times)
    expect = [7, 1, 2, *range(400), 1, 2, 8, 1, 2, 0, 1, 2, 9] * times
    assert decode(rules, size, symbols).tolist() == expect and decode(rules, size, symbols, 2, len(expect) - 2).tolist() == expect[2:-2]


def test_rules_are_expanded_once(monkeypatch):
    asked, own = [], token_files.expanded
    monkeypatch.setattr(token_files, "expanded", lambda rules, size, symbols: asked.append(len(symbols)) or own(rules, size, symbols))
    ids = np.tile(np.arange(50), 400)
    rules, symbols = compressed(ids)
    assert (decode(rules, lengths(rules), np.tile(symbols, 20)) == np.tile(ids, 20)).all() and asked == [20 * len(symbols), len(rules)]


def test_parts_stay_from_task_to_task(monkeypatch):
    assert token_files.words_of(PATH) is token_files.words_of(PATH)
    monkeypatch.setattr(token_files, "KEPT_PARTS", 12)
    words, whole, given = Words(PATH), Tokenizer.from_file(PATH), []
    tokenize = words.parts.tokenize
    words.parts.tokenize = lambda part: given.append(part) or tokenize(part)
    for k in range(20):
        text = f"often again new{'abcdefghijklmnopqrst'[k]} " + "once" * (k + 1)
        assert np.frombuffer(words.ids([text])[0], np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(words.parts) + len(words.parts.old) <= 12
    assert given.count("often") == given.count("again") == 1
