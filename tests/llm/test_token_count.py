import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyrun.llm import token_count, vocab

from .helpers import babble, docs

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ODD = [
    "", "  a", "a  b", "a \n b ", " ", "a <|endoftext|> b", "a<|endoftext|>b  <|startoftext|>", "<|endoftext|>́x", "ΑΣ ΑΣ. Σ", "é ́x", "a\x1cb \x1fc",
    "a b　 c", "It's WE'LL 123 4५ ½ İI ẞ", "한국어 日本 ✂️👍🏽", "a\x85b", "x\ty \t z", "﻿a ​b", "'S 's't", "ΐ̈ ǆ Ǆ", "a" * 50000, " " * 50000, "\n ab!" * 20000,
]


def library(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


def test_odd_texts():
    count, encode = token_count.Counter(WORD).count, vocab.Encoder(BYTE).encode
    for text in ODD:
        assert count(text) == len(library(WORD, text)), text[:30]
        assert encode(text).tolist() == library(BYTE, text), text[:30]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=["Cs"]), st.sampled_from(" \n's.éA<|>")), max_size=60))
def test_any_text(text):
    assert vocab.encoder(BYTE).encode(text).tolist() == library(BYTE, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" abcdeéßÉ'stlv.!?\n\t0123ñç<|>…", max_size=60))
def test_counts_of_any_text(text):
    assert token_count.counter(WORD).count(text) == len(library(WORD, text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=["Cs"]), st.sampled_from(" \ua7cb\ua7dc\U00032808\U0003285c\U00032988'sa")), max_size=40))
def test_counts_of_unassigned_characters(text):
    assert token_count.counter(WORD).count(text) == len(library(WORD, text))


def test_long_pieces_are_not_remembered():
    c = token_count.Counter(WORD)
    for k in range(50):
        c.count("字" * (1000 + k) + " " + "a" * (1000 + k))
    assert not c.pieces and sum(map(len, c.words)) < 100


def test_merging_with_a_heap():
    ranks = {("a", "b"): (0, "ab"), ("b", "c"): (1, "bc"), ("ab", "c"): (2, "abc"), ("a", "a"): (3, "aa")}
    assert token_count.merged(list("abc"), ranks) == 1
    assert token_count.merged(list("bcab"), ranks) == 2
    assert token_count.merged(list("aaaa"), ranks) == 2
    assert token_count.merged(["x"], ranks) == 1 and token_count.merged([], ranks) == 0


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, babble(1, 3000)), (3, babble(1, 3000)), (None, "é è"), (4, "x " * 20000)]
    table = docs(spark, rows).withColumnRenamed("lang", "n_tokens").withColumnRenamed("n_chars", "n_bytes")
    got = sorted(map(tuple, token_count.token_counts(table, WORD).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library(WORD, t or "")), n > 2048) for i, t in rows]
    assert got == sorted(want, key=str)
    assert token_count.token_counts(docs(spark, []), WORD).collect() == []


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len(e.ids) for r, e in zip(rows, LIBRARY[WORD].encode_batch([r.text for r in rows], add_special_tokens=False))}
    assert {r.doc_id: r.n_tokens for r in token_count.op1_token_counts(spark, folder).collect()} == want
    ids = LIBRARY[BYTE].encode_batch([r.text for r in rows], add_special_tokens=False)
    assert all(vocab.encoder(BYTE).encode(r.text).tolist() == e.ids for r, e in zip(rows, ids))
