"""Operator 12 against the tokenizers library and against merges done one by one."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tendermatch.llm import word_bpe as M
from tendermatch.llm.queries import QUERIES, WORD_VOCABULARY, rank_file
from tests.conftest import SMALL
from tests.llm.conftest import rows

LIBRARY = Tokenizer.from_file(public_tokenizers.path(WORD_VOCABULARY))
CODEC = M.WordCodec(rank_file(WORD_VOCABULARY))


def ids_of(text):
    return np.frombuffer(CODEC.encode(text), dtype="<u4").tolist()


def check(text):
    own, lib = ids_of(text), LIBRARY.encode(text, add_special_tokens=False).ids
    assert own == lib, text[:200]
    assert "".join(CODEC.decode(np.array(own, dtype=np.uint32))) == LIBRARY.decode(lib, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " \t\n ", "a", "Hello world's  TEST 123 éÉ 中文", "a<|endoftext|>b <|ENDOFTEXT|><|startoftext|>'S", "Σας ΟΔΟΣ İ", "'s't're'lle''ll",
    "a\x1cb\x1d\x1e\x1fc\x85d​e\xa0f\x00g　h﻿", "é ́ ạ̈", "🙂👩‍👩‍👧 ½²Ⅷ", "한글 각 각", "ᲉꟋꟜ\U00010d50x",
    "don't I'D we'Ve", "#$%^&*()!?..", "퟿\U0010ffff"])
def test_known_texts(text):
    check(text)


def test_every_character():
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 61 == 0)]
    texts = [f"a{chr(c)}b {chr(c) * 2}" for c in codes]
    lib = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    own = [np.frombuffer(x, dtype="<u4").tolist() for x in CODEC.encode_texts(texts)]
    assert [hex(c) for c, a, b in zip(codes, own, lib) if a != b] == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst hlTHE'  \n.<|>é"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])),
               max_size=60))
def test_random_texts(text):
    check(text)


def one_by_one(symbols, pairs):
    rank = {(a, b): (k, m) for k, (a, b, m) in reversed(list(enumerate(pairs)))}
    symbols = list(symbols)
    while True:
        best = min(((rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if best is None:
            return symbols
        symbols[best[1]:best[1] + 2] = [rank[tuple(symbols[best[1]:best[1] + 2])][1]]


def test_trees_do_the_leftmost_lowest_merge():
    """Random merges, some of which make pairs of a lower rank than their own."""
    rng = random.Random(7)
    for _ in range(60):
        known, pairs = [0, 1, 2], []
        for new in range(3, 3 + rng.randint(0, 12)):
            pairs.append((rng.choice(known), rng.choice(known), new))
            known.append(new)
        pairs = list({(a, b): (a, b, m) for a, b, m in pairs}.values())
        rng.shuffle(pairs)
        merges = M.Merges(pairs)
        words = [[rng.choice(known[:3]) for _ in range(rng.randint(1, 33))] for _ in range(20)]
        width = max(map(len, words))
        table = np.array([w + [-1] * (width - len(w)) for w in words])
        M.merge_rows(table, np.array(list(map(len, words))), merges)
        assert [[s for s in row if s >= 0] for row in table.tolist()] == [one_by_one(w, pairs) for w in words]


def test_long_words_and_small_tables():
    rng = random.Random(3)
    long = "".join(rng.choice("thea") for _ in range(5_000))
    texts = [long, "中" * 3_000, "a" * 2_001, "é" * 700 + "!" * 1500, " ".join(long[k:k + 7] for k in range(0, 5_000, 7)) * 3]
    for text in texts:
        check(text)
    small = M.WordCodec(rank_file(WORD_VOCABULARY), max_stretches=20)
    assert list(small.encode_texts(texts * 2)) == [CODEC.encode(t) for t in texts * 2]
    assert len(small.known) < 1000


def test_texts_longer_than_a_slice(monkeypatch):
    monkeypatch.setattr(M, "SLICE", 50)
    text = "words and <|endoftext|> more, with spaces " * 40 + "x" * 300 + " end\x1c "
    lib = LIBRARY.encode_batch([text, "", "b " * 70, text], add_special_tokens=False)
    own = list(CODEC.encode_texts([text, "", "b " * 70, text]))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in own] == [e.ids for e in lib]


def expected(doc_id, text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return (doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_documents(spark, docs, empty_docs):
    own = M.encode_documents(docs, rank_file(WORD_VOCABULARY), keep_ids=False)
    assert rows(own) == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert M.encode_documents(empty_docs, rank_file(WORD_VOCABULARY)).collect() == []


def test_clashing_columns_and_decoding(spark):
    docs = spark.createDataFrame([(1, "Some text <|endoftext|>", 7, "x"), (None, None, 8, "y")], "doc_id int, text string, n_tokens int, ids string")
    coded = M.encode_documents(docs, rank_file(WORD_VOCABULARY))
    back = {r.doc_id: r.text for r in M.decode_ids(coded, rank_file(WORD_VOCABULARY)).collect()}
    assert back == {1: "some</w> text</w> <|endoftext|>", None: ""}


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = rows(QUERIES["op12_word_bpe"](spark, SMALL))
    assert own == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
