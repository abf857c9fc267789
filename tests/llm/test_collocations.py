"""Operator 11 against counts over lists, and its tiles against sorted pairs."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tendermatch.llm import collocations as M
from tests.llm.conftest import rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, max_words=3, min_count=10, share=50, top=2000):
    count, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    count[lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, f in count.items():
        cand = {p for p, a in f.items() if len(p) > 1 and a >= min_count}
        gone = set()
        for longer in cand:
            for m in range(2, len(longer)):
                for i in range(len(longer) - m + 1):
                    if 100 * f[longer] >= share * f[longer[i:i + m]]:
                        gone.add(longer[i:i + m])
        scored = []
        for p in cand - gone:
            a = f[p]
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out, key=repr)


def made_docs(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "a", "é", "中文", "x y", "q'", "\x00", "ᾳ"]
    docs = []
    for k in range(n):
        text = "".join(rng.choice(words[:2 + k % 11]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "?!", "\r\n", "-"])
                       for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return docs + [("en", None), (None, ""), ("fr", " .. \n"), ("en", "new york " * 30), ("en", "new york " * 30)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "lang string, text string").repartition(3)


@pytest.mark.parametrize("kw", [{}, {"min_count": 2, "tile": 4, "dense": 4}, {"min_count": 3, "share": 90, "top": 7}, {"max_words": 2}])
def test_equals_brute_force(spark, kw):
    docs = made_docs()
    own = M.collocations(frame(spark, docs), **kw)
    kw = {k: v for k, v in kw.items() if k not in ("tile", "dense")}
    assert rows(own) == brute(docs, **kw)


def test_longer_phrases(spark):
    docs = made_docs(5, 30) + [("en", "one two three four five " * 4), ("en", "x one two three four y")]
    assert rows(M.collocations(frame(spark, docs), max_words=5, min_count=3)) == brute(docs, 5, 3)


def test_chunks_and_slices_cut_anywhere(spark, monkeypatch):
    docs = made_docs(2) + [("en", "long piece without an end of its own " * 80)]
    for tokens, size in ((7, 30), (2, 11), (1, 5)):
        monkeypatch.setattr(M, "TOKENS", tokens)
        monkeypatch.setattr(M, "SLICE", size)
        assert rows(M.collocations(frame(spark, docs), min_count=4)) == brute(docs, 3, 4)
    monkeypatch.setattr(M, "WORD_BYTES", 100)
    assert rows(M.collocations(frame(spark, docs), min_count=4)) == brute(docs, 3, 4)


def test_tiles_count_like_sorting():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(0, 400))
        x, y = (np.minimum(rng.geometric(0.05, n), 200) * int(rng.integers(1, 50)) for _ in range(2))
        counted = rng.random(n) < 0.8
        xs, ys, counts, code = M.tile_counts(x, y, counted, tile=8, dense=int(rng.integers(1, 40)))
        assert list(zip(xs[code], ys[code])) == list(zip(x, y))
        assert len(set(zip(xs, ys))) == len(xs)
        assert {(a, b): c for a, b, c in zip(xs, ys, counts) if c} == Counter((a, b) for a, b, c in zip(x, y, counted) if c)


def test_tiles_take_little_memory():
    rng = np.random.default_rng(0)
    n = 1 << 20
    x, y = (np.minimum(rng.zipf(1.25, n) - 1, 60_000) for _ in range(2))
    tracemalloc.start()
    try:
        M.tile_counts(x, y, np.ones(n, dtype=bool))
        assert tracemalloc.get_traced_memory()[1] < 56 * n
    finally:
        tracemalloc.stop()


def test_last_round_needs_no_second_worker():
    """A chunk's phrases come as rows from the task that counts them, the same as those listed from a pinned chunk."""
    codes = np.array([0, 1, 0, 1, M.BREAK, 2, 0, 1, 5], dtype="<i4")
    chunks = pa.table({"chunk": pa.array([7]), "lead": pa.array([1], pa.int32()), "codes": pa.array([M.squeeze(codes)], pa.binary())})
    known = pa.table({"code": pa.array([0, 1, 2], pa.int32()), "f": pa.array([0, 0, 0]), "k0": pa.array([10, 11, 12])})
    last, earlier = (M._count_pairs(2, last, M.TILE, M.DENSE)(chunks, known) for last in (True, False))
    listed = pa.Table.from_batches(M._listed_phrases(2)(iter(earlier.select(["chunk", "words", "counts"]).to_batches())))
    assert last.to_pylist() == listed.to_pylist()
    assert {r["k0"]: r["place"] & 0xFFFFFFFF for r in last.to_pylist()} == {10 << 32 | 11: 3, 11 << 32 | 10: 1, 12 << 32 | 10: 1}
    nothing = M._count_pairs(2, True, M.TILE, M.DENSE)(chunks, known.slice(0, 0))
    assert nothing.num_rows == 0 and nothing.schema.names == ["owner", "place", "k0"]


def test_products_beyond_64_bits(spark):
    """The score expression on counts whose products pass 64 bits."""
    big = 987_654_321_987
    items = spark.createDataFrame([(1, "en", "a b", "b", big, 10**13, [3 * big], [big + 7])],
                                  "id long, lang string, phrase string, last string, f long, n long, pre array<long>, suf array<long>")
    own = M.best_cut(items).select("cut.score", "cut.l", "cut.r").first()
    assert tuple(own) == (10**6 * big * big // (3 * big * (big + 7)), 3 * big, big + 7)


def test_documents_with_awkward_rows(spark, docs, empty_docs):
    plain = [(r.lang, r.text) for r in docs.collect()]
    clash = docs.withColumn("chunk", F.lit(1)).withColumn("phrase", F.lit("x")).withColumn("score", F.lit(0)).withColumn("words", F.lit("w"))
    assert rows(M.collocations(clash, min_count=2)) == brute(plain, 3, 2)
    assert M.collocations(empty_docs).collect() == []
    with pytest.raises(ValueError):
        M.collocations(docs, max_words=1)
