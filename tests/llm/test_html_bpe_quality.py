"""HTML extraction, byte-level BPE and the quality classifier."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tendermatch.llm import bpe, html_extract, quality_mil
from tendermatch.llm.queries import op2_quality_mil, rank_file

from .conftest import rows

PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<!-- <p>not this</p> --><div class="ad">Buy this now, it is very good.</div><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &lt;one&gt; &eacute;</h1><p><b>First  line
of text.<br><p>Short.<p title="a>b">With <a href="x">a link</a>&nbsp;inside &amp;amp; more 3 < 4.</p><ul><li>one</li><li>two</li></ul>
<form><label>Name</label><input value="x"><button>Send</button></form><section id="comments"><article><p>A reader says something.</p></article></section>
<p>Last words.</p><footer>Filed under x</footer></article><aside><p>Read this too, it is long enough to look like an article block.</p></aside>
<footer>&copy; 2020</footer></body></html>"""
TEXT = "Title <one> é\nFirst line of text.\nShort.\nWith a link inside &amp; more 3 < 4.\none\ntwo\nLast words."


def test_main_text():
    tree = html_extract.train()
    assert html_extract.main_text(PAGE, tree) == TEXT
    assert html_extract.main_text(PAGE.replace("</body></html>", ""), tree) == TEXT
    for odd in (None, "", "<", "<a", "<!--", "</", "<script>", "&amp", "<p", "<div><p>", "\x00", "<<<>>>", "</p></p>"):
        assert html_extract.main_text(odd, tree) == ""


def test_page_without_containers():
    words = " ".join(["word"] * 40)
    page = f"<body><a href=1>Home</a> <a href=2>News</a><h2>Event</h2><div>{words}</div><div>short</div><div>{words}</div><div><a href=3>Next</a></div>"
    assert html_extract.main_text(page, html_extract.train()) == f"Event\n{words}\nshort\n{words}"


def test_tree_learns_its_table():
    tree = html_extract.train()
    from itertools import product
    for line in html_extract.LABELLED.strip().splitlines():
        for row in product(*(x.split("/") for x in line.split())):
            assert html_extract.is_article(tree, tuple(map(float, row[:-1]))) == (row[-1] == "1")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"<>/ab!-\"'= &;\n", "<p>", "</p>", "<div>", "<a href=x>", "<article>", "<script>"]), max_size=40).map("".join))
def test_any_markup_is_read(text):
    html_extract.main_text(text, html_extract.train())


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "<article>" + "a " * 100_000, "x")],
                                  "page_id long, url string, html string, text string")
    assert rows(html_extract.extract(pages)) == sorted(
        [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (2, None, "", 0), (None, "v", ("a " * 100_000).strip(), 199_999)], key=repr)
    assert rows(html_extract.extract(pages.limit(0))) == []


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file().splitlines())}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(rank_file(), public_tokenizers.PATTERN)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<u4").tolist()


def test_transducer_is_the_merges(codec, reference):
    rng = random.Random(3)
    alphabets = ["abcdeinrst", "aé üñ'tsll 1\n", [chr(c) for c in (*range(1, 0x180), *range(0x400, 0x450), *range(0x4E00, 0x4E20), 0x1F600, 0x2028, 0xA0)]]
    for _ in range(3000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60)))
        assert ids(codec, text) == reference.encode_ordinary(text)
        assert "".join(codec.decode(ids(codec, text))) == text


def test_small_tables_change_nothing(reference):
    small = bpe.codec(rank_file(), public_tokenizers.PATTERN, 3, 5)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("theandingion er", k=80))
        assert ids(small, text) == reference.encode_ordinary(text)


def test_long_pieces_and_texts(codec, reference, monkeypatch):
    rng = random.Random(5)
    piece = "".join(rng.choices("abcdefgh", k=20_000))
    assert ids(codec, piece) == reference.encode_ordinary(piece)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "CHUNK", 5)
    text = " ".join("".join(rng.choices("abcdé中🙂", k=rng.randint(1, 9))) for _ in range(500))
    assert ids(codec, text) == reference.encode_ordinary(text)
    assert "".join(codec.decode(ids(codec, text))) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=40))
def test_utf8_machine_is_a_decoder(data, cuts):
    machine, at, out = bpe.Utf8Machine(), 0, ""
    for cut in cuts:
        out += machine.feed(data[at:at + cut])
        at += cut
    out += machine.feed(data[at:]) + machine.end()
    assert out == data.decode("utf-8", "replace")


def test_bpe_rows(docs, empty_docs, reference, monkeypatch):
    monkeypatch.setattr(bpe, "OUT_IDS", 50)
    out = bpe.encode_documents(docs.withColumn("ids", F.lit("clash")), rank_file(), public_tokenizers.PATTERN)
    truth = []
    for r in docs.collect():
        own = reference.encode_ordinary(r.text or "")
        truth.append((r.doc_id, len(own), hashlib.sha256(np.array(own, dtype="<u4").tobytes()).hexdigest(),
                      hashlib.sha256((r.text or "").encode()).hexdigest(), own))
    assert rows(out) == sorted(truth, key=repr)
    back = bpe.decode_ids(out, rank_file(), public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.text) for r in back.where("doc_id is not null").collect()) == sorted(
        (r.doc_id, r.text or "") for r in docs.where("doc_id is not null").collect())
    assert rows(bpe.encode_documents(empty_docs, rank_file(), public_tokenizers.PATTERN)) == []


def test_passages_do_not_depend_on_neighbours():
    texts = ["a b " * 400, "", None, "É!! " * 300, "x" * 256, "| t | " * 100, "y" * 257]
    whole, counts = quality_mil.passages(pa.array(texts))
    assert counts.tolist() == [7, 1, 1, 6, 1, 3, 2]
    at = 0
    for text, n in zip(texts, counts):
        alone, _ = quality_mil.passages(pa.array([text], pa.string()))
        assert np.array_equal(alone, whole[at:at + n])
        at += n
    assert quality_mil.passages(pa.array([], pa.string()))[0].shape == (0, quality_mil.WIDTH)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x, counts, y = rng.normal(size=(9, 5)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    model = quality_mil.fit(x, counts, y, epochs=1)
    loss = lambda: -np.mean(np.log(np.where(y > 0, model.score(x, counts), 1 - model.score(x, counts))))
    grads = model.gradients(x, counts, y)
    for name, weight in model.weights.items():
        at = tuple(rng.integers(0, s) for s in weight.shape)
        kept, step = weight[at], 1e-5
        weight[at] = kept + step
        up = loss()
        weight[at] = kept - step
        assert abs((up - loss()) / (2 * step) - grads[name][at]) < 1e-6
        weight[at] = kept


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_quality_mil(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)


def test_quality_rows(docs, empty_docs):
    model = quality_mil.train(docs.withColumn("quality", (F.col("doc_id") % 2).cast("int")))
    out = quality_mil.score(docs.withColumn("score", F.lit("clash")), model)
    assert out.count() == docs.count() and out.where("score is null or predicted is null").count() == 0
    assert quality_mil.train(empty_docs.withColumn("quality", F.lit(1))) is None
    assert {r.score for r in quality_mil.score(docs, None).collect()} == {0.5}
    assert quality_mil.score(empty_docs, model).count() == 0


def test_quality_trains_on_all_passages(spark, monkeypatch):
    seen = {}
    fit = quality_mil.fit

    def spy(x, counts, y, **kw):
        seen["x"], seen["counts"], seen["y"] = np.array(x, dtype=np.float32), counts, y
        return fit(x, counts, y, epochs=1)

    monkeypatch.setattr(quality_mil, "fit", spy)
    long = "plain words. " * 8000 + "|*#" * 100 + "plain words. " * 100_000
    data = [(1, long, 0), (2, "short", 1), (3, None, 1)]
    quality_mil.train(spark.createDataFrame(data, "doc_id long, text string, quality int"))
    x, counts = quality_mil.passages(pa.array([long]))
    assert sorted(seen["counts"]) == [1, 1, counts[0]]
    begin = int(seen["counts"][:list(seen["counts"]).index(counts[0])].sum())
    assert seen["y"][list(seen["counts"]).index(counts[0])] == 0
    assert np.allclose(seen["x"][begin:begin + counts[0]], x, atol=1e-2)
