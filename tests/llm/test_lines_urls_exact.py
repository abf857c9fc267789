"""Line dedup, URL rules and exact dedup against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tendermatch.llm import exact_dedup, line_dedup, url_filter
from tendermatch.llm.common import SPACES

from .conftest import rows

LAST = 1 << 62


def _key(line):
    return line.strip(SPACES).encode().lower().decode()


def _line_truth(data):
    holders = defaultdict(set)
    for ident, text in data:
        for line in (text or "").split("\n"):
            holders[_key(line)].add(LAST if ident is None else ident)
    out = []
    for ident, text in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(_key(x)) < 10 or min(holders[_key(x)]) == (LAST if ident is None else ident)]
        out.append((ident, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_report(docs, empty_docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(line_dedup.line_report(docs)) == _line_truth(data)
    assert rows(line_dedup.line_report(empty_docs)) == []


def test_one_line_in_every_document_spans_partitions(spark):
    data = [(k, f"the very same line in all\nown line number {k}\nthe very same line in all") for k in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    assert rows(line_dedup.line_report(docs)) == _line_truth(data)


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_stream_does_not_depend_on_batches(size):
    import numpy as np
    import pyarrow as pa

    keys = sorted((h, d, p) for h in range(40) for d in range(h % 5 + 1) for p in range(2))
    names = ["h1", "h2", "did", "tid", "pos"]
    cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array(np.zeros(len(keys), np.int64)), pa.array([k[1] for k in keys], pa.int64()),
            pa.array(np.zeros(len(keys), np.int64)), pa.array([k[2] for k in keys], pa.int32())]
    table = pa.RecordBatch.from_arrays(cols, names=names)
    out = [tuple(r.values()) for b in line_dedup._stream(iter([table.slice(k, size) for k in range(0, len(keys), size)])) for r in b.to_pylist()]
    assert {(r[1], r[3], r[5]) for r in out if r[0] == 0} == {(h, d, p) for h, d, p in keys if d > 0}
    assert {(r[1], r[3], r[5]) for r in out if r[0] == 1} == {(0, 0, 0), (0, 0, 1)}
    assert [(r[1], r[3]) for r in out if r[0] == 2] == [(39, 0)]


def test_bitmaps_round_trip():
    import numpy as np
    for n in (1, 7, 8, 9, 64, 100):
        flags = np.arange(n) % 3 != 0
        import zlib
        packed = zlib.compress(np.packbits(flags.astype(np.uint8), bitorder="little").tobytes() + bytes([n % 8]))
        assert (line_dedup.kept_flags(packed, n + 5)[:n] == flags).all() and line_dedup.kept_flags(packed, n + 5)[n:].all()
    assert line_dedup.kept_flags(None, 3).all()


def test_drop_repeated_lines_keeps_columns_with_clashing_names(docs):
    odd = docs.withColumn("keep", F.lit(b"x")).withColumn("did", F.lit(1)).withColumn("own_text", F.lit("y"))
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[5] == "Hello \tworld, this is a line\nshort" and texts[3] is None and texts[2] == "other things here\n"
    assert texts[1] == "Hello  world, this is a line\nshort\nshared line of text"


def _exact_truth(data):
    import re
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in data]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out, kept = [], set()
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        first = i == keep and t not in kept
        if first:
            kept.add(t)
        out.append((i, keep, len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digests", [True, False])
def test_exact_groups(docs, empty_docs, digests):
    truth = _exact_truth([(r.doc_id, r.text) for r in docs.collect()])
    got = rows(exact_dedup.exact_groups(docs.withColumn("len", F.lit("clash")), digests=digests))
    assert got == (truth if digests else sorted((t[:4] for t in truth), key=repr))
    assert rows(exact_dedup.exact_groups(empty_docs, digests=digests)) == []


def test_exact_groups_tells_texts_of_one_length_and_prefix_apart(spark):
    data = [(k, "same start " * 20 + str(k % 3)) for k in range(30)] + [(99, "x" * 500), (98, "x" * 499 + "y")]
    got = rows(exact_dedup.exact_groups(spark.createDataFrame(data, "doc_id long, text string")))
    assert got == _exact_truth(data) and Counter(r[3] for r in got)[True] == 5


def _judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c for c in rest)
    for stop in "/?#":
        host = host.split(stop)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = host.encode().lower().decode()
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "http://NET/", "https://a.b.Example.NET/en/x?y#z", "https://example.net/en", "http://x.net",
            "http://notexample.com/de/1", "http://example.com/de/?a://b", "ftp://a.org/fr/", "http://a.org/FR/", "x://a.org?/fr/",
            "http://é.org/fr/ü", "http://example.com/en/one", "http://.net/", "http://a.net/://b.org/fr/", "http://example.com./de/"]
    rules = [*url_filter.RULES, ("example.com", "/e", "block"), ("example.com", "/en/one", "allow"), ("b.example.net", "", "block")]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(3, "http://", "x", "y")],
                                  "page_id long, url string, host string, rule string")
    table = spark.createDataFrame([*rules, rules[0], (None, "/", "block")], "host string, path string, verdict string")
    truth = sorted([(k, *_judge(u, rules)) for k, u in enumerate(urls)] + [(3, "", "", None, "allow")], key=repr)
    assert rows(url_filter.judge(pages, table)) == truth
    assert rows(url_filter.judge(pages.limit(0), table)) == []
    assert {r[3] for r in rows(url_filter.judge(pages, table.limit(0)))} == {None}
