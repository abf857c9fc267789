"""Inputs that are large or named awkwardly: they must neither stall nor crash an operator."""

import time

import pytest
from pyspark.sql import functions as F

from tendermatch.llm import html_extract, minhash_dedup, url_filter
from tests.llm.conftest import rows


def test_end_tags_without_a_partner_take_no_search():
    begin = time.process_time()
    page = "<article><p>" + "word " * 30 + "</p></article>" + "<div>" * 100_000 + "</section>" * 100_000
    assert html_extract.blocks(page)[0].text == " ".join(["word"] * 30)
    html_extract.blocks("<i class=ad>x<div>" + "<b class=ad>" * 30_000 + "</i>" * 100_000)
    assert time.process_time() - begin < 10


@pytest.mark.parametrize("page,texts", [
    ("<div>a<p>b</div>c</p>d", ["a", "b", "c", "d"]),
    ("<ul><li>a<div>b</li>c</div>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<table><tr><td>b</table>c</td><td>d</table>", ["a", "b", "c", "d"])])
def test_end_tags_stay_in_their_container(page, texts):
    assert [b.text for b in html_extract.blocks(page)] == texts


def test_long_hosts_and_urls(spark):
    rules = url_filter.rule_table(spark)
    deep = ".".join(["a"] * 100_000)
    long_path = "x" * 10_000_000
    urls = [(1, f"http://{deep}.example.com/de/x"), (2, f"http://{deep}.example.net/en/"), (3, f"http://{deep}.net/" + long_path),
            (4, f"http://{deep}/de/"), (5, "http://net/"), (6, "http://.net/"), (7, "http://net./"), (8, "http://org/fr/x"), (9, "http://" + "y" * 5_000_000)]
    own = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules)
           .select("page_id", "rule", "verdict").collect()}
    assert own == {1: ("example.com/de/", "block"), 2: ("example.net/en/", "allow"), 3: ("net/", "block"), 4: (None, "allow"), 5: ("net/", "block"),
                   6: ("net/", "block"), 7: (None, "allow"), 8: ("org/fr/", "allow"), 9: (None, "allow")}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame(urls[4:8], "page_id long, url string"), none).collect()} == {"allow"}


def test_near_duplicates_with_columns_named_like_ours(spark, docs):
    names = ["dropped", "_multiset", "did", "own", "class_id", "kept", "multiset", "comp"]
    plain = rows(minhash_dedup.drop_near_duplicates(docs))
    wide = docs
    for k, name in enumerate(names):
        wide = wide.withColumn(name, F.lit(k))
    kept = minhash_dedup.drop_near_duplicates(wide)
    assert kept.columns == [*docs.columns, *names]
    assert rows(kept.select(*docs.columns)) == plain
    assert kept.where("dropped <> 0 or _multiset <> 1 or own <> 3").count() == 0
