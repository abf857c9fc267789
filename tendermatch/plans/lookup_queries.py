"""Lookup, join, listing and paging queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tendermatch.functions.numeric import round6
from tendermatch.operators import lookups as L
from tendermatch.plans import roles
from tendermatch.plans.registry import ORACLES, query
from tendermatch.plans.sqlparts import BID_CTE, COMPANY_CTE, NOTICE_CTE, PAIR_CTE, r6, with_
from tendermatch.sources.keyfilter import KeyLog
from tendermatch.sources.paging import build_page_index, read_page
from tendermatch.sources.sinks import scratch_path

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@query("pk_lookup", oracle=with_(NOTICE_CTE, BID_CTE) + f"""
SELECT notice_no, notice_ord, {r6('o_totalprice')} AS o_totalprice, o_orderpriority FROM notice n
WHERE EXISTS (SELECT 1 FROM bid b WHERE b.bid_rate >= 0.09 AND b.notice_no = n.notice_no
              AND b.notice_ord = n.notice_ord)""")
def pk_lookup_q(spark, sf_dir):
    keys = roles.bids(spark, sf_dir).where(F.col("bid_rate") >= 0.09).select(*roles.NOTICE_PK)
    out = L.rows_by_keys(roles.notice(spark, sf_dir), keys, roles.NOTICE_PK)
    return out.select(*roles.NOTICE_PK, round6("o_totalprice").alias("o_totalprice"), "o_orderpriority")


@query("pk_lookup_composite", oracle=with_(BID_CTE) + f"""
SELECT notice_no, notice_ord, bizno, l_linenumber, {r6('bid_amount')} AS bid_amount FROM bid b
WHERE EXISTS (SELECT 1 FROM bid k WHERE k.l_linenumber = 1 AND k.notice_no = b.notice_no
              AND k.notice_ord = b.notice_ord AND k.bizno = b.bizno)""")
def pk_lookup_composite_q(spark, sf_dir):
    bids = roles.bids(spark, sf_dir)
    pk = [*roles.NOTICE_PK, "bizno"]
    keys = bids.where(F.col("l_linenumber") == 1).select(*pk)
    out = L.rows_by_keys(bids, keys, pk)
    return out.select(*pk, "l_linenumber", round6("bid_amount").alias("bid_amount"))


@query("pk_numeric_cast", oracle=with_(NOTICE_CTE, BID_CTE) + """
SELECT notice_no, notice_ord, o_orderpriority FROM notice n
WHERE EXISTS (SELECT 1 FROM bid b WHERE b.bid_rate = 0 AND TRY_CAST(b.notice_no AS BIGINT) = TRY_CAST(n.notice_no AS BIGINT)
              AND TRY_CAST(n.notice_ord AS BIGINT) = 0)""")
def pk_numeric_cast_q(spark, sf_dir):
    # request keys spell the order number as '0'; the notice table stores '000'
    keys = (roles.bids(spark, sf_dir).where(F.col("bid_rate") == 0)
            .select("notice_no", F.lit("0").alias("notice_ord")))
    out = L.rows_by_keys_numeric(roles.notice(spark, sf_dir), keys, roles.NOTICE_PK, numeric=roles.NOTICE_PK)
    return out.select(*roles.NOTICE_PK, "o_orderpriority")


@query("use_columns_query", oracle=with_(NOTICE_CTE) + f"""
SELECT notice_no, notice_ord, {r6('o_totalprice')} AS o_totalprice, o_orderpriority FROM notice
WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC NULLS LAST, notice_no LIMIT 100""")
def use_columns_query_q(spark, sf_dir):
    use = ["notice_no", "notice_ord", "o_totalprice", "o_orderpriority"]
    out = L.filter_order_limit(roles.notice(spark, sf_dir), where="o_orderpriority = '1-URGENT'",
                               order_by=[F.col("o_totalprice").desc_nulls_last(), "notice_no"], limit=100,
                               columns=use)
    return out.select("notice_no", "notice_ord", round6("o_totalprice").alias("o_totalprice"), "o_orderpriority")


@query("bid_participants", oracle=with_(NOTICE_CTE, BID_CTE, COMPANY_CTE) + """
SELECT b.notice_no, b.notice_ord, b.bizno, c.s_name, c.n_name FROM bid b LEFT JOIN company c USING (bizno)
WHERE EXISTS (SELECT 1 FROM notice n WHERE n.o_orderpriority = '1-URGENT' AND n.notice_no = b.notice_no
              AND n.notice_ord = b.notice_ord)""")
def bid_participants_q(spark, sf_dir):
    keys = roles.notice(spark, sf_dir).where(F.col("o_orderpriority") == "1-URGENT")
    comp = roles.company(spark, sf_dir).select("bizno", "s_name", "n_name")
    return L.bid_participants(roles.bids(spark, sf_dir), comp, keys, roles.NOTICE_PK)


@query("company_bid_history", oracle=with_(NOTICE_CTE, BID_CTE, COMPANY_CTE) + f"""
, h AS (SELECT b.bizno, b.notice_no, b.notice_ord, b.l_linenumber, b.bid_amount,
               row_number() OVER (PARTITION BY b.bizno ORDER BY n.registered_at DESC NULLS FIRST, b.notice_no,
                                  b.notice_ord, b.l_linenumber, b.bid_amount) AS rank
        FROM bid b LEFT JOIN notice n USING (notice_no, notice_ord)
        WHERE b.bizno IN (SELECT bizno FROM company WHERE r_name = 'ASIA'))
SELECT bizno, notice_no, notice_ord, l_linenumber, {r6('bid_amount')} AS bid_amount, CAST(rank AS BIGINT) AS rank
FROM h WHERE rank <= 100""")
def company_bid_history_q(spark, sf_dir):
    wanted = roles.company(spark, sf_dir).where(F.col("r_name") == "ASIA")
    notices = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, "registered_at")
    out = L.bid_history(roles.bids(spark, sf_dir), notices, wanted, roles.NOTICE_PK, "registered_at", 100,
                        tiebreak=["l_linenumber", "bid_amount"])
    return out.select("bizno", *roles.NOTICE_PK, "l_linenumber", round6("bid_amount").alias("bid_amount"),
                      F.col("rank").cast("long").alias("rank"))


@query("recent_notices", oracle=with_(NOTICE_CTE) + f"""
SELECT notice_no, notice_ord, {r6('o_totalprice')} AS o_totalprice FROM notice
ORDER BY registered_at DESC NULLS FIRST, notice_no, notice_ord LIMIT 100""")
def recent_notices_q(spark, sf_dir):
    out = L.recent(roles.notice(spark, sf_dir), "registered_at", roles.NOTICE_PK, 100)
    return out.select(*roles.NOTICE_PK, round6("o_totalprice").alias("o_totalprice"))


@query("notice_bundle_companies", oracle=with_(NOTICE_CTE, BID_CTE, COMPANY_CTE) + """
SELECT 'company' AS part, bizno AS k1, s_name AS k2 FROM company c
WHERE bizno IN (SELECT b.bizno FROM bid b JOIN notice n USING (notice_no, notice_ord)
                WHERE n.o_orderpriority = '1-URGENT' AND n.o_orderstatus = 'F')
UNION ALL
SELECT 'notice', notice_no, notice_ord FROM notice WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
UNION ALL
SELECT 'bid', b.notice_no, b.bizno FROM bid b JOIN notice n USING (notice_no, notice_ord)
WHERE n.o_orderpriority = '1-URGENT' AND n.o_orderstatus = 'F'""")
def notice_bundle_companies_q(spark, sf_dir):
    notices = roles.notice(spark, sf_dir)
    keys = notices.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    bundle = L.notice_bundle(notices, roles.bids(spark, sf_dir), roles.company(spark, sf_dir), keys,
                             roles.NOTICE_PK)
    return (bundle["company"].select(F.lit("company").alias("part"), F.col("bizno").alias("k1"),
                                     F.col("s_name").alias("k2"))
            .unionByName(bundle["notice"].select(F.lit("notice").alias("part"), F.col("notice_no").alias("k1"),
                                                 F.col("notice_ord").alias("k2")))
            .unionByName(bundle["bid"].select(F.lit("bid").alias("part"), F.col("notice_no").alias("k1"),
                                              F.col("bizno").alias("k2"))))


@query("row_counts", oracle="\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for t in TABLES))
def row_counts_q(spark, sf_dir):
    parts = [roles.table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(t).alias("table_name"), "n_rows") for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("id_stats", oracle=with_(PAIR_CTE) + """
SELECT 'all' AS scope, CAST(count(*) AS BIGINT) AS total_count, min(id) AS min_id, max(id) AS max_id FROM pair
UNION ALL
SELECT 'first_1000', CAST(count(*) AS BIGINT), min(id), max(id) FROM (SELECT id FROM pair ORDER BY id LIMIT 1000)""")
def id_stats_q(spark, sf_dir):
    pairs = roles.pairs(spark, sf_dir)
    a = L.id_stats(pairs).select(F.lit("all").alias("scope"), "*")
    b = L.id_stats(pairs, limit=1000).select(F.lit("first_1000").alias("scope"), "*")
    return a.unionByName(b).select("scope", F.col("total_count").cast("long"), F.col("min_id").cast("long"),
                                   F.col("max_id").cast("long"))


@query("page_scan", oracle=with_(PAIR_CTE) + """
SELECT 'page' AS kind, id, notice_no, bizno FROM (SELECT * FROM pair ORDER BY id LIMIT 500 OFFSET 1000)
UNION ALL
SELECT 'nth', id, notice_no, bizno FROM (SELECT * FROM pair ORDER BY id LIMIT 1 OFFSET 2500)""")
def page_scan_q(spark, sf_dir):
    pairs = roles.pairs(spark, sf_dir).select("id", "notice_no", "bizno")
    pg = L.page(pairs, ["id"], 1000, 500).select(F.lit("page").alias("kind"), "*")
    nth = L.page(pairs, ["id"], 2500, 1).select(F.lit("nth").alias("kind"), "*")
    return pg.unionByName(nth).select("kind", F.col("id").cast("long"), "notice_no", "bizno")


@query("page_index", oracle=ORACLES["page_scan"])
def page_index_q(spark, sf_dir):
    """The same pages from a stored index, each of which opens the files that it covers."""
    base = scratch_path(spark, "page-index")
    build_page_index(roles.pairs(spark, sf_dir).select("id", "notice_no", "bizno"), base, ["id"], rows_per_file=1000)
    pg = read_page(spark, base, 1000, 500).select(F.lit("page").alias("kind"), "*")
    nth = read_page(spark, base, 2500, 1).select(F.lit("nth").alias("kind"), "*")
    return pg.unionByName(nth).select("kind", F.col("id").cast("long"), "notice_no", "bizno")


@query("append_key_filter", oracle=with_(PAIR_CTE) + """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(id) AS BIGINT) AS first, CAST(max(id) AS BIGINT) AS last FROM pair WHERE id % 7 = 0""")
def append_key_filter_q(spark, sf_dir):
    """All pairs are stored in two batches; an append of a seventh of them and as many new ones clashes in the
    former alone (the Bloom filters say which stored keys are read)."""
    pairs = roles.pairs(spark, sf_dir)
    log = KeyLog(spark, scratch_path(spark, "key-log"), ["notice_no", "bizno"])
    for batch in range(2):
        log.add(pairs.where(F.col("id") % 2 == batch), batch)
    old = pairs.where(F.col("id") % 7 == 0).select("id", "notice_no", "bizno")
    new = old.select(F.col("id"), F.concat(F.lit("new-"), "notice_no").alias("notice_no"), "bizno")
    found = log.clashes(old.unionByName(new))
    hits = found.join(pairs.select("id", "notice_no", "bizno"), ["notice_no", "bizno"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n"), F.min("id").cast("long").alias("first"), F.max("id").cast("long").alias("last"))


@query("select_except", oracle=with_(NOTICE_CTE) + f"""
SELECT notice_no, notice_ord, {r6('o_totalprice')} AS o_totalprice, o_custkey, o_orderstatus, o_orderpriority
FROM notice""")
def select_except_q(spark, sf_dir):
    out = L.select_except(roles.notice(spark, sf_dir), ["registered_at", "o_cust_bucket"])
    return out.withColumn("o_totalprice", round6("o_totalprice"))


@query("pk_and_text", oracle="""
SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def pk_and_text_q(spark, sf_dir):
    out = L.select_pk_and_text(roles.table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("id_range", oracle=with_(PAIR_CTE) + """
SELECT CAST(id AS BIGINT) AS id, notice_no, bizno FROM pair WHERE id BETWEEN 1000 AND 2999""")
def id_range_q(spark, sf_dir):
    out = L.id_range(roles.pairs(spark, sf_dir), "id", 1000, 2999)
    return out.select(F.col("id").cast("long"), "notice_no", "bizno")


@query("distinct_company_ids", oracle=with_(BID_CTE, COMPANY_CTE) + """
SELECT bizno FROM bid WHERE bizno IS NOT NULL UNION SELECT bizno FROM company WHERE bizno IS NOT NULL""")
def distinct_company_ids_q(spark, sf_dir):
    a = L.distinct_non_null(roles.bids(spark, sf_dir), "bizno")
    b = L.distinct_non_null(roles.company(spark, sf_dir), "bizno")
    return a.union(b).distinct()


@query("bag_union", oracle=with_(BID_CTE) + """
SELECT notice_no, CAST(count(*) AS BIGINT) AS n FROM
  (SELECT notice_no FROM bid WHERE bid_rate < 0.05 UNION ALL SELECT notice_no FROM bid WHERE bid_rate >= 0.05)
GROUP BY notice_no""")
def bag_union_q(spark, sf_dir):
    bids = roles.bids(spark, sf_dir)
    low = bids.where(F.col("bid_rate") < 0.05).select("notice_no")
    high = bids.where(F.col("bid_rate") >= 0.05).select("notice_no")
    return low.unionByName(high).groupBy("notice_no").agg(F.count(F.lit(1)).alias("n"))


@query("key_difference", oracle=with_(NOTICE_CTE, BID_CTE) + """
SELECT notice_no, notice_ord FROM notice EXCEPT SELECT notice_no, notice_ord FROM bid""")
def key_difference_q(spark, sf_dir):
    n = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK)
    b = roles.bids(spark, sf_dir).select(*roles.NOTICE_PK)
    return n.subtract(b)


@query("normalized_keys", oracle=with_(NOTICE_CTE) + """
SELECT coalesce(CAST(o_orderstatus AS VARCHAR), '') AS o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM notice
GROUP BY 1""")
def normalized_keys_q(spark, sf_dir):
    """key values to text with NULL -> '' (the blanked statuses collapse into one '' key)."""
    out = L.normalize_pk(roles.notice(spark, sf_dir).select("notice_no", "o_orderstatus"), ["o_orderstatus"])
    return out.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("pairs_loaded", oracle=with_(PAIR_CTE) + """
SELECT CAST(id AS BIGINT) AS id, notice_no, notice_ord, bizno FROM pair ORDER BY id LIMIT 1000""")
def pairs_loaded_q(spark, sf_dir):
    """The positive pairs' key columns, first 1000 by id (the limit always has an order)."""
    from tendermatch.operators.pairs import load_pairs
    out = load_pairs(roles.pairs(spark, sf_dir), ["notice_no", "notice_ord", "bizno"], limit=1000)
    return out.select(F.col("id").cast("long"), "notice_no", "notice_ord", "bizno")


@query("pairs_loaded_all", oracle=with_(PAIR_CTE) + """
SELECT CAST(id AS BIGINT) AS id, notice_no, notice_ord, bizno FROM pair""")
def pairs_loaded_all_q(spark, sf_dir):
    """The key columns of all positive pairs."""
    from tendermatch.operators.pairs import load_pairs
    out = load_pairs(roles.pairs(spark, sf_dir), ["notice_no", "notice_ord", "bizno"])
    return out.select(F.col("id").cast("long"), "notice_no", "notice_ord", "bizno")
