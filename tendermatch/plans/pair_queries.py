"""Pair, split, batch and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermatch.functions.numeric import round6
from tendermatch.operators import pairs as P
from tendermatch.operators.contracts import pk_violations, table_contract
from tendermatch.operators.joins import key_coverage
from tendermatch.plans import roles
from tendermatch.plans.registry import query
from tendermatch.plans.sqlparts import BID_CTE, COMPANY_CTE, NOTICE_CTE, PAIR_CTE, r6, with_


@query("pairs_distinct_ids", oracle=with_(PAIR_CTE) + """
SELECT 'notice' AS side, notice_no AS k1, notice_ord AS k2 FROM (SELECT DISTINCT notice_no, notice_ord FROM pair)
UNION ALL
SELECT 'company', bizno, '' FROM (SELECT DISTINCT bizno FROM pair)""")
def pairs_distinct_ids_q(spark, sf_dir):
    pairs = roles.pairs(spark, sf_dir)
    n = P.pair_keys(pairs, roles.NOTICE_PK).select(F.lit("notice").alias("side"), F.col("notice_no").alias("k1"),
                                                   F.col("notice_ord").alias("k2"))
    c = P.pair_keys(pairs, roles.COMPANY_PK).select(F.lit("company").alias("side"), F.col("bizno").alias("k1"),
                                                    F.lit("").alias("k2"))
    return n.unionByName(c)


def _split_sql(n_test_expr: str, order: str) -> str:
    return with_(PAIR_CTE) + f"""
, r AS (SELECT id, row_number() OVER (ORDER BY {order}) - 1 AS rk FROM pair),
n AS (SELECT {n_test_expr} AS n_test FROM pair)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN rk < n_test THEN 'test' ELSE 'train' END AS split FROM r, n"""


@query("split_head_tail", oracle=_split_sql("CAST(floor(count(*) * 0.2) AS BIGINT)",
                                            "md5(CAST(id AS VARCHAR) || '|' || '42'), id"))
def split_head_tail_q(spark, sf_dir):
    out = P.split(roles.pairs(spark, sf_dir), 0.2, seed=42, mode="head")
    return out.select(F.col("id").cast("long"), "split")


@query("split_random", oracle=_split_sql("CAST(ceil(count(*) * 0.15) AS BIGINT)",
                                         "md5(CAST(id AS VARCHAR) || '|' || '7'), id"))
def split_random_q(spark, sf_dir):
    out = P.split(roles.pairs(spark, sf_dir), 0.15, seed=7, mode="random")
    return out.select(F.col("id").cast("long"), "split")


@query("split_id_range", oracle=_split_sql("CAST(floor(count(*) * 0.1) AS BIGINT)", "id"))
def split_id_range_q(spark, sf_dir):
    out = P.split(roles.pairs(spark, sf_dir), 0.1, mode="id_range")
    return out.select(F.col("id").cast("long"), "split")


@query("selective_features", oracle=with_(NOTICE_CTE, PAIR_CTE, COMPANY_CTE) + f"""
SELECT notice_no, notice_ord, {r6('o_totalprice')} AS o_totalprice FROM notice n
WHERE EXISTS (SELECT 1 FROM pair p JOIN company c USING (bizno)
              WHERE c.r_name = 'EUROPE' AND p.notice_no = n.notice_no AND p.notice_ord = n.notice_ord)""")
def selective_features_q(spark, sf_dir):
    europe = roles.company(spark, sf_dir).where(F.col("r_name") == "EUROPE").select("bizno")
    pairs = roles.pairs(spark, sf_dir).join(europe, "bizno", "left_semi")
    out = P.selective_features(roles.notice(spark, sf_dir), pairs, roles.NOTICE_PK)
    return out.select(*roles.NOTICE_PK, round6("o_totalprice").alias("o_totalprice"))


@query("pair_features", oracle=with_(NOTICE_CTE, PAIR_CTE, COMPANY_CTE) + f"""
SELECT CAST(p.id AS BIGINT) AS id, p.notice_no, p.bizno, {r6('n.o_totalprice')} AS o_totalprice,
       n.o_orderpriority, {r6('c.s_acctbal')} AS s_acctbal, c.n_name
FROM pair p JOIN notice n USING (notice_no, notice_ord) JOIN company c USING (bizno)""")
def pair_features_q(spark, sf_dir):
    notices = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, "o_totalprice", "o_orderpriority")
    comps = roles.company(spark, sf_dir).select("bizno", "s_acctbal", "n_name")
    out = P.pair_features(roles.pairs(spark, sf_dir), notices, comps, roles.NOTICE_PK, roles.COMPANY_PK)
    return out.select(F.col("id").cast("long"), "notice_no", "bizno", round6("o_totalprice").alias("o_totalprice"),
                      "o_orderpriority", round6("s_acctbal").alias("s_acctbal"), "n_name")


@query("key_coverage", oracle=with_(NOTICE_CTE, PAIR_CTE) + """
, req AS (SELECT DISTINCT notice_no, notice_ord FROM pair),
ret AS (SELECT DISTINCT notice_no, notice_ord FROM notice WHERE o_orderstatus IS NOT NULL)
SELECT 'missing' AS side, notice_no, notice_ord FROM req
WHERE NOT EXISTS (SELECT 1 FROM ret WHERE ret.notice_no = req.notice_no AND ret.notice_ord = req.notice_ord)
UNION ALL
SELECT 'extra', notice_no, notice_ord FROM ret
WHERE NOT EXISTS (SELECT 1 FROM req WHERE ret.notice_no = req.notice_no AND ret.notice_ord = req.notice_ord)""")
def key_coverage_q(spark, sf_dir):
    requested = roles.pairs(spark, sf_dir).select(*roles.NOTICE_PK)
    returned = roles.notice(spark, sf_dir).where(F.col("o_orderstatus").isNotNull())
    return key_coverage(requested, returned, roles.NOTICE_PK)


@query("pk_violations", oracle=with_(BID_CTE) + """
SELECT 'duplicate' AS rule, notice_no, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM bid
GROUP BY notice_no, l_linenumber HAVING count(*) > 1""")
def pk_violations_q(spark, sf_dir):
    bids = roles.bids(spark, sf_dir)
    return pk_violations(bids, ["notice_no", "l_linenumber"]).select("rule", "notice_no", "l_linenumber",
                                                                      F.col("n").cast("long"))


@query("schema_checks", oracle=with_(NOTICE_CTE, BID_CTE, COMPANY_CTE) + """
SELECT 'pk_duplicate_groups' AS rule, CAST(count(*) AS BIGINT) AS n FROM
  (SELECT notice_no, notice_ord, bizno, l_linenumber FROM bid GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'pk_null_rows', CAST(count(*) AS BIGINT) FROM bid
  WHERE notice_no IS NULL OR notice_ord IS NULL OR bizno IS NULL OR l_linenumber IS NULL
UNION ALL SELECT 'fk_unresolved:notice', CAST(count(*) AS BIGINT) FROM bid b
  WHERE NOT EXISTS (SELECT 1 FROM notice n WHERE n.notice_no = b.notice_no AND n.notice_ord = b.notice_ord)
UNION ALL SELECT 'fk_unresolved:company', CAST(count(*) AS BIGINT) FROM bid b
  WHERE NOT EXISTS (SELECT 1 FROM company c WHERE c.bizno = b.bizno)
UNION ALL SELECT 'pk_in_features', CAST(0 AS BIGINT)
UNION ALL SELECT 'duplicate_columns', CAST(0 AS BIGINT)""")
def schema_checks_q(spark, sf_dir):
    bids = roles.bids(spark, sf_dir)
    fks = {"notice": (roles.notice(spark, sf_dir), roles.NOTICE_PK, roles.NOTICE_PK),
           "company": (roles.company(spark, sf_dir), ["bizno"], ["bizno"])}
    return table_contract(bids, pk=[*roles.NOTICE_PK, "bizno", "l_linenumber"], features=["bid_amount", "bid_rate"],
                          foreign_keys=fks)


@query("pair_batches", oracle=with_(PAIR_CTE) + """
, r AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|' || '42'), id) - 1 AS rk FROM pair)
SELECT CAST(rk // 256 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n_pairs, CAST(min(id) AS BIGINT) AS min_id,
       CAST(max(id) AS BIGINT) AS max_id, CAST(sum(id) AS BIGINT) AS sum_id
FROM r GROUP BY rk // 256""")
def pair_batches_q(spark, sf_dir):
    b = P.with_batches(roles.pairs(spark, sf_dir), [P.shuffle_key("id", 42), F.col("id")], 256)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("id").cast("long").alias("min_id"),
                                     F.max("id").cast("long").alias("max_id"), F.sum("id").cast("long").alias("sum_id"))


@query("entity_row_index", oracle=with_(COMPANY_CTE) + """
SELECT bizno, CAST(row_number() OVER (ORDER BY bizno) - 1 AS BIGINT) AS row_idx FROM company""")
def entity_row_index_q(spark, sf_dir):
    from tendermatch.operators.ranking import with_row_index
    out = with_row_index(roles.company(spark, sf_dir).select("bizno"), ["bizno"], name="row_idx")
    return out.select("bizno", "row_idx")


@query("pair_subset_bundle", oracle=with_(PAIR_CTE) + """
, sub AS (SELECT * FROM pair ORDER BY id LIMIT 2000),
sp AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|' || '42'), id) - 1 AS rk FROM sub),
nt AS (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_test FROM sub),
s2 AS (SELECT id, CASE WHEN rk < n_test THEN 'test' ELSE 'train' END AS split FROM sp, nt),
b AS (SELECT id, split,
             row_number() OVER (PARTITION BY split ORDER BY md5(CAST(id AS VARCHAR) || '|' || '42'), id) - 1 AS bi
      FROM s2)
SELECT CAST(id AS BIGINT) AS id, split, CAST(bi // 64 AS BIGINT) AS batch_id, CAST(bi % 64 AS INTEGER) AS pos FROM b""")
def pair_subset_bundle_q(spark, sf_dir):
    notices = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, "o_totalprice")
    comps = roles.company(spark, sf_dir).select("bizno", "s_acctbal")
    out = P.pair_subset_bundle(roles.pairs(spark, sf_dir), notices, comps, roles.NOTICE_PK, roles.COMPANY_PK,
                               limit=2000, test_split=0.2, batch_size=64, seed=42)
    return out.select(F.col("id").cast("long"), "split", "batch_id", "pos")
