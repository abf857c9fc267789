"""Role views: the matching data model over the driver's test tables.

* notice  <- orders    pk (notice_no, notice_ord); registration time o_orderdate
* company <- supplier |><| nation |><| region, pk bizno
* bid     <- lineitem  (notice_no, bizno) plus amounts
* pair    <- distinct (l_orderkey, l_suppkey) of lineitem
* vectors <- embeddings (pair p = vec_id 2p with vec_id 2p+1)

The driver tables have no NULLs, so the notice view blanks some values with a
fixed rule on the key (every row is kept) to exercise the null paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTICE_PK = ["notice_no", "notice_ord"]
COMPANY_PK = ["bizno"]

# Fixed configuration values of the matching model (same keys as the JSON
# configs the preprocessors read).
NOTICE_NUMERIC = {
    "o_totalprice": {"fill": "median", "log1p": True, "scale": "zscore", "add_flag": True, "clip": [0.5, 99.5]},
    "o_custkey": {"fill": "mode", "log1p": True, "scale": "minmax", "add_flag": True, "clip_abs": [0.0, 1000.0],
                  "clip_to_null": True},
}
NOTICE_CATEGORICAL = {
    "o_orderstatus": {"encoding_method": "label"},
    "o_orderpriority": {"encoding_method": "label"},
    "o_cust_bucket": {"encoding_method": "label", "rare_threshold": 0.0065},
}
COMPANY_NUMERIC = {
    "s_acctbal": {"fill": "median", "log1p": False, "scale": "none", "add_flag": True, "clip_abs": [0.0, 1000000.0]},
}
COMPANY_CATEGORICAL = {
    "n_name": {"encoding_method": "label"},
    "r_name": {"encoding_method": "label"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from tendermatch.sources.readers import read_table

    return read_table(spark, f"{sf_dir}/{name}.parquet")


def notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notice_from_orders(table(spark, sf_dir, "orders"))


def notice_from_orders(o: DataFrame) -> DataFrame:
    """The notice view of an orders frame (batch or stream: stateless)."""
    k = F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("notice_no"),
        F.lit("000").alias("notice_ord"),
        F.when(k % 11 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 13 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 17 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("o_orderpriority"),
        # a high-cardinality label with a long tail: customer key bucket
        F.concat(F.lit("C"), (F.col("o_custkey") % 150).cast("string")).alias("o_cust_bucket"),
        F.col("o_orderdate").alias("registered_at"),
    )


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    # nation / region are fixed 25 / 5 row dimension tables: broadcast is bounded.
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")
            .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
            .select(F.col("s_suppkey").cast("string").alias("bizno"), "s_name", "s_acctbal", "n_name", "r_name"))


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("notice_no"),
        F.lit("000").alias("notice_ord"),
        F.col("l_suppkey").cast("string").alias("bizno"),
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        F.col("l_extendedprice").alias("bid_amount"),
        F.col("l_discount").alias("bid_rate"),
        F.col("l_shipdate").alias("bid_date"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive (notice, company) pairs with a dense id ordered by the keys."""
    from tendermatch.operators.ranking import with_row_index

    li = table(spark, sf_dir, "lineitem")
    d = li.select("l_orderkey", "l_suppkey").distinct()
    d = with_row_index(d, ["l_orderkey", "l_suppkey"], name="id")
    return d.select("id", F.col("l_orderkey").cast("string").alias("notice_no"), F.lit("000").alias("notice_ord"),
                    F.col("l_suppkey").cast("string").alias("bizno"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, left_vec, right_vec) from consecutive embedding rows."""
    e = table(spark, sf_dir, "embeddings")
    left = e.where(F.col("vec_id") % 2 == 0).select((F.col("vec_id") / 2).cast("long").alias("pair_id"),
                                                     F.col("embedding").alias("left_vec"))
    right = e.where(F.col("vec_id") % 2 == 1).select(((F.col("vec_id") - 1) / 2).cast("long").alias("pair_id"),
                                                      F.col("embedding").alias("right_vec"))
    return left.join(right, "pair_id", "inner")
