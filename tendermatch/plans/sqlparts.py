"""Shared SQL fragments for the DuckDB oracles (role views as CTEs)."""

NOTICE_CTE = """notice AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS notice_no, '000' AS notice_ord,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS o_orderstatus,
         o_orderpriority,
         'C' || CAST(o_custkey % 150 AS VARCHAR) AS o_cust_bucket,
         o_orderdate AS registered_at
  FROM orders)"""

COMPANY_CTE = """company AS (
  SELECT CAST(s.s_suppkey AS VARCHAR) AS bizno, s.s_name, s.s_acctbal, n.n_name, r.r_name
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
                  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""

BID_CTE = """bid AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS notice_no, '000' AS notice_ord, CAST(l_suppkey AS VARCHAR) AS bizno,
         CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice AS bid_amount, l_discount AS bid_rate,
         l_shipdate AS bid_date
  FROM lineitem)"""

PAIR_CTE = """pair AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_suppkey) - 1 AS id,
         CAST(l_orderkey AS VARCHAR) AS notice_no, '000' AS notice_ord, CAST(l_suppkey AS VARCHAR) AS bizno
  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem))"""

VPAIR_CTE = """vpair AS (
  SELECT l.vec_id // 2 AS pair_id, l.embedding AS left_vec, r.embedding AS right_vec
  FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1
  WHERE l.vec_id % 2 = 0)"""


def r6(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def f32(expr: str) -> str:
    """float32 output rounded like the Spark side."""
    return f"(round(CAST(CAST({expr} AS FLOAT) AS DOUBLE), 6) + 0.0)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
