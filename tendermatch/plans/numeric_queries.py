"""Numeric preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermatch.functions.numeric import round6
from tendermatch.operators.numeric import (STAT_KEYS, merge_counts, numeric_fit, numeric_fit_state, numeric_fit_transform,
                                           numeric_state, numeric_transform)
from tendermatch.plans import roles
from tendermatch.plans.registry import ORACLES, query
from tendermatch.plans.sqlparts import COMPANY_CTE, NOTICE_CTE, f32, r6, with_
from tendermatch.sources.sinks import scratch_path

_TP = """tp_fill AS (SELECT median(o_totalprice) AS f FROM notice),
tp_filled AS (SELECT notice_no, coalesce(o_totalprice, (SELECT f FROM tp_fill)) AS v FROM notice),
tp_bounds AS (SELECT quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM tp_filled),
tp_clip AS (SELECT notice_no, least(greatest(v, lo), hi) AS v FROM tp_filled, tp_bounds),
tp_off AS (SELECT CASE WHEN min(v) <= 0 THEN abs(min(v)) + 1 ELSE 0 END AS off FROM tp_clip),
tp_log AS (SELECT notice_no, ln(1 + (v + off)) AS v FROM tp_clip, tp_off),
tp_mom AS (SELECT avg(v) AS mean, CASE WHEN stddev_samp(v) = 0 THEN 1 ELSE stddev_samp(v) END AS std FROM tp_log),
tp_out AS (SELECT notice_no, (v - mean) / std AS v FROM tp_log, tp_mom),
ck_fill AS (SELECT CAST(o_custkey AS DOUBLE) AS f FROM notice WHERE o_custkey IS NOT NULL
            GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey ASC LIMIT 1),
ck_filled AS (SELECT notice_no, coalesce(CAST(o_custkey AS DOUBLE), (SELECT f FROM ck_fill)) AS v FROM notice),
ck_fit AS (SELECT CASE WHEN v BETWEEN 0 AND 1000 THEN v END AS v FROM ck_filled),
ck_off AS (SELECT CASE WHEN min(v) <= 0 THEN abs(min(v)) + 1 ELSE 0 END AS off FROM ck_fit),
ck_mm0 AS (SELECT min(ln(1 + (v + off))) AS mn, max(ln(1 + (v + off))) AS mx FROM ck_fit, ck_off),
ck_mm AS (SELECT mn, CASE WHEN mn = mx THEN mn + 1 ELSE mx END AS mx FROM ck_mm0),
ck_out AS (SELECT notice_no,
                  (ln(1 + ((CASE WHEN v BETWEEN 0 AND 1000 THEN v ELSE (SELECT f FROM ck_fill) END) + off)) - mn)
                  / (mx - mn) AS v
           FROM ck_filled, ck_off, ck_mm)"""


@query("numeric_transform", oracle=with_(NOTICE_CTE, _TP) + f"""
SELECT n.notice_no, n.notice_ord, {f32('t.v')} AS o_totalprice, {f32('c.v')} AS o_custkey,
       CAST(o_totalprice IS NULL AS DOUBLE) AS o_totalprice_is_null,
       CAST(o_custkey IS NULL AS DOUBLE) AS o_custkey_is_null
FROM notice n JOIN tp_out t USING (notice_no) JOIN ck_out c USING (notice_no)""")
def numeric_transform_q(spark, sf_dir):
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, "o_totalprice", "o_custkey")
    model = numeric_fit(notice, roles.NOTICE_NUMERIC, roles.NOTICE_PK)
    out = numeric_transform(notice, model)
    return out.select(*roles.NOTICE_PK, *[round6(c).alias(c) for c in out.columns if c not in roles.NOTICE_PK])


@query("numeric_fit_stats", oracle=with_(NOTICE_CTE, _TP) + f"""
SELECT 'o_totalprice' AS "column", {r6('(SELECT f FROM tp_fill)')} AS fill_value,
       {r6('lo')} AS clip_low, {r6('hi')} AS clip_high, {r6('off')} AS log1p_offset,
       {r6('mean')} AS mean, {r6('std')} AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max
FROM tp_bounds, tp_off, tp_mom
UNION ALL
SELECT 'o_custkey', {r6('(SELECT f FROM ck_fill)')}, 0.0, 1000.0, {r6('off')}, NULL, NULL, {r6('mn')}, {r6('mx')}
FROM ck_off, ck_mm""")
def numeric_fit_stats_q(spark, sf_dir):
    notice = roles.notice(spark, sf_dir).select("o_totalprice", "o_custkey")
    model = numeric_fit(notice, roles.NOTICE_NUMERIC)
    st = model.to_df(spark)
    return st.select("column", *[round6(k).alias(k) for k in STAT_KEYS])


@query("numeric_fit_merged", oracle=ORACLES["numeric_fit_stats"])
def numeric_fit_merged_q(spark, sf_dir):
    """P1 / P6 chunk by chunk: the stored counts of three chunks added up give the fit of all rows."""
    notice = roles.notice(spark, sf_dir).select("notice_no", "o_totalprice", "o_custkey")
    base = scratch_path(spark, "fit-states")
    for k in range(3):
        chunk = notice.where(F.pmod(F.xxhash64("notice_no"), F.lit(3)) == k)
        numeric_state(chunk, roles.NOTICE_NUMERIC).write.parquet(f"{base}/{k}")
    state = merge_counts(*[spark.read.parquet(f"{base}/{k}") for k in range(3)])
    st = numeric_fit_state(state, roles.NOTICE_NUMERIC).to_df(spark)
    return st.select("column", *[round6(k).alias(k) for k in STAT_KEYS])


_ACCT_CFG = {"s_acctbal": {"fill": "median", "clip_abs": [0.0, 5000.0], "clip_to_null": True, "add_flag": True}}


@query("numeric_clip_to_null", oracle=with_(COMPANY_CTE) + f"""
, f AS (SELECT median(s_acctbal) AS f FROM company)
SELECT bizno,
       {f32("CASE WHEN coalesce(s_acctbal, f) BETWEEN 0 AND 5000 THEN coalesce(s_acctbal, f) ELSE f END")}
         AS s_acctbal,
       CAST(s_acctbal IS NULL AS DOUBLE) AS s_acctbal_is_null
FROM company, f""")
def numeric_clip_to_null_q(spark, sf_dir):
    comp = roles.company(spark, sf_dir).select("bizno", "s_acctbal")
    model = numeric_fit(comp, _ACCT_CFG, ["bizno"])
    out = numeric_transform(comp, model)
    return out.select("bizno", round6("s_acctbal").alias("s_acctbal"), round6("s_acctbal_is_null").alias("s_acctbal_is_null"))


_MINMAX_CFG = {"o_totalprice": {"fill": 0, "clip": [1, 99], "scale": "minmax", "add_flag": False}}


@query("numeric_minmax", oracle=with_(NOTICE_CTE) + f"""
, v AS (SELECT notice_no, coalesce(o_totalprice, 0) AS v FROM notice),
b AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v),
c AS (SELECT notice_no, least(greatest(v, lo), hi) AS v FROM v, b),
m AS (SELECT min(v) AS mn, CASE WHEN min(v) = max(v) THEN min(v) + 1 ELSE max(v) END AS mx FROM c)
SELECT notice_no, {f32('(v - mn) / (mx - mn)')} AS o_totalprice FROM c, m""")
def numeric_minmax_q(spark, sf_dir):
    notice = roles.notice(spark, sf_dir).select("notice_no", "o_totalprice")
    out, _ = numeric_fit_transform(notice, _MINMAX_CFG, ["notice_no"])
    return out.select("notice_no", round6("o_totalprice").alias("o_totalprice"))


@query("numeric_null_flags", oracle=with_(NOTICE_CTE) + """
SELECT 'o_totalprice' AS "column", CAST(count(*) - count(o_totalprice) AS BIGINT) AS n_null,
       CAST(count(*) AS BIGINT) AS n_rows FROM notice
UNION ALL
SELECT 'o_custkey', CAST(count(*) - count(o_custkey) AS BIGINT), CAST(count(*) AS BIGINT) FROM notice""")
def numeric_null_flags_q(spark, sf_dir):
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, "o_totalprice", "o_custkey")
    model = numeric_fit(notice, roles.NOTICE_NUMERIC, roles.NOTICE_PK)
    out = numeric_transform(notice, model)
    flags = out.agg(*[F.sum(f"{c}_is_null").cast("long").alias(c) for c in ("o_totalprice", "o_custkey")],
                    F.count(F.lit(1)).alias("n_rows"))
    return (flags.unpivot(["n_rows"], ["o_totalprice", "o_custkey"], "column", "n_null")
            .select("column", "n_null", "n_rows"))
