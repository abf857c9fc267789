"""Categorical preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermatch.operators.categorical import CategoricalModel, categorical_fit, categorical_fit_state, categorical_transform, label_counts
from tendermatch.operators.numeric import merge_counts
from tendermatch.plans import roles
from tendermatch.plans.registry import ORACLES, query
from tendermatch.plans.sqlparts import NOTICE_CTE, with_

CAT_COLS = list(roles.NOTICE_CATEGORICAL)
_RARE = {c: cfg.get("rare_threshold", 0.0) for c, cfg in roles.NOTICE_CATEGORICAL.items()}

_LONG = " UNION ALL ".join(
    f"SELECT notice_no, '{c}' AS col, coalesce(CAST({c} AS VARCHAR), '[NULL]') AS label FROM notice" for c in CAT_COLS)
_THR = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({t} AS DOUBLE) AS thr" for c, t in _RARE.items())

VOCAB_CTES = f"""long AS ({_LONG}),
thr AS ({_THR}),
cnt AS (SELECT col, label, count(*) AS n FROM long GROUP BY col, label),
tot AS (SELECT col, sum(n) AS t FROM cnt GROUP BY col),
mapped AS (SELECT c.col, c.label AS raw,
                  CASE WHEN thr.thr > 0 AND c.n / tot.t < thr.thr THEN '[RARE]' ELSE c.label END AS label, c.n
           FROM cnt c JOIN tot USING (col) JOIN thr USING (col)),
voc AS (SELECT col, label, sum(n) AS n FROM mapped GROUP BY col, label),
idx AS (SELECT col, label, row_number() OVER (PARTITION BY col ORDER BY label) - 1 AS idx, n FROM voc),
unk AS (SELECT col, '[UNKNOWN]' AS label, count(*) AS idx, 0 AS n FROM voc GROUP BY col
        HAVING sum(CASE WHEN label = '[UNKNOWN]' THEN 1 ELSE 0 END) = 0),
vocab AS (SELECT * FROM idx UNION ALL SELECT * FROM unk),
lookup AS (SELECT m.col, m.raw, i.idx FROM mapped m JOIN idx i ON i.col = m.col AND i.label = m.label)"""


@query("categorical_vocab", oracle=with_(NOTICE_CTE, VOCAB_CTES) + """
SELECT col AS "column", label, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS cnt FROM vocab""")
def categorical_vocab_q(spark, sf_dir):
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, *CAT_COLS)
    model = categorical_fit(notice, roles.NOTICE_CATEGORICAL, roles.NOTICE_PK)
    return model.vocab.select("column", "label", "idx", "cnt")


@query("categorical_vocab_merged", oracle=ORACLES["categorical_vocab"])
def categorical_vocab_merged_q(spark, sf_dir):
    """P3 / P6 chunk by chunk: the label counts of three chunks added up give the vocabulary of all rows."""
    notice = roles.notice(spark, sf_dir).select("notice_no", *CAT_COLS)
    chunks = [label_counts(notice.where(F.pmod(F.xxhash64("notice_no"), F.lit(3)) == k), CAT_COLS) for k in range(3)]
    model = categorical_fit_state(merge_counts(*chunks), roles.NOTICE_CATEGORICAL, roles.NOTICE_PK)
    return model.vocab.select("column", "label", "idx", "cnt")


_ENC_SELECT = ",\n       ".join(
    [f"(SELECT idx FROM lookup WHERE col = '{c}' AND raw = coalesce(CAST(n.{c} AS VARCHAR), '[NULL]')) AS {c}"
     for c in CAT_COLS] + [f"CAST(n.{c} IS NULL AS DOUBLE) AS {c}_is_null" for c in CAT_COLS])


@query("categorical_encode", oracle=with_(NOTICE_CTE, VOCAB_CTES) + f"""
SELECT n.notice_no, n.notice_ord,
       {_ENC_SELECT}
FROM notice n""")
def categorical_encode_q(spark, sf_dir):
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, *CAT_COLS)
    model = categorical_fit(notice, roles.NOTICE_CATEGORICAL, roles.NOTICE_PK)
    out = categorical_transform(notice, model)
    return out.select(*roles.NOTICE_PK, *CAT_COLS, *[F.col(f"{c}_is_null").cast("double").alias(f"{c}_is_null")
                                                     for c in CAT_COLS])


@query("categorical_state_roundtrip", oracle=ORACLES["categorical_encode"])
def categorical_state_roundtrip_q(spark, sf_dir):
    """The fitted categorical state saved, loaded again, then applied."""
    from tendermatch.sources.sinks import scratch_path
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, *CAT_COLS)
    path = scratch_path(spark, "categorical-state")
    categorical_fit(notice, roles.NOTICE_CATEGORICAL, roles.NOTICE_PK).save(path)
    out = categorical_transform(notice, CategoricalModel.load(spark, path))
    return out.select(*roles.NOTICE_PK, *CAT_COLS, *[F.col(f"{c}_is_null").cast("double").alias(f"{c}_is_null")
                                                     for c in CAT_COLS])


@query("categorical_unknown", oracle=with_(NOTICE_CTE) + """,
seen AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx
         FROM (SELECT DISTINCT o_cust_bucket AS label FROM notice WHERE o_cust_bucket < 'C5'))
SELECT notice_no, notice_ord, CAST(coalesce(idx, (SELECT count(*) FROM seen)) AS BIGINT) AS o_cust_bucket
FROM notice LEFT JOIN seen ON o_cust_bucket = label""")
def categorical_unknown_q(spark, sf_dir):
    """V8: labels that the fit has not seen take the index of [UNKNOWN]."""
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, "o_cust_bucket")
    model = categorical_fit(notice.where(F.col("o_cust_bucket") < "C5"), {"o_cust_bucket": {}}, roles.NOTICE_PK)
    return categorical_transform(notice, model).select(*roles.NOTICE_PK, "o_cust_bucket")


@query("categorical_rare", oracle=with_(NOTICE_CTE, VOCAB_CTES) + """
SELECT col AS "column", CAST(count(*) AS BIGINT) AS n_labels,
       CAST(sum(CASE WHEN label = '[RARE]' THEN 1 ELSE 0 END) AS BIGINT) AS n_rare_labels,
       CAST(sum(CASE WHEN label = '[RARE]' THEN n ELSE 0 END) AS BIGINT) AS n_rare_rows
FROM mapped GROUP BY col""")
def categorical_rare_q(spark, sf_dir):
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, *CAT_COLS)
    model = categorical_fit(notice, roles.NOTICE_CATEGORICAL, roles.NOTICE_PK)
    lk = model.lookup.join(model.vocab.where("kind = 'rare'").select("column", F.col("idx").alias("rare_idx")),
                           "column", "left")
    from tendermatch.operators.categorical import label_counts
    counts = label_counts(notice, CAT_COLS)
    j = counts.join(lk, ["column", "label"])
    is_rare = F.coalesce(F.col("idx") == F.col("rare_idx"), F.lit(False))
    return j.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.sum(is_rare.cast("long")).alias("n_rare_labels"),
        F.sum(F.when(is_rare, F.col("cnt")).otherwise(0)).cast("long").alias("n_rare_rows"))


@query("encoding_spec", oracle=with_(NOTICE_CTE, VOCAB_CTES) + """
SELECT col AS "column", CAST(count(*) AS BIGINT) AS input_dim,
       bool_or(label = '[UNKNOWN]') AS has_unknown_token, bool_or(label = '[NULL]') AS has_null_token,
       bool_or(label = '[RARE]') AS has_rare_token
FROM vocab GROUP BY col""")
def encoding_spec_q(spark, sf_dir):
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, *CAT_COLS)
    model = categorical_fit(notice, roles.NOTICE_CATEGORICAL, roles.NOTICE_PK)
    return model.spec()
