"""Merged features, feature store, jagged batches and scoring queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tendermatch.functions.numeric import round6
from tendermatch.operators import jagged as J
from tendermatch.operators.pairs import with_batches
from tendermatch.operators.scoring import Layer, TowerWeights, embed_categorical, project, tower_scores
from tendermatch.operators.store import build_store, store_summary
from tendermatch.plans import roles
from tendermatch.plans.categorical_queries import VOCAB_CTES
from tendermatch.plans.numeric_queries import _TP
from tendermatch.plans.pipeline import fit_once, preprocess
from tendermatch.plans.registry import ORACLES, query
from tendermatch.plans.sqlparts import BID_CTE, NOTICE_CTE, f32, r6, with_

NUM = list(roles.NOTICE_NUMERIC)
CAT = list(roles.NOTICE_CATEGORICAL)
DENSE = [*NUM, *[f"{c}_is_null" for c in NUM]]
BATCH = 256

_FEAT_CTE = """feat AS (
  SELECT n.notice_no, n.notice_ord,
         CAST(CAST(t.v AS FLOAT) AS DOUBLE) AS o_totalprice, CAST(CAST(c.v AS FLOAT) AS DOUBLE) AS o_custkey,
         CAST(n.o_totalprice IS NULL AS DOUBLE) AS o_totalprice_is_null,
         CAST(n.o_custkey IS NULL AS DOUBLE) AS o_custkey_is_null,
""" + ",\n".join(
    f"         (SELECT idx FROM lookup WHERE col = '{c}' AND raw = coalesce(CAST(n.{c} AS VARCHAR), '[NULL]')) AS {c}"
    for c in CAT) + ",\n" + ",\n".join(f"         CAST(n.{c} IS NULL AS DOUBLE) AS {c}_is_null" for c in CAT) + """
  FROM notice n JOIN tp_out t USING (notice_no) JOIN ck_out c USING (notice_no))"""

FEATURES_SQL = with_(NOTICE_CTE, _TP, VOCAB_CTES, _FEAT_CTE)
_BATCHED = f""", fb AS (SELECT *, row_number() OVER (ORDER BY notice_no, notice_ord) - 1 AS rk FROM feat),
fbb AS (SELECT *, rk // {BATCH} AS batch_id, rk % {BATCH} AS row, count(*) OVER (PARTITION BY rk // {BATCH}) AS nb
        FROM fb)"""


def features(spark, sf_dir):
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, *NUM, *CAT)
    fitted = fit_once(notice, roles.NOTICE_PK, roles.NOTICE_NUMERIC, roles.NOTICE_CATEGORICAL)
    return preprocess(notice, fitted), fitted


@query("features_merged", oracle=FEATURES_SQL + "SELECT notice_no, notice_ord, " + ", ".join(
    [f"{r6(c)} AS {c}" for c in DENSE] + [f"CAST({c} AS BIGINT) AS {c}" for c in CAT]
    + [f"{r6(c + '_is_null')} AS {c}_is_null" for c in CAT]) + " FROM feat")
def features_merged_q(spark, sf_dir):
    f, _ = features(spark, sf_dir)
    return f.select(*roles.NOTICE_PK, *[round6(c).alias(c) for c in DENSE], *[F.col(c).cast("long") for c in CAT],
                    *[round6(f"{c}_is_null").alias(f"{c}_is_null") for c in CAT])


@query("features_merged_by_key", oracle=ORACLES["features_merged"])
def features_merged_by_key_q(spark, sf_dir):
    """Numeric and categorical features made apart and merged one-to-one on the key."""
    from tendermatch.operators.categorical import categorical_fit, categorical_transform
    from tendermatch.operators.joins import merge_one_to_one
    from tendermatch.operators.numeric import numeric_fit_transform
    notice = roles.notice(spark, sf_dir)
    num, _ = numeric_fit_transform(notice.select(*roles.NOTICE_PK, *NUM), roles.NOTICE_NUMERIC, roles.NOTICE_PK)
    labels = notice.select(*roles.NOTICE_PK, *CAT)
    cat = categorical_transform(labels, categorical_fit(labels, roles.NOTICE_CATEGORICAL, roles.NOTICE_PK))
    f = merge_one_to_one(num, cat, roles.NOTICE_PK)
    return f.select(*roles.NOTICE_PK, *[round6(c).alias(c) for c in DENSE], *[F.col(c).cast("long") for c in CAT],
                    *[round6(f"{c}_is_null").alias(f"{c}_is_null") for c in CAT])


def _store(spark, sf_dir):
    f, _ = features(spark, sf_dir)
    return build_store(f, roles.NOTICE_PK, DENSE, CAT)


_STORE_ROWS = " UNION ALL ".join(
    [f"SELECT notice_no, 'numeric' AS kind, {i} AS pos, {r6(c)} AS value FROM feat" for i, c in enumerate(DENSE)]
    + [f"SELECT notice_no, 'categorical', {i}, CAST({c} AS DOUBLE) FROM feat" for i, c in enumerate(CAT)])


@query("feature_store", oracle=FEATURES_SQL + f"SELECT notice_no, kind, CAST(pos AS INTEGER) AS pos, value FROM ({_STORE_ROWS})")
def feature_store_q(spark, sf_dir):
    s = _store(spark, sf_dir)
    num = s.select("notice_no", F.lit("numeric").alias("kind"), F.posexplode("numeric").alias("pos", "value"))
    cat = s.select("notice_no", F.lit("categorical").alias("kind"), F.posexplode("categorical").alias("pos", "value"))
    return num.select("notice_no", "kind", F.col("pos").cast("int"), round6("value").alias("value")).unionByName(
        cat.select("notice_no", "kind", F.col("pos").cast("int"), F.col("value").cast("double").alias("value")))


@query("store_summary", oracle=FEATURES_SQL + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS pos, count({c}) AS n, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max, "
    f"{r6(f'avg({c})')} AS mean FROM feat" for i, c in enumerate(DENSE)))
def store_summary_q(spark, sf_dir):
    s = store_summary(_store(spark, sf_dir))
    return s.select(F.col("pos").cast("int"), F.col("n").cast("long"), *[round6(c).alias(c) for c in ("min", "max", "mean")])


# Fixed projection weights of the projected_store query (small integers so the
# oracle can spell the matmul as sums).
W1 = [[1, 0, -1], [0, 1, 1], [2, -1, 0], [-1, 2, 1]]
B1 = [0.5, -0.5, 0.0]
W2 = [[1, -1], [2, 0], [-1, 1]]
B2 = [0.0, 0.25]


def _proj_sql() -> str:
    h = [" + ".join(f"({W1[i][j]}) * {DENSE[i]}" for i in range(4)) + f" + {B1[j]}" for j in range(3)]
    hcols = ", ".join(f"greatest({e}, 0.0) AS h{j}" for j, e in enumerate(h))
    outs = [" + ".join(f"({W2[j][k]}) * h{j}" for j in range(3)) + f" + {B2[k]}" for k in range(2)]
    return (FEATURES_SQL + f", hid AS (SELECT notice_no, {hcols} FROM feat)\n"
            + " UNION ALL ".join(f"SELECT notice_no, CAST({k} AS INTEGER) AS pos, {f32(o)} AS value FROM hid"
                                 for k, o in enumerate(outs)))


@query("projected_store", oracle=_proj_sql())
def projected_store_q(spark, sf_dir):
    s = _store(spark, sf_dir)
    layers = [Layer(np.array(W1, float), np.array(B1), relu=True), Layer(np.array(W2, float), np.array(B2))]
    p = project(s, ["notice_no"], "numeric", layers, "projected")
    return p.select("notice_no", F.posexplode("projected").alias("pos", "value")).select(
        "notice_no", F.col("pos").cast("int"), round6("value").alias("value"))


# Towers of the scoring queries: weights by rule in small integers, so that the
# oracle can spell every layer as sums.
TOWER_EMB = 2


def _weight(rows: int, cols: int, shift: int) -> list[list[int]]:
    return [[(3 * i + 5 * j + shift) % 5 - 2 for j in range(cols)] for i in range(rows)]


def _tower_layers(dense: int, cats: int) -> tuple:
    """Dense projection, one hidden layer, final layer."""
    return (_weight(dense, 3, 1), _weight(3 + TOWER_EMB * cats, 4, 2), _weight(4, 3, 3))


def _tower(dense: int, sizes: list[int]) -> TowerWeights:
    d, h, o = (np.array(w, float) for w in _tower_layers(dense, len(sizes)))
    tables = [np.array([[((i * 31 + k * 7 + e * 3) % 11 - 5) / 5.0 for e in range(TOWER_EMB)] for i in range(v)]) for k, v in enumerate(sizes)]
    return TowerWeights(dense=Layer(d, np.full(3, 0.5)), embeddings=tables, mlp=[Layer(h, np.full(4, 0.25), relu=True)],
                        final=Layer(o, np.zeros(3)))


def _tower_sql(name: str, source: str, key: str, dense: list[str], cats: list[str]) -> str:
    """CTE ``name`` with ``key`` and the unit vector e0 to e2 (before the cast to float)."""
    d, h, o = _tower_layers(len(dense), len(cats))
    layer = lambda ins, w, b: [" + ".join(f"({w[i][j]}) * {x}" for i, x in enumerate(ins)) + f" + {b}" for j in range(len(w[0]))]
    emb = [f"(((({c} * 31 + {k} * 7 + {e} * 3) % 11) - 5) / 5.0)" for k, c in enumerate(cats) for e in range(TOWER_EMB)]
    as_ = lambda exprs, p: ", ".join(f"{x} AS {p}{i}" for i, x in enumerate(exprs))
    hidden = [f"greatest({x}, 0.0)" for x in layer([*[f"p{i}" for i in range(3)], *[f"c{i}" for i in range(len(emb))]], h, 0.25)]
    return f"""{name}_in AS (SELECT {key}, {as_(layer(dense, d, 0.5), 'p')}, {as_(emb, 'c')} FROM {source}),
{name}_hid AS (SELECT {key}, {as_(hidden, 'h')} FROM {name}_in),
{name}_out AS (SELECT {key}, {as_(layer([f"h{i}" for i in range(4)], o, 0.0), 'o')} FROM {name}_hid),
{name} AS (SELECT {key}, {as_([f"CAST(o{i} / greatest(sqrt(o0 * o0 + o1 * o1 + o2 * o2), 1e-12) AS FLOAT)" for i in range(3)], 'e')} FROM {name}_out)"""


_NOTICE_TOWER = FEATURES_SQL + ", " + _tower_sql("nt", "feat", "notice_no", DENSE, CAT)
_COMPANY_CTE = """company AS (SELECT CAST(s.s_suppkey AS VARCHAR) AS bizno, s.s_acctbal, n.n_name, r.r_name
            FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
cfeat AS (SELECT bizno, CAST(CAST(least(greatest(s_acctbal, 0.0), 1000000.0) AS FLOAT) AS DOUBLE) AS acct, 0.0 AS acct_null,
                 dense_rank() OVER (ORDER BY n_name) - 1 AS n_idx, dense_rank() OVER (ORDER BY r_name) - 1 AS r_idx FROM company)"""
_COMPANY_TOWER = _COMPANY_CTE + ", " + _tower_sql("ct", "cfeat", "bizno", ["acct", "acct_null"], ["n_idx", "r_idx"])


def _vector_sql(name: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, CAST({i} AS INTEGER) AS pos, round(CAST(e{i} AS DOUBLE), 6) + 0.0 AS value FROM {name}"
                              for i in range(3))


def _vector_rows(t, key):
    return t.select(key, F.posexplode("embedding").alias("pos", "value")).select(key, F.col("pos").cast("int"), round6("value").alias("value"))


def notice_embeddings(spark, sf_dir):
    f, fitted = features(spark, sf_dir)
    weights = _tower(len(DENSE), [fitted.categorical.info[c]["vocab_size"] for c in CAT])
    return tower_scores(build_store(f, roles.NOTICE_PK, DENSE, CAT), roles.NOTICE_PK, "numeric", "categorical", weights)


def company_embeddings(spark, sf_dir):
    store, fitted = _company_store(spark, sf_dir)
    weights = _tower(2, [fitted.categorical.info[c]["vocab_size"] for c in roles.COMPANY_CATEGORICAL])
    return tower_scores(store, ["bizno"], "numeric", "categorical", weights)


@query("tower_scores", oracle=_NOTICE_TOWER + _vector_sql("nt", "notice_no"))
def tower_scores_q(spark, sf_dir):
    """The notice tower."""
    return _vector_rows(notice_embeddings(spark, sf_dir), "notice_no")


@query("company_embeddings", oracle="WITH " + _COMPANY_TOWER + _vector_sql("ct", "bizno"))
def company_embeddings_q(spark, sf_dir):
    """B14, one side alone: the company tower."""
    return _vector_rows(company_embeddings(spark, sf_dir), "bizno")


EMB_DIM = 4


def _emb_value(idx: str, key: str, d: str) -> str:
    return f"((({idx} * 31 + {key} * 7 + {d} * 3) % 11) - 5) / 5.0"


@query("embed_categorical", oracle=FEATURES_SQL + " UNION ALL ".join(
    f"SELECT notice_no, CAST({k * EMB_DIM + d} AS INTEGER) AS pos, "
    f"CAST(CAST({_emb_value(c, str(k), str(d))} AS FLOAT) AS DOUBLE) + 0.0 AS value FROM feat"
    for k, c in enumerate(CAT) for d in range(EMB_DIM)))
def embed_categorical_q(spark, sf_dir):
    f, fitted = features(spark, sf_dir)
    s = build_store(f, roles.NOTICE_PK, DENSE, CAT)
    # rule-built tables: one row per (key, index) of the fitted vocabularies
    tables = None
    for k, c in enumerate(CAT):
        v = fitted.categorical.info[c]["vocab_size"]
        t = spark.range(v).select(F.lit(k).alias("key_pos"), F.col("id").alias("idx"),
                                  F.array(*[((((F.col("id") * 31 + k * 7 + d * 3) % 11) - 5) / 5.0).cast("float")
                                            for d in range(EMB_DIM)]).alias("vec"))
        tables = t if tables is None else tables.unionByName(t)
    e = embed_categorical(s, ["notice_no"], "categorical", tables, EMB_DIM, len(CAT))
    return e.select("notice_no", F.posexplode("cat_embedding").alias("pos", "value")).select(
        "notice_no", F.col("pos").cast("int"), (F.col("value").cast("double") + F.lit(0.0)).alias("value"))


def _batched_store(spark, sf_dir):
    return with_batches(_store(spark, sf_dir), [*roles.NOTICE_PK], BATCH)


_CAT_ROWS = " UNION ALL ".join(f"SELECT batch_id, row, nb, {k} AS k, CAST({c} AS BIGINT) AS v FROM fbb"
                               for k, c in enumerate(CAT))


@query("jagged_pack_row_major", oracle=FEATURES_SQL + _BATCHED + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(row * {len(CAT)} + k AS INTEGER) AS p, v AS value
FROM ({_CAT_ROWS})""")
def jagged_pack_row_major_q(spark, sf_dir):
    p = J.pack(_batched_store(spark, sf_dir), CAT, "categorical", "row_major")
    return p.select("batch_id", F.posexplode("jagged.values").alias("p", "value")).select(
        "batch_id", F.col("p").cast("int"), "value")


@query("jagged_pack_key_major", oracle=FEATURES_SQL + _BATCHED + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(k * nb + row AS INTEGER) AS p, v AS value FROM ({_CAT_ROWS})""")
def jagged_pack_key_major_q(spark, sf_dir):
    p = J.pack(_batched_store(spark, sf_dir), CAT, "categorical", "key_major")
    return p.select("batch_id", F.posexplode("jagged.values").alias("p", "value")).select(
        "batch_id", F.col("p").cast("int"), "value")


@query("jagged_unpack", oracle=FEATURES_SQL + _BATCHED + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(row AS INTEGER) AS row, CAST(k AS INTEGER) AS key_pos,
       CASE WHEN k = 2 THEN least(greatest(v, 0), 49) ELSE v END AS idx FROM ({_CAT_ROWS})""")
def jagged_unpack_q(spark, sf_dir):
    p = J.pack(_batched_store(spark, sf_dir), CAT, "categorical", "row_major")
    u = J.unpack(p, {"o_cust_bucket": 50})
    return u.select("batch_id", "row", F.col("key_pos").cast("int"), F.col("idx").cast("long"))


@query("jagged_multi", oracle=with_(NOTICE_CTE, BID_CTE) + f"""
, mv AS (SELECT notice_no, notice_ord, list(DISTINCT CAST(bizno AS BIGINT) ORDER BY CAST(bizno AS BIGINT)) AS bidders,
                list(l_linenumber ORDER BY l_linenumber) AS lines FROM bid GROUP BY notice_no, notice_ord),
nb AS (SELECT n.notice_no, n.notice_ord, mv.bidders, mv.lines,
              row_number() OVER (ORDER BY n.notice_no, n.notice_ord) - 1 AS rk FROM notice n LEFT JOIN mv USING (notice_no, notice_ord)),
b AS (SELECT *, rk // {BATCH} AS batch_id, rk % {BATCH} AS row, count(*) OVER (PARTITION BY rk // {BATCH}) AS nb FROM nb),
lens AS (SELECT batch_id, row, nb, 0 AS k, coalesce(len(bidders), 0) AS l, bidders AS vals FROM b
         UNION ALL SELECT batch_id, row, nb, 1, coalesce(len(lines), 0), lines FROM b),
offs AS (SELECT *, sum(l) OVER (PARTITION BY batch_id ORDER BY k, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off
         FROM lens)
SELECT CAST(batch_id AS BIGINT) AS batch_id, 'len' AS part, CAST(k * nb + row AS INTEGER) AS p, CAST(l AS BIGINT) AS value FROM lens
UNION ALL
SELECT CAST(batch_id AS BIGINT), 'val', CAST(coalesce(off, 0) + generate_subscripts(vals, 1) - 1 AS INTEGER),
       CAST(unnest(vals) AS BIGINT) FROM offs WHERE l > 0""")
def jagged_multi_q(spark, sf_dir):
    bids = roles.bids(spark, sf_dir)
    mv = bids.groupBy(*roles.NOTICE_PK).agg(
        F.array_sort(F.collect_set(F.col("bizno").cast("long"))).alias("bidders"),
        F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    notices = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK).join(mv, roles.NOTICE_PK, "left")
    b = with_batches(notices, roles.NOTICE_PK, BATCH)
    p = J.pack_multi(b, ["bidders", "lines"])
    lens = p.select("batch_id", F.lit("len").alias("part"), F.posexplode("jagged.lengths").alias("p", "value"))
    vals = p.select("batch_id", F.lit("val").alias("part"), F.posexplode("jagged.values").alias("p", "value"))
    return lens.unionByName(vals).select("batch_id", "part", F.col("p").cast("int"), F.col("value").cast("long"))


def _company_store(spark, sf_dir):
    comp = roles.company(spark, sf_dir).select("bizno", *roles.COMPANY_NUMERIC, *roles.COMPANY_CATEGORICAL)
    fitted = fit_once(comp, ["bizno"], roles.COMPANY_NUMERIC, roles.COMPANY_CATEGORICAL)
    cf = preprocess(comp, fitted)
    dense = [*roles.COMPANY_NUMERIC, *[f"{c}_is_null" for c in roles.COMPANY_NUMERIC]]
    return build_store(cf, ["bizno"], dense, list(roles.COMPANY_CATEGORICAL)), fitted


@query("training_batches", oracle=FEATURES_SQL + f""",
company AS (SELECT CAST(s.s_suppkey AS VARCHAR) AS bizno, s.s_acctbal, n.n_name, r.r_name
            FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
                            LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
cf AS (SELECT bizno, CAST(CAST(least(greatest(s_acctbal, 0.0), 1000000.0) AS FLOAT) AS DOUBLE) AS acct,
              dense_rank() OVER (ORDER BY n_name) - 1 AS n_idx, dense_rank() OVER (ORDER BY r_name) - 1 AS r_idx
       FROM company),
pair AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_suppkey) - 1 AS id,
                CAST(l_orderkey AS VARCHAR) AS notice_no, '000' AS notice_ord, CAST(l_suppkey AS VARCHAR) AS bizno
         FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)),
j AS (SELECT p.id, f.o_totalprice AS nd0, f.o_orderstatus + f.o_orderpriority + f.o_cust_bucket AS ncat,
             c.n_idx + c.r_idx AS ccat, c.acct
      FROM pair p JOIN feat f USING (notice_no, notice_ord) JOIN cf c USING (bizno)),
b AS (SELECT *, (row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|' || '42'), id) - 1) // {BATCH} AS batch_id
      FROM j)
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(count(*) AS INTEGER) AS batch_rows,
       CAST(count(*) * 3 AS INTEGER) AS n_notice_values, CAST(sum(ncat) AS BIGINT) AS sum_notice_values,
       CAST(sum(ccat) AS BIGINT) AS sum_company_values, round(sum(nd0), 4) + 0.0 AS sum_notice_dense0,
       round(sum(acct), 2) + 0.0 AS sum_company_dense0
FROM b GROUP BY batch_id""")
def training_batches_q(spark, sf_dir):
    return _batch_summary(_training_batches(spark, sf_dir, selective=False))


def _training_batches(spark, sf_dir, selective):
    from tendermatch.operators.pairs import training_batches
    return training_batches(roles.pairs(spark, sf_dir), _store(spark, sf_dir), _company_store(spark, sf_dir)[0], roles.NOTICE_PK,
                            roles.COMPANY_PK, CAT, list(roles.COMPANY_CATEGORICAL), BATCH, selective=selective)


def _batch_summary(coll):
    total = lambda a: F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda x, y: x + y)
    return coll.select(
        "batch_id", F.col("batch_rows").cast("int"), F.size("notice.kjt.values").cast("int").alias("n_notice_values"),
        total(F.col("notice.kjt.values")).cast("long").alias("sum_notice_values"),
        total(F.col("company.kjt.values")).cast("long").alias("sum_company_values"),
        (F.round(total(F.transform("notice.dense", lambda d: d[0])), 4) + 0.0).alias("sum_notice_dense0"),
        (F.round(total(F.transform("company.dense", lambda d: d[0])), 2) + 0.0).alias("sum_company_dense0"))


@query("training_batches_selective", oracle=ORACLES["training_batches"])
def training_batches_selective_q(spark, sf_dir):
    """B10 with the stores narrowed to the pairs' keys: the same batches."""
    return _batch_summary(_training_batches(spark, sf_dir, selective=True))


@query("store_slice", oracle=FEATURES_SQL + f""",
company AS (SELECT CAST(s.s_suppkey AS VARCHAR) AS bizno, r.r_name FROM supplier s
            LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
wanted AS (SELECT DISTINCT CAST(l.l_orderkey AS VARCHAR) AS notice_no, '000' AS notice_ord FROM lineitem l
           JOIN company c ON c.bizno = CAST(l.l_suppkey AS VARCHAR) WHERE c.r_name = 'ASIA'),
sl AS (SELECT f.* FROM feat f JOIN wanted USING (notice_no, notice_ord))
""" + " UNION ALL ".join(f"SELECT notice_no, CAST({i} AS INTEGER) AS pos, {r6(c)} AS value FROM sl"
                         for i, c in enumerate(DENSE)))
def store_slice_q(spark, sf_dir):
    from tendermatch.operators.store import slice_store
    asia = roles.company(spark, sf_dir).where(F.col("r_name") == "ASIA").select("bizno")
    ids = roles.pairs(spark, sf_dir).join(asia, "bizno", "left_semi").select(*roles.NOTICE_PK)
    sl = slice_store(_store(spark, sf_dir), ids, roles.NOTICE_PK)
    return sl.select("notice_no", F.posexplode("dense").alias("pos", "value")).select(
        "notice_no", F.col("pos").cast("int"), round6("value").alias("value"))


@query("conditional_store", oracle=FEATURES_SQL + f"""
SELECT notice_no, {r6('o_totalprice')} AS numeric0, CAST(o_orderpriority AS BIGINT) AS cat1 FROM feat
WHERE o_totalprice > 1.0""")
def conditional_store_q(spark, sf_dir):
    f, _ = features(spark, sf_dir)
    s = build_store(f, roles.NOTICE_PK, DENSE, CAT, where=F.col("o_totalprice") > 1.0)
    return s.select("notice_no", round6(F.col("numeric")[0]).alias("numeric0"),
                    F.col("categorical")[1].alias("cat1"))


@query("jagged_combine", oracle=FEATURES_SQL + _BATCHED + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(row * {len(CAT)} + k AS INTEGER) AS p, v AS value
FROM ({_CAT_ROWS})""")
def jagged_combine_q(spark, sf_dir):
    b = _batched_store(spark, sf_dir)
    samples = b.select("batch_id", "pos", F.struct(F.array(*[F.lit(c) for c in CAT]).alias("keys"),
                                                   F.col("categorical").alias("values"),
                                                   F.array_repeat(F.lit(1), len(CAT)).alias("lengths")).alias("jagged"))
    c = J.combine(samples, "batch_id", "pos")
    return c.select("batch_id", F.posexplode("jagged.values").alias("p", "value")).select(
        "batch_id", F.col("p").cast("int"), "value")


@query("pair_scores", oracle=_NOTICE_TOWER + ", " + _COMPANY_TOWER + """,
pair AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_suppkey) - 1 AS id, CAST(l_orderkey AS VARCHAR) AS notice_no,
                CAST(l_suppkey AS VARCHAR) AS bizno FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem))
SELECT CAST(id AS BIGINT) AS id, round(CAST(nt.e0 AS DOUBLE) * ct.e0 + CAST(nt.e1 AS DOUBLE) * ct.e1 + CAST(nt.e2 AS DOUBLE) * ct.e2, 6)
       + 0.0 AS score FROM pair JOIN nt USING (notice_no) JOIN ct USING (bizno)""")
def pair_scores_q(spark, sf_dir):
    """Both towers, pair score = dot product."""
    from tendermatch.operators.scoring import pair_scores
    s = pair_scores(roles.pairs(spark, sf_dir), notice_embeddings(spark, sf_dir), company_embeddings(spark, sf_dir),
                    roles.NOTICE_PK, roles.COMPANY_PK)
    return s.select(F.col("id").cast("long"), round6("score").alias("score"))


@query("company_topk", oracle=_NOTICE_TOWER + ", " + _COMPANY_TOWER + """,
sc AS (SELECT nt.notice_no, ct.bizno, round(CAST(nt.e0 AS DOUBLE) * ct.e0 + CAST(nt.e1 AS DOUBLE) * ct.e1 + CAST(nt.e2 AS DOUBLE) * ct.e2, 6)
              + 0.0 AS score FROM nt CROSS JOIN ct)
SELECT notice_no, CAST(count(*) AS BIGINT) AS n, min(score) AS worst, max(score) AS best FROM
(SELECT *, row_number() OVER (PARTITION BY notice_no ORDER BY score DESC) AS rk FROM sc) WHERE rk <= 5 GROUP BY notice_no""")
def company_topk_q(spark, sf_dir):
    """The five best companies of the whole corpus for every notice, by their tower embeddings; best and fifth score
    (companies of one place share an embedding, so that their order inside the five says nothing)."""
    from tendermatch.operators.retrieval import corpus_topk
    t = corpus_topk(notice_embeddings(spark, sf_dir), company_embeddings(spark, sf_dir), roles.NOTICE_PK, roles.COMPANY_PK, "embedding",
                    "embedding", 5)
    return t.groupBy("notice_no").agg(F.count("*").alias("n"), round6(F.min("score")).alias("worst"), round6(F.max("score")).alias("best"))
