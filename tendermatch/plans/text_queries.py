"""Text and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermatch.functions import vectors as V
from tendermatch.functions.numeric import round6
from tendermatch.functions.text import WHITESPACE, clean_text, hashed_embedding
from tendermatch.operators.text import refresh_vectors, text_transform, update_by_key
from tendermatch.plans import roles
from tendermatch.plans.registry import ORACLES, query
from tendermatch.sources import keyed
from tendermatch.sources.sinks import scratch_path, write_versioned

DIM = 8
WS = WHITESPACE
CLEAN_SQL = f"lower(trim(coalesce(text, ''), '{WS}'))"
TOKENS_CTE = f"""d AS (SELECT doc_id, {CLEAN_SQL} AS t FROM documents),
tk AS (SELECT doc_id, unnest(regexp_split_to_array(translate(t, '{WS}', '{" " * len(WS)}'), ' +')) AS tok FROM d),
th AS (SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) AS h FROM tk WHERE length(tok) > 0),
tv AS (SELECT doc_id, k, CAST((h >> (4 * (7 - k))) & 15 AS BIGINT) AS digit FROM th, range({DIM}) r(k)),
pool AS (SELECT d.doc_id, r.k AS pos,
                (CAST(coalesce(sum(digit), 0) AS DOUBLE) - count(digit) * CAST(7.5 AS DOUBLE)) / CAST(7.5 AS DOUBLE)
                / greatest(CAST(count(digit) AS DOUBLE), 1e-6) AS v
         FROM d CROSS JOIN range({DIM}) r(k) LEFT JOIN tv ON tv.doc_id = d.doc_id AND tv.k = r.k
         GROUP BY d.doc_id, r.k)"""


def _explode(df, id_col, vec):
    return V.explode_vector(df, [id_col], vec).select(id_col, F.col("pos").cast("int"), round6("value").alias("value"))


@query("text_clean", oracle=f"""
SELECT doc_id, md5({CLEAN_SQL}) AS text_md5, CAST(length({CLEAN_SQL}) AS BIGINT) AS n_chars FROM documents""")
def text_clean_q(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents")
    c = clean_text("text")
    return docs.select("doc_id", F.md5(c).alias("text_md5"), F.length(c).cast("long").alias("n_chars"))


@query("masked_mean_pool", oracle="""
WITH h AS (SELECT label, CAST(vec_id % 3 <> 0 AS INTEGER) AS m, generate_subscripts(embedding, 1) - 1 AS pos,
                  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(v * m) / greatest(sum(m), 1e-6), 6) + 0.0 AS value FROM h GROUP BY label, pos""")
def masked_mean_pool_q(spark, sf_dir):
    """Vectors as the hidden states of their label's sequence; every third one is masked."""
    e = roles.table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return _explode(V.mean_pool(e, "label", "embedding", "mask"), "label", "pooled")


@query("hashed_mean_pool", oracle=f"""WITH {TOKENS_CTE}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(v, 6) + 0.0 AS value FROM pool""")
def hashed_mean_pool_q(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents")
    pooled = hashed_embedding(docs.select("doc_id", clean_text("text").alias("text")), "text", DIM, out="v")
    return _explode(pooled, "doc_id", "v")


@query("text_embed", oracle=f"""WITH {TOKENS_CTE},
nrm AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM pool GROUP BY doc_id)
SELECT doc_id, CAST(pos AS INTEGER) AS pos,
       round(CAST(CAST(v / greatest(n, 1e-12) AS FLOAT) AS DOUBLE), 6) + 0.0 AS value
FROM pool JOIN nrm USING (doc_id)""")
def text_embed_q(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents")
    cfg = {"text": {"max_length": None, "lowercase": True, "strip": True, "fillna": "", "l2_normalize": True}}
    out = text_transform(docs.select("doc_id", "text"), ["doc_id"], cfg, dim=DIM)
    return _explode(out, "doc_id", "text")


_SCALED = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 5))"


@query("vector_normalize", oracle=f"""
WITH s AS (SELECT vec_id, {_SCALED} AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM s)
SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos,
       round(unnest(v) / greatest(n, 1e-12), 6) + 0.0 AS value FROM n""")
def vector_normalize_q(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.lit(1) + F.col("vec_id") % 5))
    return _explode(e.select("vec_id", V.l2_normalize(scaled).alias("v")), "vec_id", "v")


@query("vector_collapse", oracle="""
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
       round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value FROM embeddings""")
def vector_collapse_q(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    wide = V.expand_vector(e, "embedding", 64)
    back = V.collapse_vectors(wide)
    return _explode(back, "vec_id", "embedding")


@query("vector_fill_zero", oracle="""
SELECT vec_id, CAST(CASE WHEN label = 0 THEN 64 ELSE len(embedding) END AS INTEGER) AS size,
       round(CASE WHEN label = 0 THEN 0.0 ELSE list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) END, 6)
       + 0.0 AS l1 FROM embeddings""")
def vector_fill_zero_q(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings")
    holed = e.select("vec_id", F.when(F.col("label") != 0, F.col("embedding")).alias("v"))
    filled = holed.select("vec_id", V.zero_fill("v", 64).alias("v"))
    l1 = F.aggregate(F.transform("v", lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, b: a + b)
    return filled.select("vec_id", F.size("v").cast("int").alias("size"), round6(l1).alias("l1"))


@query("vector_update_by_key", oracle="""
SELECT vec_id, label = 3 AS updated,
       round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (CASE WHEN label = 3 THEN 2 ELSE 1 END))), 6)
       + 0.0 AS total FROM embeddings""")
def vector_update_by_key_q(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    upd = e.where(F.col("label") == 3).select("vec_id", F.transform("embedding", lambda x: x * 2).alias("embedding"))
    out = update_by_key(e, upd, ["vec_id"], "embedding")
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return out.select("vec_id", (F.col("label") == 3).alias("updated"), round6(total).alias("total"))


@query("vector_update_in_place", oracle=ORACLES["vector_update_by_key"])
def vector_update_in_place_q(spark, sf_dir):
    """S15 / J8 over a keyed table: one update is copied into the buckets it touches, two further ones stay deltas (the
    newer one holds) until they are compacted."""
    e = roles.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    base = scratch_path(spark, "keyed-vectors")
    keyed.create(e, base, ["vec_id"])
    of = lambda n, by: e.where(F.col("label") == n).select("vec_id", F.transform("embedding", lambda x: x * by).alias("embedding"))
    keyed.update(spark, base, of(2, 1), ["vec_id"], "embedding", number=1)
    keyed.append_delta(of(3, 5), base, ["vec_id"], "embedding", 1)
    keyed.append_delta(of(3, 2), base, ["vec_id"], "embedding", 2)
    keyed.compact(spark, base, ["vec_id"], "embedding")
    out = keyed.read_merged(spark, base, ["vec_id"], "embedding")
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return out.select("vec_id", (F.col("label") == 3).alias("updated"), round6(total).alias("total"))


@query("unit_norm_check", oracle="""
WITH s AS (SELECT vec_id, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]),
                                                       lambda x: (x * (1 + label * 0.00002)) * (x * (1 + label * 0.00002)))))
                  AS n FROM embeddings)
SELECT vec_id, round(n, 6) + 0.0 AS norm, abs(n - 1.0) <= 0.00011 AS is_unit FROM s""")
def unit_norm_check_q(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double") * (F.lit(1.0) + F.col("label") * 0.00002))
    return e.select("vec_id", round6(V.norm(v)).alias("norm"), V.unit_norm_check(v).alias("is_unit"))


@query("vector_format", oracle="""
WITH u AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
p AS (SELECT *, pow(10.0, CAST(5 - floor(log10(abs(x))) AS INTEGER)) AS p FROM u)
SELECT vec_id, pos, (CASE WHEN x = 0 THEN 0.0 ELSE floor(x * p + 0.5) / p END) + 0.0 AS value FROM p""")
def vector_format_q(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings")
    txt = e.select("vec_id", V.format_vector("embedding").alias("txt"))
    # 6 significant digits survive the text round trip exactly: no extra rounding
    parsed = txt.select("vec_id", F.posexplode(V.parse_vector("txt")).alias("pos", "value"))
    return parsed.select("vec_id", F.col("pos").cast("int"), (F.col("value") + F.lit(0.0)).alias("value"))


@query("text_vector_refresh", oracle=f"""WITH {TOKENS_CTE},
nrm AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM pool GROUP BY doc_id),
emb AS (SELECT doc_id, sum(CAST(CAST(v / greatest(n, 1e-12) AS FLOAT) AS DOUBLE)) AS total FROM pool JOIN nrm USING (doc_id)
        GROUP BY doc_id)
SELECT l.doc_id, l.quality = 1 AS refreshed, round(CASE WHEN l.quality = 1 THEN e.total END, 6) + 0.0 AS total
FROM labels l LEFT JOIN emb e USING (doc_id)""")
def text_vector_refresh_q(spark, sf_dir):
    # target: the labelled documents with an empty vector; refresh those of quality 1
    docs = roles.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = roles.table(spark, sf_dir, "labels")
    target = labels.select("doc_id", "quality", F.lit(None).cast("array<float>").alias("vec"))
    source = docs.join(labels.where(F.col("quality") == 1).select("doc_id"), "doc_id", "left_semi")
    new = refresh_vectors(target, source, ["doc_id"], "text", "vec", dim=DIM)
    out = spark.read.parquet(write_versioned(new, scratch_path(spark, "doc-vectors")))   # a new version folder
    total = F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return out.select("doc_id", (F.col("quality") == 1).alias("refreshed"), round6(total).alias("total"))


# Fixed configuration of the document entity (same keys as the preprocessors' JSON configs).
DOC_NUMERIC = {"n_chars": {"fill": "median", "clip": [1, 99], "log1p": True, "scale": "zscore", "add_flag": True}}
DOC_CATEGORICAL = {"lang": {"encoding_method": "label"}, "source": {"encoding_method": "label"}}
DOC_TEXT = {"text": {"max_length": None, "lowercase": True, "strip": True, "fillna": "", "l2_normalize": True}}


@query("document_features", oracle=f"""WITH {TOKENS_CTE},
nrm AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM pool GROUP BY doc_id),
emb AS (SELECT doc_id, sum(CAST(CAST(v / greatest(n, 1e-12) AS FLOAT) AS DOUBLE)) AS total FROM pool JOIN nrm USING (doc_id)
        GROUP BY doc_id),
nc_fill AS (SELECT median(n_chars) AS f FROM documents),
nc_filled AS (SELECT doc_id, coalesce(CAST(n_chars AS DOUBLE), f) AS v FROM documents, nc_fill),
nc_b AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM nc_filled),
nc_c AS (SELECT doc_id, least(greatest(v, lo), hi) AS v FROM nc_filled, nc_b),
nc_off AS (SELECT CASE WHEN min(v) <= 0 THEN abs(min(v)) + 1 ELSE 0 END AS off FROM nc_c),
nc_log AS (SELECT doc_id, ln(1 + (v + off)) AS v FROM nc_c, nc_off),
nc_m AS (SELECT avg(v) AS mean, CASE WHEN stddev_samp(v) = 0 THEN 1 ELSE stddev_samp(v) END AS std FROM nc_log),
nc_out AS (SELECT doc_id, (v - mean) / std AS v FROM nc_log, nc_m)
SELECT d.doc_id, round(CAST(CAST(o.v AS FLOAT) AS DOUBLE), 6) + 0.0 AS n_chars,
       CAST(d.n_chars IS NULL AS DOUBLE) AS n_chars_is_null,
       CAST(dense_rank() OVER (ORDER BY coalesce(d.lang, '[NULL]')) - 1 AS BIGINT) AS lang,
       CAST(dense_rank() OVER (ORDER BY coalesce(d.source, '[NULL]')) - 1 AS BIGINT) AS source,
       round(e.total, 6) + 0.0 AS text_total
FROM documents d JOIN nc_out o USING (doc_id) LEFT JOIN emb e USING (doc_id)""")
def document_features_q(spark, sf_dir):
    """P6 + P7 + J4 with text: numeric, categorical and text features of the documents, merged one-to-one."""
    from tendermatch.plans.pipeline import fit_once, preprocess
    docs = roles.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source", "text")
    fitted = fit_once(docs, ["doc_id"], DOC_NUMERIC, DOC_CATEGORICAL, DOC_TEXT)
    out = preprocess(docs, fitted)
    total = F.aggregate(F.transform("text", lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return out.select("doc_id", round6("n_chars").alias("n_chars"), round6("n_chars_is_null").alias("n_chars_is_null"),
                      "lang", "source", round6(total).alias("text_total"))


_DOC_STORE = f"""WITH {TOKENS_CTE},
nrm AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM pool GROUP BY doc_id),
emb AS (SELECT doc_id, pos, round(CAST(CAST(v / greatest(n, 1e-12) AS FLOAT) AS DOUBLE), 6) + 0.0 AS value FROM pool JOIN nrm USING (doc_id)),
num AS (SELECT doc_id, round(CAST(CAST(n_chars AS FLOAT) AS DOUBLE), 6) + 0.0 AS value FROM documents)
"""


def _doc_store(spark, sf_dir):
    from tendermatch.operators.store import build_store
    docs = roles.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(1).alias("one"), "text")
    vec = text_transform(docs.select("doc_id", "n_chars", "one", "text"), ["doc_id", "n_chars", "one"], DOC_TEXT, dim=DIM)
    return build_store(vec, ["doc_id"], ["n_chars"], ["one"], text=["text"], text_dim=DIM)


@query("document_store", oracle=_DOC_STORE + """
SELECT doc_id, CAST(0 AS INTEGER) AS pos, value FROM num
UNION ALL SELECT doc_id, CAST(pos + 1 AS INTEGER), value FROM emb""")
def document_store_q(spark, sf_dir):
    """B1 + B3 + V17: the store with a text vector; all rows, numeric and vector fused into one dense input."""
    from tendermatch.operators.store import slice_store
    return _explode(slice_store(_doc_store(spark, sf_dir), None, ["doc_id"], ["text"]), "doc_id", "dense")


@query("document_store_separate", oracle=_DOC_STORE + """,
wanted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT doc_id, 'dense' AS part, CAST(0 AS INTEGER) AS pos, value FROM num JOIN wanted USING (doc_id)
UNION ALL SELECT doc_id, 'text', CAST(pos AS INTEGER), value FROM emb JOIN wanted USING (doc_id)""")
def document_store_separate_q(spark, sf_dir):
    """B3 + B15: the rows of given ids, with dense input and text vector apart."""
    from tendermatch.operators.store import slice_store
    ids = roles.table(spark, sf_dir, "labels").where("quality = 0")
    s = slice_store(_doc_store(spark, sf_dir), ids, ["doc_id"], ["text"], fused=False)
    parts = [_explode(s, "doc_id", c).select("doc_id", F.lit(c).alias("part"), "pos", "value") for c in ("dense", "text")]
    return parts[0].unionByName(parts[1])
