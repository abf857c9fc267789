"""Source / sink / export / profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendermatch.functions.numeric import round6
from tendermatch.operators import profile_sketch as PS
from tendermatch.operators.numeric import NumericModel, numeric_fit, numeric_transform
from tendermatch.operators.profile import column_profile, vocab_sizes
from tendermatch.plans import roles
from tendermatch.plans import store_queries as _store_queries  # noqa: F401  (registers oracles reused below)
from tendermatch.plans.numeric_queries import numeric_transform_q  # noqa: F401  (oracle reuse below)
from tendermatch.plans.registry import ORACLES, query
from tendermatch.plans.sqlparts import COMPANY_CTE, NOTICE_CTE, r6, with_
from tendermatch.sources import export as X
from tendermatch.sources import readers as R
from tendermatch.sources import sinks as S


def _events(spark, sf_dir):
    e = roles.table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(","), (F.col("event_id") % 7).cast("string"),
                 F.lit("]")).alias("int_list"),
        F.concat(F.lit("["), F.col("value").cast("string"), F.lit(",0.5]")).alias("float_list"),
        F.concat(F.lit('["'), F.col("event_type"), F.lit('",'), F.col("user_id").cast("string"),
                 F.lit("]")).alias("mixed_list"),
        F.when(F.col("event_id") % 5 == 0, F.lit("[]")).alias("empty_list"),
        F.lit("[1,2").alias("broken"))


def _long(spark, sf_dir):
    return X.typed_long(_events(spark, sf_dir).withColumn("rec_no", F.col("event_id")), exclude=("rec_no",))


def _records(spark, sf_dir):
    return X.typed_features(_events(spark, sf_dir).withColumn("rec_no", F.col("event_id")), exclude=("rec_no",))


_TYPED_ROWS = """
SELECT event_id AS rec_no, 'event_id' AS feature, 'int64' AS kind, 1 AS n_values, CAST(event_id AS DOUBLE) AS num FROM events
UNION ALL SELECT event_id, 'ts', 'bytes', 1, length(CAST(ts AS VARCHAR)) FROM events
UNION ALL SELECT event_id, 'user_id', 'int64', 1, user_id FROM events
UNION ALL SELECT event_id, 'event_type', 'bytes', 1, length(event_type) FROM events
UNION ALL SELECT event_id, 'value', 'float', 1, value FROM events
UNION ALL SELECT event_id, 'props', 'bytes', 1, length(props) FROM events
UNION ALL SELECT event_id, 'int_list', 'int64', 2, user_id + event_id % 7 FROM events
UNION ALL SELECT event_id, 'float_list', 'float', 2, value + 0.5 FROM events
UNION ALL SELECT event_id, 'mixed_list', 'bytes', 1, length('["' || event_type || '",' || CAST(user_id AS VARCHAR) || ']')
  FROM events
UNION ALL SELECT event_id, 'broken', 'bytes', 1, 4 FROM events"""


@query("typed_features", oracle=f"""
SELECT CAST(rec_no AS BIGINT) AS rec_no, feature, kind, CAST(n_values AS INTEGER) AS n_values, {r6('num')} AS num
FROM ({_TYPED_ROWS})""")
def typed_features_q(spark, sf_dir):
    """The export is written as gzip and read back."""
    path = S.scratch_path(spark, "typed")
    X.write_typed(_events(spark, sf_dir).withColumn("rec_no", F.col("event_id")), path, exclude=("rec_no",))
    ex = X.long_form(spark.read.parquet(path), ("rec_no",))
    total = lambda a: F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda x, y: x + y)
    num = F.coalesce(total(F.col("ints")), total(F.col("floats")), F.length(F.col("bytes")).cast("double"))
    # size() of a NULL array is -1 in Spark: pick by kind instead
    n = (F.when(F.col("kind") == "int64", F.size("ints")).when(F.col("kind") == "float", F.size("floats"))
         .otherwise(F.lit(1)))
    return ex.select(F.col("rec_no").cast("long"), "feature", "kind", n.cast("int").alias("n_values"),
                     round6(num).alias("num"))


@query("typed_schema", oracle=f"""
SELECT feature, min(kind) AS kind, CAST(count(*) AS BIGINT) AS n_records FROM ({_TYPED_ROWS}) GROUP BY feature""")
def typed_schema_q(spark, sf_dir):
    s = X.inspect_schema(_long(spark, sf_dir))
    return s.select("feature", "kind", F.col("n_records").cast("long"))


@query("typed_search", oracle="""
SELECT event_id AS rec_no, event_type FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 10""")
def typed_search_q(spark, sf_dir):
    hits = X.search(_records(spark, sf_dir), "event_type", "error", 10)
    return hits.select(F.col("rec_no").cast("long"), X.untyped(F.col("features")["event_type"]).alias("event_type"))


@query("snapshot_manifest", oracle="""
SELECT 'orders' AS table_name, CAST(count(*) AS BIGINT) AS total_rows, CAST(4000 AS BIGINT) AS chunk_size,
       TRUE AS files_within_chunk, TRUE AS all_gzip, TRUE AS files_differ FROM orders""")
def snapshot_manifest_q(spark, sf_dir):
    orders = roles.table(spark, sf_dir, "orders")
    path = S.scratch_path(spark, "orders-snapshot")
    S.snapshot(orders, path, chunk_size=4000, compression="gzip")
    files = S.read_manifest(spark, path)             # as written beside the files
    gzip = F.regexp_like("file", F.lit(r"\.gz\.parquet$")) & (F.col("compression") == "gzip")
    return files.agg(F.sum("rows").alias("total_rows"), F.max("chunk_size").alias("chunk_size"),
                     (F.max("rows") <= F.max("chunk_size")).alias("files_within_chunk"), F.bool_and(gzip).alias("all_gzip"),
                     (F.count_distinct("file") == F.count("file")).alias("files_differ")
                     ).select(F.lit("orders").alias("table_name"), "*")


@query("csv_roundtrip", oracle=f"""
SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, {r6('s_acctbal')} AS s_acctbal FROM supplier""")
def csv_roundtrip_q(spark, sf_dir):
    path = S.scratch_path(spark, "supplier-csv")
    S.write_csv(roles.table(spark, sf_dir, "supplier"), path)
    back = R.read_csv(spark, path, schema="s_suppkey long, s_name string, s_nationkey long, s_acctbal double")
    return back.select("s_suppkey", "s_name", "s_nationkey", round6("s_acctbal").alias("s_acctbal"))


@query("table_sink_roundtrip", oracle=with_(COMPANY_CTE) + f"""
SELECT bizno, s_name, n_name, r_name, {r6('s_acctbal')} AS s_acctbal, TRUE AS vec_missing FROM company""")
def table_sink_roundtrip_q(spark, sf_dir):
    comp = roles.company(spark, sf_dir)
    path = S.scratch_path(spark, "company-table")
    first = comp.where(F.col("r_name") < "EUROPE")
    rest = comp.where(~(F.col("r_name") < "EUROPE") | F.col("r_name").isNull())
    S.write_table(S.ensure_vector_column(first, "vec"), path, ["bizno"], if_exists="replace")
    S.write_table(S.ensure_vector_column(rest, "vec"), path, ["bizno"], if_exists="append")
    back = spark.read.parquet(path)
    assert back.columns[0] == "bizno" and back.columns[-1] == "vec"    # S12: key first, vectors last
    return back.select("bizno", "s_name", "n_name", "r_name", round6("s_acctbal").alias("s_acctbal"),
                       F.col("vec").isNull().alias("vec_missing"))


@query("table_append_conflicts", oracle=with_(COMPANY_CTE) + """
SELECT bizno FROM company WHERE r_name = 'EUROPE'""")
def table_append_conflicts_q(spark, sf_dir):
    """Of the suppliers to append, those that the stored table has."""
    comp = roles.company(spark, sf_dir)
    path = S.scratch_path(spark, "company-stored")
    S.write_table(comp.where(F.col("r_name") <= "EUROPE"), path, ["bizno"], if_exists="replace")
    return S.append_conflicts(comp.where(F.col("r_name") >= "EUROPE"), spark.read.parquet(path), ["bizno"])


@query("typed_inspect", oracle="""
SELECT event_id AS rec_no, 'event_type' AS feature, 'bytes' AS kind,
       CASE WHEN length(event_type) > 4 THEN substr(event_type, 1, 4) || '...' ELSE event_type END AS shown
FROM (SELECT * FROM events ORDER BY event_id LIMIT 7)
UNION ALL SELECT event_id, 'user_id', 'int64',
       CASE WHEN length(CAST(user_id AS VARCHAR)) > 4 THEN substr(CAST(user_id AS VARCHAR), 1, 4) || '...' ELSE CAST(user_id AS VARCHAR) END
FROM (SELECT * FROM events ORDER BY event_id LIMIT 7)""")
def typed_inspect_q(spark, sf_dir):
    """The first records with clipped values."""
    shown = X.inspect_records(_records(spark, sf_dir), 7, 4)
    return shown.where(F.col("feature").isin("event_type", "user_id")).withColumn("rec_no", F.col("rec_no").cast("long"))


_PROFILE_COLS = ["notice_no", "notice_ord", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority",
                 "o_cust_bucket", "registered_at"]
_ROLES = {"notice_no": "pk", "notice_ord": "pk", "o_totalprice": "numeric", "o_custkey": "numeric",
          "o_orderstatus": "categorical", "o_orderpriority": "categorical", "o_cust_bucket": "categorical",
          "registered_at": "dropped"}


@query("column_profile", oracle=with_(NOTICE_CTE) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, '{_ROLES[c]}' AS role FROM notice" for c in _PROFILE_COLS))
def column_profile_q(spark, sf_dir):
    p = column_profile(roles.notice(spark, sf_dir), roles.NOTICE_PK, categorical=list(roles.NOTICE_CATEGORICAL))
    return p.select("column", F.col("n_rows").cast("long"), F.col("n_null").cast("long"),
                    F.col("n_distinct").cast("long"), "role")


@query("vocab_sizes", oracle=with_(NOTICE_CTE) + """
SELECT 'o_orderstatus' AS "column", CAST(count(DISTINCT o_orderstatus) + 10 AS BIGINT) AS vocab_size FROM notice
UNION ALL SELECT 'o_orderpriority', CAST(count(DISTINCT o_orderpriority) + 10 AS BIGINT) FROM notice
UNION ALL SELECT 'o_cust_bucket', CAST(count(DISTINCT o_cust_bucket) + 10 AS BIGINT) FROM notice
UNION ALL SELECT 'unprofiled_code', CAST(1000 AS BIGINT)""")
def vocab_sizes_q(spark, sf_dir):
    p = column_profile(roles.notice(spark, sf_dir), roles.NOTICE_PK, categorical=list(roles.NOTICE_CATEGORICAL))
    return vocab_sizes(p, [*roles.NOTICE_CATEGORICAL, "unprofiled_code"])


@query("numeric_state_roundtrip", oracle=ORACLES["numeric_transform"])
def numeric_state_roundtrip_q(spark, sf_dir):
    """Fitted numeric state saved as a table + JSON, reloaded, then applied."""
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, "o_totalprice", "o_custkey")
    model = numeric_fit(notice, roles.NOTICE_NUMERIC, roles.NOTICE_PK)
    path = S.scratch_path(spark, "numeric-state")
    S.save_state(spark, path, {"stats": model.to_df(spark)}, {"model": model.to_json()})
    _, cfg = S.load_state(spark, path, ["stats"])
    loaded = NumericModel.from_json(cfg["model"])
    out = numeric_transform(notice, loaded)
    return out.select(*roles.NOTICE_PK, *[round6(c).alias(c) for c in out.columns if c not in roles.NOTICE_PK])


def _log_row(table, value):
    """One log row whose recorded number is an aggregate of a table."""
    return table.agg(value.cast("string").alias("val_loss"), F.count(F.lit(1)).cast("string").alias("train_batches"))


@query("run_log", oracle="""
SELECT '1' AS timestamp, CAST(count(*) AS VARCHAR) AS train_batches, CAST(max(o_orderkey) AS VARCHAR) AS val_loss, 'N/A' AS mrr FROM orders
UNION ALL SELECT '2', CAST(count(*) AS VARCHAR), CAST(max(s_suppkey) AS VARCHAR), 'N/A' FROM supplier""")
def run_log_q(spark, sf_dir):
    """Two rows appended to a stored log, one after the other; columns without a value read N/A."""
    path = S.scratch_path(spark, "run-log")
    for k, (name, col) in enumerate([("orders", "o_orderkey"), ("supplier", "s_suppkey")], 1):
        row = _log_row(roles.table(spark, sf_dir, name), F.max(col)).withColumn("timestamp", F.lit(str(k)))
        log = S.append_run_log(spark, path, S.run_log_row(spark, row))
    return log.select("timestamp", "train_batches", "val_loss", "mrr")


@query("run_log_append")
def run_log_append_q(spark, sf_dir):
    """The evaluation of the embedding pairs appended to a new experiment log."""
    from tendermatch.operators import metrics as M
    from tendermatch.plans.matching_queries import BATCH, SMOOTHING, _stats

    _, st = _stats(spark, sf_dir)
    ev = M.evaluate(st, SMOOTHING, (5, 10))
    values = ev.select(F.lit(BATCH).alias("batch_size"), round6("loss").alias("val_loss"),
                       round6("accuracy").alias("val_acc"), round6("recall_at_5").alias("recall_at_5"),
                       round6("recall_at_10").alias("recall_at_10"), round6("mrr").alias("mrr"),
                       round6("similarity_gap").alias("similarity_gap"), F.col("num_batches").alias("test_batches"))
    row = S.run_log_row(spark, values)
    return S.append_run_log(spark, S.scratch_path(spark, "run-log"), row)


@query("snapshot_many", oracle="""
SELECT 'orders' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, FALSE AS failed FROM orders
UNION ALL SELECT 'supplier', CAST(count(*) AS BIGINT), FALSE FROM supplier
UNION ALL SELECT 'nation', CAST(count(*) AS BIGINT), FALSE FROM nation
UNION ALL SELECT 'broken', NULL, TRUE""")
def snapshot_many_q(spark, sf_dir):
    """Snapshots as concurrent jobs; one of them fails on its first row, which its result says."""
    base = S.scratch_path(spark, "multi")
    jobs = {t: (roles.table(spark, sf_dir, t), f"{base}/{t}") for t in ("orders", "supplier", "nation")}
    bad = roles.table(spark, sf_dir, "region").select(F.raise_error(F.lit("unreadable")).cast("string").alias("x"))
    done = S.snapshot_many(spark, {**jobs, "broken": (bad, f"{base}/broken")}, max_workers=3, chunk_size=5000)
    return done.select(F.col("table").alias("table_name"), F.col("rows").alias("n_rows"), F.col("error").isNotNull().alias("failed"))


@query("run_pipeline", oracle=ORACLES["features_merged"])
def run_pipeline_q(spark, sf_dir):
    """Fit once, transform, write once; the written table read back."""
    from tendermatch.plans.pipeline import run_pipeline
    from tendermatch.plans.store_queries import CAT, DENSE, NUM
    notice = roles.notice(spark, sf_dir).select(*roles.NOTICE_PK, *NUM, *CAT)
    path = S.scratch_path(spark, "notice-preprocessed")
    run_pipeline(notice, roles.NOTICE_PK, roles.NOTICE_NUMERIC, roles.NOTICE_CATEGORICAL, None,
                 sink=lambda df, mode: S.write_table(df, path, roles.NOTICE_PK, if_exists="replace"))
    back = spark.read.parquet(path)
    return back.select(*roles.NOTICE_PK, *[round6(c).alias(c) for c in DENSE], *[F.col(c).cast("long") for c in CAT],
                       *[round6(f"{c}_is_null").alias(f"{c}_is_null") for c in CAT])


@query("snapshot_reload", oracle="""
SELECT 'orders' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM orders
UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem
UNION ALL SELECT 'all_files', (SELECT CAST(count(*) AS BIGINT) FROM orders) + (SELECT CAST(count(*) AS BIGINT) FROM lineitem)""")
def snapshot_reload_q(spark, sf_dir):
    """S10 + S19: two chunked snapshots (both tables grow), loaded back by name; records counted over a glob."""
    base = S.scratch_path(spark, "snapshots")
    S.snapshot(roles.table(spark, sf_dir, "orders"), f"{base}/orders.parquet", chunk_size=5000)
    S.snapshot(roles.table(spark, sf_dir, "lineitem"), f"{base}/lineitem", chunk_size=5000)
    parts = [R.load_snapshot(spark, base, t).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(t).alias("table_name"), "n_rows") for t in ("orders", "lineitem")]
    total = spark.createDataFrame([("all_files", R.count_records(spark, f"{base}/*/*.parquet"))],
                                  "table_name string, n_rows long")
    return parts[0].unionByName(parts[1]).unionByName(total)


@query("profile_merged", oracle="""
WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL
           SELECT 'o_orderpriority', o_orderpriority FROM orders),
d AS (SELECT "column", count(*) AS n_rows, count(*) - count(value) AS n_null, count(DISTINCT value) AS n_distinct FROM v GROUP BY "column")
SELECT "column", n_rows, n_null, n_distinct, value, count(*) AS at_least, count(*) AS at_most FROM v JOIN d USING ("column")
GROUP BY ALL""")
def profile_merged_q(spark, sf_dir):
    """M1 chunk by chunk: stored states of three chunks merged. The columns have few values, so that the frequent ones are
    all of them and their counts, like the sketched number of values, are exact."""
    orders = roles.table(spark, sf_dir, "orders")
    base = S.scratch_path(spark, "profiles")
    for k in range(3):
        PS.profile_state(orders.where(F.col("o_orderkey") % 3 == k), ["o_orderstatus", "o_orderpriority"]).write.parquet(f"{base}/chunk={k}")
    state = PS.merge_profiles(spark.read.parquet(base).drop("chunk"))
    return PS.profile_estimate(state).join(PS.frequent_values(state, 0.0), "column").select(
        "column", "n_rows", "n_null", "n_distinct", "value", "at_least", "at_most")
