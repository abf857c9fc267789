"""Key and schema contracts.

Checks are aggregations (``groupBy(pk).count()`` with map-side combine and
anti joins), reported as violation tables; ``assert_*`` turn them into
errors before a write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pk_violations(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Duplicate key groups (rule 'duplicate') and NULL keys (rule 'null'), with counts."""
    any_null = F.lit(False)
    for k in pk:
        any_null = any_null | F.col(k).isNull()
    g = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
    return (g.where((F.col("n") > 1) | any_null)
            .withColumn("rule", F.when(any_null, "null").otherwise("duplicate"))
            .select("rule", *pk, "n"))


def assert_pk(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Fail (before normalising keys) when the key is not unique or not NOT NULL."""
    bad = pk_violations(df, pk).limit(1).collect()
    if bad:
        raise ValueError(f"primary key {list(pk)} violated: {bad[0].asDict()}")
    return df


def table_contract(df: DataFrame, pk: Sequence[str], features: Sequence[str],
                   foreign_keys: dict[str, tuple[DataFrame, Sequence[str], Sequence[str]]] | None = None
                   ) -> DataFrame:
    """M7: one violations table (rule, n).

    Driver-side structure rules (PK in features, duplicate columns) cost no
    job; data rules are one aggregation plus one anti join per foreign key.
    """
    spark = df.sparkSession
    rows = [("pk_in_features", len(set(pk) & set(features))),
            ("duplicate_columns", len(df.columns) - len(set(df.columns)))]
    static = spark.createDataFrame(rows, "rule string, n long")
    any_null = F.lit(False)
    for k in pk:
        any_null = any_null | F.col(k).isNull()
    dup = (df.groupBy(*pk).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
           .agg(F.count(F.lit(1)).alias("n")).select(F.lit("pk_duplicate_groups").alias("rule"), "n"))
    nul = df.where(any_null).agg(F.count(F.lit(1)).alias("n")).select(F.lit("pk_null_rows").alias("rule"), "n")
    out = static.unionByName(dup).unionByName(nul)
    for name, (target, fk_cols, target_cols) in (foreign_keys or {}).items():
        t = target.select(*[F.col(a).alias(b) for a, b in zip(target_cols, fk_cols)]).distinct()
        unresolved = (df.select(*fk_cols).join(t, list(fk_cols), "left_anti")
                      .agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"fk_unresolved:{name}").alias("rule"), "n"))
        out = out.unionByName(unresolved)
    return out.select("rule", F.col("n").cast("long"))
