"""Checked joins.

Joins here carry no size guess: Spark broadcasts a side whose size it knows to
be small and adaptive execution decides the rest from the sizes of finished
stages. A ``broadcast`` hint stands only where a structural bound holds (a
row per configured column, per range partition, per request).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_one_to_one(left: DataFrame, right: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Left join validated one-to-one (J4): keys must be unique on both sides.

    Only the key columns are read for the check (what else the sides compute is
    pruned from it). A null key is a key like any other.
    """
    for side, df in (("left", left), ("right", right)):
        if not df.select(*pk).groupBy(*pk).count().where("count > 1").isEmpty():
            raise ValueError(f"merge_one_to_one: duplicate keys on the {side} side")
    own = right.select(*[F.col(k).alias(f"_tm_r_{k}") for k in pk], *[c for c in right.columns if c not in pk])
    on = [F.col(k).eqNullSafe(F.col(f"_tm_r_{k}")) for k in pk]
    return left.join(own, on, "left").drop(*[f"_tm_r_{k}" for k in pk])


def key_coverage(requested: DataFrame, returned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested-but-missing and returned-but-unrequested keys.

    Two null-safe anti joins on the distinct keys: a null key equals a null
    key, as in a set difference of key tuples.
    """
    req = requested.select(*keys).distinct()
    ret = returned.select(*keys).distinct()

    def anti(left: DataFrame, right: DataFrame) -> DataFrame:
        # the right side is renamed so inputs of the same lineage cannot be confused
        r = right.select(*[F.col(k).alias(f"_tm_r_{k}") for k in keys])
        return left.join(r, [F.col(k).eqNullSafe(F.col(f"_tm_r_{k}")) for k in keys], "left_anti")

    missing = anti(req, ret).withColumn("side", F.lit("missing"))
    extra = anti(ret, req).withColumn("side", F.lit("extra"))
    return missing.unionByName(extra).select("side", *keys)
