"""Operator 9: exact deduplication by progressive refinement.

Rows are grouped by the length of their normalised text, the groups with more
than one row by a hash of a prefix, and only what is left by a SHA-256 of the
whole text. The first two steps work on a few bytes per row. Where the caller
wants no digest of the other rows, whole texts are hashed for surviving groups
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermatch.llm.common import SPACE_CLASS, pin

PREFIX_CHARS = 64
MAX_BROADCAST_GROUPS = 500_000      # 16 bytes each; more of them are joined by a shuffle


def normalised(text_col: str = "text") -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SPACE_CLASS + "+", " ")


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = True,
                 prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``<id_col>, keep_id, group_size, kept`` and, with ``digests``, the
    ``text_sha256`` of every row.

    One row per row of ``docs``. Texts are equal when their normalised forms
    are; a null text equals an empty one. The smallest id of a group stays
    (nulls come last); of repeated rows with that id one stays. Other columns
    are left out; an empty table gives an empty one.
    """
    own = (docs.select(F.col(f"`{id_col}`").alias("id"), normalised(text_col).alias("norm"))
           .withColumns({"len": F.length("norm"), "start": F.xxhash64(F.substring("norm", 1, prefix_chars))}))
    sha = F.sha2(F.col("norm"), 256)
    light = pin(own.select("id", "len", "start", *([sha.alias("sha")] if digests else [])), "exact-light")

    # there are no more lengths than characters in the longest text; broadcast, they leave the rows where they are, so
    # that a length of many rows meets no single task
    lengths = pin(_repeated(light, "len"), "exact-lengths")
    if lengths.count() <= MAX_BROADCAST_GROUPS:
        lengths = F.broadcast(lengths)
    starts = pin(_repeated(light.join(lengths, "len", "left_semi"), "len", "start"), "exact-starts")
    marked = starts.withColumn("again", F.lit(True))
    if starts.count() <= MAX_BROADCAST_GROUPS:
        marked = F.broadcast(marked)
    if digests:
        rows = light.join(marked, ["len", "start"], "left")
    else:
        rows = own.join(marked, ["len", "start"], "left").withColumn("sha", F.when(F.col("again"), sha))
    rows = pin(rows.select("id", "len", "start", "sha", F.coalesce("again", F.lit(False)).alias("again")), "exact-rows")

    # rows of one id and text are counted first: what follows has each id once
    key = ["len", "start", "sha"]
    counted = pin(rows.where("again").groupBy(*key, "id").agg(F.count("*").alias("rows")), "exact-counted")
    groups = pin(counted.groupBy(*key).agg(F.min("id").alias("keep_id"), F.sum("rows").alias("group_size"))
                 .where("group_size > 1"), "exact-groups")
    several = (counted.join(groups, key, "left")
               .select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                       F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha",
                       F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("nth")))
    single = rows.where("not again").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                            "sha", F.lit(1).cast("bigint").alias("nth"))
    out = several.unionByName(single).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        *([F.col("sha").alias("text_sha256")] if digests else []))
    return out
