"""Operator 5: mixing sources to target weights by hierarchical budgeting.

Sources form a tree domain / language / source. Every level has integer
weights. A token budget flows down the tree: siblings share a node's budget by
weight, none gets more than its subtree can give (its tokens times the epochs
allowed), and what one cannot take goes to its siblings first. Only what all
siblings together cannot take is left to the level above, where the node's
capacity already says so. A leaf's budget is filled by whole epochs and a
prefix of the next one, whose order is seeded by epoch and document.

All of it is DataFrame code in integer arithmetic. Counts are aggregated per
leaf and per bucket of the order first, so that a source with a third of all
rows is never sorted in one task: only the bucket in which a leaf's budget
ends is looked at row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tendermatch.llm.common import SPACE_CLASS, pin

EPOCHS = 2                # a document is used at most so often
SEED = 17
SHARE = (3, 4)            # budget: this share of all tokens
BUCKET_ROWS = 512         # rows of a leaf per bucket of its order, on average
MAX_BROADCAST_LEAVES = 200_000
LEVELS = ("domain", "lang", "source")

#: Target weights of the registered query. Domains come from the source name; what is not listed has weight ``*``.
WEIGHTS = {"domain": {"bulk": 3, "curated": 5, "*": 2}, "lang": {"en": 4, "*": 2}, "source": {"*": 1}}
CURATED = ("src1", "src2", "src3", "src4", "src5")


def domain_of(source: Column) -> Column:
    """Domain of a source: its one very large crawl, a curated list, everything else."""
    return F.when(source == "src0", "bulk").when(source.isin(*CURATED), "curated").otherwise("other")


def tokens_of(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level, {})
    out = F.lit(known.get("*", 1))
    for name, value in known.items():
        if name != "*":
            out = F.when(F.col(level) == name, value).otherwise(out)
    return out.cast("bigint")


def _share(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``nodes`` with ``budget``: the parent's ``given`` split by ``weight``, no node over its ``cap``.

    In the order of cap / weight, a node takes its whole cap as long as its fair
    part of what is left exceeds it; the others share the rest by weight, where
    the parts of a token go to the first of them by name.
    """
    ratio = F.col("cap").cast("double") / F.col("weight")
    rank = Window.partitionBy(*parent).orderBy(ratio, name) if parent else Window.orderBy(ratio, name)
    upto = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = T.DecimalType(38, 0)
    laid = nodes.withColumns({"before": F.sum("cap").over(upto) - F.col("cap"), "others": F.sum("weight").over(after)})
    left = (F.col("given") - F.col("before"))
    full = left.cast(wide) * F.col("weight") >= F.col("cap").cast(wide) * F.col("others")
    laid = laid.withColumn("full", F.min(full.cast("int")).over(upto) == 1)
    group = Window.partitionBy(*parent, "full") if parent else Window.partitionBy("full")
    laid = laid.withColumns({"pool": F.max(left).over(group), "pool_weight": F.sum("weight").over(group)})
    laid = laid.withColumn("part", F.expr("cast(cast(pool as decimal(38, 0)) * weight div pool_weight as bigint)"))
    laid = laid.withColumn("spare", F.col("pool") - F.sum("part").over(group))
    nth = F.row_number().over(group.orderBy(name))
    return laid.withColumn("budget", F.when(F.col("full"), F.col("cap"))
                           .otherwise(F.least("cap", F.col("part") + (nth <= F.col("spare")).cast("int")))
                           ).drop("before", "others", "full", "pool", "pool_weight", "part", "spare")


def budgets(leaves: DataFrame, total: int, epochs: int, weights: dict[str, dict[str, int]],
            levels: Sequence[str] = LEVELS) -> DataFrame:
    """``levels..., budget`` added to every leaf. ``leaves``: levels and their ``tokens``; ``total``: tokens wanted."""
    tree = leaves.withColumn("cap", F.col("tokens") * epochs)
    given: DataFrame | None = None
    for depth, name in enumerate(levels):
        parent = list(levels[:depth])
        nodes = (tree.groupBy(*levels[:depth + 1]).agg(F.sum("cap").cast("bigint").alias("cap"))
                 .withColumn("weight", weight_of(name, weights)))
        nodes = nodes.withColumn("given", F.lit(total).cast("bigint")) if given is None else nodes.join(given, parent)
        given = _share(nodes, parent, name).select(*levels[:depth + 1], F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), list(levels))


def draw_key(epoch: Column, ident: Column, seed: int) -> Column:
    """Place of a document in an epoch: an MD5 of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit(""))))


def _bucket(key: Column, buckets: Column) -> Column:
    """Number of an equal slice of the key space; it rises with the key."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)).cast("bigint")


def cuts(light: DataFrame, leaves: DataFrame, seed: int, levels: Sequence[str] = LEVELS) -> DataFrame:
    """``levels..., full, cut``: whole epochs of each leaf, and the last key taken in the next one (null: none)."""
    plan = leaves.withColumn("full", F.when(F.col("tokens") > 0, F.expr("cast(budget div tokens as int)")).otherwise(0))
    plan = plan.withColumns({"rest": F.col("budget") - F.col("full") * F.col("tokens"),
                             "buckets": F.ceil(F.col("rows") / BUCKET_ROWS)})
    partial = plan.where("rest > 0").select(*levels, "full", "rest", "buckets")
    part = _with_leaves(light, partial, levels).withColumn("key", draw_key(F.col("full") + 1, F.col("ident"), seed))
    part = part.withColumn("bucket", _bucket(F.col("key"), F.col("buckets")))
    upto = Window.partitionBy(*levels).orderBy("bucket")
    sums = part.groupBy(*levels, "bucket", "rest").agg(F.sum("n_tokens").alias("own"))
    edge = pin(sums.withColumn("before", F.sum("own").over(upto) - F.col("own"))
               .where("before < rest and before + own >= rest").select(*levels, "bucket", "before"), "mix-edges")
    # a few hundred rows of each leaf
    rows = _with_leaves(part, edge, [*levels, "bucket"]).groupBy(*levels, "rest", "before", "key").agg(F.sum("n_tokens").alias("own"))
    order = Window.partitionBy(*levels).orderBy("key")
    last = (rows.withColumn("ahead", F.col("before") + F.sum("own").over(order) - F.col("own")).where("ahead < rest")
            .groupBy(*levels).agg(F.max("key").alias("cut")))
    return plan.select(*levels, "full").join(last, list(levels), "left")


def _with_leaves(rows: DataFrame, leaves: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join with a table of leaves: broadcast where their number is within the bound, else by a shuffle."""
    return rows.join(F.broadcast(leaves) if leaves.count() <= MAX_BROADCAST_LEAVES else leaves, list(on))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        weights: dict[str, dict[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS,
        seed: int = SEED) -> DataFrame:
    """Rows drawn: ``own`` (the row of ``docs`` as a struct), ``domain, lang, source, n_tokens, epoch``.

    A row comes once for each epoch in which its leaf's budget reaches it. In a
    leaf's last epoch documents are taken in seeded order as long as the tokens
    before them are below what is left of the budget, so a leaf exceeds its
    budget by less than one document. Null languages and sources count as
    empty names, null texts as empty; a document without tokens takes the
    place that its key gives it. Rows that share an id are drawn together. An
    empty table, or one without tokens, gives an empty one.
    """
    named = {"lang": F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")),
             "source": F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))}
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{id_col}`").alias("ident"),
                      F.col(f"`{text_col}`").alias("text"), *[v.alias(k) for k, v in named.items()])
    own = own.select("own", "ident", domain_of(F.col("source")).alias("domain"), "lang", "source",
                     tokens_of(F.col("text")).alias("n_tokens"))
    light = pin(own.drop("own"), "mix-light")
    leaves = light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = pin(leaves, "mix-leaves")
    tokens = leaves.agg(F.sum("tokens")).collect()[0][0] or 0
    total = min(tokens * epochs, tokens * share[0] // share[1])
    filled = pin(budgets(leaves, total, epochs, weights), "mix-budgets")
    drawn = pin(cuts(light, filled, seed).where("full > 0 or cut is not null"), "mix-cuts")

    next_epoch = F.col("full") + 1
    taken = F.col("cut").isNotNull() & (draw_key(next_epoch, F.col("ident"), seed) <= F.col("cut"))
    times = F.col("full") + F.coalesce(taken.cast("int"), F.lit(0))
    return (_with_leaves(own, drawn, LEVELS).withColumn("times", times).where("times > 0")
            .select("own", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(1), "times")).alias("epoch")))
