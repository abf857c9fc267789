"""Categorical fit / transform (P3, P4; A9, A10, A14, W1, J7, V8, S22).

Fit: all configured columns are unpivoted into ``(column, label)`` and counted
with one ``groupBy`` (map-side combined, so a label holding a third of the rows
is one partial count per task). Rare labels (relative frequency strictly
below ``rare_threshold``, denominator = all rows) collapse into ``[RARE]``;
missing values are the ``[NULL]`` label. The vocabulary (distinct labels, not
rows) is numbered in code point order by the distributed running index, and
``[UNKNOWN]`` is appended last.

Transform: one left join per column against that column's lookup table.
The bytes of the lookups are known from the fit, so the broadcast decision needs
no extra job. What exceeds the bound is a shuffle join of the cold labels: the
hot ones (at least ``HOT_SHARE`` of the rows, so a bounded number) are known from
the fit and broadcast, and their rows are dealt evenly instead of by label.
Unknown labels take the ``[UNKNOWN]`` index.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermatch.functions.numeric import null_flag
from tendermatch.operators.ranking import with_row_index
from tendermatch.session import materialize

# Fixed special tokens of the encoding.
NULL_TOKEN = "[NULL]"
RARE_TOKEN = "[RARE]"
UNKNOWN_TOKEN = "[UNKNOWN]"


@dataclass
class CategoricalModel:
    config: dict
    vocab: DataFrame            # (column, label, idx, kind, cnt): the vocabulary incl. [UNKNOWN]
    lookup: DataFrame           # (column, label, idx): raw training label -> index
    info: dict = field(default_factory=dict)   # column -> {vocab_size, unknown_idx, lookup_rows, ...}
    pk: list = field(default_factory=list)

    def spec(self) -> DataFrame:
        """Encoding spec per column (input_dim and special-token presence)."""
        return self.vocab.groupBy("column").agg(
            F.count(F.lit(1)).alias("input_dim"),
            F.max((F.col("label") == UNKNOWN_TOKEN).cast("int")).cast("boolean").alias("has_unknown_token"),
            F.max((F.col("label") == NULL_TOKEN).cast("int")).cast("boolean").alias("has_null_token"),
            F.max((F.col("label") == RARE_TOKEN).cast("int")).cast("boolean").alias("has_rare_token"),
        )


    def save(self, path: str) -> None:
        """The fitted state as tables, with the configuration beside them."""
        from tendermatch.sources.sinks import save_state
        save_state(self.vocab.sparkSession, path, {"vocab": self.vocab, "lookup": self.lookup},
                   {"config": self.config, "info": self.info, "pk": self.pk})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CategoricalModel":
        from tendermatch.sources.sinks import load_state
        tables, state = load_state(spark, path, ["vocab", "lookup"])
        return cls(state["config"], tables["vocab"], tables["lookup"], state["info"], state["pk"])


def label_expr(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN))


def label_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    long = df.select(*[label_expr(c).alias(c) for c in cols]).unpivot([], cols, "column", "label")
    return long.groupBy("column", "label").agg(F.count(F.lit(1)).alias("cnt"))


# Lookups are broadcast while all of them together stay below this many bytes
# (known from the fit: labels and a row's overhead); the others are shuffle joins.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024
ROW_BYTES = 96
HOT_SHARE = 1e-3         # of a column's rows; 1,000 labels at most have as many


def categorical_fit(df: DataFrame, config: dict, pk: list | None = None, rare_as_unknown: bool = False
                    ) -> CategoricalModel:
    cols = [c for c in df.columns if c in config and c not in (pk or [])]
    return categorical_fit_state(label_counts(df, cols), {c: config[c] for c in cols}, pk, rare_as_unknown)


def categorical_fit_state(counts: DataFrame, config: dict, pk: list | None = None, rare_as_unknown: bool = False) -> CategoricalModel:
    """P3 from label counts (``column, label, cnt``, see :func:`label_counts`): counts of chunks add up
    (``numeric.merge_counts``), so that a new chunk joins a fit without a look at the old rows. Every column of
    ``config`` is fitted; one without counts has the unknown label alone."""
    cols, spark = list(config), counts.sparkSession
    counts = materialize(counts.where(F.col("column").isin(cols)))
    thr = {c: float(config[c].get("rare_threshold", 0.0) or 0.0) for c in cols}
    thr_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(thr[c]))])

    # one small job: per column totals and label statistics
    tot = {r["column"]: int(r["total"]) for r in counts.groupBy("column").agg(F.sum("cnt").alias("total")).collect()}
    tot_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(tot.get(c, 0)).cast("long"))])
    freq = (counts.withColumn("freq", F.col("cnt") / tot_map[F.col("column")])
            .withColumn("is_rare", (thr_map[F.col("column")] > 0) & (F.col("freq") < thr_map[F.col("column")]))
            .withColumn("mapped", F.when(F.col("is_rare"), F.lit(RARE_TOKEN)).otherwise(F.col("label"))))
    stats = {r["column"]: r for r in freq.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.sum(F.col("is_rare").cast("long")).alias("n_rare"),
        F.sum(F.octet_length("label") + ROW_BYTES).alias("bytes"),
        F.max(((F.col("mapped") == UNKNOWN_TOKEN)).cast("int")).alias("has_unknown"),
        F.max(((F.col("mapped") == NULL_TOKEN)).cast("int")).alias("has_null"),
        F.max(((F.col("mapped") == RARE_TOKEN) & ~F.col("is_rare")).cast("int")).alias("raw_rare_label")).collect()}
    n_mapped = {}
    for c in cols:
        st = stats.get(c)
        if st is None:
            n_mapped[c] = 0
            continue
        n_rare = int(st["n_rare"])
        # rare labels collapse into one [RARE] label (unless a literal "[RARE]" label already exists)
        n_mapped[c] = int(st["n_raw"]) - n_rare + (1 if n_rare > 0 and not st["raw_rare_label"] else 0)

    # the vocabulary in code point order, numbered by the distributed index whatever its size
    labels = freq.groupBy("column", F.col("mapped").alias("label")).agg(F.sum("cnt").cast("long").alias("cnt"))
    indexed = with_row_index(labels, ["label"], group_by=["column"], name="idx")
    pairs_ = freq.join(indexed.select("column", F.col("label").alias("mapped"), "idx"), ["column", "mapped"])

    unk_rows = [(c, UNKNOWN_TOKEN, n_mapped[c], 0) for c in cols if not (c in stats and stats[c]["has_unknown"])]
    unk = spark.createDataFrame(unk_rows, "column string, label string, idx long, cnt long")
    kind = (F.when(F.col("label") == UNKNOWN_TOKEN, "unknown").when(F.col("label") == RARE_TOKEN, "rare")
            .when(F.col("label") == NULL_TOKEN, "null").otherwise("label"))
    vocab = indexed.select("column", "label", "idx", "cnt").unionByName(unk).withColumn("kind", kind)
    # raw label -> index; rare raw labels point at [RARE] unless reproducing the
    # original behaviour, where they fall through to [UNKNOWN].
    raw = pairs_.where(~F.col("is_rare")) if rare_as_unknown else pairs_
    lookup = raw.select("column", "label", "idx")
    if rare_as_unknown:
        lookup = lookup.unionByName(pairs_.where(F.col("is_rare")).select(
            "column", F.lit(RARE_TOKEN).alias("label"), "idx").distinct())
    info = {}
    for c in cols:
        has_unk = bool(c in stats and stats[c]["has_unknown"])
        info[c] = {"vocab_size": n_mapped[c] if has_unk else n_mapped[c] + 1,
                   "unknown_idx": None if has_unk else n_mapped[c],
                   "lookup_bytes": int(stats[c]["bytes"]) + 2 * ROW_BYTES if c in stats else 0,
                   "has_rare": bool(c in stats and int(stats[c]["n_rare"]) > 0),
                   "has_null": bool(c in stats and stats[c]["has_null"])}
    large = [c for c in cols if sum(v["lookup_bytes"] for v in info.values()) > MAX_BROADCAST_BYTES and info[c]["lookup_bytes"]]
    if large:
        for r in raw.where(F.col("column").isin(large) & (F.col("freq") >= HOT_SHARE)).select("column", "label", "idx").collect():
            info[r["column"]].setdefault("hot", []).append([r["label"], int(r["idx"])])
    if any(v["unknown_idx"] is None for v in info.values()):
        # a literal "[UNKNOWN]" label was seen: its sorted position is the unknown index
        for r in lookup.where(F.col("label") == UNKNOWN_TOKEN).collect():
            info[r["column"]]["unknown_idx"] = int(r["idx"])
    return CategoricalModel(config={c: config[c] for c in cols}, vocab=vocab, lookup=lookup, info=info,
                            pk=list(pk or []))


def encode_column(df: DataFrame, c: str, model: CategoricalModel, out: str | None = None, broadcast: bool | None = None) -> DataFrame:
    """Vocabulary lookup for one column -> long index (unknown -> [UNKNOWN]). Rows are kept one to one."""
    out = out or c
    info = model.info[c]
    lk = model.lookup.where(F.col("column") == c).select(F.col("label").alias(f"_lab_{c}"),
                                                         F.col("idx").alias(f"_idx_{c}"))
    key, unknown = f"_key_{c}", F.lit(info["unknown_idx"]).cast("long")
    keyed = df.withColumn(key, label_expr(c))
    if info["lookup_bytes"] <= MAX_BROADCAST_BYTES if broadcast is None else broadcast:
        joined = keyed.join(F.broadcast(lk), F.col(key) == F.col(f"_lab_{c}"), "left")
        return joined.withColumn(out, F.coalesce(F.col(f"_idx_{c}"), unknown)).drop(key, f"_lab_{c}", f"_idx_{c}")
    # rows of hot labels have their index before the shuffle; a running number spreads them over the join's tasks, where
    # they match nothing
    hot = df.sparkSession.createDataFrame(info.get("hot", []), f"`_hot_{c}` string, `_hidx_{c}` long")
    keyed = keyed.join(F.broadcast(hot), F.col(key) == F.col(f"_hot_{c}"), "left")
    keyed = keyed.withColumn(f"_deal_{c}", F.when(F.col(f"_hidx_{c}").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    # -1 in every row, but no constant: a constant would leave the join's keys
    cold = lk.withColumn(f"_at_{c}", F.least(F.col(f"_idx_{c}"), F.lit(-1).cast("long")))
    joined = keyed.join(cold, (F.col(key) == F.col(f"_lab_{c}")) & (F.col(f"_deal_{c}") == F.col(f"_at_{c}")), "left")
    return (joined.withColumn(out, F.coalesce(F.col(f"_hidx_{c}"), F.col(f"_idx_{c}"), unknown))
            .drop(key, f"_lab_{c}", f"_idx_{c}", f"_hot_{c}", f"_hidx_{c}", f"_deal_{c}", f"_at_{c}"))


def categorical_transform(df: DataFrame, model: CategoricalModel, pk: list | None = None) -> DataFrame:
    """PK, one index per column (input order), then ``*_is_null`` flags (always).

    One lookup join per column, on the rows themselves, so that keys may repeat
    or be null.
    """
    pk = list(pk if pk is not None else model.pk)
    cols = [c for c in df.columns if c in model.info and c not in pk]
    flagged = df.select(*pk, *cols, *[null_flag(c).alias(f"{c}_is_null") for c in cols])
    flagged = encode_all(flagged, cols, model)
    return flagged.select(*pk, *[F.col(f"_enc_{c}").alias(c) for c in cols], *[f"{c}_is_null" for c in cols])


def encode_all(df: DataFrame, cols: list[str], model: CategoricalModel) -> DataFrame:
    """Add ``_enc_<column>`` indices for ``cols``; the smallest lookups are broadcast up to the bytes allowed in all."""
    used = 0
    for c in sorted(cols, key=lambda c: model.info[c]["lookup_bytes"]):
        used += model.info[c]["lookup_bytes"]
        df = encode_column(df, c, model, out=f"_enc_{c}", broadcast=used <= MAX_BROADCAST_BYTES)
    return df
